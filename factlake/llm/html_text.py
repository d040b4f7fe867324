"""Main text of web pages, by a tree-structured graphical model over the DOM.

Every block element and every run of text between block boundaries is a node with one of three
states: OUT (holds content somewhere below), IN (content) and OFF (anything else). A node's own
evidence is a logistic model of its tag, its class and id words, and the length, link share and
punctuation of its text; parent and child are tied by a table of state transitions. Both are
learnt from labelled pages. Sum-product messages run once up and once down the tree, which is
exact on a tree; text whose marginal of IN is one half or more is the page's text.

The labelled pages are made by rule: layouts of many kinds, whose parts are known by construction
(`labelled_pages`), N_PAGES of them, a fixed bound that does not follow the input.

Defined results: a null, empty or textless page gives the empty text. Broken markup is read as far
as it goes: an unclosed comment or script runs to the end, an unclosed element to its parent's end.
A control or medium is left out where its own end tag closes it and nothing in it is more than a
control holds or a fallback says; else its tag is passed over, and its text is judged with the text
around it. So is the text of math, object and noscript.
Rows are judged one by one, so repeated and tied rows get equal texts. An empty table gives no rows.
"""

from __future__ import annotations

import html
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import columns, small_batches, stored, table

OUT, IN, OFF = range(3)
#: Labelled pages for training, and the seed of their making.
N_PAGES, SEED = 900, 11

# Element names of the HTML standard.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody "
    "td tfoot th thead tr ul".split()
)
#: Raw text by the standard: no markup in it, and no text of the page. A head is left out up to its end or the body.
RAW = frozenset("script style textarea title iframe noembed noframes xmp head".split())
#: Controls and media, and the blocks which may stand in them.
PARTS = dict.fromkeys(("button", "select"), "option optgroup") | dict.fromkeys("template svg canvas audio video".split(), "p div ul ol li br")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What must not stand in a part: it begins again, or a block which is not for it.
NOT_IN = {tag: re.compile(f"<(?:{'|'.join(sorted({tag, *BLOCKS} - set(own.split())))})(?=[\\s/>])", re.I) for tag, own in PARTS.items()}
#: Start tag to the open elements it closes, up to the nearest of the given parents.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("optgroup",)),
}

_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_MARK = re.compile("[>\"']")
_LONG_NUMBER = re.compile(r"&#(?=\d{9})0*(\d*)")
_NAMES = re.compile(r"(?<![\w-])(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?<![\w-])hidden(?![\w-])|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_SPACES = re.compile(r"\s+")


class Node:
    __slots__ = ("parent", "tag", "names", "text", "at", "length", "linked", "stops", "state")

    def __init__(self, parent: int, tag: str, at: int = 0, names: tuple[str, ...] = ()):
        self.parent, self.tag, self.at, self.names = parent, tag, at, names
        self.text, self.state, self.length, self.linked, self.stops = "", OFF, 0, 0, 0


def _names(attributes: str) -> tuple[str, ...]:
    found = {p.lower() for m in _NAMES.finditer(attributes) for p in _PARTS.findall(m[1] or m[2] or m[3] or "")}
    return tuple(sorted(found | ({"hidden"} if _HIDDEN.search(attributes) else set())))


class Tags:
    """The tags of a page, one after another, in time that follows its length.

    A tag ends at the first > outside quotes, or, where quotes do not close, at the first > of all.
    Where quotes opened at a place are known to lead nowhere, no later tag tries them again.
    """

    def __init__(self, page: str):
        self.page, self.last, self.failed = page, page.rfind(">"), set()
        self.last_of = {q: page.rfind(q) for q in "\"'"}

    def _end(self, at: int) -> int:
        """Where the tag whose attributes begin here has its >, which the page has."""
        tried, start = [], at
        while m := _MARK.search(self.page, at):
            at = m.start()
            if m[0] == ">":
                return at
            if at in self.failed or self.last_of[m[0]] <= at:
                tried.append(at)
                break
            tried.append(at)
            at = self.page.find(m[0], at + 1) + 1
        self.failed.update(tried)
        return self.page.find(">", start)

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """The first tag, comment or declaration from `at` on: where it starts and what follows it,
        "/" if it closes, its name ("" if it is no element) and its attributes."""
        page = self.page
        while (start := page.find("<", at)) >= 0:
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, end + 3 if end >= 0 else len(page), "", "", ""
            if page.startswith(("<!", "<?"), start):
                end = page.find(">", start)
                return start, end + 1 if end >= 0 else len(page), "", "", ""
            if start >= self.last:
                return None
            m = _TAG.match(page, start + 1)
            if m and m.end() <= self.last:
                end = self._end(m.end())
                return start, end + 1, m[1], m[2].lower(), page[m.end() : end]
            at = start + 1
        return None


def _decoded(text: str) -> str:
    # a number of any length is read: beyond eight digits it is no character in any case
    return html.unescape(_LONG_NUMBER.sub(lambda m: "&#" + (m[1][:8] or "0"), text))


def parse(page: str) -> list[Node]:
    """Nodes in page order, parents first: block elements, and runs of text ("#") as leaves. `at` is
    where in the page a node starts; length, linked and stops count what is below it."""
    nodes, open_blocks, run, anchors, linked = [Node(-1, "html")], [0], [], 0, 0
    begun, inline, ends, kept_in, no_end = -1, set(), {}, {}, set()
    places, seen = defaultdict(list), {"html"}  # of each tag, where its open elements are in open_blocks; tags that the page had

    def flush() -> None:
        nonlocal run, linked, inline, begun
        text = _SPACES.sub(" ", _decoded("".join(run))).strip()
        if text:
            leaf = Node(open_blocks[-1], "#", begun, tuple(sorted(inline)))
            leaf.text, leaf.length, leaf.linked = text, len(text), min(linked, len(text))
            leaf.stops = sum(text.count(c) for c in ".,;:!?。、")
            nodes.append(leaf)
        run, linked, inline, begun = [], 0, set(), -1

    def close(tag: str, within: tuple[str, ...] = ()) -> None:
        """Closes the innermost open element of this tag and all in it, unless one of `within` is in it."""
        if not places[tag]:
            return
        i = places[tag][-1]
        if any(places[w] and places[w][-1] > i for w in within):
            return
        for j in open_blocks[i:]:
            places[nodes[j].tag].pop()
        del open_blocks[i:]

    def ending(tag: str, at: int) -> tuple[int, int] | None:
        """Where the first end tag of this name is. It ends at the first > of all, so one search is enough."""
        m = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
        stop = page.find(">", m.end()) if m else -1
        return (m.start(), stop + 1) if stop >= 0 else None

    def stops_at(tag: str, at: int) -> int | None:
        found = ending(tag, at)
        body = re.compile(r"<body(?=[\s>])", re.I).search(page, at, found[0] if found else end) if tag == "head" else None
        return body.start() if body else found[1] if found else None

    at, end, tags = 0, len(page), Tags(page)
    while at < end:
        found = tags.next(at)
        piece = page[at : found[0] if found else end]
        if piece:
            run.append(piece)
            if begun < 0 and piece.strip():
                begun = at
            linked += len(piece.strip()) if anchors else 0
        if not found:
            break
        start, at, closing, tag, attributes = found
        if not tag:
            continue
        if closing:
            if tag == "a":
                anchors = 0
            elif tag in BLOCKS:
                flush()
                close(tag)
            continue
        if tag in RAW:
            if (not attributes.rstrip().endswith("/") or tag in ("script", "style", "title", "textarea")) and tag not in no_end:
                stop = stops_at(tag, at)
                if stop is not None:
                    at = stop
                elif tag == "head":
                    no_end.add(tag)
                else:
                    at = end
            continue
        if tag in PARTS and not attributes.rstrip().endswith("/"):
            if tag not in ends or ends[tag][0] < at:
                ends[tag] = ending(tag, at) or (end, 0)
                kept_in.pop(tag, None)
            first, after = ends[tag]
            if after:
                if kept_in.get(tag, -1) < at:  # what stood before this place is behind
                    kept = NOT_IN[tag].search(page, at, first)
                    kept_in[tag] = kept.start() if kept else end
                if kept_in[tag] >= first:
                    at = after
                    continue
        if tag == "a":
            anchors = 1
        elif tag == "br":
            run.append(" ")
        elif tag == "hr":
            flush()
        elif tag in BLOCKS:
            flush()
            if tag not in ("option", "optgroup"):
                close("option", ("select",))
            if tag in CLOSES:
                shut, within = CLOSES[tag]
                for name in shut:
                    close(name, within)
            elif tag not in ("html", "body"):
                close("p", ("td", "th", "button", "object"))
            if tag not in ("html", "body") or tag not in seen:
                seen.add(tag)
                places[tag].append(len(open_blocks))
                nodes.append(Node(open_blocks[-1], tag, start, _names(attributes)))
                open_blocks.append(len(nodes) - 1)
        elif tag not in VOID and attributes:
            inline.update(_names(attributes))
    flush()
    for n in reversed(nodes[1:]):
        up = nodes[n.parent]
        up.length, up.linked, up.stops = up.length + n.length, up.linked + n.linked, up.stops + n.stops
    return nodes


def evidence(nodes: list[Node]) -> list[tuple[str, ...]]:
    """The features of each node."""
    out, depth = [], []
    for n in nodes:
        depth.append(depth[n.parent] + 1 if n.parent >= 0 else 0)
        size = min(n.length.bit_length(), 12)
        share = round(4 * n.linked / n.length) if n.length else 5
        marks = min(3, 40 * n.stops // n.length) if n.length else 4
        kind = "#" + nodes[n.parent].tag if n.tag == "#" else n.tag
        own = [f"t {kind}", f"s {n.tag == '#'} {size}", f"l {n.tag == '#'} {share}", f"m {n.tag == '#'} {marks}", f"d {min(depth[-1], 6)}"]
        out.append((*own, f"u {kind} {bool(n.names)}", *(f"n {x}" for x in n.names)))
    return out


class Model:
    """Evidence weights by feature, and the two tables of the tree."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, prior: np.ndarray, tie: np.ndarray):
        self.index, self.weights, self.prior, self.tie = index, weights, prior, tie

    def own(self, features: list[tuple[str, ...]]) -> np.ndarray:
        """Scaled likelihoods: what the node's own features say, without how common states are."""
        index, none = self.index, len(self.index)  # unknown features have weight zero
        flat = np.array([index.get(f, none) for x in features for f in x])
        starts = np.cumsum([0, *(len(x) for x in features[:-1])])
        sums = np.add.reduceat(np.r_[self.weights, np.zeros((1, 3))][flat], starts)
        p = np.exp(sums - sums.max(axis=1, keepdims=True))
        p = p / p.sum(axis=1, keepdims=True) / self.prior
        return np.maximum(p / p.max(axis=1, keepdims=True), 1e-9)

    def marginals(self, nodes: list[Node], features: list[tuple[str, ...]]) -> list[float]:
        """P(IN) of each node: messages from the leaves up, then from the root down."""
        (aa, ab, ac), (ba, bb, bc), (ca, cb, cc) = self.tie.tolist()
        up = self.own(features).tolist()
        sent: list = [None] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):
            a, b, c = up[i]
            x = up[nodes[i].parent]
            sent[i] = p, q, r = aa * a + ab * b + ac * c, ba * a + bb * b + bc * c, ca * a + cb * b + cc * c
            p, q, r = x[0] * p + 1e-300, x[1] * q + 1e-300, x[2] * r + 1e-300
            top = max(p, q, r)
            x[0], x[1], x[2] = p / top, q / top, r / top
        belief = [(up[0][0], up[0][1] * 1e-6, up[0][2])]
        for i in range(1, len(nodes)):
            above, m, (a, b, c) = belief[nodes[i].parent], sent[i], up[i]
            p, q, r = above[0] / m[0], above[1] / m[1], above[2] / m[2]
            a, b, c = a * (p * aa + q * ba + r * ca), b * (p * ab + q * bb + r * cb), c * (p * ac + q * bc + r * cc)
            total = a + b + c
            belief.append((a / total, b / total, c / total))
        return [b[IN] for b in belief]


def fit(pages: list[list[Node]], rounds: int = 60, rate: float = 1.0) -> Model:
    """From nodes with known states: softmax regression on features, and counts of transitions."""
    features = [x for nodes in pages for x in evidence(nodes)]
    state = np.array([n.state for nodes in pages for n in nodes])
    index = {f: i for i, f in enumerate(sorted({f for x in features for f in x}))}
    row = np.repeat(np.arange(len(features)), [len(x) for x in features])
    col = np.array([index[f] for x in features for f in x])
    wanted = np.eye(3)[state]
    weights, speed = np.zeros((len(index), 3)), np.full((len(index), 3), 1e-6)
    for _ in range(rounds):
        sums = np.stack([np.bincount(row, weights[col, s], len(features)) for s in range(3)], axis=1)
        p = np.exp(sums - sums.max(axis=1, keepdims=True))
        error = wanted - p / p.sum(axis=1, keepdims=True)
        step = np.stack([np.bincount(col, error[row, s], len(index)) for s in range(3)], axis=1) - 0.3 * weights
        speed += step**2
        weights = weights + rate * step / np.sqrt(speed)
    tie = np.full((3, 3), 0.5)
    for nodes in pages:
        for n in nodes[1:]:
            tie[nodes[n.parent].state, n.state] += 1
    return Model(index, weights, np.bincount(state, minlength=3) / len(state) + 1e-6, tie / tie.sum(axis=1, keepdims=True))


def main_text(page: str | None, model: Model) -> str:
    nodes = parse(page or "")
    inside = model.marginals(nodes, evidence(nodes))
    return "\n".join(n.text for n, p in zip(nodes, inside, strict=True) if n.tag == "#" and p >= 0.5)


# Words that authors name the parts of a page by.
OFF_NAMES = {
    "nav": "nav navbar navigation menu topbar breadcrumb breadcrumbs crumbs links toc pagination pager tabs skip".split(),
    "header": "header masthead banner branding logo top site hero head".split(),
    "footer": "footer copyright legal colophon bottom foot imprint credits".split(),
    "side": "sidebar side aside widget related recommended recommend more trending popular archive tags categories rail secondary promo teaser".split(),
    "notice": "notice cookie cookies consent gdpr alert warning message banner popup modal overlay toast disclaimer announcement paywall hidden".split(),
    "ad": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion dfp adsense adslot commercial".split(),
    "form": "form search login signup subscribe subscription newsletter register contact feedback poll survey".split(),
    "comments": "comment comments reply replies discussion disqus respond responses thread reader guestbook feedback commentlist".split(),
    "share": "share sharing social follow buttons tools toolbar actions print byline author meta date tags".split(),
}
IN_NAMES = "article post entry content story main body text copy page blog news document prose section column primary detail single".split()


def labelled_pages(count: int = N_PAGES, seed: int = SEED) -> list[list[Node]]:
    """Pages of random layout as nodes with their states; texts are random words of random length."""
    r = random.Random(seed)
    letters = "etaoinshrdlu"

    def words(low: int, high: int) -> str:
        some = ["".join(r.choice(letters) for _ in range(r.randint(2, 9))) for _ in range(r.randint(low, high))]
        return " ".join(w + (r.choice(",.") if r.random() < 0.12 else "") for w in some).capitalize()

    def named(names: list[str]) -> str:
        own = r.choice(names)
        own = r.choice([own, own, f"{own}-{r.choice(['box', 'area', 'wrap', 'list', 'inner', 'item'])}", f"main-{own}", f"{own}{r.randint(1, 9)}"])
        return r.choice([f' class="{own}"', f' id="{own}"', f' class="{own} {r.choice(["clearfix", "box", "row", "col", "block"])}"'])

    def links(low: int, high: int) -> str:
        items = [f'<a href="/{i}">{words(1, 4)}</a>' for i in range(r.randint(low, high))]
        if r.random() < 0.7:
            return "<ul>" + "".join(f"<li>{x}" + ("</li>" if r.random() < 0.8 else "") for x in items) + "</ul>"
        return " | ".join(items)

    def element(tags: str, names: list[str] | None, inner: str) -> str:
        tag = r.choice(tags.split())
        return f"<{tag}{named(names) if names and (tag in ('div', 'section', 'ul', 'form') or r.random() < 0.5) else ''}>{inner}</{tag}>"

    def some_text() -> str:
        return r.choice([words(3, 15), f"<p>{words(3, 30)}</p>", f"<p>{words(8, 60)}</p><p>{words(5, 40)}</p>", f"<h3>{words(1, 4)}</h3><p>{words(5, 25)}</p>"])

    def off(kind: str) -> str:
        names = OFF_NAMES[kind]
        if kind == "nav":
            return element("nav nav div ul", names, links(3, 9))
        if kind == "header":
            return element("header header div", names, r.choice([f"<h1>{words(1, 4)}</h1>", f"<h2>{words(1, 3)}</h2>", f"<a href='/'>{words(1, 3)}</a>", words(1, 6)]) + r.choice(["", f"<p>{words(3, 10)}</p>", links(2, 6)]))
        if kind == "footer":
            return element("footer footer div", names, r.choice(["&copy; ", ""]) + words(3, 30) + r.choice(["", links(2, 6), f"<p>{words(4, 30)}</p>"]))
        if kind == "side":
            return element("aside aside div section", names, r.choice(["", f"<h3>{words(1, 4)}</h3>", f"<h2>{words(1, 3)}</h2>"]) + r.choice([links(2, 8), some_text(), f"<ul><li>{words(3, 12)}</li><li>{words(3, 12)}</li></ul>"]))
        if kind == "form":
            return element("form form div", names, f"<label>{words(1, 4)}</label><input name='q'>" + r.choice(["", f"<p>{words(3, 20)}</p>", f"<div>{words(2, 8)}</div>"]) + f"<button>{words(1, 2)}</button>")
        if kind == "comments":
            def one() -> str:
                tag = r.choice(["div", "li", "article", "section"])
                inner = f"<b>{words(1, 2)}</b>" + r.choice([f"<p>{words(4, 60)}</p>", words(4, 60)])
                return f"<{tag}{named(['comment', 'reply', 'response'])}>{inner}</{tag}>"

            return element("section div div ol ul", names, r.choice(["", f"<h2>{words(1, 3)}</h2>", f"<h3>{words(1, 3)}</h3>"]) + "".join(one() for _ in range(r.randint(1, 6))))
        return element("div div section aside" if kind != "share" else "div div ul p", names, r.choice([some_text(), some_text(), links(1, 5)]))

    def marked(state: int, text: str) -> str:
        return f"\x01{state}{text}\x02"

    def article() -> str:
        parts = [f"<h1>{words(1, 12)}</h1>"] if r.random() < 0.8 else []
        for _ in range(r.choice([1, 1, r.randint(1, 5), r.randint(1, 14)])):
            x = r.random()
            if x < 0.72 or not parts:
                body = r.choice([words(1, 9), words(6, 120), words(20, 120)])
                if r.random() < 0.25:
                    body = f"{words(3, 20)} <a href='#'>{words(1, 4)}</a> {body}"
                if r.random() < 0.15:
                    body = f"<b>{body}<br>" if r.random() < 0.5 else f"{words(3, 9)}<br>{body}"
                parts.append(f"<p>{body}" + ("</p>" if r.random() < 0.85 else ""))
            elif x < 0.80:
                parts.append(f"<h2>{words(2, 8)}</h2>")
            elif x < 0.86:
                parts.append("<ul>" + "".join(f"<li>{words(3, 20)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif x < 0.90:
                parts.append(f"<blockquote><p>{words(8, 40)}</p></blockquote>")
            elif x < 0.92:
                parts.append(f"<table><tr><td>{words(1, 4)}</td><td>{words(1, 4)}</td></tr></table>")
            elif x < 0.94:
                parts.append(f"<pre>{words(4, 30)}</pre>")
            else:
                parts.append(f"<div>{words(15, 80)}</div>" if r.random() < 0.4 else marked(OFF, off(r.choice(["ad", "side", "share", "notice", "form"]))))
        inner = "".join(parts)
        if r.random() < 0.3:
            inner = f"<div{named(IN_NAMES) if r.random() < 0.7 else ''}>{inner}</div>"
        tag = r.choice(["article", "article", "article", "main", "div", "div", "section"])
        return marked(IN, f"<{tag}{named(IN_NAMES) if tag in ('div', 'section') or r.random() < 0.4 else ''}>{inner}</{tag}>")

    def page() -> str:
        kinds = list(OFF_NAMES)
        bare = r.random() < 0.1
        before = [off(r.choice(["nav", "nav", "header", "header", "notice", "ad", "form", "side"])) for _ in range(0 if bare else r.randint(0, 4))]
        after = [off(r.choice([*kinds, "comments", "footer", "footer"])) for _ in range(0 if bare else r.randint(0, 4))]
        middle = [article()] if r.random() < 0.96 else []
        if r.random() < 0.4:
            tag = r.choice(["div", "div", "main", "section"])
            inner = middle + [marked(OFF, x) for x in ([off("side")] if r.random() < 0.4 else []) + ([off("comments")] if r.random() < 0.4 else [])]
            r.shuffle(inner)
            middle = [f"<{tag}{named(['wrapper', 'container', 'page', 'layout', 'wrap', 'site', 'content', 'main', 'app', 'root'])}>{''.join(inner)}</{tag}>"]
        return "<html><body>" + "".join(marked(OFF, x) for x in before) + "".join(middle) + "".join(marked(OFF, x) for x in after) + "</body></html>"

    return [_states(page()) for _ in range(count)]


def _states(page: str) -> list[Node]:
    """Nodes of a page whose parts are marked, \\x01 and a state before, \\x02 after, by their states."""
    plain, stack, spans, size, at = [], [OUT], [], 0, 0
    for m in re.finditer("\x01(\\d)|\x02", page):
        plain.append(page[at : m.start()])
        size += m.start() - at
        spans.append((size, stack[-1]))  # what starts before `size` has this state
        stack = [*stack, int(m[1])] if m[1] else stack[:-1]
        at = m.end()
    nodes = parse("".join([*plain, page[at:]]))
    ends, states = [e for e, _ in spans], [x for _, x in spans] + [OUT]
    for n in nodes:
        n.state = states[int(np.searchsorted(ends, n.at, side="right"))]
    holds = [False] * len(nodes)
    for i in range(len(nodes) - 1, 0, -1):
        holds[nodes[i].parent] |= holds[i] or nodes[i].state == IN
    for n, h in zip(nodes, holds, strict=True):
        if n.state == OUT and not h and n.tag != "html":
            n.state = OFF
    return nodes


@lru_cache(maxsize=1)
def trained() -> Model:
    return fit(labelled_pages())


def extract_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """pages (html and others, whatever their names) with `text` after the others in place of html;
    nothing is shuffled."""
    model = model or trained()
    rest = [f for f in pages.schema if f.name != "html"]
    names = [f"c{i}" for i in range(len(rest))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(x.as_py(), model) for x in batch["html"]], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), texts], [*names, "text"])

    schema = StructType([*(StructField(n, f.dataType) for n, f in zip(names, rest, strict=True)), StructField("text", StringType())])
    of = [c for c, f in zip(columns(pages), pages.schema, strict=True) if f.name != "html"]
    rows = pages.select(*[c.alias(n) for c, n in zip(of, names, strict=True)], "html")
    return rows.mapInArrow(run, schema).toDF(*[f.name for f in rest], "text")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_text(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    with small_batches(spark):  # a task holds few long pages at once
        return stored(out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars")), "text")
