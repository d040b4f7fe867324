import random
import re
import zlib
from collections import Counter

import pytest

from factlake.llm import spelling as S

SCHEMA = "doc_id long, text string"


def plain_words(docs):
    seen = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :]
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def plain(docs):
    words = plain_words(docs)
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    best = {w: min(v, key=lambda x: (-words[x], x)) for w, v in near.items() if v}
    form = {w: v if words[v] >= 10 * words[w] else None for w, v in best.items()}

    def root(w):
        return root(form[w]) if form.get(w) else w

    return sorted((w, form.get(w), root(w), n, len(near[w]), words[form[w]] if form.get(w) else None) for w, n in words.items())


def ran(frame):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in S.spelling_variants(frame).collect())


def variants(rng, base, letters, times):
    out = [base]
    for _ in range(times):
        w = rng.choice(out)
        i = rng.randrange(len(w) + 1)
        out.append(rng.choice([w[:i] + rng.choice(letters) + w[i:], w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i + 1 :]]))
    return out


def test_against_all_pairs(spark):
    rng = random.Random(3)
    words = [w for base in ("information", "aaaaaaaa", "élèvement", "straßenbahn", "abababab") for w in variants(rng, base, "abéßÿ", 60)]
    docs = []
    for i in range(60):
        weights = [1 / (1 + k % 61) ** 2 for k in range(len(words))]
        docs.append((i, " ".join(rng.choices(words, weights, k=120)).replace("info", rng.choice(["info", "INFO", "Info"]))))
    want = plain(docs)
    assert sum(w[1] is not None for w in want) > 10 and any(w[2] not in (w[0], w[1]) for w in want)
    assert ran(spark.createDataFrame(docs, SCHEMA)) == want


@pytest.mark.parametrize("pairs", [1, 4, S.PAIRS])
def test_hot_beginnings_and_endings_lose_no_link(spark, pairs):
    rng = random.Random(pairs)
    middle = lambda n: "".join(rng.choice("abcde") for _ in range(n))
    words = sorted({f"international{middle(4)}" for _ in range(250)} | {f"{middle(4)}isation" for _ in range(250)} | {"z" * n for n in range(7, 30)})
    rows = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n long")
    got = sorted((r.a, r.b) for r in S.near_pairs(rows, pairs).collect())
    want = sorted((a, b) for a in words for b in words if one_edit(a, b) and (len(a), a) < (len(b), b))
    assert got == want and len(got) > 300


def test_odd_rows(spark):
    long = "x" * 30_000
    docs = [
        (None, "hundreds hundreds"), (1, None), (1, ""), (2, "Hundreds HUNDREDS hundredth1hundredth"), (2, "Hundreds HUNDREDS hundredth1hundredth"),
        (3, f"{long} {long}y {long} {long}y"), (4, "short words only"), (5, "ÀÉÎÕÜàé àéîõüàé ÀÉÎÕÜàé àéîõüàé ×÷×÷×÷× ×÷×÷×÷×"), (6, "Ω hundreds\thundreds\x00hundreds"),
    ]
    assert ran(spark.createDataFrame(docs, SCHEMA)) == plain(docs)
    clashing = spark.createDataFrame([(*d, "word", 7) for d in docs], SCHEMA + ", word string, n int")
    assert ran(clashing) == plain(docs)


def test_empty(spark):
    assert ran(spark.createDataFrame([], SCHEMA)) == []
    assert ran(spark.createDataFrame([(1, "nothing twice")], SCHEMA)) == []


def test_a_word_in_a_third_of_all_rows(spark):
    docs = [(i, "government governments governmint " * 3 if i % 3 else "government " * 40) for i in range(90)]
    assert ran(spark.createDataFrame(docs, SCHEMA)) == plain(docs)
