"""Log-likelihood of documents under a gated recurrent language model, next to a unigram base.

Counts. Tasks count the words of training documents, a batch of texts as a whole by Arrow, and write
(hash, count, word) whenever they hold LIMIT words; Spark adds these up, over all words of all training documents. The KNOWN most
frequent ones, a fixed number, go to every task; a document's other words meet the table of
counts in a join.

Model. A GRU whose softmax has two factors: the class, then the word within it. The VOCABULARY
most frequent words have classes of CLASS words. All others are in one of BUCKETS by their last
bytes; within a bucket, words have their share of the unigram base, so the model gives every
text a probability. It is trained by truncated backpropagation on all training documents. These
are put in the order of a hash of what they say, and dealt one by one to shares of about SHARE
tokens and to ROUNDS rounds, so neither the table's partitions nor the order of its rows matter. In
each round every share trains from the same weights on its documents of the round, BLOCK tokens at
a time; weights and moments are averaged by the tokens they come from, in a tree of tasks, so that
the driver gets FAN of them at most. A text that a block cuts begins again without state.

Scoring. Documents run in step, longest first, so that a step is one product for all that are
still open; the state is carried on to the end of the document. The states met are scored together
whenever they are AT_ONCE, so a few long documents do not cost a small product for each of the classes
every few steps.

Defined results: a null or empty text is one end token. A null doc_id counts as the empty text
for its remainder. Rows are scored one by one, repeated ones alike, and repeated training rows
count each. With no training rows, N and V are 0 and every base score is 0. An empty table gives
no rows. Only doc_id and text are read. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import io
import math
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import job, small, stored, table

FOLDS, HELD_OUT = 7, 2
LIMIT, KNOWN, LONGEST = 400_000, 200_000, 256
VOCABULARY, CLASS, BUCKETS, HIDDEN = 2048, 64, 32, 16
EPOCHS, LANES, WINDOW, RATE, SEED = 1, 128, 32, 0.008, 5
#: Rounds of an epoch; tokens of a share, and those held at once; models that a task averages.
ROUNDS, SHARE, BLOCK, FAN = 4, 2_000_000, 500_000, 16
#: Documents that run in step, and tokens of those a task takes in to choose them from.
STEP_ROWS, SCORED = 1024, 4_000_000
#: States that are scored together, and those whose softmax is worked out at once, so that it stays in a core's cache.
AT_ONCE, TILE = 32768, 1024
#: No word holds white space, so this can stand for the end of a text.
END = b"\n"


def split_words(text: str | None) -> list[bytes]:
    """The words of a text and its end: what coded_words() gives for many texts at once."""
    words = (text or "").encode().lower().split()
    words.append(END)
    return words


def coded_words(text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of texts; for each word of all texts, as split_words() has them, which of
    these it is; and the number of words of each text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(text.fill_null("")))
    words = lists.flatten()
    real = pc.binary_length(words).to_numpy() > 0  # white space at an end of a text leaves an empty word there
    before = np.r_[0, np.cumsum(real)]
    size = np.diff(before[lists.offsets.to_numpy() - lists.offsets[0].as_py()]) + 1
    coded = pa.concat_arrays([words.filter(pa.array(real)), pa.array([END.decode()], words.type)]).dictionary_encode()
    code = coded.indices.to_numpy()
    every, is_word = np.full(size.sum(), code[-1]), np.ones(size.sum(), bool)
    is_word[np.cumsum(size) - 1] = False
    every[is_word] = code[:-1]
    return coded.dictionary.cast(pa.binary()), every, size


def hashes(words: pa.Array) -> np.ndarray:
    return (np.fromiter(map(xxhash.xxh3_64_intdigest, words.to_numpy(zero_copy_only=False)), np.uint64, len(words)) ^ np.uint64(1 << 63)).view(np.int64)


def buckets(words: pa.Array) -> np.ndarray:
    """The bucket of each word, by its last three bytes."""
    ends = pc.binary_slice(words, -3, 1 << 30).dictionary_encode()
    return np.array([zlib.crc32(x) % BUCKETS for x in ends.dictionary.to_numpy(zero_copy_only=False)], np.int32)[ends.indices.to_numpy()]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, bucket, c, word) of this task's training texts."""
    held: list[pa.Table] = []

    def merged() -> pa.Table:
        return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("c", "sum")])

    def out(counts: pa.Table) -> pa.RecordBatch:
        words = counts["word"].combine_chunks()
        columns = [pa.array(hashes(words)), pa.array(buckets(words)), counts["c_sum"].combine_chunks(), words]
        return pa.RecordBatch.from_arrays(columns, names=["hash", "bucket", "c", "word"])

    for batch in batches:
        if not batch.num_rows:
            continue
        words, every, _ = coded_words(batch.column(0))
        held.append(pa.table({"word": words, "c": np.bincount(every, minlength=len(words))}))
        if sum(map(len, held)) >= 2 * LIMIT:
            counts = merged()
            if len(counts) >= LIMIT:
                yield out(counts)
                held = []
            else:
                held = [counts.rename_columns({"c_sum": "c"}).select(["word", "c"])]
    if held:
        yield out(merged())


def advance(gates: np.ndarray, new: np.ndarray, h: np.ndarray, x: np.ndarray, zr: np.ndarray, reset: np.ndarray, c: np.ndarray, after: np.ndarray) -> None:
    """A step of the recurrence; a column is a text. gates, new: Model.cell(); h: states; x: of table(),
    the rows of z and r negated. Fills in the gates, r * h, the candidates and the states after."""
    n = len(h)
    np.dot(gates, h, out=zr)
    zr += x[: 2 * n]
    np.exp(zr, out=zr)  # beyond all bounds is a gate of 0
    zr += 1
    np.reciprocal(zr, out=zr)
    np.multiply(zr[n:], h, out=reset)
    np.dot(new, reset, out=c)
    c += x[2 * n :]
    np.tanh(c, out=c)
    np.subtract(h, c, out=after)
    after *= zr[:n]
    after += c


def with_one(h: np.ndarray) -> np.ndarray:
    """Rows of states with a 1 at their end, which meets the bias."""
    out = np.empty((len(h), h.shape[1] + 1), h.dtype)
    out[:, :-1] = h
    out[:, -1] = 1
    return out


def settled(*weights: np.ndarray) -> bool:
    """Whether, for states (no component is beyond 1), exp() of no product with the weights (the bias
    in their last row) overflows, and that of a row's largest does not vanish: then softmax need not
    look for the largest."""
    for w in weights:
        spread, bias = np.abs(w[..., :-1, :]).sum(axis=-2), w[..., -1, :]
        if not (np.all((bias + spread).max(axis=-1) < 60) and np.all((bias - spread).max(axis=-1) > -60)):
            return False
    return True


def _exp(logits: np.ndarray, at: np.ndarray, calm: bool) -> tuple[np.ndarray, np.ndarray]:
    """Makes exp() of logits in their place; returns its sums by row, and ln P of the column `at`."""
    if not calm:
        logits -= logits.max(axis=1, keepdims=True)
    own = logits[np.arange(len(logits)), at]
    np.exp(logits, out=logits)
    total = logits @ np.ones(logits.shape[1], logits.dtype)
    return total, own - np.log(total)


def log_softmax(logits: np.ndarray, at: np.ndarray, calm: bool) -> np.ndarray:
    return _exp(logits, at, calm)[1]


def softmax(logits: np.ndarray, at: np.ndarray, calm: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of -ln P of the column `at` the gradient, in the place of the logits; and ln P itself."""
    total, likely = _exp(logits, at, calm)
    logits *= (1 / total)[:, None]
    logits[np.arange(len(logits)), at] -= 1
    return logits, likely


def by_class(kind: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the order of their class, and where each of the first `classes` begins, and the last ends."""
    order = np.argsort(kind.astype(np.uint16), kind="stable")
    return order, np.searchsorted(kind[order], np.arange(classes + 1))


class Model:
    """Parameters of the network; all arrays are float32 until training moves them."""

    names = ("embed", "into", "bias", "gates", "new", "class_w", "class_b", "word_w", "word_b")

    def __init__(self, parts: dict[str, np.ndarray]):
        self.__dict__.update(parts)

    @classmethod
    def initial(cls, counts: np.ndarray, rest: np.ndarray, hidden: int = HIDDEN, size: int = CLASS) -> Model:
        """Before training: the unigram model. counts: of the vocabulary; rest: of the buckets."""
        r = np.random.default_rng(SEED)
        classes = -(-len(counts) // size)
        padded = np.r_[counts, np.zeros(classes * size - len(counts))].reshape(classes, size)
        mass = np.r_[padded.sum(axis=1), rest] + 1e-3
        inside = np.where(padded > 0, np.log(np.maximum(padded, 1) / np.maximum(padded.sum(axis=1, keepdims=True), 1)), -30.0)
        small = lambda *s: r.normal(0, 1 / math.sqrt(hidden), s).astype(np.float32)
        return cls(
            {
                "embed": small(len(counts) + len(rest), hidden),
                "into": small(hidden, 3 * hidden),
                "bias": np.r_[np.ones(hidden), np.zeros(2 * hidden)].astype(np.float32),
                "gates": small(hidden, 2 * hidden),
                "new": small(hidden, hidden),
                "class_w": np.zeros((hidden, len(mass)), np.float32),
                "class_b": np.log(mass / mass.sum()).astype(np.float32),
                "word_w": np.zeros((classes, hidden, size), np.float32),
                "word_b": inside.astype(np.float32),
            }
        )

    def save(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{k: getattr(self, k) for k in self.names})
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Model:
        with np.load(io.BytesIO(raw)) as f:
            return cls({k: f[k] for k in cls.names})

    def table(self) -> np.ndarray:
        """What each token adds to the three gates."""
        return self.embed @ self.into + self.bias

    def cell(self) -> tuple[np.ndarray, np.ndarray]:
        """The weights on the state as advance() takes them: a row per gate, those of z and r negated."""
        return np.ascontiguousarray(-self.gates.T), np.ascontiguousarray(self.new.T)

    def step(self, h: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """advance() by rows: the next state, and the gates it came from. x: rows of table()."""
        n, made = h.shape[1], [np.empty((k * h.shape[1], len(h)), h.dtype) for k in (2, 1, 1, 1)]
        x = np.ascontiguousarray(x.T)
        np.negative(x[: 2 * n], out=x[: 2 * n])
        with np.errstate(over="ignore"):
            advance(*self.cell(), np.ascontiguousarray(h.T), x, *made)
        zr, _, c, after = made
        return after.T, zr[:n].T, zr[n:].T, c.T

    def class_of(self, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class of tokens, and their place in it; -1 in buckets, which hold one token each."""
        words, size = len(self.embed) - (len(self.class_b) - len(self.word_b)), self.word_b.shape[1]
        known = token < words
        return np.where(known, token // size, token - words + len(self.word_b)), np.where(known, token % size, -1)

    def output(self) -> tuple[np.ndarray, np.ndarray, bool]:
        """Weights of the classes, and of the words in each, with the bias as a last row; and whether they are settled()."""
        both = np.r_[self.class_w, self.class_b[None]], np.concatenate([self.word_w, self.word_b[:, None]], axis=1)
        return *both, settled(*both)

    def log_likelihood(self, h: np.ndarray, token: np.ndarray, output: tuple[np.ndarray, np.ndarray, bool] | None = None) -> np.ndarray:
        """ln P(token | state) for rows of states: the class's share, and the word's within it."""
        of_class, of_word, calm = output or self.output()
        kind, place = self.class_of(token)
        h, out = with_one(h), np.empty(len(h))
        for first in range(0, len(h), TILE):
            rows = slice(first, first + TILE)
            out[rows] = log_softmax(h[rows] @ of_class, kind[rows], calm)
        order, ends = by_class(kind, len(self.word_b))
        order = order[: ends[-1]]
        h, place, inside = h.take(order, axis=0), place[order], np.empty(len(order))
        for c in np.flatnonzero(np.diff(ends)):
            for first in range(ends[c], ends[c + 1], TILE):
                rows = slice(first, min(first + TILE, ends[c + 1]))
                inside[rows] = log_softmax(h[rows] @ of_word[c], place[rows], calm)
        out[order] += inside
        return out

    def gradients(self, tokens: np.ndarray, before: np.ndarray, state: np.ndarray, live: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
        """Of -ln P of a window, by backpropagation through it and no further.

        tokens, before: (steps, lanes), the tokens and the ones before them (-1: a text begins, the
        state is zero); live: which count. Returns gradients, the state after, and the loss.
        """
        steps, lanes = tokens.shape
        table, n, dtype = self.table(), state.shape[1], state.dtype
        table[:, : 2 * n] *= -1
        fed, goes_on = np.maximum(before, 0), before >= 0
        keep, starts = goes_on.astype(dtype), [np.flatnonzero(x) for x in ~goes_on]
        # in the recurrence a row is a component and a column a lane, so that gates are whole rows
        x = np.ascontiguousarray(table.take(fed, axis=0).transpose(0, 2, 1))
        zr = np.empty((steps, 2 * n, lanes), dtype)
        entered, reset, c, after = (np.empty((steps, n, lanes), dtype) for _ in range(4))
        gates, new = self.cell()
        last = state.T
        with np.errstate(over="ignore"):
            for t in range(steps):
                np.multiply(last, keep[t], out=entered[t])
                last = after[t]
                advance(gates, new, entered[t], x[t], zr[t], reset[t], c[t], last)
                if len(starts[t]):
                    last[:, starts[t]] = 0
        state = np.ascontiguousarray(last.T)
        of_class, of_word, calm = self.output()
        h = with_one(after.transpose(0, 2, 1).reshape(-1, n))
        token, on = tokens.ravel(), live.ravel()
        kind, place = self.class_of(token)
        p, likely = softmax(h @ of_class, kind, calm)
        loss = -float(likely[on].sum())
        if not on.all():
            p *= on[:, None].astype(dtype)
        whole = h.T @ p
        dh = p @ self.class_w.T
        order, ends = by_class(np.where(on, kind, len(self.word_b)), len(self.word_b))
        order = order[: ends[-1]]
        own_h, w = h.take(order, axis=0), np.empty((len(order), of_word.shape[2]), dtype)
        parts = [(k, slice(ends[k], ends[k + 1])) for k in np.flatnonzero(np.diff(ends))]
        for k, rows in parts:
            np.matmul(own_h[rows], of_word[k], out=w[rows])
        w, likely = softmax(w, place[order], calm)
        loss -= float(likely.sum())
        of_words, moves = np.zeros_like(of_word), np.empty((len(order), n), dtype)
        for k, rows in parts:
            np.matmul(own_h[rows].T, w[rows], out=of_words[k])
            np.matmul(w[rows], self.word_w[k].T, out=moves[rows])
        dh[order] += moves
        dh = np.ascontiguousarray(dh.reshape(steps, lanes, n).transpose(0, 2, 1))
        moved = np.empty((steps, 3 * n, lanes), dtype)
        z, r = zr[:, :n], zr[:, n:]
        # what a gate's input moves, but for what comes from later steps: for all steps at once
        of_c, of_z, of_r = (1 - z) * (1 - c * c), (entered - c) * z * (1 - z), reset * (1 - r)
        later = np.zeros((n, lanes), dtype)
        for t in range(steps - 1, -1, -1):
            d, own = dh[t], moved[t]
            d += later
            if len(starts[t]):
                d[:, starts[t]] = 0  # and with it all that would go on to the step before
            np.multiply(d, of_c[t], out=own[2 * n :])
            back = self.new @ own[2 * n :]
            np.multiply(d, of_z[t], out=own[:n])
            np.multiply(back, of_r[t], out=own[n : 2 * n])
            np.dot(self.gates, own[: 2 * n], out=later)
            back *= r[t]
            later += back
            d *= z[t]
            later += d
        back = moved.transpose(0, 2, 1)
        of_gates, of_new = (entered @ back[:, :, : 2 * n]).sum(axis=0), (reset @ back[:, :, 2 * n :]).sum(axis=0)
        fed = fed.ravel()
        order = np.argsort(fed.astype(np.uint16), kind="stable")
        ranked = fed[order]
        first = np.flatnonzero(np.r_[True, ranked[1:] > ranked[:-1]])
        dtable = np.zeros_like(table)
        # reduceat() goes by columns, so pairs of numbers are added as the two parts of one
        pairs = back.reshape(-1, 3 * n).take(order, axis=0).view(np.result_type(dtype, np.complex64))
        dtable[ranked[first]] = np.add.reduceat(pairs, first).view(dtype)
        grads = {"embed": dtable @ self.into.T, "into": self.embed.T @ dtable, "bias": dtable.sum(axis=0), "gates": of_gates, "new": of_new}
        grads |= {"class_w": whole[:n], "class_b": whole[n], "word_w": of_words[:, :n], "word_b": of_words[:, n]}
        return grads, state, loss

    def flat(self, moving: dict[str, tuple[np.ndarray, np.ndarray]], n: float) -> bytes:
        """Weights, Adam's moments and steps so far as one vector, which can be averaged."""
        return np.concatenate([x.ravel() for k in self.names for x in (getattr(self, k), *moving[k])] + [[n]]).astype("<f4").tobytes()

    def unflat(self, raw: bytes) -> tuple[dict[str, tuple[np.ndarray, np.ndarray]], float]:
        """Takes the weights from flat(); returns the moments and steps."""
        x, at, moving = np.frombuffer(raw, "<f4"), 0, {}
        for k in self.names:
            shape = getattr(self, k).shape
            size = math.prod(shape)
            parts = [x[at + i * size : at + (i + 1) * size].reshape(shape).copy() for i in range(3)]
            setattr(self, k, parts[0])
            moving[k] = parts[1], parts[2]
            at += 3 * size
        return moving, float(x[at])

    def still(self) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """Adam's moments before the first step."""
        return {k: (np.zeros_like(getattr(self, k)), np.zeros_like(getattr(self, k))) for k in self.names}

    def train(self, texts: list[np.ndarray], moving: dict[str, tuple[np.ndarray, np.ndarray]], n: float = 0, lanes: int = LANES) -> tuple[float, float]:
        """Adam over windows of all texts, once; they lie end to end in the lanes. Moves `moving`;
        returns the steps so far and the loss a token."""
        order = np.random.default_rng([SEED, int(n)]).permutation(len(texts))
        tokens = np.concatenate([texts[i] for i in order])
        before = np.concatenate([np.r_[-1, texts[i][:-1]] for i in order])
        long = -(-len(tokens) // lanes)
        pad = long * lanes - len(tokens)
        shaped = [np.r_[x, np.full(pad, v)].reshape(lanes, long).T for x, v in ((tokens, 0), (before, -1), (np.ones(len(tokens), bool), False))]
        state, total = np.zeros((lanes, self.new.shape[0]), np.float32), 0.0
        # weights and moments are parts of three vectors, which move as a whole
        whole, m, v = (np.concatenate(x, axis=None, dtype=np.float32) for x in zip(*((getattr(self, k), *moving[k]) for k in self.names), strict=True))
        at = 0
        for k in self.names:
            shape = getattr(self, k).shape
            part = slice(at, at := at + math.prod(shape))
            setattr(self, k, whole[part].reshape(shape))
            moving[k] = m[part].reshape(shape), v[part].reshape(shape)
        for t in range(0, long, WINDOW):
            grads, state, loss = self.gradients(*(x[t : t + WINDOW] for x in shaped[:2]), state, shaped[2][t : t + WINDOW])
            total += loss
            n += 1
            live = max(1, int(shaped[2][t : t + WINDOW].sum()))
            g = np.concatenate([grads[k] for k in self.names], axis=None)
            norm = math.sqrt(float(np.vdot(g, g))) / live
            rate = RATE * min(1.0, n / 50) * math.sqrt(1 - 0.999**n) / (1 - 0.9**n)
            g *= min(1.0, 1.0 / (norm + 1e-9)) / live
            m *= 0.9
            m += 0.1 * g
            g *= g
            g *= 0.001
            v *= 0.999
            v += g
            np.sqrt(v, out=g)
            g += 1e-8
            np.divide(m, g, out=g)
            g *= rate
            whole -= g
        return n, total / len(tokens)

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """ln P of whole texts, each given by its tokens."""
        out = np.zeros(len(texts))
        order = np.argsort([-len(x) for x in texts], kind="stable")
        table, n, output = self.table(), self.new.shape[0], self.output()
        table[:, : 2 * n] *= -1
        gates, new = self.cell()
        for first in range(0, len(order), STEP_ROWS):
            rows = order[first : first + STEP_ROWS]
            size = np.array([len(texts[i]) for i in rows])
            flat, starts = np.concatenate([texts[i] for i in rows]), np.cumsum(size) - size
            h, token = np.zeros((n, len(rows)), np.float32), flat[:0]
            left = np.searchsorted(-size, -np.arange(size[0]), side="left").tolist()  # texts longer than t
            states, tokens, of, held = [], [], [], 0
            for t, some in enumerate(left):
                if t:
                    x = np.ascontiguousarray(table.take(token[:some], axis=0).T)
                    made = [np.empty((k * n, some), np.float32) for k in (2, 1, 1, 1)]
                    with np.errstate(over="ignore"):
                        advance(gates, new, h[:, :some], x, *made)
                    h = made[-1]
                token = flat[starts[:some] + t]
                states.append(h)
                tokens.append(token)
                of.append(rows[:some])
                held += some
                if held >= AT_ONCE or t + 1 == len(left):
                    likely = self.log_likelihood(np.concatenate(states, axis=1).T, np.concatenate(tokens), output)
                    out += np.bincount(np.concatenate(of), likely, len(out))
                    states, tokens, of, held = [], [], [], 0
        return out


def as_binary(values: np.ndarray, size: np.ndarray) -> pa.Array:
    """Consecutive parts of values, of these sizes, as binary values."""
    offsets = np.r_[0, np.cumsum(size)] * values.itemsize
    if offsets[-1] >= 1 << 31:
        raise ValueError("texts of one batch hold more words than its Arrow columns can")
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


class Lexicon:
    """The KNOWN words and what a text's words are to base and model."""

    def __init__(self, words: list[bytes], counts: np.ndarray, n: int, v: int, vocabulary: int):
        self.words = pa.array(words, pa.binary())
        self.base = np.log10((counts + 1) / (n + v + 1)) if len(words) else np.zeros(0)
        self.own = min(vocabulary, len(words))
        self.token = np.r_[np.arange(self.own), self.own + buckets(self.words[self.own :])].astype("<u2")

    def look_up(self, text: pa.Array) -> dict[str, pa.Array]:
        """Of each text its tokens, number of known words and base score, and the hashes of its
        other words, which count as 0 in both."""
        words, every, size = coded_words(text)
        at = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy()
        rare = np.flatnonzero(at < 0)
        token, base, hashed = np.r_[self.token, np.uint16(0)][at], np.r_[self.base, 0.0][at], np.zeros(len(words), np.int64)
        other = words.take(pa.array(rare))
        token[rare], hashed[rare] = self.own + buckets(other), hashes(other)
        starts, known = np.cumsum(size) - size, at[every] >= 0
        n_known = np.add.reduceat(known, starts, dtype=np.int64)
        return {
            "tokens": as_binary(token[every], size),
            "known": pa.array(n_known),
            "base": pa.array(np.add.reduceat(base[every], starts)),
            "rest": as_binary(hashed[every[~known]], size - n_known),
        }


def _blocks(batches: Iterator[pd.DataFrame], most: int) -> Iterator[list[np.ndarray]]:
    """The texts of all rows in blocks of `most` tokens; what does not fit goes to the next ones."""
    block, left = [], most
    for batch in batches:
        for raw in batch["tokens"]:
            text = np.frombuffer(raw, "<u2").astype(np.int32)
            while len(text) >= left:
                yield [*block, text[:left]]
                text, block, left = text[left:], [], most
            if len(text):
                block.append(text)
                left -= len(text)
    if block:
        yield block


def _average(rows: pd.DataFrame) -> pd.DataFrame:
    """One row of several (share, n, flat): the mean of the vectors by their tokens."""
    rows = rows.sort_values("share")
    tokens = int(rows["n"].sum())
    total = sum(n * np.frombuffer(raw, "<f4").astype(np.float64) for n, raw in zip(rows["n"].tolist(), rows["flat"], strict=True))
    return pd.DataFrame({"share": [rows["share"].iat[0] // FAN], "n": [tokens], "flat": [(total / tokens).astype("<f4").tobytes()]})


def _gathered(batches: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """Batches of rows put together until they hold `most` tokens."""
    held, n = [], 0
    for batch in batches:
        if len(batch):
            held.append(batch)
            n += int(batch["tokens"].str.len().sum()) // 2
        if n >= most:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def in_order(training: DataFrame) -> DataFrame:
    """tokens and place: the row's number from 0 in the order of the hash of (doc, tokens). Equal
    rows are spread over tasks by `row`, and have any of their numbers."""
    keys = [F.xxhash64("doc", "tokens").alias("h"), "row", "tokens"]
    dealt = training.select(*keys).repartitionByRange("h", "row").sortWithinPartitions("h", "row")
    dealt = stored(dealt.select("tokens").withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "dealt")
    held = dealt.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("first"))  # a row per task
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = small(stored(held.select("part", (before - F.col("first")).alias("shift")), "held"))
    return dealt.join(held, "part").select("tokens", (F.col("at") + F.col("shift")).alias("place"))


def trained(model: Model, training: DataFrame, n: int, epochs: int = EPOCHS) -> tuple[Model, int]:
    """The model after `epochs` over all rows of training (doc, row, tokens) of n tokens in all, and the
    tokens it was trained on."""
    shares = max(1, n // SHARE)
    start, raw, used = model.save(), model.flat(model.still(), 0), 0
    dealt = in_order(training).select("tokens", "place", F.pmod("place", F.lit(shares)).alias("share"))

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of each share, which come one after another, a model trained on its rows in their order."""
        runs = ((int(k), rows) for batch in batches for k, rows in batch.groupby("share", sort=True))
        for share, own in groupby(runs, key=lambda x: x[0]):
            model, tokens = Model.load(start), 0
            moving, steps = model.unflat(raw)
            for block in _blocks((rows for _, rows in own), BLOCK):
                steps, _ = model.train(block, moving, steps, LANES)
                tokens += sum(map(len, block))
            yield pd.DataFrame({"share": [share], "n": [tokens], "flat": [model.flat(moving, steps)]})

    for i in range(epochs * ROUNDS):
        of_round = dealt.where(F.pmod(F.floor(F.col("place") / shares), F.lit(ROUNDS)) == i % ROUNDS)
        rows = of_round.repartitionByRange(shares, "share").sortWithinPartitions("share", "place").mapInPandas(learn, "share bigint, n bigint, flat binary")
        left = shares
        while left > FAN:
            left = -(-left // FAN)
            rows = rows.groupBy(F.floor(F.col("share") / FAN)).applyInPandas(_average, "share bigint, n bigint, flat binary")
        learnt = rows.toPandas()  # at most FAN rows
        if len(learnt):
            mean = _average(learnt)
            raw, used = bytes(mean["flat"].iat[0]), used + int(mean["n"].iat[0])
    model = Model.load(start)
    model.unflat(raw)
    return model, used


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


@job
def score_documents(docs: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs
    (doc_id, text)."""
    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    training = rows.where("not held_out")
    part = stored(training.select("text").mapInArrow(_counts, "hash bigint, bucket int, c bigint, word binary"), "word-counts")
    counts = stored(part.groupBy("hash").agg(F.sum("c").alias("c"), F.max("bucket").alias("bucket")), "counts")
    n, v = (int(x or 0) for x in counts.agg(F.sum("c"), F.count("*")).first())
    best = small(stored(counts.orderBy(F.desc("c"), "hash").limit(KNOWN), "best"))
    # a word of more than LONGEST bytes is looked up as rare words are, so that what goes to the driver is bounded
    named = part.where(F.octet_length("word") <= LONGEST).join(best, "hash").groupBy("hash").agg(F.min("word").alias("word"), F.first(best["c"]).alias("total"), F.first(best["bucket"]).alias("b"))
    top = sorted(named.select("word", F.col("total").alias("c"), F.col("b").alias("bucket")).collect(), key=lambda r: (-r.c, bytes(r.word)))  # at most KNOWN rows
    lexicon = Lexicon([bytes(r.word) for r in top], np.array([r.c for r in top], np.int64), n, v, VOCABULARY)
    own = np.array([r.c for r in top[: lexicon.own]], np.float64)
    mass = np.ones(BUCKETS)  # of a bucket: counts and one of each of its words, and one for words never seen
    for b, c in counts.groupBy("bucket").agg(F.sum(F.col("c") + 1)).collect():
        mass[b] += c
    for r in top[: lexicon.own]:
        mass[r.bucket] -= r.c + 1
    model = Model.initial(own, mass)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            if not batch.num_rows:
                continue
            made = {"doc": batch["doc"], "held_out": batch["held_out"], "row": pa.array(row + np.arange(batch.num_rows))} | lexicon.look_up(batch["text"])
            yield pa.RecordBatch.from_arrays(list(made.values()), names=list(made))
            row += batch.num_rows

    looked_up = rows.select(F.col("doc_id").cast("string").alias("doc"), "text", "held_out").mapInArrow(
        look_up, "doc string, held_out boolean, row bigint, tokens binary, known bigint, base double, rest binary"
    )
    looked_up = stored(looked_up, "tokens")
    raw = trained(model, looked_up.where("not held_out").select("doc", "row", "tokens"), n, epochs)[0].save()
    shares = np.log10(mass / (n + v + 1))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own_model = Model.load(raw)
        for batch in _gathered(batches, SCORED):
            tokens = [np.frombuffer(x, "<u2").astype(np.int32) for x in batch.pop("tokens")]
            # a bucket's word: the bucket's probability times the word's share of it, which is its base score over the bucket's
            inside = np.array([base_of_buckets(t) for t in tokens])
            likely = own_model.score(tokens) / math.log(10)
            yield batch.assign(n_tokens=[len(t) for t in tokens], score=likely + inside)

    first = lexicon.own
    word_base = lexicon.base[:first]

    def base_of_buckets(token: np.ndarray) -> float:
        """Minus the logarithm of the bucket's share for each bucket's token; and minus what base
        holds for vocabulary words, since score adds base for all words of a text."""
        seen = token >= first
        return -float(shares[token[seen] - first].sum()) - float(word_base[token[~seen]].sum())

    scored = looked_up.select("doc", "held_out", "row", "known", "base", "tokens").mapInPandas(
        score, "doc string, held_out boolean, row bigint, known bigint, base double, n_tokens bigint, score double"
    )

    def words_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hashes = np.frombuffer(b"".join(batch["rest"]), np.int64)
            yield pd.DataFrame({"row": np.repeat(batch["row"].to_numpy(), batch["rest"].str.len().to_numpy() // 8), "hash": hashes})

    rare = looked_up.where("length(rest) > 0").select("row", "rest").mapInPandas(words_of, "row bigint, hash bigint")
    met = rare.join(counts.select("hash", "c"), "hash", "left")
    base = F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(n + v + 1)))
    more = met.groupBy("row").agg(F.sum(base).alias("more"), F.count("c").alias("more_known"))
    out = scored.join(more, "row", "left")
    whole = F.col("base") + F.coalesce("more", F.lit(0.0))
    return out.select(
        F.col("doc").cast(docs.schema["doc_id"].dataType).alias("doc_id"),
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        whole.alias("base_score"),
        (F.col("score") + whole).alias("score"),
    )


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents", "doc_id", "text"))
