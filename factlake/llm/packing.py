"""Packing: the documents' ids end to end, cut into windows of one length.

Two passes. The first turns texts into ids, once, and writes them with the task that made them
and their place within that task. The totals of the tasks, one number for each, are summed up
to global offsets; with these every document knows the windows it falls in, and the second pass
cuts it there, without a shuffle of ids. A document over a boundary leaves a record on either side.

Defined results: a null or empty text is the end id alone. Rows are documents, in the order in
which tasks read them; rows that repeat are packed again. A null doc_id stays null. An empty
table gives no pieces. Only doc_id and text are read. Memory follows SLICE and a text's ids.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import job, small_batches, stored, table

LENGTH, END = 4096, 2
#: Bytes of text that are turned into words at once, words remembered by a task, and of these the
#: ones kept when there are more and when the task ends: the first met, so the common ones.
SLICE, REMEMBERED, KEPT = 1 << 20, 200_000, 100_000
_SPACE = b" \t\n\x0b\x0c\r"
#: Bytes by kind: signs of ASCII but for the apostrophe, letters of ASCII, second bytes of letters to U+00FF.
_SIGN, _LETTER, _SECOND = (np.isin(np.arange(256), list(x)) for x in (b'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~', b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", {*range(128, 192)} - {0x97, 0xB7}))


class WordTokens:
    """Ids of texts, word by word.

    Sound where the tokenizer never looks across ASCII white space and drops it, as one does whose
    pre-tokenizer keeps runs of letters, digits or signs only, and marks the ends of runs; tests hold
    it against whole texts.
    """

    class _Index(dict):
        def __missing__(self, word: bytes) -> int:
            self.new.append(word)
            at = self[word] = len(self)
            return at

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a run of letters or signs
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.index, self.flat, self.used = self._Index(), np.zeros(1 << 16, np.uint32), 0
        self.start, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.index.new = []
        same = lambda a: self.tokenizer.encode(a, add_special_tokens=False).ids == self.tokenizer.encode(a.lower(), add_special_tokens=False).ids
        self.special = [str(t.content).lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.folds = all(map(same, ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "The End", "aBC")))  # capitals are no other words

    def words(self, raw: bytes) -> list[bytes]:
        """The words of a text; signs that follow a letter begin a word of their own, so that fewer words
        are distinct. To the tokenizer a run of letters ends there, too. Texts with one of its special
        tokens, in whatever case, are split at white space alone."""
        lowered = raw.lower()
        if any(t in lowered for t in self.special):
            return raw.split()
        raw = lowered if self.folds else raw
        x = np.frombuffer(raw, np.uint8)
        at = np.flatnonzero(_SIGN[x])
        at = at[at > 1]
        at = at[_LETTER[x[at - 1]] | (x[at - 2] == 0xC3) & _SECOND[x[at - 1]]]
        if len(at):
            raw = np.insert(x, at, 32).tobytes()
        return raw.split()

    def forget(self) -> None:
        """All words but the first KEPT."""
        kept = dict(islice(self.index.items(), KEPT))
        n = len(kept)
        self.index = self._Index(kept)
        self.index.new = []
        self.used = int((self.start[:n] + self.size[:n]).max()) if n else 0
        self.flat = self.flat[: max(self.used, 1 << 16)].copy()
        self.start, self.size = (x[: max(n, 1 << 16)].copy() for x in (self.start, self.size))

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these words, one after another, and how many each has."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int64)

    def _plain(self, words: list[str], runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for words known to be one run of letters, or that and a sign: they are encoded
        as lines of text, and cut where runs end. If there are other runs than thought, word by word."""
        lines = [" ".join(words[i : i + 200]) for i in range(0, len(words), 200)]
        ids = np.array([i for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False) for i in e.ids], np.uint32)
        ends = np.flatnonzero(self.ends[ids])
        if not len(words) or len(ends) != runs.sum():
            return self._encoded(words)
        return ids, np.diff(np.r_[0, ends[np.cumsum(runs) - 1] + 1])

    def _learn(self, first: int) -> None:
        """Ids of the words met for the first time, from place `first` on."""
        new, self.index.new = [w.decode() for w in self.index.new], []
        runs = np.array([1 if w.isalpha() else 2 if w[-1] in ",.;:!?" and w[:-1].isalpha() else 0 for w in new])
        plain, other = np.flatnonzero(runs > 0), np.flatnonzero(runs == 0)
        parts = self._plain([new[i] for i in plain], runs[plain]), self._encoded([new[i] for i in other])
        at = np.r_[plain, other]
        ids, size = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
        while len(self.start) < first + len(new):
            self.start, self.size = np.resize(self.start, 2 * len(self.start)), np.resize(self.size, 2 * len(self.size))
        while len(self.flat) < self.used + len(ids):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[first + at] = self.used + np.cumsum(size) - size
        self.size[first + at] = size
        self.used += len(ids)

    def _ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these words, and how many each has."""
        if len(self.index) > REMEMBERED:
            self.forget()
        known = len(self.index)
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        if self.index.new:
            self._learn(known)
        size, start = self.size[at], self.start[at]
        ends = np.cumsum(size)
        place = np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        return self.flat[place], size

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text; short texts are done together, long ones slice by slice."""
        group: list[list[bytes]] = []
        held = 0
        for text in texts:
            raw = (text or "").encode()
            if len(raw) >= SLICE:
                yield from self._together(group)
                group, held, parts, at = [], 0, [], 0
                while at < len(raw):
                    end = min(at + SLICE, len(raw))
                    while end < len(raw) and raw[end] not in _SPACE:
                        end += 1
                    parts.append(self._ids(self.words(raw[at:end]))[0])
                    at = end
                yield np.concatenate(parts)
                continue
            group.append(self.words(raw))
            held += len(raw)
            if held >= SLICE:
                yield from self._together(group)
                group, held = [], 0
        yield from self._together(group)

    def _together(self, group: list[list[bytes]]) -> list[np.ndarray]:
        if not group:
            return []
        ids, size = self._ids([w for words in group for w in words])
        ends = np.r_[0, np.cumsum(size)][np.cumsum([len(words) for words in group])]
        return np.split(ids, ends[:-1])


@lru_cache(maxsize=2)
def _tokens(path: str) -> WordTokens:
    """One of a process, so that it is read once; a task leaves it the common words."""
    return WordTokens(path)


def tokenized(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """doc_id, part, before, n, ids: each document's ids, the task that read it, and the ids that
    the task had made before. ids: little-endian unsigned 32-bit. Written once."""

    columns = ["doc", "part", "before", "n", "ids"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, part, before = _tokens(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            docs_of, rows, held = iter(batch["doc"]), [], 0
            for ids in tokens.encode(batch["text"]):
                n = len(ids) + 1
                rows.append((next(docs_of), part, before, n, np.append(ids, np.uint32(end)).astype("<u4").tobytes()))
                before, held = before + n, held + n
                if held >= SLICE:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=columns)
        tokens.forget()

    # a null doc_id would turn its batch's numbers into doubles, so ids travel as text
    out = docs.select(F.col("doc_id").cast("string").alias("doc"), "text").mapInPandas(run, "doc string, part int, before bigint, n bigint, ids binary")
    with small_batches(docs.sparkSession):
        return stored(out.withColumn("doc_id", F.col("doc").cast(docs.schema["doc_id"].dataType)).drop("doc"), "ids")


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """The pieces of packed sequences: doc_id, start, length, ids, doc_tokens, sequence_id, offset
    and first/last, which tell pieces that a boundary cut. All sequences but the last are full."""
    ids = tokenized(docs, tokenizer, end)
    totals = ids.groupBy("part").agg(F.sum("n").alias("n"))  # a row for each task that read documents
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = totals.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    at = F.col("base") + F.col("before")
    placed = ids.join(F.broadcast(base), "part").select("doc_id", "n", "ids", at.alias("at"))  # 12 bytes a task
    window = F.explode(F.expr(f"sequence(at div {length}, (at + n - 1) div {length})"))
    pieces = placed.select("*", window.alias("sequence_id"))
    start = F.greatest(F.col("sequence_id") * length - F.col("at"), F.lit(0))
    stop = F.least((F.col("sequence_id") + 1) * length - F.col("at"), F.col("n"))
    pieces = pieces.withColumn("start", start).withColumn("length", stop - F.col("start"))
    return pieces.select(
        "doc_id",
        "start",
        "length",
        F.expr("substring(ids, cast(4 * start + 1 as int), cast(4 * length as int))").alias("ids"),
        F.col("n").alias("doc_tokens"),
        "sequence_id",
        ((F.col("at") + F.col("start")) % length).alias("offset"),
        (F.col("start") == 0).alias("first"),
        (F.col("start") + F.col("length") == F.col("n")).alias("last"),
    )


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, n_tokens and ids of each sequence, joined from its at most LENGTH ids."""
    part = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(F.transform(part, lambda p: p["ids"]), F.lit(b""), lambda a, x: F.concat(a, x))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))


@job
def packed_pieces(docs: DataFrame, tokenizer: str) -> DataFrame:
    """What described() tells of pack(); the ids themselves are deleted when it is written."""
    return described(pack(docs, tokenizer))


def described(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return packed_pieces(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer)
