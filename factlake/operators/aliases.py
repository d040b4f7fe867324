"""Names from a dictionary of any size, found anywhere in texts: an inverted index of grams, and verification.

Each alias is filed under one gram of it, the one that fewest aliases have, so that no gram has many. Texts
are cut into short segments that overlap by an alias's length, and every gram of a segment meets the index in
an equality join; what it finds is looked for in the segment. A text is never paired with the dictionary.

That index is for a dictionary to broadcast. Beyond it a map of bits tells of every place and length of a text
whether an alias may stand there (a Bloom filter), so that no other part of a text is shuffled; what may be an
alias meets the dictionary in an equality join. Only the map, of MAP bits at most, goes to the driver and tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import SMALL_ROWS, written

#: Code points of a gram: the most that an alias has, so that a gram of long aliases is rare in texts; shorter
#: aliases are grams themselves. Code points of a segment at least.
GRAMS, SEGMENT = (8, 5), 128
#: Bits of the map for each alias, and at most in all (a fuller map lets more through, which costs time alone);
#: bits of a block of it, where all bits of an alias lie, and how many these are.
EACH, MAP, BLOCK, PROBES = 32, 2**29, 2**15, 8
#: Aliases of so many code points or more are looked for by their beginnings. Code points of a piece of text
#: at least, and of the pieces that a task holds at once, about. Lengths of a piece that are looked up first.
LONG, PIECE, TOGETHER, LENGTHS = 32, 4096, 2**17, 3

_ODD = 0x9E3779B97F4A7C15


def _grams(text: Column, size: Column | int) -> Column:
    """All grams of this many code points of a short text."""
    last = F.length(text) - size + 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(size) if isinstance(size, int) else size))).otherwise(F.array())


def _distinct(aliases: DataFrame) -> DataFrame:
    """Each alias, name once; null and empty ones are left out. Written."""
    return written(aliases.select("alias", "name").where("alias <> ''").distinct(), "names")


def index(rows: DataFrame) -> DataFrame:
    """gram, alias, name: each of the distinct aliases (alias, name) under its rarest gram. Written once."""
    size = F.coalesce(*[F.when(F.length("alias") >= n, n) for n in GRAMS], F.length("alias"))
    filed = rows.select("alias", "name", F.explode(F.array_distinct(_grams(F.col("alias"), size))).alias("gram"))
    common = filed.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = filed.hint("merge").join(common, "gram").groupBy("alias", "name").agg(F.min(F.struct("n", "gram")).alias("g"))
    return written(rarest.select(F.col("g.gram").alias("gram"), "alias", "name"), "aliases")


def _segments(rows: DataFrame, key: str, text: Column, longest: int, least: int = SEGMENT) -> DataFrame:
    """key, place, segment: parts of each text, each with the beginning of the next, so that an alias
    stands in one of them as a whole. Cut in one pass, however long the text."""
    size = max(least, longest)
    parts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    cut = rows.select(key, parts.alias("parts")).select(key, "parts", F.posexplode("parts").alias("place", "part"))
    after = F.coalesce(F.get("parts", F.col("place") + 1), F.lit(""))
    return cut.select(key, "place", F.concat("part", F.substring(after, 1, longest - 1)).alias("segment"))


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers whose bits all depend on all bits of x."""
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


class _Joined:
    """Texts one after another, in code points, and hashes of any parts of them."""

    def __init__(self, texts: list[str]):
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.ends = np.cumsum([len(x) for x in texts])
        self.starts = self.ends - [len(x) for x in texts]
        power = lambda base: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(codes), base, np.uint64)]), dtype=np.uint64)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(codes + np.uint64(1)) * power(_ODD)[:-1], dtype=np.uint64)])
        self.back = power(pow(_ODD, -1, 2**64))

    def hashes(self, at: np.ndarray, n) -> np.ndarray:
        """Of the n code points at each place: the same for the same code points, wherever they stand."""
        return _mixed((self.sums[at + n] - self.sums[at]) * self.back[at] + np.asarray(n).astype(np.uint64) * np.uint64(_ODD))


def _block(h: np.ndarray, blocks: int) -> np.ndarray:
    return (h >> np.uint64(40)).astype(np.int64) & (blocks - 1)


def _probe(h: np.ndarray, i: int) -> np.ndarray:
    """The place of each hash's i-th bit in its block."""
    first, step = h & np.uint64(BLOCK - 1), (h >> np.uint64(15)) | np.uint64(1)
    return ((first + np.uint64(i) * step) & np.uint64(BLOCK - 1)).astype(np.int64)


def _hashed(blocks: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            joined = _Joined(list(batch["gram"]))
            h = joined.hashes(joined.starts, joined.ends - joined.starts)
            yield pd.DataFrame({"block": _block(h, blocks), "h": h.view(np.int64)})

    return run


def _bits(group: pd.DataFrame) -> pd.DataFrame:
    """One block of the map."""
    bits, h = np.zeros(BLOCK, bool), group["h"].to_numpy().view(np.uint64)
    for i in range(PROBES):
        bits[_probe(h, i)] = True
    return pd.DataFrame({"block": group["block"].iloc[:1], "bits": [np.packbits(bits, bitorder="little").tobytes()]})


def _map(filed: DataFrame, n: int) -> np.ndarray:
    """The map of these grams: a row a block, worked out where the block's hashes are."""
    blocks = 2 ** max(0, (min(n * EACH, MAP) // BLOCK - 1).bit_length())
    hashes = filed.select("gram").distinct().mapInPandas(_hashed(blocks), "block int, h bigint")
    out = np.zeros((blocks, BLOCK // 8), np.uint8)
    for r in hashes.groupBy("block").applyInPandas(_bits, "block int, bits binary").toLocalIterator():
        out[r.block] = np.frombuffer(r.bits, np.uint8)
    return out


def _may_stand(bits: np.ndarray, joined: _Joined, at: np.ndarray, n: int) -> np.ndarray:
    """Of these places those where, by the map, an alias of n code points may stand."""
    h = joined.hashes(at, n)
    for i in range(PROBES):
        place = _probe(h, i)
        hit = (bits[_block(h, len(bits)), place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
        at, h = at[hit], h[hit]
    return at


def _found(shared, lengths: list[int], longest: int, first: int | None) -> Callable:
    """Of each piece (key, _piece, segment) the parts that may be aliases, from the longest on: of `first` lengths, or of all."""

    def parts(segments: list[str]) -> Iterator[tuple]:
        joined = _Joined(segments)
        owner = np.repeat(np.arange(len(segments)), joined.ends - joined.starts)
        places, ends = np.arange(len(owner)), joined.ends[owner]
        found, open_ = np.zeros(len(segments), int), np.ones(len(segments), bool)
        for n in lengths:
            at = _may_stand(shared.value, joined, places[ends - places >= n], n)
            for p in at:
                k = int(owner[p])
                here = int(p - joined.starts[k])
                yield k, segments[k][here : here + n], segments[k][here : here + longest] if n == LONG else None
            found[np.unique(owner[at])] += 1
            if first and (found[open_] >= first).any():
                open_ = found < first
                kept = open_[owner[places]]
                places, ends = places[kept], ends[kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            segments = batch.column("segment").to_pylist()
            cuts = np.cumsum([len(s) for s in segments]) // TOGETHER
            for cut in np.unique(cuts):
                mine = np.flatnonzero(cuts == cut)
                rows = [*parts([segments[i] for i in mine])]
                own = pa.array(mine[[k for k, _, _ in rows]] if rows else [], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(own), batch.column(1).take(own), pa.array([g for _, g, _ in rows], pa.string()), pa.array([x for _, _, x in rows], pa.string())],
                    names=[batch.schema.names[0], "_piece", "gram", "tail"],
                )

    return run


def _looked_up(pieces: DataFrame, key: str, filed: DataFrame, run: Callable) -> tuple[DataFrame, DataFrame]:
    """The parts of pieces that may be aliases (key, _piece, gram, tail), written, and those that are (key, _piece, alias, name)."""
    kind = pieces.schema[key].dataType.simpleString()
    may = written(pieces.select(key, "_piece", "segment").mapInArrow(run, f"`{key}` {kind}, _piece string, gram string, tail string").distinct(), "parts")
    stands = F.col("tail").isNull() | F.startswith("tail", "alias")
    return may, may.hint("merge").join(filed, "gram").where(stands).select(key, "_piece", "alias", "name")


def _pieces(rows: DataFrame, key: str, text: Column, filed: DataFrame, n: int) -> tuple[DataFrame, Callable]:
    """Pieces of the texts (key, _piece, segment; equal ones have one number), and what looks through them for the aliases."""
    longest, sizes = filed.agg(F.max(F.length("alias")), F.collect_set(F.length("gram"))).first()  # sizes up to LONG
    shared = rows.sparkSession.sparkContext.broadcast(_map(filed, n))
    pieces = _segments(rows, key, text, longest, PIECE).select(key, F.md5(F.col("segment").cast("binary")).alias("_piece"), "segment")
    return pieces, lambda first: _found(shared, sorted(sizes, reverse=True), longest, first)


def _filed(names: DataFrame) -> DataFrame:
    """gram, alias, name: aliases by themselves, long ones by their beginnings."""
    return names.select(F.substring("alias", 1, LONG).alias("gram"), "alias", "name")


def contained(rows: DataFrame, key: str, text: Column, aliases: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """key, alias, name: every alias that stands in a row's text, as it is written; once for each key.

    The index is broadcast if it has at most `most` rows, counted; beyond that a map of bits is.
    """
    names = _distinct(aliases)
    n = names.count()
    if n > most:
        filed = _filed(names)
        pieces, looked = _pieces(rows, key, text, filed, n)
        return _looked_up(pieces, key, filed, looked(None))[1].select(key, "alias", "name").distinct()
    return _by_index(rows, key, text, names)


def _by_index(rows: DataFrame, key: str, text: Column, names: DataFrame) -> DataFrame:
    filed = index(names)
    longest, sizes = filed.agg(F.max(F.length("alias")), F.collect_set(F.length("gram"))).first()  # sizes up to the largest of GRAMS
    pieces = _segments(rows, key, text, longest or 1)
    all_grams = F.explode(F.array_distinct(F.concat(F.array().cast("array<string>"), *[_grams(F.col("segment"), int(s)) for s in sorted(sizes)])))
    found = pieces.select(key, "segment", all_grams.alias("gram")).join(F.broadcast(filed), "gram")
    return found.where(F.col("segment").contains(F.col("alias"))).select(key, "alias", "name").distinct()


def longest_in(rows: DataFrame, key: str, text: Column, aliases: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """key, alias, name of the rows whose text holds an alias: the longest; of equally long ones the first
    by alias, then by name.

    With more than `most` aliases a text's longest parts that may be one are looked up, and all of its parts
    only if none of these was.
    """
    names = _distinct(aliases)
    n = names.count()
    if n > most:
        filed = _filed(names)
        pieces, looked = _pieces(rows, key, text, filed, n)
        may, found = _looked_up(pieces, key, filed, looked(LENGTHS))
        found = written(found, "found")
        full = may.groupBy("_piece").agg(F.count_distinct(F.length("gram")).alias("n")).where(F.col("n") >= LENGTHS).select("_piece")
        missed = written(full.hint("merge").join(found.select("_piece").distinct(), "_piece", "left_anti"), "missed")
        if missed.take(1):
            again = pieces.hint("merge").join(missed, "_piece", "left_semi")
            found = found.unionByName(_looked_up(again, key, filed, looked(None))[1])
    else:
        found = _by_index(rows, key, text, names)
    best = F.min(F.struct((-F.length("alias")).alias("less"), "alias", "name"))
    return found.groupBy(key).agg(best.alias("b")).select(key, "b.alias", "b.name")
