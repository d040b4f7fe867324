"""Jaccard join of documents on word shingles, as a blocked sparse matrix product.

The matrix has a row per distinct shingle set and a column per shingle. It is never multiplied
as a whole: size-derived bounds pick the blocks in which a link is possible, and only these are
multiplied, slab of columns by slab, with overlap counts accumulated and tested exactly.

1. Sets. Each text becomes its set of 64-bit shingle hashes. Equal sets form one class, which a
   group of exact copies of any size thereby is; the join is between classes.
2. Prefixes. Two sets of n and m shingles link only if they share 4/9 (n + m); so, in any common
   order, they share k of their n - ceil(4n/5) + k first (k: a twentieth of the smaller). Classes
   that share fewer of their smallest hashes with all others together are done. The others' sets
   are made again.
3. Blocks. Shingles that many classes have in their prefixes are now put last in the order. Pairs
   that share fewer than k, also with what frequent shingles may add, cannot link. What remains
   are small candidate groups. Classes that consist of frequent shingles to four fifths, without
   which these alone make no link, are tied by a star for each such shingle, not by pairs.
4. Product. A group of at most BLOCK classes is one block (a class with a long set counts as
   several, so a block is bounded by its shingles). A larger one is cut by size and by hash, blocks
   are multiplied, and their links merged; classes that then are outside the group's largest
   component are multiplied with one another and with it, block by block, where sizes and the
   number of frequent shingles allow links, and those that share rare ones are compared as such.
   So no link is lost, and no group emits its pairs: a block returns a spanning forest of its links.

Defined results: a null or empty text, or one without words, has no shingles and links with
nothing. A text under five words is one shingle. Rows that share a doc_id are judged row by row,
and linked ones get one component_id. A null doc_id is linked as others are, but names no
component while any other row does. Extra columns are not read. An empty table gives no rows.
Hashes have 64 bits: a collision is the only way to a wrong count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import job, packed, small, stored, table
from .graph import components

WIDTH = 5
#: Classes in a block of the product, columns in a slab, and when a shingle counts as frequent.
BLOCK, SLAB, FREQUENT = 256, 8192, 24
#: Shingles of a class that count as one class in a block, and shares that a frequent one is cut into.
UNIT, SALTS = 16_384, 64
#: Bits of the maps of frequent shingles and of documents to read again: SPARSE for each of them,
#: within these bounds. Where a map fills up, more is looked at than need be, and no result changes.
LEAST_BITS, MOST_BITS, SPARSE = 20, 28, 32
_LOWEST = -(2**63)


class WordHashes(dict):
    """Hash of a word, remembered for at most `limit` words."""

    limit = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str | None, hashes: WordHashes, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = (text or "").encode().lower().split()
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))] if words else [], np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = len(w) - width + 1
    total = np.zeros(n, np.uint64)
    for i in range(width):
        total = total * np.uint64(0x9E3779B97F4A7C15) + w[i : i + n]
    total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    total ^= total >> np.uint64(32)
    return np.unique(total)


def _prefix(n: int, k: int) -> int:
    return n - (4 * n + 4) // 5 + k


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _class(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64))


def _classes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hashes = WordHashes()
    for batch in batches:
        sets = [shingles(t, hashes) for t in batch.pop("text")]
        yield batch.assign(
            n=[len(s) for s in sets],
            key=[_class(s) for s in sets],
            prefix=[s[: _prefix(len(s), max(1, len(s) // 20))].tobytes() if len(s) else b"" for s in sets],
        )


def _dealt(bins: int):
    """Prefixes as blobs by bin of the hash. A batch sends a hash once: where several of its classes
    have it, these are told so at once (rows of negative bins: classes and counts), and the hash
    goes on without owner. So a hash in a third of all prefixes is one entry per batch."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            h = np.frombuffer(b"".join(batch["prefix"]), np.uint64)
            owner = np.repeat(batch["key"].to_numpy(), batch["prefix"].str.len().to_numpy() // 8)
            order = np.argsort(h, kind="stable")
            h, owner = h[order], owner[order]
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            count = np.diff(np.r_[first, len(h)])
            key, times = np.unique(owner[np.repeat(count > 1, count)], return_counts=True)
            rows = [(-1 - int(h[0] % np.uint64(bins)), b"", times.astype(np.int32).tobytes(), key.tobytes())] if len(key) else []
            h, owner, count = h[first], owner[first], np.minimum(count, 255).astype(np.uint8)
            to = (h & np.uint64(0xFFFFFFFF)) % np.uint64(bins)
            order = np.lexsort((owner, to))  # by owner within a bin, which compresses
            met, starts = np.unique(to[order], return_index=True)
            for b, at in zip(met.tolist(), np.split(order, starts[1:]), strict=True):
                rows.append((b, (h[at] >> np.uint64(32)).astype(np.uint32).tobytes(), count[at].tobytes(), owner[at].tobytes()))
            yield pd.DataFrame(rows, columns=["bin", "h", "c", "owner"])

    return deal


def _met(rows: pd.DataFrame) -> pd.DataFrame:
    """Of a bin: how many of its hashes each class shares with others, and the hashes that more than
    FREQUENT share. Halves of hashes are compared: a chance match only lets a class be looked at
    more closely."""
    if rows["bin"].iloc[0] < 0:
        key, times = np.frombuffer(b"".join(rows["owner"]), np.int64), np.frombuffer(b"".join(rows["c"]), np.int32)
        return pd.DataFrame({"hot": False, "value": key, "shared": times})
    h = np.frombuffer(b"".join(rows["h"]), np.uint32)
    count = np.frombuffer(b"".join(rows["c"]), np.uint8)
    owner = np.frombuffer(b"".join(rows["owner"]), np.int64)
    order = np.argsort(h, kind="stable")
    h, count, owner = h[order], count[order], owner[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    total = np.add.reduceat(count.astype(np.int64), first)
    key, times = np.unique(owner[(np.repeat(total, np.diff(np.r_[first, len(h)])) > 1) & (count == 1)], return_counts=True)
    hot = h[first[total > FREQUENT]].astype(np.int64)
    return pd.DataFrame({"hot": np.r_[np.zeros(len(key), bool), np.ones(len(hot), bool)], "value": np.r_[key, hot], "shared": np.r_[times, np.zeros(len(hot), int)].astype(np.int32)})


def _bits(count: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, (SPARSE * count).bit_length()))


def _bit_map(slots: DataFrame, bits: int) -> np.ndarray:
    """A map of 2 ** bits bits, packed, set at the column `slot`."""
    at = F.col("slot") + 1
    parts = slots.groupBy(F.bitmap_bucket_number(at).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("m"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for b, part in parts.collect():  # at most 2 ** (bits - 15) rows
        out[(b - 1) * 4096 : b * 4096] = np.frombuffer(part, np.uint8)
    return out


def _is_set(bit_map: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bit_map[slots >> 3] >> (slots & 7).astype(np.uint8) & 1).astype(bool)


def _entries(hot: np.ndarray, bits: int):
    """The first shingles of each set in the common order, rare ones first. late: those that the
    map puts last; lates: their number in the whole set; whole: all rare ones are among the first."""

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            heads, flags, lates, whole = [np.zeros(0, np.uint64)], [np.zeros(0, bool)], [], []
            for blob in batch["shingles"]:
                s = np.frombuffer(blob, np.uint64)
                late = _is_set(hot, (s >> np.uint64(64 - bits)).astype(np.int64))
                size, rare = _prefix(len(s), max(1, len(s) // 20)), int((~late).sum())
                heads.append(np.r_[s[~late], s[late]][:size])
                flags.append(np.arange(len(heads[-1])) >= rare)
                lates.append(len(s) - rare)
                whole.append(rare <= size)
            size = [len(x) for x in heads[1:]]
            each = {"key": batch["key"].to_numpy(), "n": batch["n"].to_numpy(), "lates": np.array(lates, np.int32), "whole": np.array(whole, bool)}
            frame = pd.DataFrame({k: np.repeat(v, size) for k, v in each.items()})
            yield frame.assign(hash=_signed(np.concatenate(heads)), late=np.concatenate(flags))

    return entries


def block_links(sets: list[np.ndarray]) -> np.ndarray:
    """Which sets of a block link: the product of the block's incidence matrix with itself.

    Columns that only one set has add nothing and are left out. The others are taken in slabs of
    SLAB dense columns, so memory does not follow the texts' lengths.
    """
    m, size = len(sets), np.array([len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), size)
    shared = count > 1
    column, row = (np.cumsum(shared) - 1)[column[shared[column]]], row[shared[column]]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    overlap = np.zeros((m, m), np.int64)
    for start in range(0, int(shared.sum()), SLAB):
        a, b = np.searchsorted(column, (start, start + SLAB))
        slab = np.zeros((m, min(SLAB, int(shared.sum()) - start)), np.float32)
        slab[row[a:b], column[a:b] - start] = 1
        overlap += (slab @ slab.T).astype(np.int64)  # at most SLAB, which a float32 holds exactly
    return 180 * overlap >= 80 * (size[:, None] + size[None, :])


def _forest(rows: pd.DataFrame) -> pd.DataFrame:
    """A spanning forest of a block's links: each class with the least one it reaches."""
    rows = rows.drop_duplicates("key").sort_values("key")
    links = block_links([np.frombuffer(x, np.uint64) for x in rows["shingles"]])
    label = np.arange(len(rows))
    while True:
        least = np.where(links, label[None, :], len(rows)).min(axis=1)
        least = np.minimum(least, label)[np.minimum(least, label)]
        if (least == label).all():
            break
        label = least
    key = rows["key"].to_numpy()
    moved = label != np.arange(len(rows))
    return pd.DataFrame({"a": key[moved], "b": key[label[moved]]})


def _multiply(blocks: DataFrame, sets: DataFrame, *by: str) -> DataFrame:
    return sets.select("key", "shingles").join(small(blocks), "key").groupBy(*by).applyInPandas(_forest, "a bigint, b bigint")


def _cut_by_size(groups: DataFrame, slot: str) -> DataFrame:
    """groups (root, key, n, w) with a slot by size within the group, BLOCK weights to a slot.

    Places come from the counts of a group's sizes; of equally large classes the hash tells the
    place. So what a window orders is a group's distinct sizes, not its classes."""
    sizes = groups.groupBy("root", "n").agg(F.sum("w").alias("held"))
    before = F.sum("held").over(Window.partitionBy("root").orderBy("n")) - F.col("held")
    sizes = sizes.select("root", "n", "held", before.alias("before"))
    place = F.col("before") + F.pmod(F.xxhash64("key"), F.col("held"))
    return groups.join(sizes, ["root", "n"]).withColumn(slot, F.floor(place / BLOCK).cast("int")).drop("held", "before")


def link_classes(sets: DataFrame, hot: np.ndarray, bits: int) -> DataFrame:
    """(node, root) for every class of sets (key, n, shingles) that links with another."""
    entries = stored(sets.mapInPandas(_entries(hot, bits), "key bigint, n int, lates int, whole boolean, hash bigint, late boolean"), "entries")
    counts = stored(entries.groupBy("hash").agg(F.count("*").alias("c")).where("c > 1"), "counts")
    # the few hashes that very many classes have are met in a broadcast, the others in a shuffle
    many = small(stored(counts.where(F.col("c") > SALTS * FREQUENT), "many"))
    few = entries.join(many.select("hash"), "hash", "left_anti").join(counts.where(F.col("c") <= SALTS * FREQUENT), "hash")
    shared = stored(few.unionByName(entries.join(many, "hash")), "shared")
    often = shared.where(F.col("late") | (F.col("c") > FREQUENT))
    # of a class: first shingles that are frequent, and all shingles that no small bucket counts
    in_often = often.groupBy("key").agg(F.count("*").alias("often"), F.count_if(~F.col("late")).alias("early"))
    known = stored(entries.groupBy("key").agg(F.first("n").alias("n"), F.first("lates").alias("lates"), F.first("whole").alias("whole")), "known")
    known = known.join(in_often, "key", "left").select(
        "key", "n", "whole", F.coalesce("often", F.lit(0)).alias("often"), (F.col("lates") + F.coalesce("early", F.lit(0))).alias("uncounted")
    )
    known = stored(known, "known")

    # classes that may link by frequent shingles alone: with enough of them among the first, and,
    # where all rare ones are known to differ, in the whole set
    least_k = F.greatest(F.lit(1), F.floor(F.floor(F.col("n") * 4 / 5) / 20))
    alone = known.where((F.col("often") >= least_k) & (~F.col("whole") | (5 * F.col("uncounted") >= 4 * F.col("n"))))
    tied = stored(often.join(alone.select("key"), "key", "left_semi").select("hash", "key", F.pmod(F.xxhash64("key"), F.lit(SALTS)).alias("salt")).distinct(), "tied")
    # a star in two steps: a hash's classes are tied within each of SALTS shares, and the shares' least with one another
    share = stored(tied.groupBy("hash", "salt").agg(F.min("key").alias("b")), "share")
    whole = share.groupBy("hash").agg(F.min("b").alias("least"))
    star = tied.join(share, ["hash", "salt"]).select(F.col("key").alias("a"), "b").union(share.join(whole, "hash").select(F.col("b").alias("a"), F.col("least").alias("b"))).distinct()

    rare = shared.where(~F.col("late") & (F.col("c") <= FREQUENT)).select("hash", "key", "n")
    x, y = (rare.select("hash", *[F.col(c).alias(f"{c}_{i}") for c in ("key", "n")]) for i in "ab")
    near = (F.col("key_a") < F.col("key_b")) & (5 * F.col("n_a") >= 4 * F.col("n_b")) & (5 * F.col("n_b") >= 4 * F.col("n_a"))
    pairs = x.join(y, "hash").where(near).groupBy("key_a", "key_b").agg(F.count("*").alias("both"))
    for i in "ab":
        pairs = pairs.join(known.select(*[F.col(c).alias(f"{c}_{i}") for c in known.columns]), f"key_{i}")
    enough = F.col("both") + F.least("often_a", "often_b") >= F.greatest(F.lit(1), F.floor(F.least("n_a", "n_b") / 20))
    possible = 9 * (F.col("both") + F.least("uncounted_a", "uncounted_b")) >= 4 * (F.col("n_a") + F.col("n_b"))
    pairs = stored(pairs.where(enough & (~F.col("whole_a") | ~F.col("whole_b") | possible)).select(F.col("key_a").alias("a"), F.col("key_b").alias("b")), "pairs")

    # often: the most that two classes can share besides what `pairs` has counted; null if that is not known
    often = F.when(F.col("whole"), F.col("uncounted")).alias("often")
    weighed = known.select("key", "n", F.ceil(F.col("n") / UNIT).alias("w"), often)
    groups = components(star.union(pairs), "a", "b").select(F.col("node").alias("key"), "root").join(weighed, "key")
    groups = stored(groups, "groups")
    size = groups.groupBy("root").agg(F.sum("w").alias("size"))
    groups = stored(groups.join(size, "root"), "sized")
    parts = groups.where(F.col("size") <= BLOCK).select("root", F.lit(0).alias("salt"), F.lit(0).alias("slot"), "key")
    large = groups.where(F.col("size") > BLOCK)
    if large.isEmpty():
        return components(stored(_multiply(stored(parts, "cut"), sets, "root", "salt", "slot"), "links"), "a", "b")
    large = stored(_cut_by_size(large, "slot"), "cut-by-size")
    parts = parts.unionByName(large.select("root", F.lit(0).alias("salt"), "slot", "key"))
    by_hash = F.pmod(F.xxhash64("key"), F.ceil(F.col("size") / BLOCK)).cast("int")
    parts = parts.unionByName(large.select("root", F.lit(1).alias("salt"), by_hash.alias("slot"), "key"))
    first = stored(_multiply(stored(parts, "cut"), sets, "root", "salt", "slot"), "links")
    linked = components(first, "a", "b")

    large = large.drop("slot").join(linked.select(F.col("node").alias("key"), F.col("root").alias("part")), "key", "left")
    large = stored(large.withColumn("part", F.coalesce("part", "key")), "large")
    held = large.groupBy("root", "part").agg(F.count("*").alias("in_part"))
    main = held.groupBy("root").agg(F.max_by("part", F.struct("in_part", "part")).alias("main"))
    large = stored(large.join(main, "root").withColumn("rest", F.col("part") != F.col("main")), "parted")
    if large.where("rest").isEmpty():
        return linked
    more = stored(_multiply(stored(_across(large), "rows"), sets, "root", "i", "j"), "links")
    # pairs that share rare shingles may link by these: they are compared as such, by one of their classes
    part = large.select("key", "part")
    apart = pairs.join(part.toDF("a", "part_a"), "a").join(part.toDF("b", "part_b"), "b").where("part_a <> part_b").select("a", "b")
    many = apart.groupBy("a").agg(F.count("*").alias("c"))
    apart = stored(apart.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("c") / BLOCK)).alias("salt")), "apart")
    rows = apart.select("a", "salt", F.col("b").alias("key")).union(apart.select("a", "salt", F.col("a").alias("key")).distinct())
    rest = stored(_multiply(stored(rows, "rows"), sets, "a", "salt"), "links")
    return components(first.union(more).union(rest), "a", "b")


def _across(large: DataFrame) -> DataFrame:
    """root, i, j, key: the blocks in which classes outside a group's main component meet one another, each
    two blocks once, and those of the main one. Blocks are cut by size; blocks whose sizes, or whose frequent
    shingles, allow no link are not paired."""
    outside = stored(_cut_by_size(large.where("rest").select("root", "key", "n", "w", "often"), "i"), "outside")
    inside = stored(_cut_by_size(large.where("not rest").select("root", "key", "n", "w", "often"), "j"), "inside")

    def spans(rows: DataFrame, slot: str, of: str) -> DataFrame:
        known = F.when(F.count("often") == F.count("*"), F.max("often"))  # null: some may share more
        return rows.groupBy("root", F.col(slot).alias(of)).agg(F.min("n").alias(f"{of}_from"), F.max("n").alias(f"{of}_to"), known.alias(f"{of}_often"))

    sized = (5 * F.col("j_to") >= 4 * F.col("i_from")) & (5 * F.col("i_to") >= 4 * F.col("j_from"))
    shared = F.when(F.col("i_often").isNotNull() & F.col("j_often").isNotNull(), F.least("i_often", "j_often"))
    fits = sized & F.coalesce(9 * shared >= 4 * (F.col("i_from") + F.col("j_from")), F.lit(True))
    both = spans(outside, "i", "i").join(spans(outside, "i", "j"), "root").where(fits & (F.col("i") <= F.col("j")))
    meet = both.select("root", "i", "j").union(spans(outside, "i", "i").join(spans(inside, "j", "j"), "root").where(fits).select("root", "i", (-1 - F.col("j")).alias("j")))
    meet = stored(meet, "meet")
    rows = outside.join(meet, ["root", "i"]).select("root", "i", "j", "key")
    rows = rows.union(outside.withColumnRenamed("i", "j").join(meet, ["root", "j"]).select("root", "i", "j", "key"))
    rows = rows.union(inside.withColumn("j", -1 - F.col("j")).join(meet, ["root", "j"]).select("root", "i", "j", "key"))
    return rows.distinct()


def _doc() -> Column:
    return F.coalesce("doc_id", F.lit(_LOWEST)).cast("bigint").alias("doc")


@job
def linked_rows(docs: DataFrame) -> DataFrame:
    """doc (null as the least number), mark (xxhash64 of the text), n, key (of the set), n_copies,
    least and best for each row of docs (doc_id, text): the least doc_id of its component, and the
    (doc, mark) of the row that stands for it, both null without shingles."""
    spark = docs.sparkSession
    rows = docs.select(_doc(), F.xxhash64("text").alias("mark"), "text")
    read = stored(rows.mapInPandas(_classes, "doc bigint, mark bigint, n int, key bigint, prefix binary"), "classes")
    named = F.col("doc") != _LOWEST
    classes = stored(
        read.where("n > 0").groupBy("key").agg(
            F.min(F.struct("doc", "mark")).alias("of"), F.min(F.when(named, F.struct("doc", "mark"))).alias("least"), F.count("*").alias("n_copies"), F.first("n").alias("n")
        ),
        "counted",
    )
    prefixes = read.where("n > 0").groupBy("key").agg(F.first("prefix").alias("prefix"))
    total = read.agg(F.sum(F.length("prefix") / 8)).first()[0] or 0
    bins = int(max(int(spark.conf.get("spark.sql.shuffle.partitions")) * 2, total / 500_000))
    blobs = prefixes.mapInPandas(_dealt(bins), "bin int, h binary, c binary, owner binary")
    met = stored(blobs.groupBy("bin").applyInPandas(_met, "hot boolean, value bigint, shared int"), "met")
    shared = met.where("not hot").groupBy(F.col("value").alias("key")).agg(F.sum("shared").alias("shared"))
    chosen = stored(classes.join(shared, "key").where(F.col("shared") >= F.greatest(F.lit(1), F.floor(F.floor(F.col("n") * 4 / 5) / 20))).select("key", "of.doc", "of.mark"), "chosen")
    bits = _bits(chosen.count())
    slot = F.shiftrightunsigned(F.xxhash64("doc", "mark"), 64 - bits).alias("slot")
    wanted = spark.sparkContext.broadcast(_bit_map(chosen.select(slot), bits))

    def sets_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            found = [shingles(t, hashes) for t in batch["text"][_is_set(wanted.value, batch["slot"].to_numpy())]]
            yield pd.DataFrame({"key": [_class(s) for s in found], "n": [len(s) for s in found], "shingles": [s.tobytes() for s in found]})

    again = rows.select(slot, "text").mapInPandas(sets_of, "key bigint, n int, shingles binary")
    sets = stored(again.join(small(chosen.select("key")), "key", "left_semi"), "sets")
    # rows that are equal in id and text are read again together; a class is to stand for them once
    twice = stored(sets.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "twice")
    if not twice.isEmpty():
        once = sets.join(small(twice), "key", "left_semi").groupBy("key").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles"))
        sets = stored(sets.join(small(twice), "key", "left_anti").unionByName(once), "sets")
    hot = met.where("hot").select("value").distinct()
    bits = _bits(hot.count())
    linked = link_classes(sets, _bit_map(hot.select(F.shiftrightunsigned(F.shiftleft("value", 32), 64 - bits).alias("slot")), bits), bits)

    named = classes.join(linked.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    names = named.groupBy("root").agg(F.min("least").alias("best"))
    named = stored(named.join(names, "root").select("key", "best", "n_copies"), "named")
    # copies are many where their class is frequent: those few classes are met in a broadcast
    copied = small(stored(named.where(F.col("n_copies") > SALTS * FREQUENT), "copied"))
    rows = read.select("doc", "mark", "n", "key")
    rare = rows.join(copied.select("key"), "key", "left_anti").join(named.where(F.col("n_copies") <= SALTS * FREQUENT), "key", "left")
    return rare.unionByName(rows.join(copied, "key")).withColumn("least", F.col("best.doc"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and n_copies (rows with the same set) for each row of
    docs (doc_id, text)."""
    doc_id = F.when(F.col("doc") != _LOWEST, F.col("doc"))
    empty = F.col("n") == 0
    return linked_rows(docs).select(
        doc_id.alias("doc_id"),
        F.col("n").cast("bigint").alias("n_shingles"),
        F.when(empty, doc_id).otherwise(F.col("least")).alias("component_id"),
        F.when(empty, 1).otherwise(F.col("n_copies")).cast("bigint").alias("n_copies"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: of its least doc_id the text with the least xxhash64,
    and of rows equal in both the one with the least xxhash64 of its other columns. Rows without
    a doc_id stay, as do those without words."""
    rows = linked_rows(docs)
    seen = rows.where((F.col("n") > 0) & (F.col("doc") != _LOWEST))
    gone = stored(seen.where(F.struct("doc", "mark") != F.col("best")).select("doc", "mark").distinct(), "gone")
    whole = docs.select(packed(docs), _doc(), F.xxhash64("text").alias("mark"))
    kept = whole.join(small(gone), ["doc", "mark"], "left_anti")
    again = stored(seen.join(small(gone), ["doc", "mark"], "left_anti").groupBy("doc", "mark").agg(F.count("*").alias("c")).where("c > 1").select("doc", "mark"), "again")
    if again.isEmpty():
        return kept.select("_row.*")
    hashed = [f.name for f in docs.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    order = F.xxhash64(*[F.col("_row").getField(c) for c in hashed])
    once = kept.join(small(again), ["doc", "mark"], "left_semi").groupBy("doc", "mark").agg(F.min_by("_row", order).alias("_row"))
    return kept.join(small(again), ["doc", "mark"], "left_anti").select("_row.*").unionByName(once.select("_row.*"))


def op3_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_shingles", "component_id")


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN w ELSE w[i:i+4] END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL
), links AS MATERIALIZED (
  SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)
), reach AS (
  SELECT doc_id, doc_id AS r FROM documents UNION SELECT doc_id, b FROM reach JOIN links ON a = r
)
SELECT doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r)::BIGINT AS component_id
FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""
