"""Line dedup: repeated long lines go from all documents but one, as keep bitmaps.

The method. A row per long line (hash, document, row, line) is written once, without text. Rows are
dealt by ranges of (hash, document, row, line), so that a line of a third of all documents is spread
over as many tasks as its rows need, and sorted by hash, then document, largest first, and position.
One pass over a sorted partition streams the runs of a hash: its first document keeps the line, the
others lose it where enough documents hold it. Hashes whose run may go on in another task, the first
and the last of a partition and those with very many rows, are left open by the stream, and settled
by an aggregate over these few. A document's decision is a compressed bitmap over its lines.

Defined results
- A null or empty text is one empty line. A line under 20 code points after stripping is kept.
- A row is a document. Rows that share a doc_id count one by one, and each of them keeps the
  line if that doc_id is the largest. A null doc_id counts, is below all others, and where only
  such rows hold a line, they keep it.
- A key that a document has on several lines counts once; all of these lines go or stay.
- Extra columns, whatever their names, pass through. An empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import columns, job, small, stored, table

MIN_CHARS, MIN_DOCS = 20, 3
SPACES = " \t\n\x0b\x0c\r"
LOWER = {c: c + 32 for c in range(65, 91)}
#: Rows of a hash that a task holds at most, rows to a partition, and bytes of bitmaps to be broadcast.
HELD, SHARE, SMALL_BYTES = 100_000, 1_000_000, 32 << 20
#: What kept_text adds.
COUNTS = ("_n_lines", "_n_dropped", "_n_long_left")
#: Stands for a null doc_id: below all others.
LOWEST = -(2**63)


LINE = "a bigint, b bigint, doc bigint, row bigint, line int, mark bigint, n_lines int"


def _hashed(min_chars: int):
    """A row for each long line: the halves of its hash, its document, row and place."""

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            digests, places, counts, long = [], [], [], []
            for text in batch["text"]:
                own = [x.strip(SPACES) for x in (text or "").split("\n")]
                at = [i for i, x in enumerate(own) if len(x) >= min_chars]
                digests += [xxhash.xxh3_128_digest(own[i].translate(LOWER).encode()) for i in at]
                places += at
                counts.append(len(own))
                long.append(len(at))
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            of = np.repeat(np.arange(len(batch)), long)
            yield pd.DataFrame(
                {
                    "a": halves[:, 0],
                    "b": halves[:, 1],
                    "doc": batch["doc"].to_numpy()[of],
                    "row": row + of,
                    "line": np.array(places, np.int32),
                    "mark": batch["mark"].to_numpy()[of],
                    "n_lines": np.array(counts, np.int32)[of],
                }
            )
            row += len(batch)

    return lines


def _runs(min_docs: int, limit: int):
    """Streams rows sorted by (a, b, doc descending, row, line): those that lose their line, and the
    open ones. Only the run at hand is kept from batch to batch, up to `limit` rows of it."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, opened = None, None  # rows of the run at hand; the hash whose rows are all left open
        for batch in batches:
            if not len(batch):
                continue
            if opened is None:
                opened = (batch["a"].iat[0], batch["b"].iat[0])
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            a, b, doc, row = (rows[c].to_numpy() for c in ("a", "b", "doc", "row"))
            new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
            starts = np.flatnonzero(new)
            run = np.cumsum(new) - 1
            another = new | np.r_[True, row[1:] != row[:-1]]
            docs = np.add.reduceat(another.astype(np.int64), starts)
            left = (a == opened[0]) & (b == opened[1])
            last = run == len(starts) - 1
            keep = last & ~left
            if keep.sum() > limit:
                opened, left, keep = (a[-1], b[-1]), left | last, keep & False
            gone = ~left & ~keep & (docs[run] >= min_docs) & (doc != doc[starts][run])
            held = rows[keep] if keep.any() else None
            yield rows[gone | left].assign(left=left[gone | left])
        if held is not None:
            yield held.assign(left=True)

    return scan


def _bitmaps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Compressed bits, one per line: 1 stays, 0 goes."""
    for batch in batches:
        maps = []
        for n, gone in zip(batch["n_lines"], batch.pop("gone"), strict=True):
            bits = np.ones(n, np.uint8)
            bits[np.asarray(gone, np.int64)] = 0
            maps.append(zlib.compress(np.packbits(bits).tobytes()))
        yield batch.assign(keep=maps)


def _doc() -> Column:
    return F.coalesce("doc_id", F.lit(LOWEST)).cast("bigint").alias("doc")


@job
def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc, mark, n_lines, keep) for each text that loses lines; other texts keep all.

    docs: doc_id, text. `mark` is xxhash64 of the text, so that rows that share a doc_id are told
    apart; doc is the doc_id with null as LOWEST.
    """
    rows = docs.select(_doc(), F.xxhash64("text").alias("mark"), "text")
    lines = stored(rows.mapInPandas(_hashed(min_chars), LINE), "lines")
    shares = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), lines.count() // SHARE)
    order = ["a", "b", F.desc("doc"), "row", "line"]
    dealt = lines.repartitionByRange(shares, *order).sortWithinPartitions(*order)
    seen = stored(dealt.mapInPandas(_runs(min_docs, HELD), LINE + ", left boolean"), "runs")
    # the open hashes: two to a partition, and those of more than HELD rows
    left = seen.where("left")
    totals = left.select("a", "b", "doc", "row").distinct().groupBy("a", "b").agg(F.count("*").alias("docs"), F.max("doc").alias("top"))
    totals = stored(totals.where(F.col("docs") >= min_docs).drop("docs"), "totals")
    gone = seen.where("not left").unionByName(left.join(small(totals), ["a", "b"]).where("doc <> top").drop("top"))
    each = gone.groupBy("doc", "mark", "n_lines").agg(F.collect_set("line").alias("gone"))
    return each.mapInPandas(_bitmaps, "doc bigint, mark bigint, n_lines int, keep binary")


def _cut(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs' columns as c0, c1 ... with text cut to the lines kept, then COUNTS."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index("text")
    schema = StructType([StructField(n, f.dataType) for n, f in zip(names, docs.schema, strict=True)] + [StructField(c, LongType()) for c in COUNTS])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for text, keep in zip(batch[names[at]].to_pylist(), batch["keep"].to_pylist(), strict=True):
                lines = (text or "").split("\n")
                stay = lines
                if keep is not None:
                    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
                    stay = [x for x, b in zip(lines, bits, strict=True) if b]
                    text = "\n".join(stay)
                texts.append(text)
                counts.append((len(lines), len(lines) - len(stay), sum(len(x.strip(SPACES)) >= MIN_CHARS for x in stay)))
            n = np.array(counts, np.int64).reshape(-1, 3)
            own = [pa.array(texts, pa.string()) if c == names[at] else batch[c] for c in names]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(n[:, i]) for i in range(3))], [*names, *COUNTS])

    rows = docs.select(*[c.alias(n) for c, n in zip(columns(docs), names, strict=True)], _doc(), F.xxhash64("text").alias("mark"))
    maps = bitmaps.select("doc", "mark", "keep")
    held = maps.agg(F.sum(F.length("keep") + 16)).first()[0] or 0
    maps = small(maps) if held <= SMALL_BYTES else maps  # where they are few bytes, no text is shuffled
    return rows.join(maps, ["doc", "mark"], "left").drop("doc", "mark").mapInArrow(cut, schema)


def kept_text(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with its columns, text cut to the lines kept, and _n_lines, _n_dropped, _n_long_left:
    lines before, lines dropped, and lines of MIN_CHARS or more that stay."""
    return _cut(docs, bitmaps).toDF(*docs.columns, *COUNTS)


@job
def _without_copied_lines(docs: DataFrame) -> DataFrame:
    """without_copied_lines(), with columns c0, c1 ..."""
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    out = _cut(docs, keep_bitmaps(docs)).where((F.col("_n_dropped") == 0) | F.col(at["text"]).rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in at:
        out = out.withColumn(at["n_chars"], F.length(at["text"]).cast(docs.schema["n_chars"].dataType))
    return out.drop(*COUNTS)


def without_copied_lines(docs: DataFrame) -> DataFrame:
    """docs with text cut and n_chars anew. Only a document of which nothing but white space is left
    goes; all others keep their remaining lines, however short. Written, so that its batches to
    Python are bounded whatever the session's settings are."""
    return _without_copied_lines(docs).toDF(*docs.columns)


@job
def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the digest of what is kept, for each row of docs (doc_id, text)."""
    out = kept_text(docs, keep_bitmaps(docs))
    return out.select(
        "doc_id",
        F.col("_n_lines").alias("n_lines"),
        F.col("_n_dropped").alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents", "doc_id", "text"))


_LINES_SQL = r"""
  SELECT doc_id, i, lines[i] AS line,
    translate(regexp_replace(regexp_replace(lines[i], '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))
"""
OP4_SQL = rf"""
WITH l AS ({_LINES_SQL}), r AS (
  SELECT key, max(doc_id) AS top FROM l WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}
), j AS (
  SELECT doc_id, i, line, r.key IS NOT NULL AND doc_id <> top AS gone FROM l LEFT JOIN r USING (key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
