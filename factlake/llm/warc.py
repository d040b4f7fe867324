"""WARC archives: a deterministic sharded writer, and a reader of what it wrote.

Writing. Records are sorted by page_id and payload digest, and cut into shards of about equal bytes:
of the pairs that a hash chooses, about PER_SHARD a shard, every PER_SHARD-th begins one, so equal
tables give equal shards whatever the cluster, and a page_id with very many payloads is cut as well.
Which records are revisits is decided on digests alone; the decision travels as a row of its own that
sorts before its records, so payloads are shuffled once. A task writes its shards in order, starts a
new file when the compressed size is reached, and makes headers and digests anew. Files are written
under a temporary name with the attempt in it, renamed when complete, and listed in a manifest,
itself a table that Spark commits: files that it does not list do not count, and a repeated task
writes the same bytes over the same name.

Reading takes the manifest's files, one at a time, record by record.

Defined results: a null html is the empty payload, a null url the empty target. Rows that share
a page_id are records each; among equal payloads of one page_id the first written is the response,
and rows equal in both are written by one task, all but one of them as revisits if they are long.
A null page_id is written as an empty id and is below all others. An empty table gives an empty
manifest and no records. Columns other than the three are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, job, scratch, small, stored, table

#: Compressed bytes of a file, least payload that is not written twice, and bytes that a reader holds, about.
FILE_BYTES, REVISIT_BYTES, HELD = 16 << 20, 1000, 4 << 20
#: Payload bytes of a shard: a share of the table within these bounds; pairs that tell where one ends.
SHARDS, LEAST_BYTES, MOST_BYTES, PER_SHARD = 64, 4 << 20, 256 << 20, 32
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_LOWEST = -(2**63)


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _record_id(page: str, digest: bytes) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page}:{digest.hex()}')}>"


def record(page: str, url: str, payload: bytes, original: str | None) -> bytes:
    """One gzip member. original: the page_id of the response that a revisit stands for."""
    digest = hashlib.sha1(payload).digest()
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head + payload if original is None else head
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if original is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {''.join(url.splitlines())}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        f"X-Page-ID: {page}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if original is not None:
        lines[5:5] = [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(original, digest)}", f"X-Refers-To-Page: {original}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


class _Files:
    """The files of one shard: temporary until complete, then renamed and listed."""

    def __init__(self, store: fs.FileSystem, folder: str, limit: int):
        self.store, self.folder, self.limit = store, folder, limit
        self.shard, self.out, self.rows = -1, None, []

    def add(self, shard: int, member: bytes) -> None:
        if self.out is not None and (shard != self.shard or self.size + len(member) > self.limit):
            self.close()
        if self.out is None:
            self.number = self.number + 1 if shard == self.shard else 0
            self.shard, self.size, self.records, self.sha = shard, 0, 0, hashlib.sha256()
            self.name = f"shard-{shard:06d}-{self.number:05d}.warc.gz"
            self.temporary = f"{self.folder}/.{self.name}.{TaskContext.get().taskAttemptId()}"
            self.out = self.store.open_output_stream(self.temporary)
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)
        self.records += 1

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.store.move(self.temporary, f"{self.folder}/{self.name}")
            self.rows.append((self.name, self.shard, self.records, self.size, self.sha.hexdigest()))
            self.out = None

    def listed(self) -> pd.DataFrame:
        rows, self.rows = self.rows, []
        return pd.DataFrame(rows, columns=["file", "shard", "records", "bytes", "sha256"])


def _writer(folder: str, limit: int):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = _store(folder)
        files = _Files(store, path, limit)
        of, top, first = None, None, True  # the pair at hand, its decision, whether none was written
        for batch in batches:
            for shard, page, digest, kind, url, payload, kept in batch.itertuples(index=False, name=None):
                page, digest = int(page), bytes(digest)
                if (page, digest) != of:
                    of, top, first = (page, digest), None, True
                if kind == 0:
                    top = int(kept)
                    continue
                name = "" if page == _LOWEST else str(page)
                response = top is None or (top == page and first)
                first = False
                original = None if response else "" if top == _LOWEST else str(top)
                files.add(int(shard), record(name, url, bytes(payload), original))
            yield files.listed()
        files.close()
        yield files.listed()

    return write


def _starts(rows: DataFrame, every: int) -> list[tuple[int, int]]:
    """Where shards begin but the first: of the pairs (page, d) that a hash chooses, one in `every`,
    each PER_SHARD-th in their order. The driver gets these alone, one for each shard."""
    chosen = rows.select("page", "d").where(F.pmod(F.xxhash64("page", "d"), F.lit(every)) == 0)
    ordered = chosen.repartitionByRange("page", "d").sortWithinPartitions("page", "d")
    ordered = stored(ordered.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "chosen")
    held = ordered.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("first"))  # a row per task
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.col("at") - F.col("first") + F.col("before")
    cuts = ordered.join(small(stored(held.withColumn("before", before), "held")), "part").where((place % PER_SHARD == 0) & (place > 0))
    return sorted({(r.page, r.d) for r in cuts.select("page", "d").collect()})


@job
def write_archives(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html) to a new folder in the shared store; returns the manifest:
    file, shard, records, bytes, sha256."""
    store, path = _store(folder)
    store.create_dir(path, recursive=True)
    spark = pages.sparkSession
    page = F.coalesce("page_id", F.lit(_LOWEST)).cast("bigint")
    rows = pages.select(page.alias("page"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    digest, size = F.unhex(F.sha1("payload")).alias("digest"), F.length("payload").alias("size")

    digests = stored(rows.select("page", digest, size).withColumn("d", F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("bigint")), "digests")
    long = digests.where(F.col("size") >= revisit_bytes).select("page", "digest")
    tops = long.groupBy("digest").agg(F.max("page").alias("top"), F.count("*").alias("n")).where("n > 1").drop("n")
    decisions = stored(long.distinct().join(tops, "digest"), "decisions")

    count, total = digests.agg(F.count("*"), F.sum("size")).first()
    shard_bytes = min(MOST_BYTES, max(LEAST_BYTES, (total or 0) // SHARDS))
    shard_rows = max(1, count * shard_bytes // max(1, total or 0))
    starts = spark.sparkContext.broadcast(_starts(digests, max(1, shard_rows // PER_SHARD)))
    both = rows.select("page", digest, F.lit(1).alias("kind"), "url", "payload", F.lit(0).cast("bigint").alias("top")).union(
        decisions.select("page", "digest", F.lit(0).alias("kind"), F.lit("").alias("url"), F.lit(b"").alias("payload"), "top")
    )

    def shard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = zip(batch["page"].tolist(), (int.from_bytes(x[:7], "big") for x in batch["digest"]), strict=True)
            batch.insert(0, "shard", [bisect_right(starts.value, x) for x in pairs])
            yield batch

    schema = "shard int, page bigint, digest binary, kind int, url string, payload binary, top bigint"
    sharded = both.mapInPandas(shard, schema).repartitionById(len(starts.value) + 1, "shard")  # a task for each shard
    ordered = sharded.sortWithinPartitions("shard", "page", "digest", "kind", "url", "payload")
    return ordered.mapInPandas(_writer(folder, file_bytes), "file string, shard int, records int, bytes bigint, sha256 string")


def _records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive, one record in memory at a time."""
    with gzip.GzipFile(fileobj=io.BufferedReader(stream, 1 << 20)) as f:
        while line := f.readline():
            if line.rstrip() != b"WARC/1.1":
                raise ValueError(f"no WARC record here: {line[:40]!r}")
            headers = {}
            while (line := f.readline().rstrip(b"\r\n")) != b"":
                name, _, value = line.decode().partition(": ")
                headers[name] = value
            block = f.read(int(headers["Content-Length"]))
            if f.read(4) != b"\r\n\r\n":
                raise ValueError("a record does not end where its length says")
            yield headers, block


def _reader(folder: str, payloads: bool):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = _store(folder)
        for batch in batches:
            for name in batch["file"]:
                rows, held = [], 0
                with store.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for h, block in _records(stream):
                        if hashlib.sha1(block).digest() != base64.b32decode(h["WARC-Block-Digest"][5:]):
                            raise ValueError(f"{name}: a block has another digest")
                        payload = block.split(b"\r\n\r\n", 1)[1] if h["WARC-Type"] == "response" else None
                        digest = base64.b32decode(h["WARC-Payload-Digest"][5:]).hex()
                        size = int(h["X-Payload-Length"])
                        if payload is not None and (len(payload), hashlib.sha1(payload).hexdigest()) != (size, digest):
                            raise ValueError(f"{name}: a payload has another digest")
                        payload = payload if payloads else None
                        held += len(payload or b"") + 1000
                        rows.append((h["X-Page-ID"], h["WARC-Target-URI"], payload, size, digest, h["WARC-Type"], h.get("X-Refers-To-Page")))
                        if held >= HELD:
                            yield pd.DataFrame(rows, columns=_COLUMNS)
                            rows, held = [], 0
                yield pd.DataFrame(rows, columns=_COLUMNS)

    return read


_COLUMNS = ["page", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers"]


def read_archives(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the manifest's files; digests and lengths are verified. A revisit has no payload, nor has
    any record if they are not asked for."""
    count, size = manifest.agg(F.count("*"), F.sum("bytes")).first()
    tasks = max(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), (size or 0) // FILE_BYTES)
    files = manifest.select("file").repartition(max(1, min(count, tasks)))
    schema = "page string, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers string"
    rows = files.mapInPandas(_reader(folder, payloads), schema)
    number = lambda c: F.when(F.col(c) != "", F.col(c).cast("bigint"))
    return rows.select(number("page").alias("page_id"), "url", "payload", "payload_bytes", "payload_digest", "record_type", number("refers").alias("refers_to"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{scratch(spark)}/warc-{uuid.uuid4().hex}"
    manifest = write_archives(table(spark, sf_dir, "pages", "page_id", "url", "html"), folder)
    read = read_archives(manifest, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    out = stored(read, "records")
    discard(spark, folder)
    return out


OP8_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS digest FROM p),
t AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS top FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= {REVISIT_BYTES} AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= {REVISIT_BYTES} AND page_id <> top THEN top END AS refers_to
FROM t
"""
