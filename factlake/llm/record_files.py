"""Record files: documents' ids as length-delimited binary records, in order, with an index beside them.

A file is a row of frames: length (8 bytes), masked CRC-32C of the length, payload, masked CRC-32C of the
payload, all little-endian, as the public TFRecord format frames its records. A payload is the length of
the document's id as text (4 bytes, -1 for null), the id in UTF-8, the bytes of one token id (2 where all
of the document's fit, else 4), and the ids. The index has the offset and the number of ids of every
record, then how many there are and a masked CRC-32C, so that any record is read by one seek.

Documents are dealt by range of doc_id and sorted; a task turns its texts into ids and writes its range,
a new file where one is full. Files are written under a temporary name with the attempt in it, renamed
when complete, index first, and listed in a manifest that Spark commits: what it does not list does not
count, and a repeated task writes the same bytes. The place of the first id of a file is a prefix sum over
the manifest, a row a file.

Defined results: a null or empty text is the end id alone. Rows that share a doc_id are records each, in
the order of their texts' hashes, so a doc_id that very many rows share is cut into ranges, too; a null
doc_id comes first. An empty table gives an empty manifest and no records. Only doc_id and text are read.
A task holds SLICE bytes of text and ids, or one document's.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, job, release, scratch, small_batches, stored, table
from .packing import END, SLICE, _tokens

#: Bytes of text in a task's range, about, and of a file at most, but for its last record.
RANGE_BYTES, FILE_BYTES = 64 << 20, 128 << 20
# Fixed values of the format: the reflected polynomial of CRC-32C and what a masked sum is moved by.
POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8
#: Bytes of a lane of the checksum; a payload is cut into lanes, which are summed side by side.
LANE = 128


@lru_cache(maxsize=1)
def _two_bytes() -> np.ndarray:
    """What two bytes make of a register that is otherwise zero."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(POLYNOMIAL), one >> 1)
    x = np.arange(1 << 16, dtype=np.uint32)
    for _ in range(2):
        x = one[x & 255] ^ (x >> 8)
    return x


@lru_cache(maxsize=64)
def _zeros(k: int) -> np.ndarray:
    """What 2**k zero bytes make of a register, a table for each of its bytes: (4, 256)."""
    if k == 0:
        bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
        two = _two_bytes()
        images = two[(bits << 8) & 0xFFFF] ^ (bits >> 8)  # one zero byte: two after the register was moved up by one
    else:
        images = _after(_after(np.uint32(1) << np.arange(32, dtype=np.uint32), _zeros(k - 1)), _zeros(k - 1))
    out = np.zeros((4, 256), np.uint32)
    value = np.arange(256)
    for b in range(32):
        out[b // 8] ^= np.where(value >> (b % 8) & 1, images[b], 0).astype(np.uint32)
    return out


def _after(register: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    return zeros[0][register & 255] ^ zeros[1][(register >> 8) & 255] ^ zeros[2][(register >> 16) & 255] ^ zeros[3][register >> 24]


def _moved(register: np.ndarray, times: np.ndarray, unit: int) -> np.ndarray:
    """Registers after times * 2**unit zero bytes."""
    out = register.copy()
    for k in range(int(times.max(initial=0)).bit_length()):
        at = np.flatnonzero(times >> k & 1)
        out[at] = _after(out[at], _zeros(unit + k))
    return out


def crc32c(blobs: list[bytes]) -> np.ndarray:
    """CRC-32C of each. Zeros before a text leave a zero register as it is, so texts are filled up in
    front to whole lanes; a lane counts as what the lanes after it make of it."""
    if not blobs:
        return np.zeros(0, np.uint32)
    size = np.array([len(b) for b in blobs], np.int64)
    lanes = np.maximum(-(-size // LANE), 1)
    ends = np.cumsum(lanes)
    held = np.zeros(int(ends[-1]) * LANE, np.uint8)
    for b, n, end in zip(blobs, size.tolist(), (ends * LANE).tolist(), strict=True):
        held[end - n : end] = np.frombuffer(b, np.uint8)
    register, two = np.zeros(int(ends[-1]), np.uint32), _two_bytes()
    for pair in np.ascontiguousarray(held.view("<u2").reshape(-1, LANE // 2).T):
        register = two[(register ^ pair) & 0xFFFF] ^ (register >> 16)
    behind = np.repeat(ends, lanes) - np.arange(1, int(ends[-1]) + 1)
    whole = np.bitwise_xor.reduceat(_moved(register, behind, LANE.bit_length() - 1), ends - lanes)
    begun = _moved(np.full(len(blobs), 0xFFFFFFFF, np.uint32), size, 0)
    return whole ^ begun ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> 15) | (crc << 17)) + np.uint32(MASK)


def framed(payloads: list[bytes]) -> list[bytes]:
    lengths = [struct.pack("<Q", len(p)) for p in payloads]
    sums = masked(crc32c(lengths)), masked(crc32c(payloads))
    return [n + struct.pack("<I", a) + p + struct.pack("<I", b) for n, p, a, b in zip(lengths, payloads, *(s.tolist() for s in sums), strict=True)]


def payload(doc: str | None, ids: np.ndarray) -> bytes:
    key = (doc or "").encode()
    wide = len(ids) > 0 and int(ids.max()) > 0xFFFF
    return struct.pack("<i", -1 if doc is None else len(key)) + key + (b"\x04" if wide else b"\x02") + ids.astype("<u4" if wide else "<u2").tobytes()


def unpacked(data: bytes) -> tuple[str | None, np.ndarray]:
    (n,) = struct.unpack_from("<i", data)
    at = 4 + max(n, 0)
    return (None if n < 0 else data[4:at].decode()), np.frombuffer(data, f"<u{data[at]}", offset=at + 1).astype("<u4")


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class _File:
    """A file and its index: temporary until complete, then renamed."""

    def __init__(self, store: fs.FileSystem, folder: str, name: str):
        self.store, self.path, self.name = store, f"{folder}/{name}", name
        self.temporary = f"{folder}/.{name}.{TaskContext.get().taskAttemptId()}"
        self.out = store.open_output_stream(self.temporary)
        self.at, self.index, self.ids = 0, [], 0

    def add(self, payloads: list[bytes], counts: list[int]) -> None:
        for frame, n in zip(framed(payloads), counts, strict=True):
            self.index.append((self.at, n))
            self.out.write(frame)
            self.at, self.ids = self.at + len(frame), self.ids + n

    def close(self) -> tuple[str, int, int, int]:
        self.out.close()
        body = np.array(self.index, "<u8").tobytes() + struct.pack("<Q", len(self.index))
        with self.store.open_output_stream(f"{self.temporary}.idx") as index:
            index.write(body + struct.pack("<I", int(masked(crc32c([body]))[0])))
        self._named(f"{self.temporary}.idx", f"{self.path}.idx")
        self._named(self.temporary, self.path)
        return self.name, len(self.index), self.ids, self.at

    def _named(self, temporary: str, path: str) -> None:
        try:
            self.store.move(temporary, path)
        except OSError:  # stores that do not rename over a file: another attempt wrote the same bytes
            if self.store.get_file_info(path).type != fs.FileType.File:
                raise
            self.store.delete_file(temporary)


_MANIFEST = "part int, number int, file string, records bigint, ids bigint, bytes bigint"


def _writer(folder: str, tokenizer: str, end: int, limit: int):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = _store(folder)
        tokens, part, rows = _tokens(tokenizer), TaskContext.get().partitionId(), []
        file, payloads, counts, held = None, [], [], 0

        def flush() -> None:
            nonlocal file, payloads, counts, held
            if payloads:
                if file is None:
                    file = _File(store, path, f"ids-{part:06d}-{len(rows):05d}.rec")
                file.add(payloads, counts)
                payloads, counts, held = [], [], 0

        for batch in batches:
            for doc, ids in zip(batch["doc"], tokens.encode(batch["text"]), strict=True):
                data = payload(doc, np.append(ids, np.uint32(end)))
                if file is not None and file.at + held + len(data) > limit:
                    flush()
                    rows.append((part, len(rows), *file.close()))
                    file = None
                payloads.append(data)
                counts.append(len(ids) + 1)
                held += len(data)
                if held >= SLICE:
                    flush()
        flush()
        if file is not None:
            rows.append((part, len(rows), *file.close()))
        tokens.forget()
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _MANIFEST.split(", ")])

    return write


@job
def write_records(docs: DataFrame, folder: str, tokenizer: str, end: int = END, range_bytes: int = RANGE_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes docs (doc_id, text) to a new folder in the shared store; returns the manifest: part, number
    (together the files' order), file, records, ids, bytes."""
    store, path = _store(folder)
    store.create_dir(path, recursive=True)
    rows = docs.select("doc_id", F.col("doc_id").cast("string").alias("doc"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // range_bytes + 1)
    order = [F.col("doc_id"), F.xxhash64("text"), F.col("text")]
    ordered = rows.repartitionByRange(parts, *order[:2]).sortWithinPartitions(*order)
    return ordered.select("doc", "text").mapInPandas(_writer(folder, tokenizer, end, file_bytes), _MANIFEST)


def _frames(stream, name: str) -> Iterator[bytes]:
    """The payloads of a file; lengths and sums are verified, SLICE bytes at a time."""
    held, sums, lengths, size = [], [], [], 0

    def verified() -> list[bytes]:
        found = np.concatenate([masked(crc32c(lengths)), masked(crc32c(held))])
        if (found != np.array([a for a, _ in sums] + [b for _, b in sums], np.uint32)).any():
            raise ValueError(f"{name}: a record has another checksum")
        return held

    while head := stream.read(12):
        if len(head) < 12:
            raise ValueError(f"{name} ends within a record")
        n, a = struct.unpack("<QI", head)
        if int(masked(crc32c([head[:8]]))[0] if n > SLICE else a) != a:  # a broken length is not read by
            raise ValueError(f"{name}: a length has another checksum")
        data = stream.read(n + 4)
        if len(data) < n + 4:
            raise ValueError(f"{name} ends within a record")
        held.append(data[:-4])
        lengths.append(head[:8])
        sums.append((a, struct.unpack("<I", data[-4:])[0]))
        size += n
        if size >= SLICE:
            yield from verified()
            held, sums, lengths, size = [], [], [], 0
    yield from verified()


def _files(manifest: DataFrame, *columns: str) -> DataFrame:
    """The files, dealt evenly, at most a task each."""
    count = manifest.count()
    tasks = max(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), count // 16)
    return manifest.select(*columns).repartition(max(1, min(count, tasks)))


def _bounded(rows: Iterator[tuple], columns: list[str], size: int) -> Iterator[pd.DataFrame]:
    """Frames of rows, of about SLICE bytes; `size` is the place of what is large in a row."""
    out, held = [], 0
    for row in rows:
        out.append(row)
        held += len(row[size]) + 64
        if held >= SLICE:
            yield pd.DataFrame(out, columns=columns)
            out, held = [], 0
    yield pd.DataFrame(out, columns=columns)


def read_records(manifest: DataFrame, folder: str) -> DataFrame:
    """doc (the id as text), start (ids of all records before), n, ids (little-endian unsigned 32-bit)."""
    before = F.sum("ids").over(Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1))  # a row a file
    based = manifest.withColumn("base", F.coalesce(before, F.lit(0)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = _store(folder)

        def rows(name: str, start: int) -> Iterator[tuple]:
            with store.open_input_stream(f"{path}/{name}", compression=None, buffer_size=1 << 20) as stream:
                for data in _frames(stream, name):
                    doc, ids = unpacked(data)
                    yield doc, start, len(ids), ids.tobytes()
                    start += len(ids)

        for batch in batches:
            for name, base in zip(batch["file"], batch["base"], strict=True):
                yield from _bounded(rows(name, int(base)), ["doc", "start", "n", "ids"], 3)

    return _files(based, "file", "base").mapInPandas(run, "doc string, start bigint, n bigint, ids binary")


def read_index(manifest: DataFrame, folder: str) -> DataFrame:
    """file, place, offset, n of every record, from the indexes alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = _store(folder)
        for batch in batches:
            for name in batch["file"]:
                with store.open_input_stream(f"{path}/{name}.idx", compression=None) as stream:
                    raw = stream.read()
                if len(raw) < 12 or int(masked(crc32c([raw[:-4]]))[0]) != struct.unpack("<I", raw[-4:])[0]:
                    raise ValueError(f"{name}: the index has another checksum")
                entries = np.frombuffer(raw[:-12], "<u8").reshape(-1, 2).astype(np.int64)
                yield pd.DataFrame({"file": name, "place": np.arange(len(entries)), "offset": entries[:, 0], "n": entries[:, 1]})

    return _files(manifest, "file").mapInPandas(run, "file string, place bigint, offset bigint, n bigint")


def read_shuffled(manifest: DataFrame, folder: str, seed: int) -> DataFrame:
    """doc, n, ids of every record in an order that the seed gives: indexes are shuffled, records are
    read where they lie. The same seed gives the same order, whatever the cluster."""
    key = F.xxhash64(F.lit(seed), "file", "place")
    dealt = read_index(manifest, folder).withColumn("key", key).repartitionByRange("key", "file", "place").sortWithinPartitions("key", "file", "place")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = _store(folder)
        opened: dict = {}

        def rows(batch: pd.DataFrame) -> Iterator[tuple]:
            for name, offset in zip(batch["file"], batch["offset"], strict=True):
                if name not in opened:
                    if len(opened) == 64:
                        opened.pop(next(iter(opened))).close()
                    opened[name] = store.open_input_file(f"{path}/{name}")
                file = opened[name]
                head = file.read_at(12, int(offset))
                (n,) = struct.unpack_from("<Q", head)
                if int(masked(crc32c([head[:8]]))[0]) != struct.unpack_from("<I", head, 8)[0]:
                    raise ValueError(f"{name}: no record begins at {offset}")
                data = file.read_at(n + 4, int(offset) + 12)
                if int(masked(crc32c([data[:-4]]))[0]) != struct.unpack("<I", data[-4:])[0]:
                    raise ValueError(f"{name}: a record has another checksum")
                doc, ids = unpacked(data[:-4])
                yield doc, len(ids), ids.tobytes()

        for batch in batches:
            yield from _bounded(rows(batch), ["doc", "n", "ids"], 2)
        for file in opened.values():
            file.close()

    return dealt.select("file", "offset").mapInPandas(run, "doc string, n bigint, ids binary")


def op12_record_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    folder = f"{scratch(spark)}/ids-{uuid.uuid4().hex}"
    manifest = write_records(docs, folder, tokenizer)
    with small_batches(spark):
        found = read_records(manifest, folder)
        kind = docs.schema["doc_id"].dataType
        out = stored(found.select(F.col("doc").cast(kind).alias("doc_id"), "start", F.col("n").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")), "read-back")
    discard(spark, folder)
    release(manifest)
    return out
