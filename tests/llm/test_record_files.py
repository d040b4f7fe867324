import os
import struct
import uuid
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factlake.llm import record_files as R

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string"


def bytewise(data):
    table = []
    for c in range(256):
        for _ in range(8):
            c = (c >> 1) ^ (R.POLYNOMIAL if c & 1 else 0)
        table.append(c)
    out = 0xFFFFFFFF
    for b in data:
        out = table[(out ^ b) & 255] ^ (out >> 8)
    return out ^ 0xFFFFFFFF


def whole(text):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 2]


def folder():
    return f"/tmp/factlake-shared/test-{uuid.uuid4().hex}"


def files(path):
    return {f: open(f"{path}/{f}", "rb").read() for f in sorted(os.listdir(path)) if not f.startswith(".")}


def test_checksums():
    assert R.crc32c([b"123456789", bytes(32), b"\xff" * 32]).tolist() == [0xE3069283, 0x8A9136AA, 0x62A8AB43]  # published values
    blobs = [os.urandom(n) for n in (0, 1, 2, 127, 128, 129, 255, 257, 4000, 70_001)]
    assert R.crc32c(blobs).tolist() == [bytewise(b) for b in blobs]
    assert R.crc32c([]).tolist() == []


def test_frames_are_tfrecords():
    data = R.framed([b"abc"])[0]
    masked = lambda b: ((bytewise(b) >> 15 | bytewise(b) << 17) + 0xA282EAD8) & 0xFFFFFFFF
    assert data == struct.pack("<QI", 3, masked(struct.pack("<Q", 3))) + b"abc" + struct.pack("<I", masked(b"abc"))


@pytest.mark.parametrize("doc", [None, "", "17", "é"])
@pytest.mark.parametrize("ids", [[2], [1, 65535, 2], [70_000, 2], []])
def test_payloads(doc, ids):
    key, found = R.unpacked(R.payload(doc, np.array(ids, np.uint32)))
    assert (key, found.tolist()) == (doc, ids)


def odd(spark):
    rows = [(5, "Hello, big world"), (None, "none"), (3, None), (3, ""), (-4, "word " * 50_000), (9, "same"), (9, "same"), (9, "other"), (7, "\n é ß \x00 日本")]
    return rows, spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", ids string, part int")


def test_round_trip_of_odd_rows(spark):
    rows, frame = odd(spark)
    path = folder()
    manifest = R.write_records(frame, path, PATH, file_bytes=2000)
    got = R.read_records(manifest, path).orderBy("start").collect()
    key = lambda d: float("-inf") if d is None else d
    assert [r.doc for r in got] == [None if d is None else str(d) for d, _ in sorted(rows, key=lambda r: key(r[0]))]
    assert sorted((r.doc or "", bytes(r.ids)) for r in got) == sorted(("" if d is None else str(d), np.array(whole(t), "<u4").tobytes()) for d, t in rows)
    at = 0
    for r in got:
        assert (r.start, r.n) == (at, len(r.ids) // 4)
        at += r.n
    assert manifest.count() > 1 and manifest.agg(F.sum("ids")).first()[0] == at


def test_index_and_shuffled_reads(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    path = folder()
    manifest = R.write_records(docs, path, PATH, file_bytes=100_000)
    in_order = [(r.doc, bytes(r.ids)) for r in R.read_records(manifest, path).orderBy("start").collect()]
    index = R.read_index(manifest, path)
    assert index.count() == len(in_order) == 200
    for r in index.limit(20).collect():
        (n,) = struct.unpack_from("<Q", files(path)[r.file], r.offset)
        assert len(R.unpacked(files(path)[r.file][r.offset + 12 : r.offset + 12 + n])[1]) == r.n
    one, again, other = ([(r.doc, bytes(r.ids)) for r in R.read_shuffled(manifest, path, seed).collect()] for seed in (1, 1, 2))
    assert one == again != other and one != in_order
    assert sorted(one) == sorted(other) == sorted(in_order)


def test_a_repeated_job_writes_the_same_bytes(spark):
    _, frame = odd(spark)
    a, b = folder(), folder()
    R.write_records(frame, a, PATH)
    R.write_records(frame.repartition(5), b, PATH)
    join = lambda path: b"".join(v for k, v in files(path).items() if k.endswith(".rec"))
    assert join(a) == join(b)
    assert not [f for f in os.listdir(a) if f.startswith(".ids")]


@pytest.mark.parametrize("place", [0, 9, 20, -1])
def test_a_changed_byte_is_found(spark, place):
    path = folder()
    manifest = R.write_records(spark.createDataFrame([(1, "some text here"), (2, "and more")], SCHEMA).coalesce(1), path, PATH)
    name = f"{path}/{manifest.first().file}"
    data = bytearray(open(name, "rb").read())
    data[place] ^= 1
    open(name, "wb").write(data)
    with pytest.raises(Exception, match="checksum|ends within"):
        R.read_records(manifest, path).collect()


def test_empty(spark):
    path = folder()
    manifest = R.write_records(spark.createDataFrame([], SCHEMA), path, PATH)
    assert manifest.count() == R.read_records(manifest, path).count() == R.read_shuffled(manifest, path, 1).count() == 0


def test_query_against_whole_texts(spark, sf):
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: r for r in R.op12_record_files(spark, sf).collect()}
    at = 0
    for d, text in docs:
        ids = whole(text)
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert len(got) == len(docs)
