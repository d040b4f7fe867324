"""Resumable index builds, zipped lists, places of rows."""

import random
import zipfile

import pytest
from pyspark.sql import functions as F

from factlake.operators import ordinals
from factlake.operators.chunking import split_text
from factlake.sources import archives, incremental


def section_rows(n=23, changed=()):
    rng = random.Random(2)
    rows = []
    for f in range(n):
        for i in range(rng.randint(0, 4)):
            text = " ".join(rng.choice(["alpha", "beta.", "gamma\n\n", "delta\n"]) for _ in range(rng.choice([1, 5, 300, 900])))
            rows.append((f"f{f:02d}", i, text + (" changed" if f in changed else "")))
    return rows


def sections(spark, **named):
    return spark.createDataFrame(section_rows(**named), "source_file string, section_idx bigint, text string")


def plain(rows):
    out = []
    for file, idx, text in rows:
        for name, (size, overlap, least) in incremental.SETTINGS.items():
            if len(text) >= max(1, least):
                out += [(file, idx, name, i, p) for i, p in enumerate([text] if len(text) <= size else split_text(text, size, overlap))]
    return sorted(out)


def test_a_build_stopped_half_way_and_resumed_equals_one(spark, tmp_path):
    rows, out = section_rows(), f"file://{tmp_path}/index"
    incremental.build(sections(spark), out, limit=7, slice_files=3)
    seen = {"n": 0}

    def breaks(part, settings):
        seen["n"] += 1
        if seen["n"] == 3:
            raise RuntimeError("stopped")
        return incremental.recursive(part, settings)

    with pytest.raises(RuntimeError):
        incremental.build(sections(spark), out, cut=breaks, slice_files=3)
    half = incremental.manifest(spark, out).count()
    assert 7 < half < len({r[0] for r in rows})
    left = f"{tmp_path}/index/chunks/00000099-left"  # what a killed job leaves: chunks without a manifest
    spark.createDataFrame([("f00", 0, "vector", 0, "wrong", "00000099-left")], "source_file string, section_idx bigint, setting string, chunk_idx int, chunk string, build string").write.parquet(f"file://{left}")
    done = incremental.build(sections(spark), out, slice_files=3)
    assert done.count() == len({r[0] for r in rows})
    assert sorted(map(tuple, incremental.chunks(spark, out).collect())) == plain(rows)
    assert incremental.clear(spark, out) == ["00000099-left"]


def test_only_changed_files_are_built_again(spark, tmp_path):
    out = f"file://{tmp_path}/index"
    first = {r.source_file: r.build for r in incremental.build(sections(spark), out).collect()}
    again = {r.source_file: r.build for r in incremental.build(sections(spark), out).collect()}
    assert first == again
    changed = [int(f[1:]) for f in sorted(first)[:2]]
    third = {r.source_file: r.build for r in incremental.build(sections(spark, changed=changed), out).collect()}
    assert {f for f in first if first[f] != third[f]} == {f"f{c:02d}" for c in changed}
    assert sorted(map(tuple, incremental.chunks(spark, out).collect())) == plain(section_rows(changed=changed))


def test_vectors_come_from_a_port(spark, tmp_path):
    out = f"file://{tmp_path}/index"
    incremental.build(sections(spark), out, embed=lambda c: F.array(F.length(c).cast("float")))
    assert incremental.chunks(spark, out).where("embedding[0] <> length(chunk)").count() == 0


def test_empty_build(spark, tmp_path):
    none = spark.createDataFrame([], "source_file string, section_idx bigint, text string")
    assert incremental.build(none, f"file://{tmp_path}/i").count() == 0 and incremental.chunks(spark, f"file://{tmp_path}/i").count() == 0


def test_zipped_lists(spark, tmp_path):
    item = "<list><corp_code>{}</corp_code><corp_name>{}</corp_name><stock_code>{}</stock_code><modify_date>1</modify_date></list>"
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("ONE.xml", "<result>" + "".join(item.format(i, f"C&amp;{i}", i) for i in range(1, 2001)) + "</result>")
        z.writestr("two.XML", '<?xml version="1.0" encoding="UTF-8"?><result>' + item.format(126380, "삼성전자", " 5930 ") + item.format(1, "a", " ") + item.format(2, "b", "nan") + "<list><corp_code>3</corp_code></list></result>")
        z.writestr("readme.txt", "no xml")
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("three.xml", "<result/>")
    spark.dataSource.register(archives.ZippedXml)
    raw = spark.read.format("zipped_xml").option("row_tag", "list").load(f"file://{tmp_path}")
    assert raw.rdd.getNumPartitions() == 3 and raw.count() == 2004
    got = {r.corp_code: (r.corp_name, r.stock_code) for r in archives.company_list(spark, f"file://{tmp_path}").collect()}
    assert len(got) == 2001 and got["00126380"] == ("삼성전자", "005930") and got["00000007"] == ("C&7", "000007")
    assert archives.company_list(spark, f"file://{tmp_path}/a.zip").count() == 2001


@pytest.mark.parametrize("tasks", [1, 7])
def test_places(spark, tasks):
    values = [random.Random(3).randint(0, 50) for _ in range(500)]
    rows = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v int, i int").repartition(tasks)
    got = ordinals.with_ordinals(rows, [F.col("v")]).orderBy("place").collect()
    assert [r.place for r in got] == list(range(500)) and [r.v for r in got] == sorted(values)
    assert [r.place for r in ordinals.slice_of(ordinals.with_ordinals(rows, [F.col("v")], descending=True), 490, 100).orderBy("place").collect()] == list(range(490, 500))
    assert ordinals.with_ordinals(rows.limit(0), [F.col("v")]).count() == 0


def test_lists_of_unequal_length_meet_by_place(spark):
    lists = {n: ordinals.with_ordinals(spark.createDataFrame([(f"{n}{i:02d}",) for i in range(k)], "a string"), [F.col("a")]) for n, k in (("x", 5), ("y", 3), ("z", 0))}
    got = [(r.place, r.x and r.x.a, r.y and r.y.a, r.z) for r in ordinals.by_place(lists).orderBy("place").collect()]
    assert got == [(i, f"x{i:02d}", f"y{i:02d}" if i < 3 else None, None) for i in range(5)]
