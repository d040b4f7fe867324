"""Index builds that can be stopped and resumed: chunks under several settings, committed by a manifest.

A build takes the files whose contents the manifest does not have yet, slice by slice. A slice's chunks are
written to a folder of its own; then its manifest is written, which makes them count. What a stopped build
left behind has no manifest and is never read. Of a file that has changed the last committed slice counts, so
readers see its old chunks until the new ones are whole. Folders nothing refers to any more can be cleared.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.chunking import split_text
from ..operators.ordinals import slice_of, with_ordinals
from .shared import written

#: The settings in use, each with size, overlap, and the least length of a section.
SETTINGS = {"sections": (3000, 300, 0), "vector": (1000, 100, 50), "hybrid": (1200, 150, 50), "table_aware": (1500, 200, 0), "table_hybrid": (1200, 200, 0)}
SLICE_FILES = 1000
_MANIFEST = "source_file string, fingerprint string, build string, n_sections bigint, n_chunks bigint"
_CHUNKS = "source_file string, section_idx bigint, setting string, chunk_idx int, chunk string"


def recursive(sections: DataFrame, settings: dict[str, tuple[int, int, int]]) -> DataFrame:
    """source_file, section_idx, setting, chunk_idx, chunk: each section cut under every setting, in one pass."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for file, idx, text in zip(batch["source_file"], batch["section_idx"], batch["text"], strict=True):
                for name, (size, overlap, least) in settings.items():
                    if len(text) >= max(least, 1):
                        pieces = [text] if len(text) <= size else split_text(text, size, overlap)
                        out += [(file, idx, name, i, p) for i, p in enumerate(pieces)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _CHUNKS.split(", ")])

    return sections.where("text is not null").select("source_file", "section_idx", "text").mapInPandas(run, _CHUNKS)


def strides(sections: DataFrame, settings: dict[str, tuple[int, int, int]]) -> DataFrame:
    """The same with chunks of a fixed length, each beginning size - overlap after the one before; no Python."""
    kinds = F.explode(F.array(*[F.struct(F.lit(n).alias("setting"), F.lit(s).alias("size"), F.lit(o).alias("overlap"), F.lit(m).alias("least")) for n, (s, o, m) in settings.items()]))
    rows = sections.select("source_file", "section_idx", "text", kinds.alias("k")).select("source_file", "section_idx", "text", "k.*").where("length(text) >= greatest(least, 1)")
    last = F.greatest(F.ceil((F.length("text") - F.col("overlap")) / (F.col("size") - F.col("overlap"))).cast("int"), F.lit(1))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), last - 1)).alias("chunk_idx"))
    return rows.select("source_file", "section_idx", "setting", "chunk_idx", F.substring("text", F.col("chunk_idx") * (F.col("size") - F.col("overlap")) + 1, F.col("size")).alias("chunk"))


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Folders beneath a path whose writing was finished."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()]
    return sorted(n for n in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))


def manifest(spark: SparkSession, out: str) -> DataFrame:
    """The files that are built, each with its last committed build."""
    names = _folders(spark, f"{out}/manifest")
    if not names:
        return spark.createDataFrame([], _MANIFEST)
    rows = spark.read.schema(_MANIFEST).parquet(*[f"{out}/manifest/{n}" for n in names])
    last = F.row_number().over(Window.partitionBy("source_file").orderBy(F.desc("build")))
    return rows.withColumn("_n", last).where("_n = 1").drop("_n")


def chunks(spark: SparkSession, out: str) -> DataFrame:
    """The chunks that count."""
    live = manifest(spark, out).select("source_file", "build")
    names = [r.build for r in live.select("build").distinct().collect()]  # a row a slice
    if not names:
        return spark.createDataFrame([], _CHUNKS)
    rows = spark.read.parquet(*[f"{out}/chunks/{n}" for n in sorted(names)])
    return rows.join(live, ["source_file", "build"], "left_semi").drop("build")


def build(
    sections: DataFrame, out: str, cut: Callable = recursive, embed: Callable[[Column], Column] | None = None,
    settings: dict[str, tuple[int, int, int]] = SETTINGS, start: int = 0, limit: int | None = None, slice_files: int = SLICE_FILES,
) -> DataFrame:
    """Builds what is missing of sections (source_file, section_idx, text) and returns the manifest.

    start, limit: the files to look at, by their place in the order of their names. embed: a port that makes a
    column of vectors of the chunks. Files that are gone from sections stay as they are.
    """
    spark, out = sections.sparkSession, out.rstrip("/")
    marks = F.sum(F.xxhash64("section_idx", "text").cast("decimal(38,0)")).cast("string")
    files = sections.where("source_file is not null").groupBy("source_file").agg(F.concat_ws(":", F.count("*").cast("string"), marks).alias("fingerprint"))
    asked = slice_of(with_ordinals(files, [F.col("source_file")]), start, limit)
    todo = asked.drop("place").join(manifest(spark, out).select("source_file", "fingerprint"), ["source_file", "fingerprint"], "left_anti")
    todo = written(with_ordinals(todo, [F.col("source_file")]).withColumn("slice", F.floor(F.col("place") / slice_files).cast("int")), "todo")
    done = len(_folders(spark, f"{out}/manifest"))
    for i in range((todo.agg(F.max("slice")).first()[0] if todo.take(1) else -1) + 1):
        name = f"{done + i:08d}-{uuid.uuid4().hex[:8]}"
        mine = todo.where(F.col("slice") == i).select("source_file", "fingerprint")
        rows = cut(sections.join(mine, "source_file", "left_semi"), settings).withColumn("build", F.lit(name))
        rows = rows.withColumn("embedding", embed(F.col("chunk"))) if embed else rows
        rows.write.parquet(f"{out}/chunks/{name}")
        n = spark.read.parquet(f"{out}/chunks/{name}").groupBy("source_file").agg(F.count("*").alias("n_chunks"))
        sizes = sections.join(mine, "source_file", "left_semi").groupBy("source_file").agg(F.count("*").alias("n_sections"))
        listed = mine.join(sizes, "source_file").join(n, "source_file", "left").na.fill(0, ["n_chunks"]).withColumn("build", F.lit(name))
        listed.select(*[c.split()[0] for c in _MANIFEST.split(", ")]).write.parquet(f"{out}/manifest/{name}")  # from here on the slice counts
    return manifest(spark, out)


def clear(spark: SparkSession, out: str) -> list[str]:
    """Deletes the chunks of slices that do not count, and returns their names. Not while a build is running."""
    live = {r.build for r in manifest(spark, out).select("build").distinct().collect()}
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/chunks")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName() not in live] if fs.exists(at) else []
    for path in gone:
        fs.delete(path, True)
    return sorted(p.getName() for p in gone)
