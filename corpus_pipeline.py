"""From raw documents to packed training sequences: five stages, each with one operator.

A stage takes what its predecessor kept and returns the columns of documents; the last returns
the pieces of packed sequences. Nothing here is expressible in SQL as a whole, since packing needs
the tokenizer, so ORACLE_SQL is None and tests hold the stages against plain versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factlake.llm import line_dedup, mixing, packing, quality, shingle_join
from factlake.llm.common import job, release, table

#: Epochs that the mixing stage may take of a source; every source is taken once at least.
REPEATS = 2.0


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))


def line_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.without_copied_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shingle_join.one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, repeats=REPEATS, whole=True)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.packed_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_copies),
    ("shingle join", near_copies),
    ("mixing", mixture),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:

        @job
        def staged(rows: DataFrame, stage=stage) -> DataFrame:
            return stage(spark, rows, sf_dir)

        # a stage's result is written, what it wrote on the way is deleted, and then what it read
        before, docs = docs, staged(docs)
        release(before)  # of the stages' tables; documents are not ours
    return docs
