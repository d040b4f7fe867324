"""Readers and writers of the library's own formats; every schema is stated, none inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.periods import report_kind

FACTS = (
    "fact_id string, corp_name string, fiscal_year int, source_file string, statement string, report_type string, xbrl_class string, statement_title string, title_dates string, account_code string, account_kr string, "
    "account_norm string, period_tag string, period_cp string, period_year int, period_type string, period_scope string, period_variant string, is_current_period boolean, value double, value_raw string, unit_hint string"
)
SECTIONS = "corp_name string, fiscal_year int, source_file string, section_path array<string>, section_idx int, text string, char_count int"
RESULTS = "id int, question string, ground_truth string, answer string, intent string, confidence string, sources array<string>, elapsed double, error string"
CODES = "corp_code string, corp_name string, stock_code string"


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FACTS).json(path)


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SECTIONS).json(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation results, a JSON array in a file."""
    return spark.read.schema(RESULTS).option("multiLine", "true").json(path)


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """Company codes from CSV, as text, padded to eight and six digits; rows without a stock code go."""
    rows = spark.read.schema(CODES).option("header", "true").csv(path).na.drop(subset=["stock_code"])
    return rows.select(F.lpad("corp_code", 8, "0").alias("corp_code"), "corp_name", F.lpad(F.trim("stock_code"), 6, "0").alias("stock_code"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", "true").csv(path)


def write_chunks(chunks: DataFrame, embed, path: str) -> DataFrame:
    """Chunks with the vectors that a port makes of them: embed is a Column function of the text."""
    chunks.withColumn("embedding", embed(F.col("chunk"))).write.mode("overwrite").parquet(path)
    return chunks.sparkSession.read.parquet(path)


def latest_filings(rows: DataFrame) -> DataFrame:
    """Listed filings of the three periodic kinds, each receipt number once: of its rows the whole
    first one, by all columns."""
    kept = rows.withColumn("kind", report_kind(F.col("report_nm"))).where("kind is not null")
    return kept.groupBy("rcept_no").agg(F.min(F.struct(*[c for c in kept.columns if c != "rcept_no"])).alias("r")).select("rcept_no", "r.*")
