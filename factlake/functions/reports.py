"""What the words around a table say: its report and statement, its period, its id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns in the order in which they are tried.
REPORT_TYPES = (("연결", "연결"), ("별도|개별", "별도"))
STATEMENTS = (("재무\\s*상태표|대차대조표", "BS"), ("손익계산서", "IS"), ("현금\\s*흐름표", "CF"), ("자본\\s*변동표", "EF"))
PERIODS = (("반기말", "HY_END"), ("반기", "HY"), ("3\\s*분기말", "3Q_END"), ("3\\s*분기", "3Q_CUM"), ("1\\s*분기말", "1Q_END"), ("1\\s*분기", "1Q_CUM"), ("기말", "FY_END"))
DATED = r"\d{4}[.\-]\d{2}[.\-]\d{2}|제\s*\d+\s*기"


def _chosen(text: Column, forms: str, spelled: str) -> Column:
    """The first place where one of the forms stands, those that are spelled out before the others."""
    found = F.regexp_extract_all(text, F.lit(forms), F.lit(0))
    return F.coalesce(F.get(F.filter(found, lambda x: x.contains(spelled)), F.lit(0)), F.get(found, F.lit(0)))


def quarter(text: Column) -> Column:
    """The quarter that a text names: "3분기", "3Q" or "Q3", else the second for a half-year."""
    named = F.regexp_extract(_chosen(text, r"(?i)[1-4]\s*분기|[1-4]q|q[1-4]", "분기"), "[1-4]", 0)
    return F.coalesce(F.nullif(named, F.lit("")).cast("int"), F.when(text.contains("반기"), 2))


def period_end(text: Column) -> Column:
    """The first date of a text as yyyy-mm-dd: one with 년, 월, 일, else one with points or dashes."""
    date = _chosen(text, r"\d{4}\s*년\s*\d{1,2}\s*월\s*\d{1,2}\s*일|\d{4}[-.]\d{1,2}[-.]\d{1,2}", "년")
    parts = F.regexp_extract_all(date, F.lit(r"\d+"), F.lit(0))
    return F.when(date.isNotNull(), F.concat_ws("-", *[F.lpad(F.get(parts, F.lit(i)), n, "0") for i, n in enumerate((4, 2, 2))]))


def dated(paragraphs: Column) -> Column:
    """The first three paragraphs with a date or the number of a business year, joined by " | "."""
    return F.array_join(F.slice(F.filter(paragraphs, lambda p: p.rlike(DATED)), 1, 3), " | ")


def item_id(company: Column, year: Column, in_quarter: Column, kind: str, number: Column, source: Column) -> Column:
    """{company}_{year}{Qn or Y}_{kind}{0001}_{hash of the file}; the last keeps filings of a year apart.
    Numbers of more than four digits are written whole."""
    name = F.replace(F.coalesce(F.nullif(company, F.lit("")), F.lit("unknown")), F.lit(" "), F.lit("_"))
    when = F.coalesce(F.concat(F.lit("Q"), in_quarter.cast("string")), F.lit("Y"))
    return F.concat(name, F.lit("_"), year.cast("string"), when, F.lit(f"_{kind}"), F.format_string("%04d", number), F.lit("_"), F.substring(F.md5(source.cast("binary")), 1, 8))
