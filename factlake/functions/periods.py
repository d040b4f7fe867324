"""Period tags such as CFY2025dHYA, and other ways to name a period."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dims import SCOPE_ALIASES
from .reports import PERIODS

# The form of a tag.
TAG = r"^([CP])FY(\d{4})([ed])(FY|HY|FQ|SQ|TQ|[1-4]Q)([AQ])?$"
HEAD = r"^([CP])FY(\d{4})"


def parse_period_tag(tag: Column) -> Column:
    """struct<cp, year, type, scope, variant>: all of a well-formed tag, company period and year of
    one with that beginning, else nulls."""
    full = tag.rlike(TAG)
    part = lambda pattern, i: F.nullif(F.regexp_extract(tag, pattern, i), F.lit(""))
    scope = part(TAG, 4)
    for short, name in SCOPE_ALIASES.items():
        scope = F.when(scope == short, name).otherwise(scope)
    return F.struct(
        part(HEAD, 1).alias("cp"),
        part(HEAD, 2).cast("int").alias("year"),
        F.when(full, F.when(part(TAG, 3) == "e", "end").otherwise("during")).alias("type"),
        scope.alias("scope"),
        part(TAG, 5).alias("variant"),
    )


def tag_of_context(context: Column, near: Column | None = None) -> Column:
    """The tag that a cell's context begins with; without one UNK_ and the period that the text near
    its table names, else UNKNOWN."""
    found = F.nullif(F.regexp_extract(context, r"^([CP]FY\d{4}[a-zA-Z0-9]+?)(?:_|$)", 1), F.lit(""))
    guess = F.lit(None).cast("string")
    for pattern, name in reversed(PERIODS if near is not None else ()):
        guess = F.when(near.rlike(pattern), "UNK_" + name).otherwise(guess)
    return F.coalesce(found, guess, F.lit("UNKNOWN"))


def report_kind(title: Column) -> Column:
    """A001 annual, A002 half-year, A003 quarterly, by a word of the report's name; null for others."""
    return F.when(title.contains("사업보고서"), "A001").when(title.contains("반기보고서"), "A002").when(title.contains("분기보고서"), "A003")


def fiscal_period(title: Column, received: Column) -> Column:
    """struct<year, scope> of a report named "... (2024.09)"; else by its kind and the date it was
    received: an annual report that comes in by April is the year before's, a quarterly one that
    comes in by June is of the first quarter; "?" for other reports."""
    month = F.regexp_extract(title, r"\((\d{4})\.(\d{2})\)", 2)
    year = F.regexp_extract(title, r"\((\d{4})\.(\d{2})\)", 1)
    kind = report_kind(title)
    late = F.year(received) - F.when((kind == "A001") & (F.month(received) <= 4), 1).otherwise(0)
    by_kind = F.when(kind == "A001", "FY").when(kind == "A002", "HY").when(kind == "A003", F.when(F.month(received) <= 6, "1Q").otherwise("3Q")).otherwise("?")
    scope = F.when(month == "12", "FY").when(month == "09", "3Q").when(month == "06", "HY").when(month == "03", "1Q").when(month != "", month).otherwise(by_kind)
    return F.struct(F.coalesce(F.nullif(year, F.lit("")).cast("int"), late).alias("year"), scope.alias("scope"))


def period_label(cp: Column, year: Column, kind: Column, scope: Column) -> Column:
    """A period as readers name it."""
    name = F.when(scope == "FY", "연간").when(scope == "HY", "반기").otherwise(F.concat(F.substring(scope, 1, 1), F.lit("분기")))
    tail = F.when(kind == "end", " 말").otherwise(" 누적")
    return F.concat(year.cast("string"), F.lit("년 "), name, tail, F.when(cp == "P", " (전기)").otherwise(""))


def relative_time(then: Column, now: Column) -> Column:
    """How long ago, up to a week; the date in +09:00 beyond."""
    seconds = F.timestamp_diff("SECOND", then, now)
    return (
        F.when(seconds < 60, "방금")
        .when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit("분 전")))
        .when(seconds < 86400, F.concat(F.floor(seconds / 3600).cast("string"), F.lit("시간 전")))
        .when(seconds < 7 * 86400, F.concat(F.floor(seconds / 86400).cast("string"), F.lit("일 전")))
        .otherwise(F.date_format(then + F.expr("interval 9 hours"), "yyyy.MM.dd"))
    )


def parse_rfc822(text: Column) -> Column:
    """"Mon, 01 Jan 2024 09:00:00 +0900" as a timestamp, null where it is something else."""
    return F.try_to_timestamp(F.regexp_replace(text, r"^\w{3},\s*", ""), F.lit("dd MMM yyyy HH:mm:ss Z"))
