"""Accounting numbers: reading, scaling, printing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dims import UNITS


def parse_value(text: Column) -> Column:
    """The number of a printed cell: commas and spaces go, (x) is negative, a leading minus turns
    the sign once more, blank and "-" and anything unreadable are null."""
    t = F.regexp_replace(text, "[, ]", "")
    boxed = t.rlike(r"^\(.*\)$")
    body = F.when(boxed, F.regexp_extract(t, r"^\((.*)\)$", 1)).otherwise(t)
    minus = body.startswith("-")
    number = F.when(minus, F.substring(body, F.lit(2), F.length(body))).otherwise(body).try_cast("double")
    sign = F.when(boxed == minus, 1.0).otherwise(-1.0)
    return F.when((t == "") | (t == "-"), F.lit(None).cast("double")).otherwise(number * sign)


def unit_factor(unit: Column) -> Column:
    """What one of the unit is worth; 1 where the unit is unknown or null."""
    out = None
    for name, worth in UNITS:
        hit = F.lower(unit).contains(name)
        out = F.when(hit, F.lit(worth)) if out is None else out.when(hit, F.lit(worth))
    return out.otherwise(F.lit(1)).cast("bigint")


def to_base(value: Column, unit: Column) -> Column:
    return value * unit_factor(unit)


def format_amount(value: Column) -> Column:
    """Large amounts in the units that readers use: 조, 억, 만, else as they are; N/A for null.

    value: a decimal, so that both the choice of unit and the rounding, half up, are exact.
    """
    size = F.abs(value)
    part = lambda by, digits, unit: F.concat(F.format_number(F.round((size / F.lit(by)).cast("decimal(38,18)"), digits), digits), F.lit(unit))
    text = (
        F.when(size >= 10**12, part(10**12, 1, "조원")).when(size >= 10**8, part(10**8, 0, "억원")).when(size >= 10**4, part(10**4, 0, "만원")).otherwise(part(1, 0, "원"))
    )
    return F.when(value.isNull(), "N/A").otherwise(F.concat(F.when(value < 0, "-").otherwise(""), text))


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where either is null or b is zero."""
    return F.try_divide(a, b)


def change_percent(now: Column, before: Column) -> Column:
    return F.round(F.try_divide(now - before, F.abs(before)) * 100, 2)
