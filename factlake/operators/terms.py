"""A dictionary of terms: its keys, lookups, categories in the order of the dictionary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import few_or_merged, written


def keys(terms: DataFrame) -> DataFrame:
    """key and the columns of terms (ordinal, term, name_full, category, definition). A term's keys are
    itself, itself in capitals, and what stands between the first and the last bracket of its full
    name, cut at commas, each as it is and in capitals. Of equal keys the last term's counts."""
    full = F.col("name_full")
    inside = F.regexp_extract(full, r"(?s)\((.*)\)", 1)
    names = F.filter(F.transform(F.split(inside, ","), lambda x: F.trim(x)), lambda x: (x != "") & (x != F.col("term")))
    own = F.array_distinct(F.concat(F.array("term", F.upper("term")), names, F.transform(names, lambda x: F.upper(x))))
    # numbers alone are grouped, which needs no sort of whole terms; an ordinal is of one term
    last = written(terms.select(F.explode(own).alias("key"), "ordinal").groupBy("key").agg(F.max("ordinal").alias("ordinal")), "last")
    return terms.join(few_or_merged(last), "ordinal").select("key", *terms.columns)


def lookup(questions: DataFrame, index: DataFrame) -> DataFrame:
    """questions (qid, word) with the term and definition found for the word as it is, in capitals, or
    in small letters, in this order; nulls without any. index: keys(), a dictionary. Each distinct word is looked
    up once; dictionary and findings are broadcast if their rows, counted, are few."""
    tried = F.array_distinct(F.array("w", F.upper("w"), F.lower("w")))
    words = questions.select(F.trim("word").alias("w")).where("w <> ''").distinct()
    rows = words.select("w", F.posexplode(tried).alias("priority", "key")).join(few_or_merged(written(index, "dictionary")), "key")
    found = rows.groupBy("w").agg(F.min_by(F.struct("term", "category", "definition"), "priority").alias("t"))
    both = questions.join(few_or_merged(written(found, "found")), F.trim("word") == F.col("w"), "left")
    return both.select("qid", "word", "t.term", "t.category", "t.definition")


def categories(terms: DataFrame) -> DataFrame:
    """category, n, position: in the order in which the dictionary first names them."""
    rows = terms.groupBy("category").agg(F.count("*").alias("n"), F.min("ordinal").alias("first"))
    return rows.select("category", "n", F.row_number().over(Window.orderBy("first")).alias("position"))


def first_pattern(text: Column, patterns: tuple[tuple[str, str], ...]) -> Column:
    """What the first pattern found in the text stands for; null without any."""
    out = F.lit(None).cast("string")
    for pattern, name in reversed(patterns):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out
