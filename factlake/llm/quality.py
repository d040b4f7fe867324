"""Quality rules whose cutoffs are certified on labelled documents.

Native: DataFrame functions only.

Every rule is a ratio of counts of a text that is large for junk, and rejects above its cutoff. A
set of cutoffs may be used in a stratum only if the labelled clean documents prove it safe: with n
clean documents of the stratum that pass the base, k of them rejected by any rule, the binomial tail
P(X <= k | n, RISK) must be at most alpha / m. Equivalently the exact upper confidence bound of the
false rejection rate is at most RISK.

Tests come in fixed sequences. A path is a set of rules whose cutoffs tighten together, from the
loosest of a fixed grid; it ends where a test fails, so a path is one hypothesis at level alpha / m
however long it is. Paths are all rules together, those on characters, those on repetition, and each
alone, so that a rule that clean documents break does not hold up the others; m is strata times
paths (Bonferroni). Of the certified
ends of its paths a stratum takes the one that rejects most labelled junk: all are certified at once.

A stratum is a language with LEAST clean labels or more. Others are too small for a proof of their
own, and are one stratum together; the bound then holds for them together, not for each. With k = 0
a lone stratum needs 245 clean labels, four need 314 each: below that, rules are off.

Defined results
- A null or empty text has no words, fails the base rule and is not kept. Null ids, languages
  and labels are allowed: a null language is a stratum, a null label is no label.
- Rows that repeat are judged alike; a doc_id labelled twice counts as often as it is labelled.
- An empty documents table gives no rows; without labels only the base rule rejects.
- keep_good() passes on all columns, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, job, packed, small, stored, table

#: Share of a stratum's clean documents that all rules together may reject, the level, and the clean
#: labels that make a language a stratum of its own.
RISK, ALPHA, LEAST = 0.02, 0.05, 320
#: Cutoffs tried for every rule, in thousandths.
CUTOFFS = (10, 20, 30, 50, 80, 120, 160, 200, 250, 300, 400, 500, 650, 800, 1000)
#: Rules: 1000 * numerator > cutoff * denominator rejects.
RULES = {
    "symbols": ("n_symbols", "n_words"),
    "repeats": ("n_repeat_words", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "shouts": ("n_shouts", "n_words"),
}
#: Rules that tighten together.
PATHS = (tuple(RULES), ("symbols", "shouts"), ("repeats", "dup_lines"), *((r,) for r in RULES))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouts")


def _let(value: Column, body) -> Column:
    """body(value) with value worked out once for the row."""
    return F.transform(F.array(value), body)[0]


def _covered(starts: Column) -> Column:
    """Words covered by 3-word windows at these ascending starts."""
    zero = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    step = lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"))
    return F.aggregate(starts, zero, step, lambda acc: acc["n"])


def _repeated(w: Column) -> Column:
    """Words in 3-word windows which the text has twice or more, the first ones included.

    Windows are compared by a 64-bit hash. Only a text with some repeated hash sorts its windows
    with their places: equal neighbours are repeats, and each covers the words up to the next
    repeat's start, three at most. So a text of n words costs n log n, whatever it repeats.
    """
    n = F.size(w)
    hashes = F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), 1, F.greatest(n - 2, F.lit(0)))

    def starts(p: Column) -> Column:
        same = lambda x, j: (F.get(p, j - 1)["h"].eqNullSafe(x["h"])) | (F.get(p, j + 1)["h"].eqNullSafe(x["h"]))
        return F.array_sort(F.array_compact(F.transform(p, lambda x, j: F.when(same(x, j), x["i"]))))

    def count(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_covered(_let(placed, starts)))

    return _let(hashes, count)


def measured(docs: DataFrame) -> DataFrame:
    """docs with COUNTS in place of text; one pass over the texts, nothing shuffled."""
    text = F.coalesce("text", F.lit(""))
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    found = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def counts(w: Column) -> Column:
        return _let(
            lines,
            lambda ln: F.struct(
                F.size(w).alias("n_words"),
                F.length(F.array_join(w, "")).alias("word_chars"),
                (F.size(F.split(text, "[#*$%&|<>]")) - 1).alias("n_symbols"),
                (F.size(ln) - F.size(F.array_distinct(ln))).alias("n_dup_lines"),
                _repeated(w).alias("n_repeat_words"),
                F.size(ln).alias("n_lines"),
                (F.size(F.split(text, "!")) - 1).alias("n_shouts"),
            ),
        )

    rest = [c for c in docs.columns if c != "text"]
    out = docs.select(*rest, _let(found, counts).alias("_counts"))
    return out.select(*rest, *[F.col(f"_counts.{c}").cast("bigint").alias(c) for c in COUNTS])


def _ln_factorial(n: Column) -> Column:
    """ln n!: the table up to 20, then Stirling's series, right to twelve digits."""
    x = (n + 1).cast("double")
    series = (x - 0.5) * F.ln(x) - x + 0.5 * F.ln(2 * F.pi()) + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3))) + 1 / (1260 * F.pow(x, F.lit(5)))
    return F.when(n <= 20, F.ln(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for X of n draws at rate p; 1 where k is not below the mean, which rejects nothing.

    The largest term comes from logarithms, those below it from their ratio to the one above.
    """
    top = F.exp(_ln_factorial(n) - _ln_factorial(k) - _ln_factorial(n - k) + k * F.lit(math.log(p)) + (n - k) * F.lit(math.log1p(-p)))
    steps = F.when(k > 0, F.sequence(F.lit(1).cast("bigint"), k)).otherwise(F.array().cast("array<bigint>"))
    zero = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def step(acc: Column, j: Column) -> Column:
        t = acc["t"] * (k - j + 1) / (n - k + j) * F.lit((1 - p) / p)
        return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))

    return F.when(k >= n * F.lit(p), F.lit(1.0)).otherwise(top * F.aggregate(steps, zero, step, lambda acc: acc["s"]))


def _level(rule: str) -> Column:
    """How many of the cutoffs the rule's ratio is above; they ascend, so these are the first ones."""
    a, b = RULES[rule]
    return F.size(F.filter(F.array(*[F.lit(c) for c in CUTOFFS]), lambda c: 1000 * F.col(a) > c * F.col(b)))


def certified(labelled: DataFrame, stratum: str, risk: float = RISK, alpha: float = ALPHA, least: int = LEAST) -> DataFrame:
    """One row per stratum with its certified cutoffs: _of (its language), pooled (whether it is that
    of all small languages), and cut_<rule>, null for a rule that is off.

    labelled: stratum, COUNTS and `quality` (1: clean, 0: junk). Counting is one aggregate with a
    partial step, whose groups are languages times paths times the fixed grid: no group gathers rows.
    """
    rows = labelled.where("quality in (0, 1)").select(stratum, "quality", *[_level(r).alias(f"_{r}") for r in RULES])
    paths = [F.struct(F.lit(p).alias("path"), F.greatest(F.lit(0), *[F.col(f"_{r}") for r in path]).alias("level")) for p, path in enumerate(PATHS)]
    held = rows.select(F.col(stratum).alias("s"), "quality", F.explode(F.array(*paths)).alias("x")).groupBy("s", "quality", "x.path", "x.level").agg(F.count("*").alias("c"))
    held = stored(held, "levels")
    sizes = held.where("path = 0").groupBy(F.col("s").alias("t")).agg((F.sum(F.when(F.col("quality") == 1, F.col("c")).otherwise(0)) < least).alias("pooled"))
    held = held.join(small(stored(sizes, "sizes")), F.col("s").eqNullSafe(F.col("t"))).withColumn("_of", F.when(~F.col("pooled"), F.col("s")))  # a row per language
    count = lambda q, i: F.sum(F.when((F.col("quality") == q) & (F.col("level") > i), F.col("c")).otherwise(0))
    tests = [F.struct(F.lit(c).alias("cutoff"), count(1, i).alias("k"), count(0, i).alias("junk")) for i, c in enumerate(CUTOFFS)]
    sums = stored(held.groupBy("_of", "pooled", "path").agg(count(1, -1).alias("n"), F.array(*tests).alias("g")), "strata")
    m = sums.count()  # strata times paths
    long = sums.select("_of", "pooled", "path", "n", F.explode("g").alias("g"))
    safe = binomial_tail(F.col("n"), F.col("g.k"), risk) * m <= alpha
    # a tighter set rejects what a looser one does and more, so the tightest that passes ends its path
    ends = long.groupBy("_of", "pooled", "path").agg(F.min(F.when(safe, F.struct("g.cutoff", "g.junk"))).alias("end"))
    best = ends.groupBy("_of", "pooled").agg(F.max_by(F.struct("path", "end.cutoff"), F.struct(F.coalesce("end.junk", F.lit(-1)), -F.col("path"))).alias("b"))
    cut = lambda rule: F.when(F.col("b.path").isin([p for p, rules in enumerate(PATHS) if rule in rules]), F.col("b.cutoff"))
    return best.select("_of", "pooled", *[cut(rule).alias(f"cut_{rule}") for rule in RULES])


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _with_cuts(counts: DataFrame, labelled: DataFrame, labels: DataFrame, risk: float, alpha: float) -> DataFrame:
    """counts (_stratum, COUNTS, others) with base_failed and kept, by cutoffs from labelled."""
    marked = labels.select("doc_id", "quality").join(labelled.where(~base_failed()), "doc_id")
    cuts = stored(certified(marked, "_stratum", risk, alpha), "cuts")
    rest = cuts.where("pooled").first()  # one row, for languages without one of their own
    # a row per stratum: texts stay where they are, also when one stratum holds most of them
    own = small(cuts.where("not pooled").drop("pooled").withColumn("_own", F.lit(True)))
    hit = F.lit(False)
    for rule, (a, b) in RULES.items():
        pooled = F.lit(rest[f"cut_{rule}"] if rest else None).cast("int")
        cut = F.when(F.col("_own"), F.col(f"cut_{rule}")).otherwise(pooled)
        hit = hit | F.coalesce(1000 * F.col(a) > cut * F.col(b), F.lit(False))
    judged = counts.join(own, F.col("_stratum").eqNullSafe(F.col("_of")), "left")
    return judged.withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & ~hit)


@job
def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, alpha: float = ALPHA) -> DataFrame:
    """doc_id, the counts, base_failed and kept for every row of docs (doc_id, lang, text).

    The counts are written once; the labels and the verdicts both read them, not the texts.
    """
    counts = stored(measured(docs.select("doc_id", F.col("lang").alias("_stratum"), "text")), "quality")
    return _with_cuts(counts, counts, labels, risk, alpha).select("doc_id", *COUNTS, "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, risk: float = RISK, alpha: float = ALPHA) -> DataFrame:
    """The rows of docs (doc_id, lang, text, any others) that judge() keeps. Rows are written once
    with their counts; cutoffs read the counts alone, and no text is shuffled."""
    rows = docs.select(packed(docs), "doc_id", F.col("lang").alias("_stratum"), "text")
    rows = stored(measured(rows), "quality")
    return _with_cuts(rows, rows.drop("_row"), labels, risk, alpha).where("kept").select("_row.*")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "lang", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    out = judge(docs, labels)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_PATHS_SQL = ", ".join(f"({i}, [{', '.join(repr(r) for r in rules)}])" for i, rules in enumerate(PATHS))
_CUTOFFS_SQL = ", ".join(f"({c})" for c in CUTOFFS)
_HIT_SQL = "(" + " OR ".join(f"(list_contains(rules, '{rule}') AND 1000 * {a} > cutoff * {b})" for rule, (a, b) in RULES.items()) + ")"
OP5_SQL = rf"""
WITH split AS (
  SELECT row_number() OVER () AS id, doc_id, lang, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln
  FROM documents
), windows AS (
  SELECT id, i, w[i] AS a, w[i+1] AS b, w[i+2] AS c FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM split)
), twice AS (
  SELECT id, i FROM windows QUALIFY count(*) OVER (PARTITION BY id, a, b, c) > 1
), repeats AS (
  SELECT id, count(DISTINCT p) AS n FROM (SELECT id, unnest([i, i+1, i+2]) AS p FROM twice) GROUP BY id
), counts AS (
  SELECT doc_id, lang, len(w) AS n_words, length(list_aggregate(w, 'string_agg', '')) AS chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(ln) - len(list_distinct(ln)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(ln) AS n_lines,
    length(text) - length(replace(text, '!', '')) AS n_shouts
  FROM split LEFT JOIN repeats USING (id)
), marked AS (SELECT counts.*, quality FROM labels JOIN counts USING (doc_id) WHERE NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
), sizes AS (SELECT lang, count(*) FILTER (quality = 1) < {LEAST} AS pooled FROM marked GROUP BY lang
), grid AS (SELECT path, rules, cutoff FROM (VALUES {_PATHS_SQL}) p(path, rules), (VALUES {_CUTOFFS_SQL}) c(cutoff)
), tests AS (
  SELECT CASE WHEN NOT pooled THEN m.lang END AS lang, pooled, path, cutoff, count(*) FILTER (quality = 1) AS n,
    count(*) FILTER (quality = 1 AND {_HIT_SQL}) AS k,
    count(*) FILTER (quality = 0 AND {_HIT_SQL}) AS junk
  FROM marked m JOIN sizes z ON m.lang IS NOT DISTINCT FROM z.lang, grid GROUP BY ALL
), tails AS (
  SELECT *, CASE WHEN k >= n * {RISK} THEN 1 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
    + i * ln({RISK}) + (n - i) * ln(1 - {RISK})))) END AS tail FROM tests
), safe AS (
  SELECT lang, pooled, path, min(cutoff) AS cutoff, arg_min(junk, cutoff) AS junk FROM tails
  WHERE tail * {len(PATHS)} * (SELECT count(*) FROM (SELECT DISTINCT lang, pooled FROM tests)) <= {ALPHA} GROUP BY ALL
), cuts AS (SELECT * FROM safe JOIN (SELECT DISTINCT path, rules FROM grid) USING (path) QUALIFY row_number() OVER (PARTITION BY lang, pooled ORDER BY junk DESC, path) = 1
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS failed,
    EXISTS (SELECT 1 FROM cuts WHERE (CASE WHEN EXISTS (SELECT 1 FROM sizes z WHERE z.lang IS NOT DISTINCT FROM counts.lang AND NOT z.pooled)
        THEN cuts.lang IS NOT DISTINCT FROM counts.lang AND NOT cuts.pooled ELSE cuts.pooled END) AND {_HIT_SQL}) AS hit
  FROM counts
)
SELECT doc_id, n_words::BIGINT AS n_words, coalesce(chars, 0)::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, failed AS base_failed, NOT failed AND NOT hit AS kept
FROM judged
"""
