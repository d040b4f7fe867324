"""Mixing sources to target weights by temperature.

Source i holds a share p of all tokens and gets a weight in proportion to p ** a. The exponent is
bisected: the largest in [0, 1] whose weights reach the wanted entropy, unless the smallest
sources would then be repeated more often than allowed; then the smallest that respects that.
Weights times the budget give each source's tokens: whole epochs of all its documents, and a
remainder, which is a prefix of a random permutation of the source's blocks. A block is a hash
class of its documents; of the block in which the remainder ends, documents are taken by hash.

A source of any size is spread over blocks, whose number follows the tokens, and totals are formed
by partial aggregates. What a window orders is one of ORDERS shares of a source's block totals, or
the totals by hash of the one block per source in which its remainder ends. The driver gets sums; of
up to SMALL sources it gets their totals, beyond that the exponent is searched by aggregates.

Defined results: tokens are words, so a null or empty text has none; it is taken where its
block is. A budget above `repeats` epochs of the whole table cannot be met and is an error. A null
source is a source of its own. Rows are documents, and rows that repeat go
together. An empty table, or one without tokens, gives its rows one copy each. Other columns,
whatever their names, pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, job, packed, release, small, stored, table

#: Of the largest possible entropy; epochs of any source; of the hashes.
ENTROPY, REPEATS, SEED = 0.95, 4.0, 17
#: Blocks of all sources at least, tokens of a block at most, shares of a source's order of blocks.
BLOCKS, BLOCK_TOKENS, ORDERS = 4096, 1 << 22, 64
#: Rounds of the bisection; or exponents tried at once, and rounds, where there are many sources.
_ROUNDS, _TRIED, _FEW_ROUNDS = 60, 15, 15
#: Weights times budgets are often whole numbers but for the last digits of a double.
ROUNDING = 1e-12
#: A table of sources is broadcast up to so many rows, else joined by shuffling.
SMALL = 100_000


def n_tokens(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, SPACE + "+"))).cast("bigint")


def exponent(tokens: list[int], entropy: float, repeats: float, budget: float | None) -> float:
    """tokens: of each source, none zero. budget None: one that gives each source an epoch at least."""
    shares = [n / sum(tokens) for n in tokens]

    def weights(a: float) -> list[float]:
        powers = [p**a for p in shares]
        return [x / sum(powers) for x in powers]

    def even_enough(a: float) -> bool:
        return -sum(w * math.log(w) for w in weights(a)) >= entropy * math.log(len(shares))

    def repeated_less(a: float) -> bool:
        epochs = [w / n for w, n in zip(weights(a), tokens, strict=True)]
        return max(epochs) * (budget if budget is not None else 1 / min(epochs)) <= repeats

    def bisect(ok, low: float, high: float) -> float:
        """The end of [low, high] at which ok turns; low is where it holds."""
        for _ in range(_ROUNDS):
            mid = (low + high) / 2
            low, high = (mid, high) if ok(mid) else (low, mid)
        return low

    a = 1.0 if even_enough(1.0) else bisect(even_enough, 0.0, 1.0)
    return a if repeated_less(a) else bisect(repeated_less, 1.0, a)


def _hash(*parts) -> Column:
    """60 bits of an MD5, which other engines have as well."""
    text = F.concat_ws(":", F.lit(str(SEED)), *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("null"))


def _keyed(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(*columns, source_key(F.col("source")).alias("_s"), _hash(F.col("doc_id")).alias("_h"))


def _searched(shares: DataFrame, entropy: float, repeats: float, total: float, budget: float | None) -> float:
    """exponent() for many sources: shares (n) stay where they are, _TRIED exponents to an aggregate."""
    p = F.col("n") / F.lit(total)
    count, least, most = shares.agg(F.count("*"), F.min(p), F.max(p)).first()

    def sums(tried: list[float]) -> list[tuple[float, float]]:
        row = shares.agg(*[x for a in tried for x in (F.sum(F.pow(p, F.lit(a))), F.sum(F.pow(p, F.lit(a)) * F.ln(p)))]).first()
        return list(zip(row[::2], row[1::2], strict=True))

    def even_enough(a: float, s: float, e: float) -> bool:
        return math.log(s) - a * e / s >= entropy * math.log(count)

    def repeated_less(a: float, s: float, _: float) -> bool:
        epochs = [x ** (a - 1) / s / total for x in (least, most)]
        return max(epochs) * (budget if budget is not None else 1 / min(epochs)) <= repeats

    def turn(ok, low: float, high: float) -> float:
        for _ in range(_FEW_ROUNDS):
            tried = [low + (high - low) * (i + 1) / (_TRIED + 1) for i in range(_TRIED)]
            good = [a for a, (s, e) in zip(tried, sums(tried), strict=True) if ok(a, s, e)]
            low, high = good[-1] if good else low, next((a for a in tried if a not in good), high)
        return low

    a = 1.0 if even_enough(1.0, *sums([1.0])[0]) else turn(even_enough, 0.0, 1.0)
    return a if repeated_less(a, *sums([a])[0]) else turn(repeated_less, 1.0, a)


def _by_source(counted: DataFrame, entropy: float, repeats: float, budget: float, whole: bool) -> DataFrame:
    """_s, weight, budget, epochs, rest (of tokens beyond whole epochs), _blocks of each source."""
    if not whole and budget > repeats:
        raise ValueError("a budget above the repetition limit cannot be met")
    sources = stored(counted.groupBy("_s").agg(F.sum("n").alias("n")), "sources")
    full = sources.where("n > 0").select("n")
    count, total = full.agg(F.count("*"), F.sum("n")).first()
    if not count:
        a, powers, tokens, total = 1.0, 1.0, 0.0, 1
    else:
        own = None if whole else budget * total
        a = exponent(sorted(int(r.n) for r in full.collect()), entropy, repeats, own) if count <= SMALL else _searched(full, entropy, repeats, float(total), own)
        p = F.col("n") / F.lit(float(total))
        powers, most = full.agg(F.sum(F.pow(p, F.lit(a))), F.max(p)).first()
        tokens = total * powers * most ** (1 - a) if whole else budget * total
    n = F.col("n")
    weight = F.when(n > 0, F.pow(n / F.lit(float(total)), F.lit(a)) / F.lit(powers)).otherwise(0.0)
    own = F.floor(weight * F.lit(float(tokens)) * F.lit(1 + ROUNDING) + 1e-6).cast("bigint")
    own = F.greatest(n, own) if whole else own
    blocks = F.greatest(F.lit(1), F.ceil(max(BLOCKS, total // BLOCK_TOKENS) * (n / F.lit(float(total)))))
    rest = F.when(n > 0, own % n).otherwise(0)  # the remainder of a source without tokens takes all its rows once
    epochs = F.when(n > 0, F.floor(own / n)).otherwise(0)
    cast = {"budget": F.when(n > 0, own).otherwise(0), "epochs": epochs, "rest": rest, "_blocks": blocks}
    return sources.select("_s", weight.alias("weight"), *[c.cast("bigint").alias(k) for k, c in cast.items()])


@job
def plan(counted: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: float = 1.0, whole: bool = False) -> DataFrame:
    """counted (_s, _h, n) to a row per block: _s, _b, _blocks (of its source), weight, budget,
    epochs, rank of the block in its permutation, and _upto: the largest hash taken in the last epoch.

    budget: tokens of the mixture over tokens of the table; whole: as many as give every source
    an epoch at least.
    """
    by_source = small(stored(_by_source(counted, entropy, repeats, budget, whole), "by-source"), SMALL)
    placed = counted.join(by_source, "_s").withColumn("_b", F.col("_h") % F.col("_blocks"))
    blocks = placed.groupBy("_s", "_b", "_blocks", "weight", "budget", "epochs", "rest").agg(F.sum("n").alias("n"))
    blocks = stored(blocks.withColumn("_o", _hash(F.col("_s"), F.col("_b"))).withColumn("_p", F.floor(F.col("_o") / F.lit((1 << 60) // ORDERS)).cast("int")), "blocks")
    # a source's permutation, and the tokens up to each block, by shares of it
    shares = blocks.groupBy("_s", "_p").agg(F.sum("n").alias("_n"), F.count("*").alias("_c"))
    earlier = Window.partitionBy("_s").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    shares = shares.select("_s", "_p", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n"), F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_c"))
    order = Window.partitionBy("_s", "_p").orderBy("_o", "_b")
    blocks = blocks.join(small(stored(shares, "shares"), SMALL), ["_s", "_p"])
    blocks = blocks.withColumn("rank", F.row_number().over(order) + F.col("_c")).withColumn("_to", F.sum("n").over(order) + F.col("_n"))
    blocks = stored(blocks.withColumn("_left", F.col("rest") - (F.col("_to") - F.col("n"))), "ordered")
    edge = blocks.where("_left >= 0 and _left < n").select("_s", "_b", "_left")
    inside = placed.select("_s", "_b", "_h", "n").join(edge, ["_s", "_b"]).groupBy("_s", "_b", "_left", "_h").agg(F.sum("n").alias("n"))
    run = F.sum("n").over(Window.partitionBy("_s", "_b").orderBy("_h"))
    cut = inside.withColumn("_run", run).where("_run <= _left").groupBy("_s", "_b").agg(F.max("_h").alias("_cut"))
    upto = F.when(F.col("_left") >= F.col("n"), F.lit(2**62)).when(F.col("_left") >= 0, F.coalesce("_cut", F.lit(-1))).otherwise(F.lit(-1))
    # a block's remainder of exactly zero tokens takes nothing but what has no tokens
    return blocks.join(cut, ["_s", "_b"], "left").select("_s", "_b", "_blocks", "weight", "budget", "epochs", "rank", upto.alias("_upto"))


def _copies(keyed: DataFrame, blocks: DataFrame) -> DataFrame:
    of = small(stored(blocks.select("_s", "_blocks").distinct(), "of"), SMALL)
    placed = keyed.join(of, "_s").withColumn("_b", F.col("_h") % F.col("_blocks")).drop("_blocks")
    copies = F.col("epochs") + (F.col("_h") <= F.col("_upto")).cast("bigint")
    return placed.join(blocks, ["_s", "_b"]).withColumn("_copies", copies)


def mix(docs: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: float = 1.0, whole: bool = False) -> DataFrame:
    """The rows of docs (doc_id, source, text, any others), each as often as the mixture takes it."""
    counted = stored(_keyed(docs.select("doc_id", "source", n_tokens(F.col("text")).alias("n")), "n"), "tokens")
    blocks = plan(counted, entropy, repeats, budget, whole)
    release(counted)
    keyed = docs.select(packed(docs), source_key(F.col("source")).alias("_s"), _hash(F.col("doc_id")).alias("_h"))
    out = _copies(keyed, small(blocks, SMALL)).where("_copies > 0")
    return out.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("_row.*")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its source's weight and budget, its place and how often it is taken."""
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    counted = stored(_keyed(docs.select("doc_id", "source", n_tokens(F.col("text")).alias("n")), "doc_id", "source", "n"), "tokens")
    out = _copies(counted, small(plan(counted.select("_s", "_h", "n")), SMALL))
    return out.select(
        "doc_id",
        "source",
        F.col("n").alias("n_tokens"),
        F.round("weight", 9).alias("weight"),
        F.col("budget").alias("source_budget"),
        F.col("_b").alias("block"),
        F.col("rank").cast("bigint").alias("block_rank"),
        F.col("_copies").alias("copies"),
    )


_MD5 = "('0x' || substr(md5('{seed}:' || {what}), 1, 15))::BIGINT".replace("{seed}", str(SEED))
OP1_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce('s' || source, 'null') AS s, {_MD5.format(what="coalesce(doc_id::VARCHAR, '-')")} AS h,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n
  FROM documents
), t AS (SELECT s, sum(n)::DOUBLE AS n FROM d GROUP BY s HAVING sum(n) > 0
), p AS (SELECT s, n, n / (SELECT sum(n) FROM t) AS p FROM t
), q AS (SELECT list(p ORDER BY s) AS ps FROM p
), bend AS (
  SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, ps FROM q
  UNION ALL SELECT i + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END, ps
  FROM (SELECT i, lo, hi, ps, (lo + hi) / 2 AS mid,
      ln(list_sum(list_transform(ps, lambda x: pow(x, (lo + hi) / 2)))) - (lo + hi) / 2
      * list_sum(list_transform(ps, lambda x: pow(x, (lo + hi) / 2) * ln(x))) / list_sum(list_transform(ps, lambda x: pow(x, (lo + hi) / 2)))
      >= {ENTROPY} * ln(len(ps)) AS ok FROM bend WHERE i < {_ROUNDS})
), e AS (
  SELECT CASE WHEN -list_sum(list_transform(ps, lambda x: x * ln(x))) >= {ENTROPY} * ln(len(ps)) THEN 1 ELSE lo END AS a, ps
  FROM bend WHERE i = {_ROUNDS}
), least AS (
  SELECT 0 AS i, 1.0::DOUBLE AS lo, a AS hi, ps FROM e
  UNION ALL SELECT i + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END, ps
  FROM (SELECT i, lo, hi, ps, (lo + hi) / 2 AS mid,
      list_max(list_transform(ps, lambda x: pow(x, (lo + hi) / 2 - 1))) / list_sum(list_transform(ps, lambda x: pow(x, (lo + hi) / 2))) <= {REPEATS} AS ok
    FROM least WHERE i < {_ROUNDS})
), f AS (
  SELECT CASE WHEN list_max(list_transform(e.ps, lambda x: pow(x, e.a - 1))) / list_sum(list_transform(e.ps, lambda x: pow(x, e.a))) <= {REPEATS}
    THEN e.a ELSE least.lo END AS a FROM e, least WHERE least.i = {_ROUNDS}
), w AS (
  SELECT s, n::BIGINT AS n, pow(p, a) / (SELECT sum(pow(p, a)) FROM p, f) AS w, greatest(1, ceil(greatest({BLOCKS}, (SELECT sum(n) FROM t)::BIGINT // {BLOCK_TOKENS}) * p))::BIGINT AS blocks FROM p, f
  UNION ALL SELECT s, 0, 0, 1 FROM d GROUP BY s HAVING sum(n) = 0
), v AS (SELECT s, n, w, floor(w * (SELECT sum(n) FROM t) * (1 + {ROUNDING}) + 1e-6)::BIGINT AS budget, blocks FROM w
), k AS (SELECT d.*, w, budget, v.n AS total, h % blocks AS b FROM d JOIN v USING (s)
), g AS (SELECT s, b, sum(n)::BIGINT AS n, any_value(budget % greatest(total, 1)) AS rest FROM k GROUP BY ALL
), o AS (
  SELECT *, row_number() OVER x AS rank, rest - (sum(n) OVER x - n) AS more FROM g
  WINDOW x AS (PARTITION BY s ORDER BY {_MD5.format(what="s || ':' || b")}, b)
), r AS (
  SELECT k.*, rank, more, o.n AS held, sum(k.n) OVER (PARTITION BY k.s, k.b ORDER BY h) AS run FROM k JOIN o ON k.s = o.s AND k.b = o.b
)
SELECT doc_id, source, n::BIGINT AS n_tokens, round(w, 9) AS weight, budget AS source_budget, b AS block, rank::BIGINT AS block_rank,
  (CASE WHEN total > 0 THEN budget // total ELSE 0 END + CASE WHEN more >= held THEN 1 WHEN more >= 0 AND run <= more THEN 1 ELSE 0 END)::BIGINT AS copies
FROM r
"""
