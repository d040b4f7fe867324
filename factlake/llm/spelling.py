"""Spelling variants: words of a corpus that one inserted, deleted or replaced letter tells apart.

Asymmetric chunks. Of two such words the shorter one, cut into two disjoint chunks, has one chunk that the
edit leaves alone; the longer one has it too, as the gram that stands as far from its beginning or from
its end, so shifted by one place at most. So a word contributes its two chunks under its own length, and
under the length of words one shorter the two grams of such size that can stand within that shift: the
other positional grams can meet no chunk. Words of one length meet as chunks. What meets is verified.

A chunk that too many words share is not compared: what is left of the word is cut into two again, and the
words meet under what is known to agree and one half of the rest. The edit is in one of the halves, so
nothing is lost, and a hot beginning or ending is split until what shares it is few. This ends when a
single letter is left open, where a group has no more words than there are letters, or pairs of them.

Defined results: a null text has no words, a null doc_id is written as nothing. Rows that repeat count
again. An empty table gives no rows. A word has no form if nothing near it is MORE times as frequent.
Only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, job, release, stored, table

RUN = r"[A-Za-zÀ-ÿ]"
#: Code points of a word at least, its occurrences, the share of runs that lose a letter, and how many
#: times as frequent a form is.
LENGTH, OCCURRENCES, LOSES, MORE = 7, 2, 31, 10
#: Pairs that the words of a chunk are compared in, at most; beyond that the rest of the word is cut again.
PAIRS = 64


def _lowered(run: Column) -> Column:
    """A-Z lower-cased; the quick way for runs of ASCII, which is all of that there."""
    ascii_only = F.octet_length(run) == F.length(run)
    return F.when(ascii_only, F.lower(run)).when(run.rlike("[A-Z]"), ascii_lower(run)).otherwise(run)


def occurrences(docs: DataFrame) -> DataFrame:
    """word, n: the runs of letters, one in LOSES without a letter that its document and itself name."""
    found = F.regexp_extract_all("text", F.lit(RUN + f"{{{LENGTH},}}"), F.lit(0))  # shorter runs are no words
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(found).alias("run"))
    runs = runs.select("doc", _lowered(F.col("run")).alias("run")).select("run", F.crc32(F.concat("doc", F.lit(":"), "run")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % LOSES == 0, shorter).otherwise(F.col("run")).alias("word")
    return runs.select(word).where(F.length("word") >= LENGTH).groupBy("word").agg(F.count("*").alias("n"))


def _chunks(rows: DataFrame) -> DataFrame:
    """Each row twice, with one half or the other of its open middle closed, and the key of what is closed.

    size: length of the words that contribute chunks here; grams: 1 for a word one longer, whose open
    middle is one longer; head, tail: code points closed at the beginning and at the end.
    """
    half = F.expr("(size - head - tail) div 2").cast("int")
    rest = (F.col("size") - F.col("head") - F.col("tail")).cast("int")
    closed = F.array(F.struct((F.col("head") + half).alias("head"), F.col("tail").alias("tail")), F.struct(F.col("head").alias("head"), (F.col("tail") + rest - half).alias("tail")))
    out = rows.select("word", "n", "size", "grams", F.explode(closed).alias("c")).select("word", "n", "size", "grams", "c.head", "c.tail")
    ending = F.substring("word", F.length("word") - F.col("tail") + 1, F.col("tail"))
    return out.withColumn("key", F.xxhash64("size", "head", "tail", F.substring("word", F.lit(1), F.col("head")), ending))


def near_pairs(words: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """a, a_n, b, b_n: every two words that one edit tells apart, once. words: word, n, each word once."""
    roles = F.array(F.struct(F.length("word").alias("size"), F.lit(0).alias("grams")), F.struct((F.length("word") - 1).alias("size"), F.lit(1).alias("grams")))
    rows = words.select("word", "n", F.explode(roles).alias("r")).select("word", "n", "r.*", F.lit(0).alias("head"), F.lit(0).alias("tail"))
    found = known = None
    while True:
        chunks = stored(_chunks(rows), "chunks")
        if known is not None:
            release(known)
        c, g = F.count_if(F.col("grams") == 0), F.count_if(F.col("grams") == 1)
        work = (c * (c - 1) / 2 + c * g).alias("work")
        met = chunks.groupBy("key").agg(work).where("work > 0")
        known = stored(chunks.join(met, "key"), "met")
        release(chunks)
        # a middle of one letter cannot be cut: such a group is bounded by the letters there are
        last = F.col("size") - F.col("head") - F.col("tail") <= 1
        few = known.where((F.col("work") <= pairs) | last)
        a = few.where("grams = 0").select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
        b = few.select("key", F.col("word").alias("b"), F.col("n").alias("b_n"), "grams")
        one_edit = F.levenshtein("a", "b", 1) == 1
        links = a.join(b, (a["key"] == b["key"]) & ((F.col("grams") == 1) | (F.col("a") < F.col("b"))) & one_edit).select("a", "a_n", "b", "b_n")
        links = stored(links, "links")
        found = links if found is None else found.union(links)
        many = known.where((F.col("work") > pairs) & ~last)
        if many.isEmpty():
            break
        rows = many.select("word", "n", "size", "grams", "head", "tail")
    return found.distinct()  # an inserted letter beside its like is found from either side


def _roots(forms: DataFrame) -> DataFrame:
    """word, root of words that have a form: the last of the forms' forms. Each round doubles the steps
    taken; a form is MORE times as frequent as its word, so there are few."""
    at = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = at.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        joined = stored(at.join(onward, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")), "roots")
        release(at)
        at = joined
        if at.where("moved").isEmpty():
            return at.drop("moved")


@job
def spelling_variants(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) to word, n, n_near, form, form_n, root."""
    words = stored(occurrences(docs).where(F.col("n") >= OCCURRENCES), "words")
    links = stored(near_pairs(words), "near")
    both = links.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).union(links.select("b", "a", "a_n"))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))  # the most frequent, of equals the first
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))
    has = F.col("near_n") >= MORE * F.col("n")
    forms = stored(joined.select("word", "n", "n_near", F.when(has, F.col("near")).alias("form"), F.when(has, F.col("near_n")).alias("form_n")), "forms")
    roots = _roots(forms.where("form is not null"))
    return forms.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents", "doc_id", "text"))


#: CRC-32 by a table that its polynomial gives; UTF-8 of letters up to U+00FF has one byte, or 195 and another.
_CRC_SQL = """
xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(s, ''), lambda ch: CASE WHEN ord(ch) < 128 THEN [ord(ch)::BIGINT] ELSE [195::BIGINT, (ord(ch) - 64)::BIGINT] END))),
  lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295)"""
OP11_SQL = f"""
WITH RECURSIVE t AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS crc),
runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents)),
hashed AS (
  SELECT run, occurs, {_CRC_SQL} AS h
  FROM (SELECT run, count(*) AS occurs, coalesce(doc_id::VARCHAR, '') || ':' || run AS s FROM runs WHERE length(run) >= {LENGTH} GROUP BY doc_id, run), t),
lettered AS (
  SELECT occurs, CASE WHEN h % {LOSES} = 0 THEN substring(run, 1, (h % length(run))::BIGINT) || substring(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM hashed),
words AS MATERIALIZED (
  SELECT word, sum(occurs)::BIGINT AS n FROM lettered WHERE length(word) >= {LENGTH} GROUP BY word HAVING sum(occurs) >= {OCCURRENCES}),
without AS MATERIALIZED (
  SELECT word, n, length(word) AS l, i, word[1:i - 1] || word[i + 1:] AS d FROM words, range(1, length(word) + 1) AS r(i)),
near AS MATERIALIZED (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM without a JOIN without b ON a.d = b.d AND a.i = b.i AND a.l = b.l AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM words a JOIN without b ON a.word = b.d
  UNION SELECT b.word, b.n, a.word, a.n FROM words a JOIN without b ON a.word = b.d),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM near GROUP BY word),
forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {MORE} * w.n THEN near END AS form, CASE WHEN near_n >= {MORE} * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word),
chain AS (
  SELECT word, word AS at FROM forms
  UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON c.at = f.word WHERE f.form IS NOT NULL),
roots AS (SELECT c.word, c.at AS root FROM chain c JOIN forms f ON c.at = f.word WHERE f.form IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM forms f JOIN roots r ON f.word = r.word
"""
