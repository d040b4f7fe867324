"""Questions in words to structured questions: entities, period, intent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import few_or_merged, written
from .aliases import longest_in

# Keywords of intents.
DEFINITION = ("뭐야", "뭐지", "무엇", "무슨", "뭐냐", "뭔가요", "정의", "의미", "뜻", "개념", "설명해", "알려줘", "알려주세요", "가르쳐", "이란", "이라는")
NARRATIVE = (
    "사업", "개요", "전략", "연혁", "역사", "연구개발", "R&D", "어떤", "무엇", "왜", "어떻게", "설명", "분석", "평가",
    "부문", "제품", "서비스", "시장", "경쟁", "전망", "정책", "계획", "방침", "방향", "주요", "성과",
)
SECTOR = ("업종", "산업", "섹터", "peer", "비교해", "비교 해", "어디", "가장")
NEWS = ("최근", "요즘", "이슈", "동향", "현황", "분위기", "뉴스", "소식", "근황", "어떻게 되", "어떻게 돌아", "상황", "변화", "트렌드", "이슈는")
# Words of periods; patterns where a blank may stand or a word must end.
PRIOR = ("전기", "전년", "작년", "전분기")
CURRENT = ("당기", "당분기", "당년도", "금년", "기준")
END = r"말(?![\p{L}\p{N}_])|시점|기준|현재"
CUMULATIVE = ("누적", "지금까지", "총")
ANNUAL = r"연간|사업연도|사업\s*\(년\)|연말|12월\s*말"
HALF = ("반기", "상반기", "H1", "2분기말")
THIS_QUARTER = r"당분기|이번\s*분기"
#: Quarters as "3분기", "Q3" or "3Q", whichever stands first.
QUARTER = r"([1-4])\s*분기|[Qq]\s*([1-4])|([1-4])\s*[Qq]"


def has(text: Column, words: tuple[str, ...]) -> Column:
    """Whether the text has one of the words, as they are written."""
    return F.coalesce(text.rlike("|".join(r"\Q" + w + r"\E" for w in words)), F.lit(False))


def longest_contained(rows: DataFrame, key: str, text: Column, names: list[tuple[str, str]], out: str, words: bool = False) -> DataFrame:
    """rows with `out`: what the longest name contained in the text stands for; of equally long
    ones the first in the list; null without any. words: a name in ASCII counts only as a word,
    whatever its case, so that PER is not found in PERSON.

    The list is code, not data: a chain of tests, longest first, in one pass without a join.
    """
    ordered = sorted(enumerate(names), key=lambda x: (-len(x[1][0]), x[0]))
    found = F.lit(None).cast("string")
    for _, (name, stands_for) in reversed(ordered):
        hit = text.rlike(rf"(?i)(?<![a-z0-9])\Q{name}\E(?![a-z0-9])") if words and name.isascii() else text.contains(name)
        found = F.when(hit, stands_for).otherwise(found)
    return rows.withColumn(out, found)


def longest_alias(rows: DataFrame, key: str, text: Column, aliases: DataFrame) -> DataFrame:
    """key and name: the longest alias (alias, name) that stands in the text as whole words, for
    alias tables of any size: the text's words meet the aliases' first words in an equality join,
    and only those few are tested against the text. Aliases are broadcast if their rows, counted, are
    few; the words of the texts never are, though Spark takes them for as few as the texts."""
    words = F.array_distinct(F.filter(F.split(F.lower(text), r"\W+"), lambda w: w != ""))
    tokens = rows.select(key, F.lower(text).alias("_t"), F.explode(words).alias("_w"))
    first = aliases.select(F.lower("alias").alias("alias"), "name", F.split_part(F.lower(F.col("alias")), F.lit(" "), F.lit(1)).alias("_w"))
    whole = lambda t: F.concat(F.lit(" "), F.regexp_replace(t, r"\W+", " "), F.lit(" "))
    hits = tokens.join(few_or_merged(written(first, "first-words")), "_w").where(whole(F.col("_t")).contains(F.concat(F.lit(" "), F.col("alias"), F.lit(" "))))
    order = Window.partitionBy(key).orderBy(F.desc(F.length("alias")), "alias", "name")
    return hits.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").select(key, "alias", "name")


def period(text: Column) -> Column:
    """struct<year, scope, cp, type, variant> of a question."""
    year = F.nullif(F.regexp_extract(text, r"(20[0-9]{2})", 1), F.lit("")).cast("int")
    quarter = F.coalesce(*[F.nullif(F.regexp_extract(text, QUARTER, i), F.lit("")) for i in (1, 2, 3)])
    scope = F.when(quarter.isNotNull(), F.concat(quarter, F.lit("Q"))).when(has(text, HALF), "HY").when(text.rlike(ANNUAL), "FY").when(text.rlike(THIS_QUARTER), "3Q")
    end, cumulative = F.coalesce(text.rlike(END), F.lit(False)), has(text, CUMULATIVE)
    return F.struct(
        year.alias("year"),
        scope.alias("scope"),
        F.when(has(text, PRIOR), "P").when(has(text, CURRENT), "C").alias("cp"),
        F.when(end, "end").when(cumulative, "during").alias("type"),
        F.when(~end & cumulative, "A").alias("variant"),
    )


def intent(text: Column, corp: Column, account: Column, statement: Column, sector: Column, term: Column, scope: Column, year: Column) -> Column:
    """The first rule that holds, of ten."""
    c, f, p = corp.isNotNull(), account.isNotNull() | statement.isNotNull(), scope.isNotNull() | year.isNotNull()
    n, w = has(text, NARRATIVE), has(text, NEWS)
    return (
        F.when(term.isNotNull() & ~c, "definition")
        .when(term.isNotNull() & has(text, DEFINITION) & ~f, "definition")
        .when(sector.isNotNull() & ~c & has(text, SECTOR), "sector_compare")
        .when(c & w & ~(f & p), "news_context")
        .when(c & n & ~f, "narrative")
        .when(c & f & p & n, "hybrid")
        .when(c & f, "fact_lookup")
        .when(c, "narrative")
        .otherwise("general")
    )


def route_confidence(corp: Column, account: Column, year: Column, scope: Column) -> Column:
    part = lambda x, v: F.when(x.isNotNull(), v).otherwise(0)
    return (part(corp, 40) + part(account, 30) + part(year, 15) + part(scope, 15)) / F.lit(100.0)


def with_name(rows: DataFrame, text: Column, names: list[tuple[str, str]] | DataFrame, out: str, words: bool = False) -> DataFrame:
    """rows (qid, ...) with `out`: what the longest name in the text stands for. A list is code and is
    tested in one pass; a table (alias, name) is a dictionary of any size, and is joined."""
    if isinstance(names, list):
        return longest_contained(rows, "qid", text, names, out, words)
    found = longest_in(rows, "qid", text, names).select("qid", F.col("name").alias(out))
    return rows.join(found, "qid", "left")


def route(questions: DataFrame, names: dict[str, list[tuple[str, str]] | DataFrame]) -> DataFrame:
    """qid, text to entities, period, intent and confidence. names: corp, account, sector, term.

    Balance-sheet accounts are instants; flows are cumulative unless told; the period meant is the
    current one unless told. `총` in "자산총계" does not make it a flow.
    """
    text = F.col("text")
    rows = questions.withColumn("_flat", F.replace(text, F.lit(" "), F.lit("")))
    for field in ("corp", "sector", "term"):
        rows = with_name(rows, text, names[field], field, words=field == "term")
    rows = with_name(rows, F.col("_flat"), names["account"], "account")
    balance = F.col("account").isin("assets", "liabilities", "equity")
    rows = rows.withColumn("statement", F.when(balance, "BS").when(F.col("account").isNotNull(), "IS")).withColumn("p", period(text))
    return rows.select(
        "qid",
        "corp",
        "account",
        "sector",
        "statement",
        F.col("p.year").alias("year"),
        F.col("p.scope").alias("scope"),
        F.coalesce("p.cp", F.lit("C")).alias("cp"),
        F.when(F.col("statement") == "BS", "end").when(F.col("statement") == "IS", "during").otherwise(F.col("p.type")).alias("type"),
        F.when(F.col("statement") == "BS", None).when(F.col("statement") == "IS", F.coalesce("p.variant", F.lit("A"))).otherwise(F.col("p.variant")).alias("variant"),
        intent(text, F.col("corp"), F.col("account"), F.col("statement"), F.col("sector"), F.col("term"), F.col("p.scope"), F.col("p.year")).alias("intent"),
        route_confidence(F.col("corp"), F.col("account"), F.col("p.year"), F.col("p.scope")).alias("confidence"),
    )
