"""A dialogue from raw questions to answers: memory, late classification, dispatch."""

from pyspark.sql import functions as F

from factlake.operators import asking

NAMES = {
    "corp": [("삼성전자", "SEC"), ("현대차", "HMC")],
    "account": [("매출액", "revenue"), ("영업이익", "operating_profit"), ("자산총계", "assets")],
    "sector": [("반도체", "반도체")],
    "term": [("ROE", "ROE")],
}
TURNS = [
    (1, 1, "2024년 연간 매출액 알려줘"), (1, 2, "삼성전자 2024년 3분기 매출액"), (1, 3, "그럼 영업이익은?"), (1, 4, "전년 대비는?"), (1, 5, "이 회사 전략은?"), (1, 6, "현대차는?"), (1, 7, "그 회사 자산총계"),
    (2, 1, "안녕"), (2, 2, "ROE 뜻"), (2, 3, "반도체 업종 비교"), (3, 1, "현대차 최근 뉴스"), (3, 2, "왜?"), (None, 1, "삼성전자 매출액"),
]
# what the rules give, worked out by hand: corp, year, scope, account, intent, used
WANT = [
    (None, 2024, "FY", "revenue", "general", False), ("SEC", 2024, "3Q", "revenue", "fact_lookup", False), ("SEC", 2024, "3Q", "operating_profit", "fact_lookup", True), ("SEC", 2023, "3Q", "operating_profit", "fact_lookup", True),
    ("SEC", 2023, "3Q", None, "narrative", True), ("HMC", 2023, "3Q", None, "narrative", True), ("HMC", 2023, "3Q", "assets", "fact_lookup", True),
    (None, None, None, None, "general", False), (None, None, None, None, "definition", False), (None, None, None, None, "sector_compare", False), ("HMC", None, None, None, "news_context", False), ("HMC", None, None, None, "narrative", True),
    ("SEC", None, None, "revenue", "fact_lookup", False),
]


def questions(spark):
    return spark.createDataFrame([(i, s, t, q) for i, (s, t, q) in enumerate(TURNS)], "qid bigint, session bigint, turn int, text string")


def test_questions_are_understood_in_their_dialogue(spark):
    got = asking.understood(questions(spark), NAMES).orderBy("qid").collect()
    assert [(r.corp, r.year, r.scope, r.account, r.intent, r.used) for r in got] == WANT


def test_each_handler_sees_its_own_questions(spark):
    def names_itself(name):
        return lambda rows: rows.where(F.col("qid") != 6).select("qid", F.concat(F.lit(name + " "), F.coalesce("corp", F.lit("-"))).alias("answer"))

    out = asking.ask_batch(questions(spark), NAMES, {n: names_itself(n) for n in ("fact_lookup", "narrative", "definition")}).orderBy("qid").collect()
    assert [r.intent for r in out] == [w[4] for w in WANT]
    assert [r.answer for r in out if r.status == "answered"] == [f"{w[4]} {w[0] or '-'}" for i, w in enumerate(WANT) if w[4] in ("fact_lookup", "narrative", "definition") and i != 6]
    assert {r.qid for r in out if r.status == "not_found"} == {0, 6, 7, 9, 10}
