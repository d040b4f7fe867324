import datetime

import pytest
from pyspark.sql import functions as F

from factlake.functions import reports, periods, text, values
from factlake.operators import chunking, retrieval, routing


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "raw, want",
    [("1,234", 1234.0), ("(1,234)", -1234.0), ("-5", -5.0), ("(-5)", 5.0), ("-", None), ("", None), (" ", None), ("n/a", None), ("1 234.5", 1234.5), (None, None), ("1e5", 1e5)],
)
def test_parse_value(spark, raw, want):
    assert one(spark, values.parse_value(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize(
    "tag, want",
    [
        ("CFY2025dHYA", ("C", 2025, "during", "HY", "A")),
        ("CFY2025eTQA", ("C", 2025, "end", "3Q", "A")),
        ("CFY2025dFY", ("C", 2025, "during", "FY", None)),
        ("PFY2024eTQ", ("P", 2024, "end", "3Q", None)),
        ("CFY2025zz", ("C", 2025, None, None, None)),
        ("XFY2025dFY", (None, None, None, None, None)),
        ("", (None, None, None, None, None)),
        (None, (None, None, None, None, None)),
    ],
)
def test_period_tag(spark, tag, want):
    assert tuple(one(spark, periods.parse_period_tag(F.lit(tag).cast("string")))) == want


def test_context_and_fiscal_period(spark):
    assert one(spark, periods.tag_of_context(F.lit("CFY2025dHYA_ifrs_Member"))) == "CFY2025dHYA"
    assert one(spark, periods.tag_of_context(F.lit("other"))) == "UNKNOWN"
    day = F.lit(datetime.date(2025, 3, 20))
    assert tuple(one(spark, periods.fiscal_period(F.lit("분기보고서 (2024.09)"), day))) == (2024, "3Q")
    assert tuple(one(spark, periods.fiscal_period(F.lit("사업보고서"), day))) == (2024, "FY")


@pytest.mark.parametrize("x, want", [(1.25e12, "1.3조원"), (3.4e8, "3억원"), (-56789, "-6만원"), (12, "12원"), (None, "N/A")])
def test_format_amount(spark, x, want):
    assert one(spark, values.format_amount(F.lit(x).cast("decimal(28,2)"))) == want


@pytest.mark.parametrize("label, want", [("Net sales (주30)", "revenue"), ("　매출액 ", "revenue"), ("영업이익(손실)", "operating_profit"), ("기타 (단위: 원)", "기타"), (None, None),
    ("매출액 (주25,26,33)", "revenue"), ("기타(주)", "기타(주)"), ("기타(주석3)", "기타(주석3)"), ("기타(주 3)(단위:원)", "기타(주3)"), ("기타(단위:원)(주3)", "기타"), ("기타(단위(a)", "기타"),
    ("-·기타, ", "기타"), ("(주3)", ""), ("가(나)(주 ,)", "가(나)"), ("주3)", "주3)"), ("a((주3)", "a("), ("(단위:원)b)", "(단위:원)b)")])
def test_normalize_account(spark, label, want):
    assert one(spark, text.normalize_account(F.lit(label).cast("string"))) == want


def test_numbers_and_status(spark):
    assert one(spark, text.numbers(F.lit("a 1,234 and 12 and 9.55 x 123"))) == ["1234", "9.55"]
    assert one(spark, text.number_match(F.lit("it is 58,414 of 1,234"), F.lit("58414 won"))) is True
    assert one(spark, text.number_match(F.lit("none"), F.lit("58414"))) is None
    assert [one(spark, text.answer_status(F.lit(a).cast("string"))) for a in (None, "", " ", "Error: x", "답변 생성 중 오류가 발생했습니다", "찾을 수 없습니다", "값을 확인할 수 없", "ok")] == [
        "empty", "empty", "answered", "answered", "error", "not_found", "not_found", "answered",
    ]


@pytest.mark.parametrize("truth, answer, want", [
    ("당사는 반도체를 생산합니다 그리고 반도체를 판매하고 있습니다", "반도체를 만든다", 0.25),  # 당사는 반도체를 생산 판매 (그리고, 있습니다 are no keywords)
    ("매출에서 이익까지", "매출 이익", 1.0), ("합니다", "합니다", None), ("a b c", "x", None), (None, "x", None), ("Net sales", "net SALES", 0.0), ("Net sales", "Netsale", 1.0),
])
def test_keyword_coverage(spark, truth, answer, want):
    """Values worked out by hand from the endings and the words that do not count."""
    got = one(spark, text.keyword_coverage(F.lit(truth).cast("string"), F.lit(answer)))
    assert got == want


def test_item_ids_do_not_collide(spark):
    ids = {one(spark, reports.item_id(F.lit("A B"), F.lit(2024), F.lit(None).cast("int"), "t", F.lit(n), F.lit("f"))) for n in (1, 9999, 10_000, 10_001, 99_990)}
    assert {i[:15] for i in ids} == {"A_B_2024Y_t0001", "A_B_2024Y_t9999", "A_B_2024Y_t1000", "A_B_2024Y_t9999"} and len(ids) == 5


def test_markdown(spark):
    rows = F.array(F.array(F.lit("a"), F.lit("b|c")), F.array(F.lit("1")))
    assert one(spark, text.markdown_table(rows)) == "| a | b\\|c |\n| --- | --- |\n| 1 |   |"


def test_html_and_urls(spark):
    assert one(spark, text.flat_text(F.lit("<p>a&amp;b</p><script>x</p></script><b>c</b>"))) == "a&b c"
    assert one(spark, text.source_of(F.lit("https://m.abc.example.org/x"))) == "Example Org"
    assert one(spark, text.last_json(F.lit('say {"a": {"b": 1}} ok'))) == '{"a": {"b": 1}}'


@pytest.mark.parametrize("size, overlap", [(20, 0), (20, 5), (7, 2)])
def test_split_text(size, overlap):
    source = "One two three.\n\nFour five six seven, eight. Nine\nten eleventwelvethirteenfourteen end"
    parts = chunking.split_text(source, size, overlap)
    assert all(0 < len(p) <= size for p in parts)
    assert set("".join(source.split())) <= set("".join("".join(parts).split()))
    if not overlap:
        assert "".join("".join(parts).split()) == "".join(source.split())


def test_relax(spark):
    hits = spark.createDataFrame([(1, 2, "a"), (1, 1, "b"), (2, 2, "c"), (3, 0, "d"), (3, 2, "e")], "qid int, level int, doc string")
    assert sorted((r.qid, r.doc, r.applied) for r in retrieval.relax(hits).collect()) == [(1, "b", 1), (2, "c", 2), (3, "d", 0)]


@pytest.mark.parametrize("q, want", [("2024년 3분기 누적", (2024, "3Q", None, "during", "A")), ("작년 연간 기준", (None, "FY", "P", "end", None)), ("상반기 현재", (None, "HY", None, "end", None)), ("hello", (None, None, None, None, None))])
def test_period_of_question(spark, q, want):
    assert tuple(one(spark, routing.period(F.lit(q)))) == want


def test_relative_time_and_rfc822(spark):
    t = one(spark, periods.parse_rfc822(F.lit("Mon, 01 Jan 2024 09:00:00 +0900")))
    assert t == datetime.datetime(2024, 1, 1, 0, 0)
    assert one(spark, periods.parse_rfc822(F.lit("nonsense"))) is None


def test_fact_accuracy(spark):
    """The given tables hold no scorable turn, so the rollup's figures are held here: halves round up, unscorable rows do not count."""
    from factlake.operators.evaluate import fact_accuracy

    rows = [("a", "x", True), ("a", "x", False), ("a", "x", False), ("a", "x", None), ("a", "y", True), ("c", "x", None)]
    rows += [("b", "x", i == 0) for i in range(8)]
    scored = spark.createDataFrame(rows, "system string, category string, number_ok boolean")
    want = [("a", "total", 4, 2, 50), ("a", "x", 3, 1, 33), ("a", "y", 1, 1, 100), ("b", "total", 8, 1, 13), ("b", "x", 8, 1, 13)]
    assert sorted(tuple(r) for r in fact_accuracy(scored).collect()) == want
    assert fact_accuracy(scored.limit(0)).count() == 0


@pytest.mark.parametrize("title, quarter, end", [
    ("제 3 분기 2024.09.30", 3, "2024-09-30"), ("2Q 3분기", 3, None), ("q4 실적 (2024-1-5)", 4, "2024-01-05"), ("반기 2024.06.30, 2024년 6 월 3일", 2, "2024-06-03"), ("사업보고서", None, None), (None, None, None), ("5Q", None, None),
])
def test_quarters_and_dates_of_titles(spark, title, quarter, end):
    t = F.lit(title).cast("string")
    assert (one(spark, reports.quarter(t)), one(spark, reports.period_end(t))) == (quarter, end)
