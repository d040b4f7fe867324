import pytest
import pytest
from pyspark.sql import functions as F

from factlake.functions.periods import fiscal_period
from factlake.sources import filings, tables

PAGE = """<?xml version="1.0" encoding="utf-8"?><DOCUMENT><COMPANY-NAME>Acme</COMPANY-NAME><BODY>
<SECTION-1><TITLE>사업의 내용</TITLE><P>{long}</P><SECTION-2><TITLE>위험 관리</TITLE><P>{long2}</P><P>tail &lt;x&gt;</P></SECTION-2></SECTION-1>
<SECTION-1><TITLE>목차</TITLE><P>{long}</P></SECTION-1><SECTION-1><TITLE>short</TITLE><P>{short}</P></SECTION-1>
<TABLE-GROUP ACLASS="{{XBRL}}IS_C1"><TITLE>손익 (단위: 백만원)</TITLE><P>not a section</P><TABLE>
<TR><TE ACODE="h">과목</TE><TE>당기</TE></TR>
<TR><TE>매출액 (주3)</TE><TE ACODE="rev" ACONTEXT="CFY2024dFY_x">1,234</TE><TE ACODE="rev" ACONTEXT="PFY2023dFY_x">(1,000)</TE></TR>
<TR><TE>매출원가</TE><TE ACODE="cost" ACONTEXT="CFY2024dFY_x">-</TE><TE ACONTEXT="CFY2024dFY_x">77</TE></TR>
<TR><TE> </TE><TE ACODE="odd" ACONTEXT="CFY2024dFY_x">5</TE></TR></TABLE></TABLE-GROUP>
<TABLE-GROUP ACLASS="{{XBRL}}NT_1"><TITLE>note</TITLE><TABLE><TR><TD>a|b</TD><TD>c</TD></TR></TABLE></TABLE-GROUP>
<TABLE-GROUP ACLASS="{{XBRL}}ZZ"><TITLE>none</TITLE><TABLE><TR><TD>q</TD><TD ACODE="z">9</TD></TR></TABLE></TABLE-GROUP>
</BODY></DOCUMENT>""".format(long="가" * 100, long2="나" * 120, short="다" * 99)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("filings")
    (d / "[Acme]_[2024년도공시]_1.xml").write_text(PAGE)
    (d / "[Acme]_[2024년도공시]_2.xml").write_text(PAGE)
    (d / "[Bad]_[2023년도공시]_1.xml").write_bytes(b"<DOCUMENT>\xff\xfe\xff")
    return d


def test_parts(spark, folder):
    cells = filings.parsed(spark, f"file://{folder}").cache()
    facts = filings.facts(cells).collect()
    assert len(facts) == 4 and len({f.fact_id for f in facts}) == 4
    assert {(f.corp_name, f.fiscal_year, f.account_norm, f.period_cp, f.period_year, f.period_scope, f.value, f.unit_hint) for f in facts} == {
        ("Acme", 2024, "revenue", "C", 2024, "FY", 1234.0, "백만원"),
        ("Acme", 2024, "revenue", "P", 2023, "FY", -1000.0, "백만원"),
    }
    sections = filings.sections(cells).where("source_file like '%_1.xml'").orderBy("section_idx").collect()
    assert [(s.section_path, s.char_count) for s in sections] == [(["사업의 내용"], 100), (["사업의 내용", "위험 관리"], 129), (["목차"], 100)]
    assert sections[1].text.endswith("tail <x>")
    kept = filings.tables(cells).where("source_file like '%_1.xml'").orderBy("table_no").collect()
    assert [t.xbrl_class for t in kept] == ["IS_C1", "NT_1"] and kept[1].markdown.startswith("| a\\|b | c |")
    bad = {r.source_file[-12:]: r for r in filings.manifest(cells).collect() if r.error}
    assert len(bad) == 1


def test_written_tables(spark, folder, tmp_path):
    out = f"file://{tmp_path}/out"
    assert filings.process_directory(spark, f"file://{folder}", out).count() == 3
    facts = tables.read_facts(spark, f"{out}/facts")
    built = filings.build_fact_table(facts.union(facts), f"{out}/built")
    assert built.count() == 4
    assert tables.read_sections(spark, f"{out}/sections").count() == 6


def test_codes(spark, tmp_path):
    (tmp_path / "codes.csv").write_text("corp_code,corp_name,stock_code\n126380,Acme,5930\n1,None,\n")
    assert [tuple(r) for r in tables.read_codes(spark, f"file://{tmp_path}/codes.csv").collect()] == [("00126380", "Acme", "005930")]


UNITS = """<DOCUMENT><BODY><SECTION-1><TITLE>III. 재무</TITLE><P>{long}</P>
<TABLE-GROUP ACLASS="{{XBRL}}BS_C"><TITLE>재무상태표</TITLE><P>제 56 기 2024.12.31 현재</P><P>(단위 : 천원)</P><TABLE><TR><TE ACODE="h">x</TE></TR>
<TR><TE>자 산 총 계</TE><TE ACODE="a" ACONTEXT="CFY2024eFY_x">5</TE></TR></TABLE></TABLE-GROUP>
<TABLE-GROUP ACLASS="{{XBRL}}IS_S1"><TITLE>손익계산서</TITLE><TABLE><TR><TD>(단위 : 백만원)</TD></TR><TR><TE>매출액</TE><TE ACODE="r" ACONTEXT="CFY2024dFY_x">7</TE></TR></TABLE>
<TABLE-GROUP ACLASS="{{XBRL}}ZZ"><P>{inner}</P></TABLE-GROUP></TABLE-GROUP>
<TABLE-GROUP ACLASS="{{XBRL}}ZZ"><P>{free}</P></TABLE-GROUP>
</SECTION-1><SECTION-1><TITLE>연결재무제표 주석</TITLE><P>{long}</P></SECTION-1></BODY></DOCUMENT>""".format(long="가" * 100, inner="나" * 10, free="다" * 10)


def test_units_groups_and_blocked_titles(spark, tmp_path):
    """Units stand in paragraphs or cells; text of groups that are no statement stays; notes go."""
    (tmp_path / "[Acme]_[2024년도공시]_1.xml").write_text(UNITS)
    cells = filings.parsed(spark, f"file://{tmp_path}").cache()
    assert {(f.account_norm, f.unit_hint) for f in filings.facts(cells).collect()} == {("assets", "천원"), ("revenue", "백만원")}
    assert [(s.section_path, s.char_count) for s in filings.sections(cells).collect()] == [(["III. 재무"], 111)]


def test_latest_filings_and_periods(spark):
    rows = [("1", "사업보고서 (2023.12)", "b"), ("1", "사업보고서 (2023.12)", "a"), ("2", "분기보고서", "z"), ("3", "주요사항", "q")]
    got = tables.latest_filings(spark.createDataFrame(rows, "rcept_no string, report_nm string, corp string")).orderBy("rcept_no").collect()
    assert [(r.rcept_no, r.corp, r.kind) for r in got] == [("1", "a", "A001"), ("2", "z", "A003")]
    cases = [("사업보고서", "2024-03-11", 2023, "FY"), ("반기보고서", "2024-08-14", 2024, "HY"), ("분기보고서", "2024-05-16", 2024, "1Q"), ("분기보고서", "2024-11-14", 2024, "3Q"), ("공시", "2024-02-01", 2024, "?"), ("분기보고서 (2024.09)", "2024-11-14", 2024, "3Q")]
    frame = spark.createDataFrame([(t, d) for t, d, *_ in cases], "t string, d string").select(fiscal_period(F.col("t"), F.to_date("d")).alias("p"))
    assert [(r.p.year, r.p.scope) for r in frame.collect()] == [c[2:] for c in cases]


def group(kind, *parts, unit="", rows=""):
    said = "".join(f"<P>{p}</P>" for p in parts)
    return f'<TABLE-GROUP ACLASS="{{XBRL}}{kind}"><TITLE>t</TITLE>{said}<TABLE>{unit}<TR><TE>매출액</TE><TE ACODE="r" ACONTEXT="other">7</TE></TR>{rows}</TABLE></TABLE-GROUP>'


@pytest.mark.parametrize("parts, cell, want", [
    (["이번 표는 천원까지 적었다"], "", None), (["(천 원)"], "", "천원"), (["( 백만원 )"], "", "백만원"), (["(억원)"], "", None), (["단위 : 억 원"], "", "억원"), (["단위：원"], "", "원"), (["단위 : 원화"], "", None),
    (["없음"], "<TR><TH>(단위 : 천원)</TH></TR>", None), (["없음"], "<TR><TU>(단위 : 천원)</TU></TR>", "천원"), (["(단위 : 원) (백만원)", "단위 : 천원"], "", "원"), (["x", "단위 : 천원"], "<TR><TD>단위 : 백만원</TD></TR>", "천원"),
])
def test_units_as_printed(spark, tmp_path, parts, cell, want):
    """Literal expectations: a unit counts with its heading or in brackets, not as a word of a sentence."""
    (tmp_path / "[Acme]_[2024년도공시]_1.xml").write_text(f"<DOCUMENT>{group('IS_C1', *parts, unit=cell)}</DOCUMENT>")
    assert [f.unit_hint for f in filings.facts(filings.parsed(spark, f"file://{tmp_path}")).collect()] == [want]


def test_periods_from_text_near_a_table(spark, tmp_path):
    """Cells without a period in their context take it from the first three dated paragraphs of their group."""
    body = [
        group("IS_C1", "제 56 기 반기말 2024.06.30 현재", "other"), group("IS_C2", "제 56 기 3분기 2024.09.30"), group("IS_C3", "2024-12-31 기말", "제 55 기", "2022.12.31", "2021.12.31"),
        group("BS_C", "반기, but no date"), f'<TABLE-GROUP ACLASS="{{XBRL}}CF_C"><TITLE>t</TITLE>{group("ZZ", "제 1 분기 2024.03.31 1분기말")}<TABLE><TR><TE>매출액</TE><TE ACODE="r">7</TE></TR></TABLE></TABLE-GROUP>',
    ]
    (tmp_path / "[Acme]_[2024년도공시]_1.xml").write_text(f"<DOCUMENT>{''.join(body)}</DOCUMENT>")
    got = {f.xbrl_class: (f.period_tag, f.title_dates, f.is_current_period) for f in filings.facts(filings.parsed(spark, f"file://{tmp_path}")).collect()}
    assert got == {
        "IS_C1": ("UNK_HY_END", "제 56 기 반기말 2024.06.30 현재", True), "IS_C2": ("UNK_3Q_CUM", "제 56 기 3분기 2024.09.30", True), "IS_C3": ("UNK_FY_END", "2024-12-31 기말 | 제 55 기 | 2022.12.31", True),
        "BS_C": ("UNKNOWN", "", True), "CF_C": ("UNK_1Q_END", "제 1 분기 2024.03.31 1분기말", True),
    }
