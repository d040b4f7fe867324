"""Filings (XML or HTML files) to facts, tables and sections.

A file is parsed in one task by a tolerant event parser; the rest is columns. A file that cannot
be read yields no cells; the manifest has its error.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.periods import parse_period_tag, tag_of_context
from ..functions.reports import DATED
from ..functions.text import collapse, markdown_table, normalize_account
from ..functions.values import parse_value
from ..operators.aliases import longest_in

# Statement classes with their statement and report type.
CLASSES = {
    "BS_C": ("재무상태표", "연결"), "BS_S": ("재무상태표", "별도"),
    "IS_C1": ("포괄손익계산서", "연결"), "IS_C2": ("포괄손익계산서", "연결"), "IS_C3": ("포괄손익계산서", "연결"),
    "IS_S1": ("포괄손익계산서", "별도"), "IS_S2": ("포괄손익계산서", "별도"), "IS_S3": ("포괄손익계산서", "별도"),
    "CF_C": ("현금흐름표", "연결"), "CF_S": ("현금흐름표", "별도"),
    "EF_C": ("자본변동표", "연결"), "EF_S": ("자본변동표", "별도"),
}
# What the titles of sections of statements, notes and audits hold. Their figures are
# facts already, so they are left out, as are sections shorter than MIN_SECTION.
BLOCKED = ("재무제표", "요약재무정보", "재무상태표", "손익계산서", "포괄손익계산서", "현금흐름표", "자본변동표", "감사의견", "감사보고서", "외부감사")
MIN_SECTION = 100
# Units as printed near a table, tested in this order, and the cells that may print them.
UNITS = (
    (r"단위\s*[:：]\s*백만\s*원", "백만원"), (r"단위\s*[:：]\s*천\s*원", "천원"), (r"단위\s*[:：]\s*억\s*원", "억원"), (r"단위\s*[:：]\s*원(?![\p{L}\p{N}_])", "원"),
    (r"\(\s*백만\s*원\s*\)", "백만원"), (r"\(\s*천\s*원\s*\)", "천원"),
)
UNIT_CELLS = ("te", "td", "tu")

CELLS = "kind string, tag string, class string, group_no int, groups array<int>, title string, section array<string>, table_no int, row_no int, cell_no int, label string, code string, context string, text string"


class _Events(HTMLParser):
    """Cells, tables' titles and paragraphs in document order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple] = []
        self.path: list[tuple[int, str]] = []
        self.table, self.groups, self.text = -1, 0, []
        self.inside: list[list] = []  # open table groups: number, class, title
        self.level = 0
        self.row = self.cell = -1
        self.label, self.attrs = "", {}

    def handle_starttag(self, tag: str, attrs) -> None:
        attrs = {k.upper(): v or "" for k, v in attrs}
        if tag.startswith("section-"):
            self.level = int(tag[8:] or 1) if tag[8:].isdigit() else 1
        elif tag == "table-group":
            self.groups += 1
            self.inside.append([self.groups, attrs.get("ACLASS", ""), ""])
        elif tag == "table":
            self.table, self.row = self.table + 1, -1
        elif tag == "tr":
            self.row, self.cell, self.label = self.row + 1, -1, ""
        elif tag in ("td", "te", "th", "tu"):
            self.cell, self.attrs, self.text = self.cell + 1, attrs, []
        elif tag in ("title", "p"):
            self.text = []

    def handle_data(self, data: str) -> None:
        self.text.append(data)

    def handle_endtag(self, tag: str) -> None:
        text = " ".join("".join(self.text).replace("　", " ").split())
        names, groups = [t for _, t in self.path], [n for n, _, _ in self.inside]
        group, kind, title = self.inside[-1] if self.inside else (-1, "", "")
        if tag == "table-group":
            self.inside = self.inside[:-1]
        elif tag in ("td", "te", "th", "tu"):
            if self.cell == 0:
                self.label = text
            self.rows.append(("cell", tag, kind, group, groups, title, names, self.table, self.row, self.cell, self.label, self.attrs.get("ACODE"), self.attrs.get("ACONTEXT"), text))
            self.text = []
        elif tag == "title":
            if self.inside:
                self.inside[-1][2] = text
            else:
                while self.path and self.path[-1][0] >= self.level:
                    self.path.pop()
                self.path.append((self.level, text))
            self.text = []
        elif tag == "p":
            if text:
                # a paragraph belongs to its section unless a statement's group holds it, at any depth
                held = next((k for _, k, _ in self.inside if k.removeprefix("{XBRL}") in CLASSES), kind)
                self.rows.append(("text", tag, held, group, groups, title, names, -1, len(self.rows), -1, "", None, None, text))
            self.text = []


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in CELLS.split(", ")]
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            events, error = _Events(), None
            try:
                events.feed(bytes(content).decode("utf-8"))
                events.close()
            except (UnicodeDecodeError, AssertionError, ValueError) as e:
                events.rows, error = [], str(e)[:200]
            frame = pd.DataFrame(events.rows or [("none", *[None] * (len(columns) - 1))], columns=columns)
            yield frame.assign(source_file=path, error=error)


def parsed(spark: SparkSession, folder: str) -> DataFrame:
    """Cells and paragraphs of all XML and HTML files of a folder, one row each."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{xml,XML,html,HTML}").load(folder).select("path", "content")
    return files.mapInPandas(_parse, CELLS + ", source_file string, error string")


def named(source_file: Column) -> dict[str, Column]:
    """Company and year from a name like [company]_[2024년도공시]_x.xml; with_companies() knows better."""
    name = F.url_decode(F.regexp_replace(F.element_at(F.split(source_file, "/"), -1), r"\+", "%2B"))
    year = F.regexp_extract(name, r"(\d{4})년도공시", 1)
    return {
        "corp_name": F.nullif(F.regexp_extract(name, r"[\[_]([가-힣A-Za-z0-9]+)[\]_]", 1), F.lit("")),
        "fiscal_year": F.nullif(F.when(year != "", year).otherwise(F.regexp_extract(name, r"(20\d{2})", 1)), F.lit("")).cast("int"),
    }


def statement_class(rows: DataFrame) -> DataFrame:
    """rows with xbrl_class, statement, report_type; nulls for classes that the map lacks."""
    code = F.regexp_extract(F.coalesce("class", F.lit("")), r"^\{XBRL\}([A-Z0-9_]+)", 1)
    pick = lambda i: F.create_map(*[F.lit(x) for k, v in CLASSES.items() for x in (k, v[i])])
    return rows.withColumns({"xbrl_class": F.nullif(code, F.lit("")), "statement": F.try_element_at(pick(0), code), "report_type": F.try_element_at(pick(1), code)})


def unit_hint(text: Column) -> Column:
    out = F.lit(None).cast("string")
    for pattern, unit in reversed(UNITS):
        out = F.when(text.rlike(pattern), unit).otherwise(out)
    return out


def surroundings(cells: DataFrame) -> DataFrame:
    """source_file, group_no, unit, dates of each group of tables, from all that stands in it, groups
    within it included: the first unit that a paragraph prints, else the first that a cell does; its
    first three paragraphs with a date or a business year, in order."""
    said = cells.where(F.col("kind").isin("text", "cell")).select("source_file", F.explode("groups").alias("group_no"), "kind", "tag", "table_no", "row_no", "cell_no", "text")
    is_cell = F.col("kind") == "cell"
    unit = F.when(~is_cell | F.col("tag").isin(*UNIT_CELLS), unit_hint(F.col("text")))
    date = F.when(~is_cell & F.col("text").rlike(DATED), F.struct("row_no", "text"))
    said = said.withColumns({"unit": unit, "date": date}).where("unit is not null or date is not null")
    dates = F.array_join(F.transform(F.slice(F.sort_array(F.collect_list("date")), 1, 3), lambda d: d["text"]), " | ")
    first = F.min(F.when(F.col("unit").isNotNull(), F.struct(is_cell, "table_no", "row_no", "cell_no", "unit")))
    return said.groupBy("source_file", "group_no").agg(first["unit"].alias("unit"), dates.alias("dates"))


def with_companies(rows: DataFrame, companies: DataFrame) -> DataFrame:
    """rows with corp_name: the longest known company (alias, name) that the file's name contains;
    files of none keep theirs. A row a file meets the companies, not a row a cell."""
    base = F.url_decode(F.regexp_replace(F.element_at(F.split("source_file", "/"), -1), r"\+", "%2B"))
    files = rows.select("source_file").distinct().withColumn("_name", base)
    known = longest_in(files, "source_file", F.col("_name"), companies).select("source_file", F.col("name").alias("_known"))
    return rows.join(known, "source_file", "left").withColumn("corp_name", F.coalesce("_known", "corp_name")).drop("_known")


def facts(cells: DataFrame) -> DataFrame:
    """Numeric cells of known statements: coded cells, not first in their row, whose row has a label
    and whose text is a number. fact_id has the file, so filings do not collide."""
    rows = statement_class(cells.where("kind = 'cell'")).where("statement is not null and code is not null and cell_no > 0 and label <> ''")
    near = surroundings(cells)
    rows = rows.join(near, ["source_file", "group_no"], "left")
    tag = tag_of_context(F.col("context"), F.col("dates"))
    rows = rows.withColumns(named(F.col("source_file"))).withColumns({"value": parse_value(F.col("text")), "period_tag": tag}).where("value is not null")
    p = parse_period_tag(F.col("period_tag"))
    ident = F.concat_ws("_", "corp_name", F.col("fiscal_year").cast("string"), "xbrl_class", "code", "period_tag", *[F.col(c).cast("string") for c in ("table_no", "row_no", "cell_no")], F.md5(F.col("source_file").cast("binary")))
    return rows.select(
        ident.alias("fact_id"), "corp_name", "fiscal_year", "source_file", "statement", "report_type", "xbrl_class", F.col("title").alias("statement_title"), F.coalesce("dates", F.lit("")).alias("title_dates"), F.col("code").alias("account_code"),
        F.col("label").alias("account_kr"), normalize_account(F.col("label")).alias("account_norm"), "period_tag", p["cp"].alias("period_cp"), p["year"].alias("period_year"), p["type"].alias("period_type"),
        p["scope"].alias("period_scope"), p["variant"].alias("period_variant"), F.coalesce(p["cp"] == "C", F.lit(True)).alias("is_current_period"), "value", F.col("text").alias("value_raw"), F.coalesce("unit", unit_hint(F.col("title"))).alias("unit_hint"),
    )


def tables(cells: DataFrame) -> DataFrame:
    """Tables of statements and of notes (class NT_...) as markdown; blank ones go."""
    rows = statement_class(cells.where("kind = 'cell'"))
    rows = rows.where(F.col("statement").isNotNull() | F.col("xbrl_class").startswith("NT_"))
    line = rows.groupBy("source_file", "table_no", "row_no", "xbrl_class", "statement", "report_type", "title").agg(F.sort_array(F.collect_list(F.struct("cell_no", "text"))).alias("c"))
    whole = line.groupBy("source_file", "table_no", "xbrl_class", "statement", "report_type", "title").agg(F.sort_array(F.collect_list(F.struct("row_no", F.col("c.text").alias("r")))).alias("t"))
    out = whole.withColumns(named(F.col("source_file"))).withColumn("markdown", markdown_table(F.col("t.r")))
    return out.where(F.regexp_replace("markdown", r"[|\-\s]", "") != "").drop("t")


def sections(cells: DataFrame) -> DataFrame:
    """Paragraphs of each section joined in document order; short and blocked sections go."""
    rows = statement_class(cells.where("kind = 'text' and size(section) > 0")).where("statement is null")
    whole = rows.groupBy("source_file", "section").agg(F.min("row_no").alias("at"), F.sort_array(F.collect_list(F.struct("row_no", "text"))).alias("p"))
    out = whole.withColumns(named(F.col("source_file"))).withColumn("text", collapse(F.array_join(F.col("p.text"), " ")))
    out = out.where((F.length("text") >= MIN_SECTION) & ~F.element_at("section", -1).rlike("|".join(BLOCKED)))
    number = F.row_number().over(Window.partitionBy("source_file").orderBy("at"))
    return out.select("corp_name", "fiscal_year", "source_file", F.col("section").alias("section_path"), number.alias("section_idx"), "text", F.length("text").alias("char_count"))


def manifest(cells: DataFrame) -> DataFrame:
    """Per file: cells, paragraphs, and the error of one that could not be read."""
    return cells.groupBy("source_file").agg(F.count_if(F.col("kind") == "cell").alias("n_cells"), F.count_if(F.col("kind") == "text").alias("n_texts"), F.max("error").alias("error"))


def process_directory(spark: SparkSession, folder: str, out: str) -> DataFrame:
    """Parses a folder once and writes facts, tables, sections and the manifest beneath `out`."""
    parsed(spark, folder).write.mode("overwrite").parquet(f"{out}/cells")
    cells = spark.read.parquet(f"{out}/cells")
    write_jsonl(facts(cells), f"{out}/facts")
    write_jsonl(tables(cells), f"{out}/tables")
    write_jsonl(sections(cells), f"{out}/sections")
    write_jsonl(manifest(cells), f"{out}/manifest")
    return spark.read.json(f"{out}/manifest")


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def build_fact_table(rows: DataFrame, path: str) -> DataFrame:
    """The facts without repeated ids, the first by file and row, partitioned by company's year."""
    w = Window.partitionBy("fact_id").orderBy("source_file", "value_raw")
    kept = rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    kept.write.mode("overwrite").partitionBy("period_year").parquet(path)
    return rows.sparkSession.read.parquet(path)
