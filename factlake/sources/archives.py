"""Rows of XML files inside ZIP archives, as a Python data source: a task for each member.

    spark.dataSource.register(ZippedXml)
    spark.read.format("zipped_xml").schema("corp_code string, corp_name string").option("row_tag", "list").load(path)

The driver reads the archives' directories only. A task opens its archive where it lies, streams one member
and keeps one element in memory; an archive's members are thus read side by side.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructType

from .tables import CODES


def _open(path: str):
    store, at = fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{path}")
    return store, at


class _Member(InputPartition):
    def __init__(self, archive: str, member: str):
        self.archive, self.member = archive, member


class ZippedXmlReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names, self.tag = schema.fieldNames(), options.get("row_tag", "list")
        self.paths = options["path"].split(",")
        wrong = [f.name for f in schema.fields if not isinstance(f.dataType, StringType)]
        if wrong:
            raise ValueError(f"elements are text; cast what is read: {', '.join(wrong)}")

    def partitions(self) -> list[_Member]:
        out = []
        for path in self.paths:
            store, at = _open(path)
            info = store.get_file_info(at)
            found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at, allow_not_found=True))
            for name in sorted(f.path for f in found if f.path.lower().endswith(".zip") and f.is_file):
                with store.open_input_file(name) as raw, zipfile.ZipFile(raw) as z:
                    prefix = path[: len(path) - len(at)] if path.endswith(at) else "file://"
                    out += [_Member(prefix + name, m.filename) for m in z.infolist() if m.filename.lower().endswith(".xml")]
        return out

    def read(self, partition: _Member) -> Iterator[tuple]:
        store, at = _open(partition.archive)
        with store.open_input_file(at) as raw, zipfile.ZipFile(raw) as z, z.open(partition.member) as stream:
            path = []
            for event, element in ElementTree.iterparse(stream, events=("start", "end")):
                if event == "start":
                    path.append(element)
                    continue
                path.pop()
                if element.tag == self.tag:
                    found = {child.tag: "".join(child.itertext()) for child in element}
                    yield tuple(found.get(n) for n in self.names)
                    if path:
                        path[-1].remove(element)  # else the parent keeps all of them


class ZippedXml(DataSource):
    """path: an archive, or a folder of archives; row_tag: the element that is a row. Columns are the texts of
    its children of that name, null where there is none."""

    @classmethod
    def name(cls) -> str:
        return "zipped_xml"

    def schema(self) -> str:
        return CODES

    def reader(self, schema: StructType) -> ZippedXmlReader:
        return ZippedXmlReader(schema, self.options)


def company_list(spark: SparkSession, path: str) -> DataFrame:
    """Companies of zipped lists: codes padded to eight and six digits; those without a stock code go, be it
    missing, blank, or the word that a null had become."""
    spark.dataSource.register(ZippedXml)
    rows = spark.read.format("zipped_xml").schema(CODES).option("row_tag", "list").load(path)
    stock = F.trim("stock_code")
    return rows.where((stock != "") & (F.lower(stock) != "nan")).select(F.lpad(F.trim("corp_code"), 8, "0").alias("corp_code"), F.trim("corp_name").alias("corp_name"), F.lpad(stock, 6, "0").alias("stock_code"))
