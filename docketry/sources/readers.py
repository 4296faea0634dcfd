"""Readers with fixed schemas: nothing is inferred."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from docketry.sources.tables import write_counted

SNAPSHOT = "id BIGINT, name STRING, ext STRING, path STRING, pages INT"
TEXT_INTAKE = "entry_id BIGINT, full_text STRING, text_source STRING, di_model STRING, di_confidence DOUBLE, paragraphs ARRAY<STRUCT<num: STRING, text: STRING>>"


def texts(columns: Sequence[str]) -> StructType:
    return StructType([StructField(c, StringType()) for c in columns])


def read_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """All values as text, by header; a byte-order mark doesn't matter."""
    df = spark.read.csv(path, header=True, schema=texts(columns), multiLine=True, escape='"', enforceSchema=True, encoding="UTF-8")
    return df


def read_json_array(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """An array of objects in one file, all values as text."""
    return spark.read.schema(texts(columns)).option("multiLine", True).json(path)


def parsed_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(line, file, r): JSON lines, plain or gzip, blank ones left out; ``r`` is null where a line isn't an object."""
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.input_file_name().alias("file")).where(F.trim("value") != "")
    typed = F.from_json("line", schema, {"mode": "PERMISSIVE"})
    return lines.withColumn("r", F.when(F.trim("line").startswith("{") & F.try_parse_json("line").isNotNull(), typed))


def _snapshot_lines(spark: SparkSession, path: str) -> tuple[DataFrame, Column]:
    lines = parsed_lines(spark, path, SNAPSHOT).withColumn("whole", F.get_json_object("line", "$.id").rlike(r"^-?\d+$"))
    return lines, F.col("r.id").isNotNull() & F.coalesce("whole", F.lit(False))


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, malformed lines) of an index snapshot; a record needs an integer id."""
    lines, good = _snapshot_lines(spark, path)
    return lines.where(good).select("r.*"), lines.where(~good).select("file", "line")


def load_snapshot(spark: SparkSession, path: str, folder: str) -> dict[str, int]:
    """Writes an index snapshot's records and malformed lines below a folder, as ``kind=record`` and ``kind=malformed``, in one pass over
    its files that also counts ``lines``, ``records`` and ``malformed``."""
    lines, good = _snapshot_lines(spark, path)
    both = lines.select(F.when(good, "record").otherwise("malformed").alias("kind"), "r.*", "file", F.when(~good, F.col("line")).alias("line"))
    kind = F.col("kind")
    return write_counted(both, folder, "kind", lines=F.count("*"), records=F.count_if(kind == "record"), malformed=F.count_if(kind == "malformed"))


def read_texts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, rejected lines) of text intake; ``has_paragraphs`` tells a missing key from an empty list. A folder
    without files raises ``ValueError``."""
    lines = parsed_lines(spark, path, TEXT_INTAKE)
    if not lines.inputFiles():
        raise ValueError(f"{path} holds no files")
    keyed = F.col("line").rlike(r'"paragraphs"\s*:')
    good = F.col("r.entry_id").isNotNull()
    return lines.where(good).select("r.*", keyed.alias("has_paragraphs")), lines.where(~good | F.col("r").isNull()).select("file", "line")


def list_files(spark: SparkSession, root: str, pattern: str = "*.pdf", pruned: str = "state architect files") -> DataFrame:
    """(path, size, modified) of files below a folder, without their contents; a pruned folder's files are left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")).where(~F.lower("path").rlike(rf"/([0-9a-z](\.\d+)*(\s|%20)+)?{pruned.replace(' ', '(%20| )')}/"))


# Headings of an index workbook's first sheet by column.
WORKBOOK = {"Path": "path", "Name": "name", "Type": "type", "Entry ID": "entry_id", "Page Count": "pages"}


def sheet_rows(content: bytes) -> Iterator[dict[str, str]]:
    """Rows of a workbook's first sheet as texts by the headings of its first row."""
    tag = lambda e: e.tag.rpartition("}")[2]
    text = lambda e: "".join(t.text or "" for t in e.iter() if tag(t) == "t")
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        shared = [text(e) for e in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        heads: dict[str, str] = {}
        with book.open(min(n for n in names if n.startswith("xl/worksheets/sheet"))) as sheet:
            for _, row in ElementTree.iterparse(sheet):
                if tag(row) != "row":
                    continue
                cells = {}
                for cell in row:
                    value = next((v.text or "" for v in cell if tag(v) == "v"), text(cell))
                    cells[cell.get("r", "").rstrip("0123456789")] = shared[int(value)] if cell.get("t") == "s" and value else value
                row.clear()
                if not heads:
                    heads = cells
                else:
                    yield {heads[c]: v for c, v in cells.items() if c in heads}


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, type, entry_id, pages) of the index rows in XLSX files, one task a file; rows without an entry id or a
    path are left out, and pages are null where they aren't a number."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                found = [{new: row.get(old) for old, new in WORKBOOK.items()} for row in sheet_rows(content)]
                yield pd.DataFrame(found, columns=list(WORKBOOK.values())).astype(object)

    read = spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, "path string, name string, type string, entry_id string, pages string")
    number = lambda c: F.expr(f"try_cast(try_cast({c} AS DOUBLE) AS BIGINT)")
    return read.select("path", "name", "type", number("entry_id").alias("entry_id"), number("pages").cast("int").alias("pages")).where("entry_id IS NOT NULL AND trim(path) != ''")


def date_dimension(spark: SparkSession, first: str, last: str) -> DataFrame:
    """One row a day with the usual parts of a date."""
    days = spark.sql("SELECT explode(sequence(to_date(:a), to_date(:b), interval 1 day)) AS date", args={"a": first, "b": last})
    return days.select(
        "date",
        F.year("date").alias("year"),
        F.month("date").alias("month_num"),
        F.date_format("date", "MMM").alias("month_name"),
        F.concat(F.lit("Q"), F.quarter("date").cast("string")).alias("quarter"),
        F.date_format("date", "yyyy-MM").alias("year_month"),
        F.concat(F.year("date").cast("string"), F.lit(" Q"), F.quarter("date").cast("string")).alias("year_quarter"),
    )


def compact_json(value: Column) -> Column:
    """JSON without null fields."""
    return F.to_json(value)
