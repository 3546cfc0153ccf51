"""Cells of workbooks as rows. Spark reads the files, so they can lie in any store; a task takes a file at a time, and a
file that can't be read says so in its own row."""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KINDS = ("xlsx", "xlsm", "xltx", "xltm")
CELLS = "path string, sheet string, active boolean, row int, col int, value string, rowspan int, colspan int, error string"
#: Bytes that a part of a workbook may unpack to.
MOST_BYTES = 256 << 20
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
# The format's own numbers of formats with thousands commas, and of dates.
GROUPED, DATES = {3, 4, 37, 38, 39, 40}, {*range(14, 23), *range(45, 48)}


def place(address: str) -> tuple[int, int]:
    """``B3`` -> (3, 2)."""
    letters, digits = re.fullmatch(r"\$?([A-Z]{1,3})\$?([0-9]+)", address).groups()
    col = 0
    for c in letters:
        col = col * 26 + ord(c) - 64
    return int(digits), col


def shown(number: str, kind: str) -> str:
    """A number as a cell shows it: whole where it is whole, with commas where its format says so, or a date."""
    value = float(number)
    if kind == "date":
        return str(dt.datetime(1899, 12, 30) + dt.timedelta(seconds=round(value * 86400)))
    if kind == "grouped":
        return f"{value:,.0f}"
    return str(int(value)) if value.is_integer() else str(value)


class Workbook:
    """The parts of a zipped workbook that cells need."""

    def __init__(self, content: bytes):
        self.parts = zipfile.ZipFile(io.BytesIO(content))
        names = set(self.parts.namelist())
        book = self.tree("xl/workbook.xml")
        links = {r.get("Id"): r.get("Target") for r in self.tree("xl/_rels/workbook.xml.rels")}
        self.sheets = [(s.get("name"), "xl/" + links[s.get(_LINK)].removeprefix("/xl/")) for s in book.iter(f"{_MAIN}sheet")]
        self.active = next((int(v.get("activeTab", 0)) for v in book.iter(f"{_MAIN}workbookView")), 0)
        self.strings = ["".join(t.text or "" for t in s.iter(f"{_MAIN}t")) for s in self.tree("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
        self.kinds = self.formats() if "xl/styles.xml" in names else []

    def open(self, name: str):
        if self.parts.getinfo(name).file_size > MOST_BYTES:
            raise ValueError(f"{name} unpacks to more than {MOST_BYTES} bytes")
        return self.parts.open(name)

    def tree(self, name: str) -> ElementTree.Element:
        with self.open(name) as part:
            return ElementTree.parse(part).getroot()

    def formats(self) -> list[str]:
        """For each style whether its numbers are dates, grouped, or plain."""
        root = self.tree("xl/styles.xml")
        own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iter(f"{_MAIN}numFmt")}

        def kind(number: int) -> str:
            code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", own.get(number, ""))
            if number in DATES or re.search("[ymdhs]", code, re.IGNORECASE) and "General" not in code:
                return "date"
            return "grouped" if number in GROUPED or "#,##0" in code else "plain"

        styles = root.find(f"{_MAIN}cellXfs")
        return [kind(int(x.get("numFmtId", 0))) for x in styles] if styles is not None else []

    def cells(self, part: str) -> Iterator[tuple]:
        """(row, col, value, rowspan, colspan): cells with a value, then merged ranges by their first cell, without a value."""
        with self.open(part) as file:
            for _, node in ElementTree.iterparse(file):
                if node.tag == f"{_MAIN}c" and (text := self.text(node)) is not None:
                    yield (*place(node.get("r")), text, 1, 1)
                elif node.tag == f"{_MAIN}mergeCell":
                    first, _, last = node.get("ref").partition(":")
                    (r0, c0), (r1, c1) = place(first), place(last or first)
                    yield r0, c0, None, r1 - r0 + 1, c1 - c0 + 1
                if node.tag == f"{_MAIN}row":
                    node.clear()

    def text(self, cell: ElementTree.Element) -> str | None:
        kind, value = cell.get("t", "n"), cell.find(f"{_MAIN}v")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
        if value is None or value.text is None:
            return None
        if kind == "s":
            return self.strings[int(value.text)]
        if kind == "b":
            return str(value.text == "1")
        style = int(cell.get("s", 0))
        return shown(value.text, self.kinds[style] if style < len(self.kinds) else "plain") if kind == "n" else value.text


def _read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in CELLS.split(", ")]
    for part in parts:
        for path, content in zip(part["path"], part["content"]):
            rows = []
            try:
                book = Workbook(content)
                for i, (name, inside) in enumerate(book.sheets):
                    rows += [(path, name, i == book.active, *cell, None) for cell in book.cells(inside)]
            except Exception as e:  # one file's fault is no other's
                rows = [(path, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}")]
            yield pd.DataFrame(rows, columns=columns).astype({c: "Int32" for c in ("row", "col", "rowspan", "colspan")})


def workbook_cells(spark: SparkSession, path: str, most_rows: int = 80, most_columns: int = 30, most_bytes: int = 20 << 20) -> DataFrame:
    """Workbooks under ``path`` -> (path, sheet, active, row, col, value, rowspan, colspan, error).

    A row for each cell with a value and each merged range, within ``most_rows`` and ``most_columns`` from the first used row
    and column of its sheet; cells that a merged range covers are left out, its first cell spans it. A file that
    can't be read, or is larger than ``most_bytes``, has one row with an error and no cells.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(KINDS) + "}").load(path)
    fits = found.filter(F.col("length") <= most_bytes).select("path", "content").mapInPandas(_read, CELLS)
    large = found.filter(F.col("length") > most_bytes).select("path", *[F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in CELLS.split(", ")[1:-1])], F.lit("too large").alias("error"))
    rows = fits.unionByName(large)
    sheet = Window.partitionBy("path", "sheet")
    rows = rows.withColumns({"_r": F.min("row").over(sheet), "_c": F.min("col").over(sheet)})
    inside = F.col("error").isNotNull() | ((F.col("row") < F.col("_r") + most_rows) & (F.col("col") < F.col("_c") + most_columns))
    merged = F.struct("row", "col", (F.col("row") + F.col("rowspan") - 1).alias("to_row"), (F.col("col") + F.col("colspan") - 1).alias("to_col"))
    one = rows.filter(inside).groupBy("path", "sheet", "active", "row", "col", "error").agg(F.max("value").alias("value"), F.max("rowspan").alias("rowspan"), F.max("colspan").alias("colspan"))
    ranges = F.collect_list(F.when((F.col("rowspan") > 1) | (F.col("colspan") > 1), merged)).over(sheet)
    covered = F.exists("_m", lambda m: (F.col("row").between(m["row"], m["to_row"])) & F.col("col").between(m["col"], m["to_col"]) & ~((F.col("row") == m["row"]) & (F.col("col") == m["col"])))
    return one.withColumn("_m", ranges).filter(F.col("error").isNotNull() | ~F.coalesce(covered, F.lit(False))).select(*[c.split()[0] for c in CELLS.split(", ")])
