"""Scans: tables, rules in JSON, inline values, files by kind and size, and spreadsheet cells."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

RECEIPT_KINDS = ("jpg", "jpeg", "png", "webp", "pdf")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def jdbc(spark: SparkSession, url: str, query: str, partition: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A database query; ``partition``: (column, lower, upper, number of parts) reads it in parallel."""
    reader = spark.read.format("jdbc").options(url=url, **options)
    if partition is None:
        return reader.option("query", query).load()
    column, low, high, parts = partition
    return reader.options(dbtable=f"({query}) q", partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts).load()


def by_key(df: DataFrame, column: str, value: object) -> DataFrame:
    """The row of a key, at most one; a null key finds none. The equality reaches the scan."""
    return df.filter(F.col(column) == F.lit(value)).limit(1)


def staged(spark: SparkSession, rows: DataFrame, use: Callable[[str], DataFrame]) -> DataFrame:
    """What ``use`` makes of the rows under a name of their own, which is gone afterwards. Nothing is stored."""
    name = f"staged_{uuid.uuid4().hex}"
    rows.createOrReplaceTempView(name)
    try:
        return use(name)
    finally:
        spark.catalog.dropTempView(name)


def columns_of(spark: SparkSession, df: DataFrame) -> DataFrame:
    """(name, place from 1) of a table's columns."""
    return spark.createDataFrame([(c, i) for i, c in enumerate(df.columns, 1)], "name string, place long")


def or_empty(spark: SparkSession, scan: Callable[[], DataFrame], schema: str) -> DataFrame:
    """The scan, or no rows if its source is missing or unreadable when it is planned."""
    try:
        return scan()
    except PySparkException:
        return spark.createDataFrame([], schema)


def json_rules(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return or_empty(spark, lambda: spark.read.schema(schema).option("multiLine", True).json(path), schema)


def inline(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows written in code. They come as an Arrow table, so that the plan knows their size and joins can go by it."""
    names = StructType.fromDDL(schema).names
    columns = {name: [row[i] for row in rows] for i, name in enumerate(names)}
    return spark.createDataFrame(pa.table(columns), schema)


def files(spark: SparkSession, path: str, kinds: tuple[str, ...] = RECEIPT_KINDS, most_bytes: int = 20 << 20) -> DataFrame:
    """path, length, content of files of the kinds, none larger than ``most_bytes``; contents are read only for these."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return found.filter((F.col("length") <= most_bytes) & F.lower(F.substring_index("path", ".", -1)).isin(*kinds)).select("path", "length", "content")


def grid(rows: DataFrame, key: str, most_rows: int = 80, most_columns: int = 30) -> DataFrame:
    """Rows of delimited text (``key``, ``sheet``, ``line_no``, ``line``) -> cells (key, sheet, row, col, value) within the bounds."""
    cells = rows.filter(F.col("line_no") < most_rows).select(key, "sheet", (F.col("line_no") + 1).alias("row"), F.posexplode(F.slice(F.split("line", "\t"), 1, most_columns)).alias("col", "value"))
    return cells.select(key, "sheet", "row", (F.col("col") + 1).alias("col"), "value").filter(F.trim("value") != "")


class Cached:
    """Scans kept for a while by key, as rule tables are; ``refresh`` reads them anew."""

    def __init__(self, seconds: float = 1800.0, clock: Callable[[], float] = time.monotonic):
        self.seconds, self.clock, self.kept = seconds, clock, {}

    def get(self, key: str, scan: Callable[[], DataFrame], refresh: bool = False) -> DataFrame:
        old = self.kept.get(key)
        if old and not refresh and self.clock() - old[0] < self.seconds:
            return old[1]
        if old:
            old[1].unpersist()
        self.kept[key] = (self.clock(), scan().persist())
        return self.kept[key][1]
