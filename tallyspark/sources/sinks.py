"""Sinks: quoted CSV, JSON results, audit rows and spreadsheet cells."""

from __future__ import annotations

import logging

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def csv(df: DataFrame, path: str) -> None:
    """Every cell quoted, quotes doubled, a byte order mark before the header (in the first column's name)."""
    first, *rest = df.columns
    text = df.select(F.col(f"`{first}`").cast("string").alias(f"﻿{first}"), *[F.col(f"`{c}`").cast("string") for c in rest])
    text.write.options(header=True, quoteAll=True, escape='"', emptyValue="").csv(path)


def json_results(df: DataFrame, key: str) -> DataFrame:
    """(key, body): everything but the key as one JSON object a row; nulls are left out."""
    return df.select(key, F.to_json(F.struct(*[c for c in df.columns if c != key])).alias("body"))


def audit(df: DataFrame, path: str) -> bool:
    """Append; a failure is logged and never stops the caller."""
    try:
        df.write.mode("append").parquet(path)
    except PySparkException:
        logging.getLogger(__name__).exception("audit rows were not written to %s", path)
        return False
    return True


def cells(df: DataFrame, path: str) -> None:
    """(document, sheet, row, col, value) as Parquet by document; a workbook writer takes it from there."""
    df.repartition("document").sortWithinPartitions("document", "sheet", "row", "col").write.parquet(path)
