"""Filling templates: mappings and facts become cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import column_number

BLOCKING = ("UPLOADED", "EXTRACTING", "FAILED", "NEED_SUPPLEMENT")


def ready(files: DataFrame, batch: str) -> DataFrame:
    """(batch, blocked, ready): a batch is ready if it has files and none of a blocking status."""
    return files.groupBy(batch).agg(F.count(F.when(F.col("status").isin(*BLOCKING), 1)).alias("blocked"), F.count(F.lit(1)).alias("files")).select(batch, "blocked", ((F.col("blocked") == 0) & (F.col("files") > 0)).alias("ready"))


def single_cells(heads: DataFrame, mappings: DataFrame) -> DataFrame:
    """``heads(document, field_key, value)`` x SINGLE ``mappings(field_key, sheet, row, col)`` -> cells. Whether the mappings are broadcast is decided by their size."""
    return heads.join(mappings, "field_key").select("document", "sheet", "row", "col", "value")


def repeat_cells(details: DataFrame, mappings: DataFrame) -> DataFrame:
    """``details(document, line_no, field_key, value)`` x REPEAT ``mappings(field_key, sheet, column_letter, start_row, max_rows)`` -> cells.

    Line k goes to row start + k - 1; a group of columns with one sheet and start has the room of its smallest.
    """
    room = F.min("max_rows").over(Window.partitionBy("sheet", "start_row"))
    fitted = mappings.withColumn("_room", room)
    joined = details.join(fitted, "field_key").filter(F.col("line_no") <= F.col("_room"))
    return joined.select("document", "sheet", (F.col("start_row") + F.col("line_no") - 1).alias("row"), column_number(F.col("column_letter")).alias("col"), "value")


def candidates(cells: DataFrame, most: int = 4) -> DataFrame:
    """Labels (text without a digit, 40 characters at most) and the first free column to the right, within ``most``."""
    order = Window.partitionBy("key", "sheet", "row").orderBy("col")
    gap = F.coalesce(F.lead("col").over(order), F.col("col") + most + 1) - F.col("col")
    label = (F.length("value") <= 40) & ~F.col("value").rlike("[0-9]")
    return cells.withColumn("_gap", gap).filter(label & (F.col("_gap") > 1)).select("key", "sheet", "row", (F.col("col") + 1).alias("col"), F.col("value").alias("label"))


def anchored(rows: DataFrame, key: str, order: list[str], described: Column, amount: str) -> DataFrame:
    """Amounts that stand alone go to the first earlier row that is described and has none; such a row is then gone.

    A row without a description and with an amount takes the first open gap before it, if there is one,
    else it stays. How many found none is the largest excess of such rows over gaps so far, so the
    pairs follow from running counts: the n-th row that finds one fills the n-th gap. ``order`` must be total.
    """
    has = F.coalesce(F.col(amount) > 0, F.lit(False))
    w = Window.partitionBy(key).orderBy(*order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    known = F.coalesce(described, F.lit(False))
    out = rows.withColumns({"_gap": known & ~has, "_alone": ~known & has, "_no": F.row_number().over(w)})
    out = out.withColumns({"_g": F.sum(F.col("_gap").cast("int")).over(so_far), "_f": F.sum(F.col("_alone").cast("int")).over(so_far)})
    out = out.withColumn("_lost", F.greatest(F.lit(0), F.max(F.col("_f") - F.col("_g")).over(so_far)))
    out = out.withColumn("_paired", F.col("_alone") & (F.col("_lost") == F.coalesce(F.lag("_lost").over(w), F.lit(0))))
    pair = F.when(F.col("_gap"), F.col("_g")).when(F.col("_paired"), F.col("_f") - F.col("_lost")).otherwise(-F.col("_no"))
    given = F.max(F.when(F.col("_paired"), F.col(amount))).over(Window.partitionBy(key, "_pair"))
    out = out.withColumn("_pair", pair).withColumn(amount, F.when(F.col("_gap"), F.coalesce(given, F.col(amount))).otherwise(F.col(amount)))
    return out.filter(~F.col("_paired")).select(*rows.columns)
