"""Documents as lines: labels and the amounts near them, sections, blocks, and lines from the places of words."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import money_in


def lines(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line_no from 0, line trimmed), without blank lines."""
    return docs.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line_no", "line")).withColumn("line", F.trim("line")).filter("line <> ''")


def distinct_lines(docs: DataFrame, key: str, text: str = "text", separator: str = "\n") -> DataFrame:
    """(key, text): each line once, where it first stands."""
    kept = F.array_distinct(F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != ""))
    return docs.select(key, F.array_join(kept, separator).alias(text))


def near_label(rows: DataFrame, key: str, label: Column, value: Column, ahead: int = 3) -> DataFrame:
    """(key, line_no, value): for a labelled line its own value, or that of the next lines."""
    order = Window.partitionBy(key).orderBy("line_no")
    marked = rows.withColumn("_v", value)
    found = marked.select(key, "line_no", label.alias("_l"), F.coalesce("_v", *[F.lead("_v", k).over(order) for k in range(1, ahead + 1)]).alias("value"))
    return found.filter("_l").select(key, "line_no", "value")


def blocks(rows: DataFrame, key: str, boundary: Column) -> DataFrame:
    """Adds block: how many boundary lines stand up to here."""
    order = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("block", F.sum(boundary.cast("int")).over(order))


def section(rows: DataFrame, key: str, start: Column, end: Column) -> DataFrame:
    """The lines after the first start marker and before the first end marker after it."""
    whole = Window.partitionBy(key)
    begun = rows.withColumn("_s", F.min(F.when(start, F.col("line_no"))).over(whole)).filter(F.col("line_no") > F.col("_s"))
    ended = begun.withColumn("_e", F.min(F.when(end, F.col("line_no"))).over(whole))
    return ended.filter(F.col("_e").isNull() | (F.col("line_no") < F.col("_e"))).drop("_s", "_e")


def amounts(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, amounts distinct in order, most, n)."""
    found = F.array_distinct(F.filter(money_in(F.col(text)), lambda x: x.isNotNull()))
    return docs.select(key, found.alias("amounts")).select(key, "amounts", F.array_max("amounts").alias("most"), F.size("amounts").alias("n"))


def geometry_lines(tokens: pd.DataFrame) -> pd.DataFrame:
    """One page's tokens (x, cy, h, word) -> lines: tokens whose centres are within max(10, .65 median height), left to right."""
    if tokens.empty:
        return pd.DataFrame({"page": [], "line_no": [], "line": []})
    near = max(10.0, 0.65 * float(tokens["h"].median()))
    rows: list[list] = []
    for t in tokens.sort_values(["cy", "x"]).itertuples():
        if rows and abs(np.mean([o.cy for o in rows[-1]]) - t.cy) <= near:
            rows[-1].append(t)
        else:
            rows.append([t])
    return pd.DataFrame([(tokens["page"].iloc[0], i, " ".join(t.word for t in sorted(r, key=lambda t: t.x))) for i, r in enumerate(rows)], columns=["page", "line_no", "line"])


def page_lines(tokens: DataFrame) -> DataFrame:
    """(page, x, cy, h, word) -> (page, line_no, line); a page's tokens fit in a task."""
    return tokens.groupBy("page").applyInPandas(geometry_lines, "page long, line_no long, line string")



def line_before(rows: DataFrame, key: str) -> DataFrame:
    """Adds before: the line before, null for the first."""
    return rows.withColumn("before", F.lag("line").over(Window.partitionBy(key).orderBy("line_no")))
