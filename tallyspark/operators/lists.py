"""What lists and details are made of: names from dimensions, each user's pages, set-based updates, generated documents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_names(df: DataFrame, key: str, dimension: DataFrame, dimension_key: str, names: Mapping[str, str]) -> DataFrame:
    """``names``: the dimension's column -> new column. Rows without a match, or with a null key, keep null names."""
    side = dimension.select(F.col(dimension_key).alias("_key"), *[F.col(c).alias(n) for c, n in names.items()])
    return df.join(side, df[key] == side["_key"], "left").drop("_key")


def pages_of_each(df: DataFrame, keys: Sequence[str], order: Sequence[Column], number: int = 1, size: int = 20) -> DataFrame:
    """One page of every key's rows, with place (from 1) and total: what each user sees at the same page of their own list.

    The place is cut before the shuffle to what the page can hold; totals are added up before theirs. Keys with
    no rows on the page give none.
    """
    number = max(1, number)
    last = number * size
    placed = df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("place") <= last)
    totals = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    return placed.filter(F.col("place") > last - size).join(totals, list(keys))


def updated(df: DataFrame, key: str, updates: DataFrame, columns: Sequence[str], unless: Column | None = None) -> DataFrame:
    """``UPDATE … WHERE id = ?`` for many ids at once: one row of ``updates`` an id, its null columns change nothing.

    Rows for which ``unless`` holds stay as they are.
    """
    new = updates.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    may = F.lit(True) if unless is None else ~F.coalesce(unless, F.lit(False))
    joined = df.join(new, df[key] == new["_key"], "left")
    changed = {c: F.when(may, F.coalesce(f"_new_{c}", c)).otherwise(F.col(c)) for c in columns}
    return joined.withColumns(changed).select(*df.columns)


def batch_number(at: Column) -> Column:
    """``BATCH-yyyymmdd-`` and the last six digits of the milliseconds; ``at`` is a timestamp without zone."""
    millis = F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), at)
    return F.concat(F.lit("BATCH-"), F.date_format(at, "yyyyMMdd"), F.lit("-"), F.right(millis.cast("string"), F.lit(6)))


def generated(batches: DataFrame, ready: Column, file_name: Column) -> tuple[DataFrame, DataFrame]:
    """(new document rows, batches as they are afterwards) for the batches with (batch_id, status) that are ``ready``."""
    made = F.coalesce(ready, F.lit(False))
    documents = batches.filter(made).select("batch_id", file_name.alias("file_name"), file_name.alias("document_name"), F.lit("xlsx").alias("file_type"), F.lit("DOWNLOADABLE").alias("status"))
    return documents, batches.withColumn("status", F.when(made, "GENERATED").otherwise(F.col("status")))


def source_context(df: DataFrame) -> DataFrame:
    """A file's context: its own template and type before its batch's; names that are missing are empty texts.

    Takes file_template, batch_template, file_type, batch_type, department, site, batch_site, submitter and title.
    A template 0 and a blank text count as missing.
    """
    text = lambda *cs: F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cs])
    return df.withColumns(
        {
            "template_id": F.coalesce(F.nullif(F.col("file_template"), F.lit(0).cast("long")), F.col("batch_template")),
            "document_type": F.coalesce(text("file_type", "batch_type"), F.lit("RECEIPT")),
            "department_name": F.coalesce(text("department"), F.lit("")),
            "site_name": F.coalesce(text("site", "batch_site"), F.lit("")),
            "user_name": F.coalesce(text("submitter"), F.lit("")),
            "expense_title": F.coalesce(text("title"), F.lit("")),
        }
    )


def progress(files: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, total, final, percent, blocking, can_complete): final states and those that keep a batch open, unknown ones too."""
    status = F.col("status")
    final, open_ = status.isin("CONFIRMED", "NEED_SUPPLEMENT", "FAILED"), ~F.coalesce(status.isin("CONFIRMED", "NEED_SUPPLEMENT", "FAILED", "NORMAL"), F.lit(False))
    n = files.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count_if(final).alias("final"), F.count_if(open_).alias("blocking"))
    percent = F.floor(F.col("final") * 100 / F.col("total") + 0.5)
    return n.select(*keys, "total", "final", percent.alias("percent"), "blocking", (F.col("blocking") == 0).alias("can_complete"))


def dashboards(files: DataFrame, roles: Mapping[str, tuple[Sequence[str] | None, Sequence[str]]]) -> DataFrame:
    """(role, n, open): ``roles`` gives the states that a role sees (None: all) and those that wait for it. One pass."""
    status = F.col("status")
    seen = lambda states: F.count(F.lit(1)) if states is None else F.count_if(status.isin(*states))
    one = files.agg(F.array(*[F.struct(F.lit(r).alias("role"), seen(s).alias("n"), F.count_if(status.isin(*w)).alias("open")) for r, (s, w) in roles.items()]).alias("_r"))
    return one.select(F.inline("_r"))


def with_preset(fields: DataFrame, preset: DataFrame, advanced: bool = False) -> DataFrame:
    """``fields(key, own_order)`` with ``preset(key, label, sort_order, advanced)`` over them, in order; advanced ones only if asked."""
    out = with_names(fields, "key", preset, "key", {"label": "_label", "sort_order": "_order", "advanced": "_advanced"})
    out = out.select("key", F.coalesce("_label", "key").alias("label"), F.coalesce("_order", "own_order", F.lit(0)).alias("sort_order"), F.coalesce("_advanced", F.lit("N")).alias("advanced"))
    return (out if advanced else out.filter("advanced <> 'Y'")).orderBy("sort_order", "key")
