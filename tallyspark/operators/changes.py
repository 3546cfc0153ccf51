"""Changes to tables as batch transforms: each returns the new table or the rows to append."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import anti_append, first_by_key


def insert_missing(target: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[Column], default: object = None) -> DataFrame:
    """The target and, once each, the rows whose keys it lacks. Doing it twice changes nothing."""
    return target.unionByName(first_by_key(anti_append(target, rows, keys, default), keys, order).select(*target.columns))


def upsert(target: DataFrame, rows: DataFrame, keys: Sequence[str], newest: Column) -> DataFrame:
    """The target with the newest of the rows of each key in place of its own."""
    latest = first_by_key(rows, keys, [F.struct((-newest.cast("double")).alias("n"), *[c for c in rows.columns if c not in keys])]).select(*target.columns)
    return target.join(latest, list(keys), "left_anti").unionByName(latest)


def replace(target: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All target rows of the keys that ``rows`` has go, then its rows come."""
    return target.join(rows.select(*keys).distinct(), list(keys), "left_anti").unionByName(rows)


def synced(old: DataFrame, new: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, value, change): insert, update, delete or keep."""
    a, b = old.select(*keys, F.col(value).alias("_old"), F.lit(True).alias("_a")), new.select(*keys, F.col(value).alias("_new"), F.lit(True).alias("_b"))
    both = a.join(b, list(keys), "full")
    change = F.when(F.col("_a").isNull(), "insert").when(F.col("_b").isNull(), "delete").when(F.col("_old").eqNullSafe(F.col("_new")), "keep").otherwise("update")
    return both.select(*keys, F.when(F.col("_b").isNull(), F.col("_old")).otherwise(F.col("_new")).alias(value), change.alias("change"))


def guarded(df: DataFrame, column: str, value: Column, blocked: Sequence[str]) -> DataFrame:
    """Sets the column except where it is one of ``blocked``."""
    return df.withColumn(column, F.when(~F.col(column).isin(*blocked), value).otherwise(F.col(column)))


def activated(df: DataFrame, key: Column, group: Column, chosen: Column, chosen_group: Column) -> DataFrame:
    """The chosen row is ACTIVE and no other of its group; other groups stay."""
    status = F.when(key == chosen, "ACTIVE").when((group == chosen_group) & (F.col("status") == "ACTIVE"), "INACTIVE").otherwise(F.col("status"))
    return df.withColumn("status", status)


def counted_up(df: DataFrame, column: str, where: Column) -> DataFrame:
    return df.withColumn(column, F.when(where, F.coalesce(column, F.lit(0)) + 1).otherwise(F.col(column)))


def patched(df: DataFrame, patch: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Fields that the patch gives change. A status follows into active_yn: APPROVED is Y, all else N."""
    changes = patch.select(*keys, *[F.col(f).alias(f"_{f}") for f in fields])
    out = df.join(changes, list(keys), "left")
    for f in fields:
        if f == "status" and "active_yn" in df.columns:
            out = out.withColumn("active_yn", F.when(F.col("_status").isNull(), F.col("active_yn")).when(F.col("_status") == "APPROVED", "Y").otherwise("N"))
        out = out.withColumn(f, F.coalesce(f"_{f}", f))
    return out.select(*df.columns)


def images(before: DataFrame, after: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(keys, before_data, after_data) as JSON for rows whose fields differ."""
    a = before.select(*keys, F.to_json(F.struct(*fields)).alias("before_data"))
    b = after.select(*keys, F.to_json(F.struct(*fields)).alias("after_data"))
    return a.join(b, list(keys)).filter(~F.col("before_data").eqNullSafe(F.col("after_data")))


def status_image(status: Mapping[str, str], default: str) -> Column:
    out = None
    for old, new in status.items():
        out = F.when(F.col("status") == old, new) if out is None else out.when(F.col("status") == old, new)
    return out.otherwise(default) if out is not None else F.lit(default)
