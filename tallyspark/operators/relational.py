"""Predicates, joins, set operations, sorts and paging."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def where(df: DataFrame, *predicates: Column | None) -> DataFrame:
    """All predicates that are given; none: the whole table."""
    given = [p for p in predicates if p is not None]
    return df.filter(reduce(and_, given)) if given else df


def equals(columns: Mapping[str, Column], params: Mapping[str, object]) -> list[Column]:
    """An equality for each parameter that is not empty; lists become IN."""
    kept = {k: v for k, v in params.items() if v not in (None, "", [], ()) and k in columns}
    return [columns[k].isin(*v) if isinstance(v, (list, tuple, set)) else columns[k] == F.lit(v) for k, v in kept.items()]


def keyword(columns: Sequence[Column], word: str | None) -> Column | None:
    """Any column contains the word, without case. A blank word filters nothing."""
    word = (word or "").strip().lower()
    return reduce(or_, [F.coalesce(F.contains(F.lower(c.cast("string")), F.lit(word)), F.lit(False)) for c in columns]) if word else None


def not_in(column: Column, values: Sequence[object]) -> Column:
    """SQL's NOT IN: a null is not kept either."""
    return ~column.isin(*values)


def half_open(ts: Column, start, end) -> list[Column]:
    """start <= date(ts) <= end as a range over the raw column, so that the scan can use it."""
    out = []
    if start is not None:
        out.append(ts >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        out.append(ts < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz"))
    return out


def anti_append(target: DataFrame, rows: DataFrame, keys: Sequence[str], default: object = None) -> DataFrame:
    """Rows whose keys the target lacks; with ``default``, null keys count as that value on both sides."""
    side = lambda df, c: F.coalesce(df[c], F.lit(default)) if default is not None else df[c]
    return rows.join(target, [side(rows, k) == side(target, k) for k in keys], "left_anti")


def first_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row a key, the first in ``order``. Combined map-side, so a hot key costs one row a task."""
    rest = [c for c in df.columns if c not in keys]
    names = [f"o{i}" for i in range(len(order))]
    one = df.select(*keys, F.struct(*[o.alias(n) for o, n in zip(order, names)]).alias("_o"), F.struct(*rest).alias("_r"))
    return one.groupBy(*keys).agg(F.min_by("_r", "_o").alias("_r")).select(*keys, "_r.*")


def nested(parents: DataFrame, children: DataFrame, on: str, fields: Sequence[str], name: str) -> DataFrame:
    """Each parent with the sorted list of its children; none: an empty list."""
    lists = children.groupBy(on).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))
    joined = parents.join(lists, on, "left")
    return joined.withColumn(name, F.coalesce(name, F.array().cast(joined.schema[name].dataType)))


def lookup(df: DataFrame, table: DataFrame, code: Column, name: Column, fallback: Column) -> DataFrame:
    """``table(code, name, value)``, one row a code: by code, else by name, else the fallback, as column value."""
    by_code = table.select(F.upper("code").alias("_c"), F.col("value").alias("_v1"))
    by_name = table.groupBy(F.col("name").alias("_n")).agg(F.min("value").alias("_v2"))
    out = df.join(by_code, F.upper(code) == F.col("_c"), "left").join(by_name, name == F.col("_n"), "left")
    return out.withColumn("value", F.coalesce("_v1", "_v2", fallback)).drop("_c", "_n", "_v1", "_v2")


def listed_order(column: Column, values: Sequence[object], missing: int = 999) -> Column:
    """The place in a list from 1; not in it: ``missing``."""
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(v) for v in values]), column), F.lit(0).cast("long")), F.lit(missing).cast("long"))


def preferred_last(column: Column, value: object) -> Column:
    """0 for any other value, 1 for the value: ascending, the exact match comes last. Kept as it is used today."""
    return F.when(column == F.lit(value), 1).otherwise(0)


def page(df: DataFrame, order: Sequence[Column], number: int = 1, size: int = 20) -> DataFrame:
    """One page; numbers from 1, 5 to 100 rows."""
    size = min(100, max(5, size))
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def page_count(df: DataFrame, size: int = 20) -> DataFrame:
    size = min(100, max(5, size))
    return df.agg(F.count(F.lit(1)).alias("total")).withColumn("pages", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("total") / size)))


def counts_of(named: Mapping[str, DataFrame]) -> DataFrame:
    """(label, n): a row for each table."""
    parts = [df.agg(F.lit(k).alias("label"), F.count(F.lit(1)).alias("n")) for k, df in named.items()]
    return reduce(DataFrame.unionByName, parts)


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def mode(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The most frequent value of each key, ties to the larger one."""
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(*keys).agg(F.max_by(value, F.struct("n", value)).alias(value), F.max("n").alias("n"))


def renumbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "line_no") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def by_code_or_name(words: DataFrame, word: str, types: DataFrame, order: str) -> DataFrame:
    """One row of ``types(code, name, …)`` for each word, found by code or name: two equi-joins, not one with OR.

    A row found by its code comes after those found by name (``preferred_last``), then by ``order``.
    """
    code = words.join(types, F.col(word) == F.col("code"))
    name = words.join(types, (F.col(word) == F.col("name")) & ~F.col("name").eqNullSafe(F.col("code")))
    return first_by_key(code.unionByName(name), [word], [(F.col("code") == F.col(word)).cast("int"), F.col(order)])
