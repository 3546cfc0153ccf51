"""Field facts: one row per document, field and line, with several versions of a value."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import stripped_money
from ..functions.text import first_present

#: The three orders in which the versions of a value are looked at; they differ on purpose.
ORDERS = {"report": ("final_value", "modified_value", "normalized_value", "extracted_value"), "export": ("modified_value", "final_value", "normalized_value", "extracted_value"), "review": ("final_value", "normalized_value", "extracted_value")}


def resolved(use: str, blanks_count: bool = True) -> Column:
    """A value for its use; blank texts count as values in SQL, but not where ``blanks_count`` is False."""
    columns = [F.col(c) for c in ORDERS[use]]
    return F.coalesce(*columns) if blanks_count else first_present(*columns)


def melted(df: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Columns -> (keys, field_key, value as text)."""
    return df.select(*keys, *[F.col(f).cast("string").alias(f) for f in fields]).unpivot(list(keys), list(fields), "field_key", "value")


def pivoted(facts: DataFrame, key: Sequence[str], texts: Mapping[str, Sequence[str]], amounts: Mapping[str, Sequence[str]], value: Column | None = None) -> DataFrame:
    """One row a key: the largest text, or amount read as money, among the aliases of each attribute."""
    value = F.col("value") if value is None else value
    pick = lambda names: F.when(F.col("field_key").isin(*names), value)
    return facts.groupBy(*key).agg(*[F.max(pick(n)).alias(a) for a, n in texts.items()], *[F.max(stripped_money(pick(n))).alias(a) for a, n in amounts.items()])


def joined_text(value: Column, order: Sequence[str], separator: str = "||") -> Column:
    """Texts in order, nulls left out. A key's texts fit in a task: they are one document's."""
    kept = F.filter(F.sort_array(F.collect_list(F.struct(*order, value.alias("_v")))), lambda x: x["_v"].isNotNull())
    return F.array_join(F.transform(kept, lambda x: x["_v"]), separator)


def first_values(facts: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """(key, field_key, value): the first value that is there and not blank."""
    sound = facts.filter(F.trim("value") != "")
    return sound.groupBy(*key, "field_key").agg(F.min_by("value", F.struct(*order)).alias("value"))


def total_amount(facts: DataFrame, key: str, totals: Sequence[str], lines: Sequence[str], fallback: Sequence[str]) -> DataFrame:
    """(key, amount): the largest total, else the largest head amount, else the sum of each line's largest amount, else the fallback."""
    money = stripped_money(F.col("value"))
    head = F.coalesce("row_index", F.lit(0)) <= 0
    per_line = facts.groupBy(key, F.coalesce("row_index", F.lit(0)).alias("line")).agg(
        F.max(F.when(F.col("field_key").isin(*totals), money)).alias("total"),
        F.max(F.when(head & F.col("field_key").isin(*lines), money)).alias("head"),
        F.max(F.when(~head & F.col("field_key").isin(*lines), money)).alias("line_amount"),
        F.max(F.when(F.col("field_key").isin(*fallback), money)).alias("other"),
    )
    return per_line.groupBy(key).agg(F.coalesce(F.max("total"), F.max("head"), F.sum("line_amount"), F.max("other")).alias("amount"))


def residual(details: DataFrame, totals: DataFrame, key: str, label: str = "기타/미분류 금액") -> DataFrame:
    """(key, line_no, item, amount): the lines, and one that makes up for what the total has more."""
    spent = details.groupBy(key).agg(F.sum("amount").alias("spent"), F.max("line_no").alias("last"))
    more = totals.join(spent, key, "left").withColumn("rest", F.col("total") - F.coalesce("spent", F.lit(0))).filter("rest > 0")
    return details.select(key, "line_no", "item", "amount").unionByName(more.select(key, (F.coalesce("last", F.lit(0)) + 1).cast(details.schema["line_no"].dataType).alias("line_no"), F.lit(label).alias("item"), F.col("rest").cast(details.schema["amount"].dataType).alias("amount")))


def without_fragments(items: DataFrame, keys: Sequence[str], small: float = 1000) -> DataFrame:
    """Items whose amount is below ``small`` go where the same name has one of ``small`` or more."""
    from pyspark.sql import Window

    most = F.max("amount").over(Window.partitionBy(*keys))
    return items.withColumn("_most", most).filter(~((F.col("amount") < small) & (F.col("_most") >= small))).drop("_most")
