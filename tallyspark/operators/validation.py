"""Issues, statuses, penalties and confidence of extracted documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISSUE = "struct<code:string,field:string,severity:string,action:string,penalty:double>"


def issue(when: Column, code: str, field: str, severity: str = "ERROR", action: str = "REVIEW", penalty: float | None = None) -> Column:
    """The issue where it holds, else null."""
    made = F.struct(F.lit(code).alias("code"), F.lit(field).alias("field"), F.lit(severity).alias("severity"), F.lit(action).alias("action"), F.lit(penalty).cast("double").alias("penalty"))
    return F.when(F.coalesce(when, F.lit(False)), made)


def issues(*each: Column) -> Column:
    return F.array_compact(F.array(*each))


def with_issue(found: Column, new: Column) -> Column:
    """Adds the issue unless its code is there already."""
    known = F.exists(found, lambda x: x["code"] == new["code"])
    return F.when(new.isNull() | known, found).otherwise(F.concat(found, F.array(new)))


def status(found: Column) -> Column:
    asks = F.exists(found, lambda x: (x["severity"] == "ERROR") & (x["action"] == "SUPPLEMENT"))
    return F.when(asks, "NEED_SUPPLEMENT").when(F.size(found) > 0, "NEED_REVIEW").otherwise("PASS")


def stored_status(found: Column, verdict: Column) -> Column:
    """What the tables keep: any issue or review is NEED_REVIEW, even one that asks for a supplement."""
    return F.when((F.size(found) > 0) | (verdict == "NEED_REVIEW"), "NEED_REVIEW").when(verdict == "NEED_SUPPLEMENT", "NEED_SUPPLEMENT").otherwise("NORMAL")


def penalty(found: Column, most: float = 0.75) -> Column:
    """Sum of the penalties; a missing one, and one of 0, count .08 for errors and .04 otherwise."""
    each = lambda x: F.when(F.coalesce(x["penalty"], F.lit(0.0)) != 0, x["penalty"]).when(x["severity"] == "ERROR", 0.08).otherwise(0.04)
    return F.least(F.lit(most), F.aggregate(found, F.lit(0.0), lambda a, x: a + each(x)))


def confidence(terms: list[tuple[Column, float]], base: float = 0.5) -> Column:
    """The base and what holds adds or takes away, within 0 and .99."""
    total = F.lit(base)
    for holds, points in terms:
        total = total + F.when(holds, points).otherwise(0.0)
    return F.least(F.lit(0.99), F.greatest(F.lit(0.0), total))


def capped(score: Column, caps: list[tuple[Column, float]]) -> Column:
    limits = F.array_compact(F.array(*[F.when(holds, most) for holds, most in caps]))
    return F.least(score, F.coalesce(F.array_min(limits), F.lit(1.0)))
