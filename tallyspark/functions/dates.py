"""Dates: reading them, settlement deadlines, and their states. ``as_of`` stands for today everywhere."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


# Shapes of dates, tried in this order; the first that a text has decides, even if there is no such day.
DATE_SHAPES = (
    r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})",
    r"([0-9]{2,4})[./년\-\s]([0-9]{1,2})[./월\-\s]([0-9]{1,2})",
    r"(?<![0-9A-Za-z_])([0-9]{4})([0-9]{2})([0-9]{2})(?![0-9A-Za-z_])",
    r"(?<![0-9A-Za-z_])([0-9]{2})([0-9]{2})([0-9]{2})(?![0-9A-Za-z_])",
)


def date_only(text: Column) -> Column:
    """The day of the first of ``DATE_SHAPES`` that the text has; years of two digits are of this century. No such day: null."""
    text, out = F.trim(text), None
    for shape in DATE_SHAPES:
        year, month, day = (F.regexp_extract(text, shape, k) for k in (1, 2, 3))
        year = F.when(year.try_cast("int") < 100, F.concat(F.lit("20"), F.lpad(year.try_cast("int").cast("string"), 2, "0"))).otherwise(F.lpad(year, 4, "0"))
        whole = F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")
        out = F.when(text.rlike(shape), whole) if out is None else out.when(text.rlike(shape), whole)
    return out


def settlement_due(day: Column) -> Column:
    """The 5th of the next month."""
    return F.date_add(F.trunc(F.add_months(day, 1), "month"), 4)


def deadline_status(due: Column, as_of: dt.date) -> Column:
    left = F.datediff(due, F.lit(as_of))
    return F.when(due.isNull(), "NONE").when(left < 0, "OVERDUE").when(left == 0, "TODAY").when(left <= 3, "DUE_SOON").when(left <= 7, "NORMAL").otherwise("ENOUGH")


def expense_date_status(raw: Column, day: Column, as_of: dt.date, too_far_years: int = 1) -> Column:
    """``raw``: what was written; ``day``: what it was read as. The first state that holds."""
    today = F.lit(as_of)
    return (
        F.when(F.trim(F.coalesce(raw, F.lit(""))) == "", "MISSING")
        .when(day.isNull(), "SUSPICIOUS")
        .when(F.abs(F.year(day) - F.year(today)) > too_far_years, "TOO_FAR_YEAR")
        .when(F.datediff(day, today) > 1, "FUTURE_DATE")
        .when(F.datediff(day, today) < -365, "TOO_OLD")
        .otherwise("NORMAL")
    )


def deadline_label(due: Column, as_of: dt.date) -> Column:
    """How a deadline is shown; the texts are fixed values."""
    left = F.datediff(due, F.lit(as_of))
    return F.when(due.isNull(), "마감일 없음").when(left < 0, F.concat(F.lit("D+"), (-left).cast("string"))).when(left == 0, "오늘 마감").otherwise(F.concat(F.lit("D-"), left.cast("string")))


def representative_day(first: Column, last: Column, as_of: dt.date) -> Column:
    """A batch's expense day: the first one if sound, else the last one if sound, else whatever is there."""
    sound = lambda day: expense_date_status(day.cast("string"), day, as_of) == "NORMAL"
    return F.when(sound(first), first).when(sound(last), last).otherwise(F.coalesce(first, last))


def chosen_deadline(manual: Column, expense_day: Column, expense_state: Column, uploaded: Column, as_of: dt.date) -> Column:
    """A deadline set by hand, or from a sound expense date, or from the upload; without an upload from today."""
    return F.coalesce(manual, settlement_due(F.when(expense_state == "NORMAL", expense_day)), settlement_due(F.coalesce(uploaded, F.lit(as_of))))


def period(day: Column, grain: str) -> Column:
    """daily, monthly or yearly; anything else counts as monthly."""
    return F.date_format(day, {"daily": "yyyy-MM-dd", "yearly": "yyyy"}.get(grain, "yyyy-MM"))


def basis(columns: dict[str, Column], name: str | None, default: str) -> Column:
    """The date column a report goes by; an unknown name gives the default."""
    return columns.get(name or "", columns[default])


def preset_range(preset: str | None, as_of: dt.date, start: dt.date | None = None, end: dt.date | None = None) -> tuple[dt.date | None, dt.date | None]:
    """(from, to) of a preset. Kept as it is used today: this and last month have no upper end, and last
    month has no lower end in January; start and end count for CUSTOM only."""
    if preset == "TODAY":
        return as_of, as_of
    if preset == "LAST_7_DAYS":
        return as_of - dt.timedelta(days=6), as_of
    if preset == "THIS_MONTH":
        return as_of.replace(day=1), None
    if preset == "LAST_MONTH":
        return (None if as_of.month == 1 else as_of.replace(month=as_of.month - 1, day=1)), None
    return (start, end) if preset == "CUSTOM" else (None, None)


def overlaps(start: Column, end: Column, low: dt.date | None, high: dt.date | None) -> Column:
    """Whether [start, end] meets [low, high]; a missing end of the row's range is its other end."""
    out = F.lit(True)
    if low is not None:
        out = out & (F.coalesce(end, start) >= F.lit(low))
    if high is not None:
        out = out & (F.coalesce(start, end) <= F.lit(high))
    return out
