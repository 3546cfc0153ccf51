"""Several recognitions of one page: lines put right, the recognition chosen by what it holds, and long pages put together again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Misread words, one after the other, and what tells a line with money.
MISREAD = [
    ("P0S", "POS"), ("p0s", "POS"), ("부 가 세", "부가세"), ("부가 세", "부가세"), ("공 급가액", "공급가액"), ("공 급가", "공급가"),
    ("합계글액", "합계금액"), ("발은금액", "받은금액"), ("영수번호::", "영수번호:"),
]
MONEY_WORDS = "금액|운임|요금|영수|합계|총액|결제|승인|카드"
#: Recognitions that keep the page as it was, and those that can lose parts of it, by their labels.
STABLE, DESTRUCTIVE = "resized_color|enhanced_gray", "binary|line_preserved|shadow_removed|illumination"
#: Score from which on parts of a page count, and how many of them.
PART, MOST_PARTS = 0.42, 5


def recognised_line(line: Column) -> Column:
    """Without invisible signs, one kind of bars and dashes, misread words mended, and won signs put right where money stands."""
    text = F.trim(F.coalesce(line, F.lit("")))
    text = F.replace(F.regexp_replace(F.translate(text, "｜–—", "|--"), "[​﻿\r]", ""), F.lit("₩"), F.lit("원"))
    for wrong, right in MISREAD:
        text = F.replace(text, F.lit(wrong), F.lit(right))
    money = text.rlike(MONEY_WORDS) | (text.rlike("[월Ww]") & text.rlike("[0-9]")) | text.rlike(r"[0-9]{1,3}(?:[,.][0-9]{3})+")
    won = F.regexp_replace(text, "[월Ww]", "원")
    won = F.when(won.rlike("[0-9]O[0-9]"), F.replace(won, F.lit("O"), F.lit("0"))).otherwise(won)
    return F.trim(F.regexp_replace(F.when(money, won).otherwise(text), r"(?U)\s+", " "))


def scored(candidates: DataFrame, page: str = "page") -> DataFrame:
    """Adds selection to ``candidates(page, place, label, text, quality, usable, has_amount, has_date, has_vendor, hints, dates, noise, structure)``.

    Quality and what a recognition holds, more for a date that most recognitions of the page agree on, less for a
    recognition that lost text or hints against those that keep the page. ``structure`` is what its lines are worth;
    nulls count as 0 and false. ``place`` tells a page's recognitions apart.
    """
    whole = Window.partitionBy(page)
    label, length, hints = F.lower(F.coalesce("label", F.lit(""))), F.length(F.trim(F.coalesce("text", F.lit("")))), F.coalesce("hints", F.lit(0))
    zero, no = (lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))), (lambda c: F.coalesce(c, F.lit(False)))
    rows = candidates.withColumns({"_label": label, "_n": length, "_h": hints, "_stable": label.rlike(STABLE), "_dates": F.array_distinct(F.coalesce("dates", F.array().cast("array<string>")))})
    rows = rows.withColumn("_any", F.max("_stable").over(whole))
    of = lambda c: F.max(F.when(F.col("_stable") | ~F.col("_any"), F.col(c))).over(whole)
    rows = rows.withColumns({"_most": of("_n"), "_most_hints": of("_h"), "_all": F.flatten(F.collect_list(F.coalesce("dates", F.array().cast("array<string>"))).over(whole))})
    times = F.transform(F.array_distinct("_all"), lambda d: F.struct(F.size(F.filter("_all", lambda x: x == d)).alias("n"), d.alias("d")))
    rows = rows.withColumn("_times", times).withColumn("_top", F.coalesce(F.array_max(F.transform("_times", lambda t: t["n"])), F.lit(0)))
    agreed = F.transform(F.filter("_times", lambda t: (t["n"] == F.col("_top")) & (t["n"] >= 2)), lambda t: t["d"])
    dated = F.when(F.size("_dates") == 0, -0.03).when(F.arrays_overlap("_dates", agreed), 0.08).when(F.size("_times") >= 2, -0.05).otherwise(0.0)
    add = lambda holds, points: F.when(no(holds), points).otherwise(0.0)
    base = zero("quality") + add(F.col("has_amount"), 0.05) + add(F.col("has_date"), 0.04) + add(F.col("has_vendor"), 0.03) + zero("structure") + dated
    base = base - add(F.contains("_label", F.lit("line_preserved")) & (zero("structure") < 0.20), 0.14)
    lost = F.col("_label").rlike(DESTRUCTIVE)
    base = base - add(lost & (F.col("_most") >= 80) & (F.col("_n") < F.col("_most") * 0.65), 0.18)
    base = base - add(lost & (F.col("_most_hints") >= 2) & (F.col("_h") < F.col("_most_hints")), F.least(F.lit(0.16), (F.col("_most_hints") - F.col("_h")) * 0.04))
    rows = rows.withColumn("_score", base)
    binary = F.contains("_label", F.lit("binary"))
    final = F.col("_score") - add(binary & ~no(F.col("has_amount")) & (F.col("_score") < 0.5), 0.10) - add(binary & (zero("noise") > 0.03), 0.12)
    return rows.withColumn("selection", F.round(F.greatest(F.lit(0.0), final), 4)).select(*candidates.columns, "selection")


def chosen(candidates: DataFrame, page: str = "page") -> DataFrame:
    """The recognitions that a page's text is made of, with rank from 1: up to five good parts if there are two, else the best one.

    Unusable ones count only where all are; a score of 0 gives way to the quality; of equals the one placed first.
    """
    rows = scored(candidates, page)
    whole = Window.partitionBy(page)
    usable = F.coalesce(F.col("usable"), F.lit(False))
    rows = rows.withColumn("_usable", usable).withColumn("_some", F.max("_usable").over(whole)).filter("_usable or not _some")
    order = whole.orderBy(F.desc(F.coalesce(F.nullif(F.col("selection"), F.lit(0.0)), F.col("quality"), F.lit(0.0))), "place")
    part = F.contains(F.lower(F.coalesce("label", F.lit(""))), F.lit("crop")) & F.col("_usable") & (F.col("selection") >= PART)
    rows = rows.withColumns({"_part": part, "_best": F.row_number().over(order)})
    rows = rows.withColumns({"_parts": F.sum(F.col("_part").cast("int")).over(whole), "_nth": F.sum(F.col("_part").cast("int")).over(order)})
    kept = F.when(F.col("_parts") >= 2, F.col("_part") & (F.col("_nth") <= MOST_PARTS)).otherwise(F.col("_best") == 1)
    return rows.filter(kept).select(*candidates.columns, "selection", F.when(F.col("_parts") >= 2, F.col("_nth")).otherwise(1).cast("int").alias("rank"))


def page_texts(selected: DataFrame, page: str = "page") -> DataFrame:
    """(page, text): one recognition as it is; of several their lines put right, each once by its letters, in order of rank."""
    joined = F.split(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("rank", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"])), "\r\n|\r|\n")
    per = selected.groupBy(page).agg(F.count(F.lit(1)).alias("n"), F.max("text").alias("one"), joined.alias("lines"))
    lines = per.filter("n > 1").select(page, F.posexplode("lines").alias("no", "raw")).withColumn("line", recognised_line(F.col("raw")))
    key = F.regexp_replace(F.lower("line"), r"(?U)[\s,.]+", "")
    first = lines.withColumn("_key", key).filter("_key <> ''").groupBy(page, "_key").agg(F.min(F.struct("no", "line")).alias("x"))
    text = first.groupBy(page).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("merged"))
    return per.drop("lines").join(text, page, "left").select(page, F.when(F.col("n") == 1, F.coalesce("one", F.lit(""))).otherwise(F.coalesce("merged", F.lit(""))).alias("text"))
