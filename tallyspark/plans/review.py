"""Review queues: states, deadlines, urgency."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates, money, review
from ..operators import relational, validation
from ..sources.scans import table
from .base import AS_OF, FILES, files

QUERIES = {}
DAY = f"DATE '{AS_OF}'"
DEADLINE = f"""CASE WHEN due IS NULL THEN 'NONE' WHEN datediff('day', {DAY}, due) < 0 THEN 'OVERDUE' WHEN due = {DAY} THEN 'TODAY' WHEN datediff('day', {DAY}, due) <= 3 THEN 'DUE_SOON' WHEN datediff('day', {DAY}, due) <= 7 THEN 'NORMAL' ELSE 'ENOUGH' END"""
DUE = "CAST(date_trunc('month', shipped + INTERVAL 1 MONTH) AS DATE) + 4"
RANK = """greatest(CASE deadline WHEN 'OVERDUE' THEN 100 WHEN 'TODAY' THEN 95 WHEN 'DUE_SOON' THEN 85 ELSE 50 END, CASE status WHEN 'FAILED' THEN 88 WHEN 'NEED_SUPPLEMENT' THEN 80 ELSE 0 END,
  CASE WHEN score IS NULL OR score <= 0 THEN 78 WHEN score < 30 THEN 76 WHEN score < 50 THEN 72 WHEN score < 70 THEN 62 ELSE 0 END)"""
COUNTS = """count(batch_id) AS total, count(CASE WHEN status = 'QUEUED' THEN 1 END) AS processing, count(CASE WHEN status = 'FAILED' THEN 1 END) AS failed, count(CASE WHEN status = 'NEED_SUPPLEMENT' THEN 1 END) AS supplement,
  count(CASE WHEN status = 'NEED_REVIEW' THEN 1 END) AS review, count(CASE WHEN status = 'CONFIRMED' THEN 1 END) AS confirmed, count(CASE WHEN status = 'NORMAL' THEN 1 END) AS normal"""
BATCHES = f"{FILES}, n AS (SELECT o_orderkey, {COUNTS} FROM orders LEFT JOIN files ON batch_id = o_orderkey GROUP BY 1)"


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def counts(spark, d):
    """Every batch, also one without files, with its counts."""
    joined = table(spark, d, "orders").select("o_orderkey").join(files(spark, d), F.col("o_orderkey") == F.col("batch_id"), "left")
    kinds = {"processing": review.PROCESSING, "failed": ("FAILED",), "supplement": ("NEED_SUPPLEMENT",), "review": ("NEED_REVIEW",), "confirmed": ("CONFIRMED",), "normal": ("NORMAL",)}
    return joined.groupBy("o_orderkey").agg(F.count("batch_id").alias("total"), *[F.count(F.when(F.col("status").isin(*v), 1)).alias(k) for k, v in kinds.items()])


NAMES = ("total", "processing", "failed", "supplement", "review", "confirmed", "normal")


@query(f"WITH {FILES} SELECT status, count(*) AS n, avg(score) AS mean_score, min(shipped) AS first_day, max(shipped) AS last_day FROM files GROUP BY 1")
def status_histogram(spark, d):
    return files(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"), F.min("shipped").alias("first_day"), F.max("shipped").alias("last_day"))


@query(f"WITH {BATCHES} SELECT o_orderkey, total, review + supplement AS open FROM n WHERE review + supplement > 2")
def batch_rollup_having(spark, d):
    return counts(spark, d).select("o_orderkey", "total", (F.col("review") + F.col("supplement")).alias("open")).filter("open > 2")


@query(f"""WITH {BATCHES} SELECT o_orderkey, CASE WHEN total = 0 THEN 'UPLOADED' WHEN processing > 0 THEN 'PROCESSING' WHEN review > 0 THEN 'NEED_REVIEW' WHEN normal > 0 THEN 'READY_TO_CONFIRM'
  WHEN confirmed = total THEN 'READY_TO_GENERATE' WHEN confirmed + supplement + failed = total THEN 'REVIEW_COMPLETED' WHEN supplement > 0 THEN 'NEED_SUPPLEMENT' ELSE 'NEED_REVIEW' END AS state FROM n""")
def batch_status_sm(spark, d):
    return counts(spark, d).select("o_orderkey", review.batch_state({k: F.col(k) for k in NAMES}).alias("state"))


@query(f"""WITH {BATCHES} SELECT o_orderkey, CASE WHEN total = 0 THEN 'EMPTY' WHEN processing > 0 THEN 'PROCESSING' WHEN review > 0 THEN 'NEED_REVIEW' WHEN normal > 0 THEN 'READY_TO_CONFIRM'
  WHEN confirmed + supplement + failed = total THEN 'REVIEW_COMPLETED' WHEN failed > 0 THEN 'HAS_FAILED' WHEN supplement > 0 THEN 'NEED_SUPPLEMENT' ELSE 'MIXED' END AS state FROM n""")
def batch_status_display(spark, d):
    return counts(spark, d).select("o_orderkey", review.shown_state({k: F.col(k) for k in NAMES}).alias("state"))


@query(f"""WITH {FILES} SELECT CASE WHEN score IS NULL THEN 'MISSING' WHEN score <= 0 THEN 'ZERO' WHEN score < 30 THEN 'CRITICAL' WHEN score < 50 THEN 'LOW' WHEN score < 70 THEN 'WARNING' WHEN score < 90 THEN 'GOOD' ELSE 'EXCELLENT' END AS band,
  count(*) AS n, count(CASE WHEN score < 50 THEN 1 END) AS below_50 FROM files GROUP BY 1""")
def score_band(spark, d):
    return files(spark, d).groupBy(review.score_band(F.col("score")).alias("band")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(review.in_bucket(F.col("score"), "LT50"), 1)).alias("below_50"))


def enriched(spark, d):
    f = files(spark, d).withColumn("due", dates.settlement_due(F.col("shipped"))).withColumn("deadline", dates.deadline_status(F.col("due"), AS_OF))
    f = f.withColumn("rank", review.urgency_rank(F.col("deadline"), F.col("status"), F.col("score")))
    return f.withColumns({"level": review.urgency_level(F.col("rank")), "settled": review.settlement(F.col("status"))})


ENRICHED = f"""{FILES}, d1 AS (SELECT *, {DUE} AS due FROM files), d2 AS (SELECT *, {DEADLINE} AS deadline FROM d1), d3 AS (SELECT *, {RANK} AS r0 FROM d2),
  d4 AS (SELECT *, CASE WHEN r0 <= 50 AND status IN ('NORMAL', 'CONFIRMED', 'READY_TO_CONFIRM', 'REVIEW_COMPLETED') THEN 20 ELSE r0 END AS rank FROM d3)"""


@query(f"WITH {ENRICHED} SELECT batch_id, max(rank) AS rank, count(CASE WHEN rank >= 90 THEN 1 END) AS urgent, count(CASE WHEN rank < 45 THEN 1 END) AS low FROM d4 GROUP BY 1")
def urgency_rank(spark, d):
    return enriched(spark, d).groupBy("batch_id").agg(F.max("rank").alias("rank"), F.count(F.when(F.col("level") == "URGENT", 1)).alias("urgent"), F.count(F.when(F.col("level") == "LOW", 1)).alias("low"))


@query(f"WITH {ENRICHED} SELECT deadline, due, count(*) AS n FROM d4 GROUP BY 1, 2")
def deadline_status(spark, d):
    return enriched(spark, d).groupBy("deadline", "due").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH o AS (SELECT CAST(o_orderdate AS DATE) AS day FROM orders) SELECT CASE WHEN year(day) < {AS_OF.year} - 1 OR year(day) > {AS_OF.year} + 1 THEN 'TOO_FAR_YEAR' WHEN datediff('day', {DAY}, day) > 1 THEN 'FUTURE_DATE' WHEN datediff('day', {DAY}, day) < -365 THEN 'TOO_OLD' ELSE 'NORMAL' END AS state, count(*) AS n FROM o GROUP BY 1""")
def expense_date_status(spark, d):
    raw = F.date_format("o_orderdate", "yyyy.M.d")
    o = table(spark, d, "orders").select(raw.alias("raw"), dates.date_only(raw).alias("day"))
    return o.groupBy(dates.expense_date_status(F.col("raw"), F.col("day"), AS_OF).alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {BATCHES}, g AS (SELECT *, CASE WHEN o_orderkey % 7 = 0 THEN 1 END AS given_hold, CASE WHEN o_orderkey % 5 = 0 THEN 0 END AS given_open FROM n)
  SELECT o_orderkey, normal AS ready, confirmed AS settled, CAST(coalesce(given_hold, supplement + failed) AS BIGINT) AS on_hold, CAST(coalesce(given_open, greatest(0, total - normal - confirmed - coalesce(given_hold, supplement + failed))) AS BIGINT) AS unsettled FROM g""")
def settlement_counts(spark, d):
    given = {"on_hold": F.when(F.col("o_orderkey") % 7 == 0, F.lit(1).cast("long")), "unsettled": F.when(F.col("o_orderkey") % 5 == 0, F.lit(0).cast("long"))}
    found = review.settlement_counts({k: F.col(k) for k in NAMES}, given)
    return counts(spark, d).select("o_orderkey", *[c.alias(k) for k, c in found.items()])


@query(f"""WITH {ENRICHED} SELECT batch_id, line_no, l_partkey, rank, CAST(score AS DOUBLE) AS score, due FROM d4 ORDER BY rank DESC, due ASC NULLS LAST, coalesce(score, 999) ASC, batch_id, line_no, l_partkey LIMIT 50""")
def review_topk(spark, d):
    rows = enriched(spark, d).select("batch_id", "line_no", "l_partkey", "rank", "score", "due")
    return rows.orderBy(F.desc("rank"), F.asc_nulls_last("due"), F.coalesce("score", F.lit(999.0)), "batch_id", "line_no", "l_partkey").limit(50)


@query("""WITH l AS (SELECT l_orderkey, min(CAST(l_shipdate AS DATE)) AS s, max(CAST(l_shipdate AS DATE)) AS e FROM lineitem GROUP BY 1) SELECT l_orderkey, s AS first_day, e AS last_day FROM l WHERE e >= DATE '1997-03-01' AND s <= DATE '1997-04-30'""")
def interval_overlap(spark, d):
    low, high = dates.preset_range("CUSTOM", AS_OF, AS_OF.replace(1997, 3, 1), AS_OF.replace(1997, 4, 30))
    spans = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min(F.to_date("l_shipdate")).alias("first_day"), F.max(F.to_date("l_shipdate")).alias("last_day"))
    return spans.filter(dates.overlaps(F.col("first_day"), F.col("last_day"), low, high))


@query(f"WITH {FILES}, i AS (SELECT status, list_position(['FAILED', 'NEED_SUPPLEMENT', 'NEED_REVIEW'], status) AS p FROM files) SELECT status, CAST(coalesce(nullif(p, 0), 999) AS BIGINT) AS place, count(*) AS n FROM i GROUP BY 1, 2")
def importance_sort(spark, d):
    place = relational.listed_order(F.col("status"), ["FAILED", "NEED_SUPPLEMENT", "NEED_REVIEW"])
    return files(spark, d).groupBy("status", place.alias("place")).agg(F.count(F.lit(1)).alias("n")).orderBy("place", "status")


@query(f"""WITH {FILES}, v AS (SELECT batch_id, CASE WHEN score < 30 THEN 1 ELSE 0 END AS a, CASE WHEN status = 'NEED_SUPPLEMENT' THEN 1 ELSE 0 END AS b, CASE WHEN amount > 50000 THEN 1 ELSE 0 END AS c FROM files)
  SELECT CASE WHEN b = 1 THEN 'NEED_SUPPLEMENT' WHEN a + c > 0 THEN 'NEED_REVIEW' ELSE 'PASS' END AS verdict, CASE WHEN a + b + c > 0 THEN 'NEED_REVIEW' ELSE 'NORMAL' END AS stored, CAST(round(least(0.75, a * 0.2 + b * 0.08 + c * 0.04), 4) AS DOUBLE) AS penalty, count(*) AS n FROM v GROUP BY 1, 2, 3""")
def validation_issues(spark, d):
    found = validation.issues(
        validation.issue(F.col("score") < 30, "LOW_SCORE", "score", penalty=0.2),
        validation.issue(F.col("status") == "NEED_SUPPLEMENT", "MISSING_PART", "status", action="SUPPLEMENT"),
        validation.issue(F.col("amount") > 50000, "LARGE", "amount", "WARNING", penalty=0.0),
    )
    rows = files(spark, d).select(found.alias("found")).withColumn("verdict", validation.status(F.col("found")))
    return rows.select("verdict", validation.stored_status(F.col("found"), F.col("verdict")).alias("stored"), F.round(validation.penalty(F.col("found")), 4).alias("penalty")).groupBy("verdict", "stored", "penalty").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {FILES} SELECT round(least(least(0.99, greatest(0, 0.5 + CASE WHEN score >= 50 THEN 0.3 ELSE 0 END - CASE WHEN status = 'FAILED' THEN 0.4 ELSE 0 END + CASE WHEN amount > 10000 THEN 0.25 ELSE 0 END)), CASE WHEN status = 'NEED_REVIEW' THEN 0.6 ELSE 1 END), 4) AS confidence, count(*) AS n FROM files GROUP BY 1")
def confidence_caps(spark, d):
    score = validation.confidence([(F.col("score") >= 50, 0.3), (F.col("status") == "FAILED", -0.4), (F.col("amount") > 10000, 0.25)])
    return files(spark, d).groupBy(F.round(validation.capped(score, [(F.col("status") == "NEED_REVIEW", 0.6)]), 4).alias("confidence")).agg(F.count(F.lit(1)).alias("n"))


BATCH_ROWS = f"""{BATCHES}, dated AS (SELECT batch_id, min(shipped) AS first_day, max(shipped) AS last_day, CAST(round(avg(CAST(CASE WHEN score > 20 THEN score END AS DOUBLE))) AS DOUBLE) AS score FROM files GROUP BY 1),
  b0 AS (SELECT n.*, first_day, last_day, CASE WHEN score <= 1 THEN round(score * 100) ELSE score END AS score, CAST(o_orderdate AS DATE) AS uploaded,
    CASE WHEN total = 0 THEN 'EMPTY' WHEN processing > 0 THEN 'PROCESSING' WHEN review > 0 THEN 'NEED_REVIEW' WHEN normal > 0 THEN 'READY_TO_CONFIRM' WHEN confirmed + supplement + failed = total THEN 'REVIEW_COMPLETED' WHEN failed > 0 THEN 'HAS_FAILED' WHEN supplement > 0 THEN 'NEED_SUPPLEMENT' ELSE 'MIXED' END AS status
    FROM n LEFT JOIN dated ON batch_id = n.o_orderkey JOIN orders o ON o.o_orderkey = n.o_orderkey),
  b1 AS (SELECT *, first_day IS NOT NULL AND abs(year(first_day) - {AS_OF.year}) <= 1 AND datediff('day', {DAY}, first_day) BETWEEN -365 AND 1 AS ok_first, last_day IS NOT NULL AND abs(year(last_day) - {AS_OF.year}) <= 1 AND datediff('day', {DAY}, last_day) BETWEEN -365 AND 1 AS ok_last FROM b0),
  b2 AS (SELECT *, CASE WHEN ok_first THEN first_day WHEN ok_last THEN last_day ELSE first_day END AS expense_day, CASE WHEN ok_first THEN first_day WHEN ok_last THEN last_day ELSE uploaded END AS base FROM b1),
  b3 AS (SELECT *, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(date_trunc('month', base + INTERVAL 1 MONTH) AS DATE) + 4 END AS due FROM b2),
  b4 AS (SELECT *, {DEADLINE} AS deadline FROM b3),
  b5 AS (SELECT *, CASE WHEN deadline = 'OVERDUE' THEN 100 WHEN deadline = 'TODAY' THEN 95 WHEN failed > 0 THEN 88 WHEN deadline = 'DUE_SOON' THEN 85 WHEN supplement > 0 THEN 80 WHEN score IS NULL OR score <= 0 THEN 78 WHEN score < 30 THEN 76 WHEN score < 50 THEN 72 WHEN score < 70 THEN 62
    WHEN status IN ('READY_TO_CONFIRM', 'REVIEW_COMPLETED') THEN 20 ELSE 50 END AS rank FROM b4)"""


def batch_rows(spark, d):
    """Every batch with its state, score, expense day, deadline, urgency and its reason; some deadlines are unknown."""
    dated = files(spark, d).groupBy("batch_id").agg(F.min("shipped").alias("first_day"), F.max("shipped").alias("last_day"), F.round(F.avg(F.when(F.col("score") > 20, F.col("score")))).alias("mean"))
    uploaded = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("uploaded"))
    b = counts(spark, d).join(dated, F.col("batch_id") == F.col("o_orderkey"), "left").join(uploaded, "o_orderkey")
    b = b.withColumns({"score": money.percent(F.col("mean"), bounded=False), "status": review.shown_state({k: F.col(k) for k in NAMES}), "expense_day": dates.representative_day(F.col("first_day"), F.col("last_day"), AS_OF)})
    state = dates.expense_date_status(F.col("expense_day").cast("string"), F.col("expense_day"), AS_OF)
    chosen = dates.chosen_deadline(F.lit(None).cast("date"), F.col("expense_day"), state, F.col("uploaded"), AS_OF)
    b = b.withColumn("due", F.when(F.col("o_orderkey") % 11 != 0, chosen)).withColumn("deadline", dates.deadline_status(F.col("due"), AS_OF))
    asked = [F.col(c) for c in ("deadline", "status", "score", "failed", "supplement")]
    return b.withColumns({"rank": review.urgency_rank(*asked), "reason": review.urgency_reason(*asked), "label": dates.deadline_label(F.col("due"), AS_OF), "issues": review.issue_count(F.lit(None).cast("long"), [F.col("review"), F.col("supplement"), F.col("failed")], F.col("status"))})


@query(f"""WITH {BATCH_ROWS} SELECT o_orderkey, status, expense_day, due, deadline, CAST(rank AS INTEGER) AS rank, CASE WHEN due IS NULL THEN '마감일 없음' WHEN due < {DAY} THEN 'D+' || datediff('day', due, {DAY}) WHEN due = {DAY} THEN '오늘 마감' ELSE 'D-' || datediff('day', {DAY}, due) END AS label,
  CASE rank WHEN 100 THEN '마감일이 지났습니다.' WHEN 95 THEN '오늘 마감입니다.' WHEN 88 THEN '처리 실패 항목이 있어 우선 확인이 필요합니다.' WHEN 85 THEN '3일 이내 마감입니다.' WHEN 80 THEN '보완 요청이 필요한 항목입니다.' WHEN 78 THEN 'AI 추출 점수가 없거나 0점입니다.' WHEN 76 THEN 'AI 추출 점수가 30점 미만입니다.'
    WHEN 72 THEN 'AI 추출 점수가 50점 미만입니다.' WHEN 62 THEN 'AI 추출 점수가 70점 미만입니다.' WHEN 20 THEN '검증 통과 또는 확정 완료 항목입니다.' ELSE '일반 검토 항목입니다.' END AS reason FROM b5""")
def batch_enrichment(spark, d):
    return batch_rows(spark, d).select("o_orderkey", "status", "expense_day", "due", "deadline", "rank", "label", "reason")


#: Parts in which batches are sorted; a prime, so that no shuffle before is like it.
SORT_PARTS = 257
#: Sorts of the review list, with what the reference's comparison of the key comes to in SQL.
_SORTED = {"urgent": "rank DESC", "deadline_asc": "due ASC NULLS LAST", "deadline_desc": "due DESC NULLS FIRST", "score_asc": "coalesce(score, 999) ASC", "score_desc": "coalesce(score, -1) DESC", "expense_date_desc": "expense_day DESC NULLS FIRST", "issue_count_desc": "issues DESC", "file_count_asc": "total ASC", "oldest": "uploaded ASC", "latest": "uploaded DESC", "expense_date_asc": "expense_day ASC NULLS LAST", "urgency_desc": "rank DESC", "urgency_asc": "rank ASC", "uploaded_at_desc": "uploaded DESC", "uploaded_at_asc": "uploaded ASC", "issue_count_asc": "issues ASC", "file_count_desc": "total DESC"}
_TIES = "rank DESC, due ASC NULLS LAST, coalesce(score, 999) ASC, uploaded DESC, o_orderkey"
_ISSUES = "CASE WHEN review + supplement + failed > 0 THEN review + supplement + failed WHEN status IN ('NEED_REVIEW', 'NEED_SUPPLEMENT', 'FAILED') THEN 1 ELSE 0 END"


@query(f"WITH {BATCH_ROWS}, b6 AS (SELECT *, {_ISSUES} AS issues FROM b5) " + " UNION ALL ".join(f"(SELECT '{name}' AS sort, o_orderkey, CAST(row_number() OVER (ORDER BY {by}, {_TIES}) AS INTEGER) AS place FROM b6 ORDER BY place LIMIT 20)" for name, by in _SORTED.items()))
def review_sorts(spark, d):
    """The first 20 batches by each sort of the review list."""
    b = batch_rows(spark, d)
    columns = {"urgency": F.col("rank"), "deadline": F.col("due"), "score": F.col("score"), "expense_date": F.col("expense_day"), "uploaded_at": F.col("uploaded"), "issue_count": F.col("issues"), "file_count": F.col("total")}
    # one pass: every batch with its place in each sort; of each sort a task keeps its first 20 before anything is shuffled
    places = F.explode(F.array(*[F.struct(F.lit(name).alias("sort"), review.review_place(name, columns).alias("key")) for name in _SORTED])).alias("s")
    # every batch becomes as many rows as there are sorts, which a task sorts: so many parts that they stay small, never put together
    b = b.repartition(SORT_PARTS, "o_orderkey")
    rows = b.select("o_orderkey", *[c.alias(k) for k, c in columns.items()], places)
    ties = review.review_ties({k: F.col(k) for k in columns})
    place = F.row_number().over(Window.partitionBy("s.sort").orderBy("s.key", *ties, "o_orderkey"))
    return rows.select(F.col("s.sort").alias("sort"), "o_orderkey", place.alias("place")).filter("place <= 20")


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice) AS BIGINT) AS amount FROM lineitem), b AS (SELECT *, amount % 1000 AS tail FROM a)
  SELECT l_orderkey, l_linenumber, amount, CASE WHEN amount >= 1000 AND (tail IN (8, 80, 88, 800, 808, 880, 888, 868, 688) OR (lpad(CAST(tail AS VARCHAR), 3, '0') LIKE '%8%' AND tail < 900)) THEN amount - tail ELSE amount END AS repaired FROM b""")
def amount_repairs(spark, d):
    """The last reading of each amount whose zeros may have been misread."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.floor("l_extendedprice").cast("long").alias("amount"))
    return rows.withColumn("repaired", F.element_at(money.zero_repairs(F.col("amount")), -1))


@query("""WITH o AS (SELECT o_orderkey, o_orderkey % 12 AS k, CAST(o_orderdate AS DATE) AS day FROM orders)
  SELECT o_orderkey, CASE WHEN k IN (1, 5, 7, 11) THEN NULL WHEN k = 10 THEN TRY_CAST('0123-' || strftime(day, '%m-%d') AS DATE) WHEN k IN (3, 8) THEN make_date(2000 + year(day) % 100, month(day), day(day)) ELSE day END AS day FROM o""")
def read_dates(spark, d):
    """Days in all the shapes that they are written in, and in some that are none."""
    k, day = F.col("o_orderkey") % 12, F.col("o_orderdate")
    shapes = ["yyyy-MM-dd HH:mm", "yyyy-13-dd", "yyyy.M.d", "'on 'yy/MM/dd", "yyyy'년'M'월'd'일'", "yyyy'년 'M'월 'd'일'", "'no. 'yyyyMMdd", "'x'yyyyMMdd", "yyMMdd", "yyyy M d", "'123.'M.d"]
    text = F.coalesce(*[F.when(k == i, F.date_format(day, s)) for i, s in enumerate(shapes)], F.lit(" "))
    return table(spark, d, "orders").select("o_orderkey", dates.date_only(text).alias("day"))


@query(f"""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderkey % 7 = 0 THEN make_date(2001, 9, 9) END AS manual, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderdate AS DATE) + 40 END AS up FROM orders),
  c AS (SELECT *, CASE WHEN abs(year(day) - {AS_OF.year}) <= 1 AND datediff('day', {DAY}, day) BETWEEN -365 AND 1 THEN day ELSE coalesce(up, {DAY}) END AS base FROM o)
  SELECT o_orderkey, coalesce(manual, CAST(date_trunc('month', base) + INTERVAL 1 MONTH AS DATE) + 4) AS due FROM c""")
def deadline_choice(spark, d):
    """Deadlines by hand, by a sound expense date, by the upload, or by today."""
    day = F.to_date("o_orderdate")
    manual, up = F.when(F.col("o_orderkey") % 7 == 0, F.lit(dt.date(2001, 9, 9))), F.when(F.col("o_orderkey") % 3 > 0, F.date_add(day, 40))
    state = dates.expense_date_status(day.cast("string"), day, AS_OF)
    return table(spark, d, "orders").select("o_orderkey", dates.chosen_deadline(manual, day, state, up, AS_OF).alias("due"))
