"""Audit log: pages, facets, payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relational
from ..sources.scans import table

QUERIES = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


@query("SELECT event_id, user_id, event_type, CAST(ts AS VARCHAR) AS at FROM events WHERE event_type = 'purchase' AND ts >= DATE '2024-01-05' AND ts < DATE '2024-01-21' ORDER BY ts DESC, event_id DESC LIMIT 20 OFFSET 20")
def audit_page(spark, d):
    e = relational.where(table(spark, d, "events"), F.coalesce("event_type", F.lit("")) == "purchase", *relational.half_open(F.col("ts"), "2024-01-05", "2024-01-20"))
    page = relational.page(e, [F.desc("ts"), F.desc("event_id")], 2, 20)
    return page.select("event_id", "user_id", "event_type", F.rtrim(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("0")).alias("raw")).withColumn("at", F.rtrim("raw", F.lit("."))).drop("raw")


@query("SELECT coalesce(event_type, '-') AS action, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, action LIMIT 10")
def audit_top_actions(spark, d):
    return table(spark, d, "events").groupBy(F.coalesce("event_type", F.lit("-")).alias("action")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "action").limit(10)


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, CAST(sum(CASE WHEN CAST(ts AS DATE) = DATE '2024-01-15' THEN 1 ELSE 0 END) AS BIGINT) AS today FROM events WHERE trim(event_type) <> '' GROUP BY 1")
def audit_facets(spark, d):
    e = table(spark, d, "events").filter(F.trim("event_type") != "")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.sum(F.when(F.to_date("ts") == F.lit("2024-01-15").cast("date"), 1).otherwise(0)).alias("today"))


@query("SELECT c_custkey, c_name, count(*) AS logs FROM customer JOIN events ON user_id = c_custkey GROUP BY 1, 2")
def users_with_logs(spark, d):
    logs = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("logs"))
    return table(spark, d, "customer").join(logs, F.col("user_id") == F.col("c_custkey")).select("c_custkey", "c_name", "logs")


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events WHERE json_valid(props) GROUP BY 1")
def json_props(spark, d):
    e = table(spark, d, "events").select(F.try_variant_get(F.try_parse_json("props"), "$.k", "long").alias("k"), F.try_parse_json("props").isNotNull().alias("ok"))
    return e.filter("ok").groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT greatest(1, CAST(ceil(count(*) / 20.0) AS BIGINT)) AS pages, count(*) AS total FROM events")
def audit_pages(spark, d):
    return relational.page_count(table(spark, d, "events"), 20).select("pages", "total")


@query("""SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type DESC) AS r FROM events GROUP BY 1, 2) WHERE r = 1""")
def most_frequent_action(spark, d):
    return relational.mode(table(spark, d, "events"), ["user_id"], "event_type")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line_no FROM events WHERE event_type <> 'view'")
def renumbered(spark, d):
    e = table(spark, d, "events").filter(F.col("event_type") != "view")
    return relational.renumbered(e, ["user_id"], [F.col("ts"), F.col("event_id")]).select("event_id", F.col("line_no").cast("long").alias("line_no"))


@query("SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_keys(spark, d):
    return relational.repeated_keys(table(spark, d, "events").select("user_id", F.to_date("ts").alias("day")), ["user_id", "day"])
