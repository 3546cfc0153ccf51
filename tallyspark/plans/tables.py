"""Keeping reference tables: inserts, upserts, replacements, activation, patches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import changes, facts, relational
from ..sources.scans import inline, table
from .base import files

QUERIES = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_seed(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return relational.anti_append(li, table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"])


@query("""SELECT n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT id, min(name) FROM (SELECT c_nationkey + 20 AS id, c_mktsegment AS name FROM customer) WHERE id NOT IN (SELECT n_nationkey FROM nation) GROUP BY 1""")
def insert_ignore(spark, d):
    target = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    rows = table(spark, d, "customer").select((F.col("c_nationkey") + 20).alias("id"), F.col("c_mktsegment").alias("name"))
    return changes.insert_missing(target, rows, ["id"], [F.col("name")])


@query("""WITH u AS (SELECT user_id AS c_custkey, max(event_id) AS event_id FROM events GROUP BY 1) SELECT c_custkey, coalesce(u.event_id, -1) AS event_id FROM customer FULL JOIN u USING (c_custkey)""")
def upsert_latest(spark, d):
    target = table(spark, d, "customer").select("c_custkey", F.lit(-1).cast("long").alias("event_id"))
    rows = table(spark, d, "events").select(F.col("user_id").alias("c_custkey"), "event_id")
    return changes.upsert(target, rows, ["c_custkey"], F.col("event_id"))


@query("""SELECT o_orderkey, o_orderstatus AS v FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) UNION ALL SELECT l_orderkey, l_returnflag FROM lineitem WHERE l_quantity > 45""")
def replace_by_key(spark, d):
    target = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("v"))
    rows = table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("v"))
    return changes.replace(target, rows, ["o_orderkey"])


@query("""SELECT p_partkey, CASE WHEN p_partkey = 7 THEN 'ACTIVE' WHEN p_brand = (SELECT p_brand FROM part WHERE p_partkey = 7) THEN 'INACTIVE' ELSE 'ACTIVE' END AS status FROM part""")
def exclusive_activation(spark, d):
    p = table(spark, d, "part").withColumn("status", F.lit("ACTIVE"))
    group = p.filter("p_partkey = 7").select(F.col("p_brand").alias("g")).limit(1)  # a scalar
    return changes.activated(p.join(F.broadcast(group), how="left"), F.col("p_partkey"), F.col("p_brand"), F.lit(7), F.col("g")).select("p_partkey", "status")


@query("SELECT 'orders' AS label, count(*) AS n FROM orders UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'events', count(*) FROM events")
def union_counts(spark, d):
    return relational.counts_of({n: table(spark, d, n) for n in ("orders", "part", "events")})


@query("""WITH o AS (SELECT l_orderkey AS k, l_linenumber AS n, max(l_quantity) AS v FROM lineitem GROUP BY 1, 2), w AS (SELECT l_orderkey AS k, l_linenumber + 1 AS n, max(l_quantity) AS v FROM lineitem GROUP BY 1, 2)
  SELECT CASE WHEN o.k IS NULL THEN 'insert' WHEN w.k IS NULL THEN 'delete' WHEN o.v = w.v THEN 'keep' ELSE 'update' END AS change, count(*) AS rows FROM o FULL JOIN w ON o.k = w.k AND o.n = w.n GROUP BY 1""")
def sync_diff(spark, d):
    one = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n")).agg(F.max("l_quantity").alias("v"))
    two = one.select("k", (F.col("n") + 1).alias("n"), "v")
    return changes.synced(one, two, ["k", "n"], "v").groupBy("change").agg(F.count(F.lit(1)).alias("rows"))


@query("SELECT s_suppkey, CASE WHEN s_nationkey = 3 THEN s_acctbal + 1 ELSE s_acctbal END AS s_acctbal, CASE WHEN s_nationkey IN (1, 2) THEN 'LOCKED' ELSE 'CHANGED' END AS state FROM supplier")
def guarded_update(spark, d):
    s = table(spark, d, "supplier").withColumn("state", F.when(F.col("s_nationkey").isin(1, 2), "LOCKED").otherwise("OPEN"))
    s = changes.guarded(s, "state", F.lit("CHANGED"), ["LOCKED"])
    return changes.counted_up(s, "s_acctbal", F.col("s_nationkey") == 3).select("s_suppkey", "s_acctbal", "state")


@query("""SELECT p_partkey, CASE WHEN p_size > 40 THEN 'APPROVED' WHEN p_size < 5 THEN 'DISABLED' ELSE 'PENDING' END AS status, CASE WHEN p_size > 40 THEN 'Y' WHEN p_size < 5 THEN 'N' ELSE 'Y' END AS active_yn FROM part""")
def patch_fields(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.lit("PENDING").alias("status"), F.lit("Y").alias("active_yn"))
    size = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 40, "APPROVED").when(F.col("p_size") < 5, "DISABLED").alias("status"))
    return changes.patched(p, size, ["p_partkey"], ["status"])


@query("SELECT p_brand, max(p_size) + 1 AS next_version FROM part GROUP BY 1")
def next_version(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg((F.max("p_size") + 1).alias("next_version"))


@query("""WITH t(code, name, value) AS (VALUES ('BUILDING', 'a', 1), ('MACHINERY', 'b', 2), ('X', 'HOUSEHOLD', 3)) SELECT c_custkey, coalesce(a.value, b.value, 0) AS value FROM customer LEFT JOIN t a ON upper(c_mktsegment) = a.code LEFT JOIN t b ON c_mktsegment = b.name""")
def category_lookup(spark, d):
    t = inline(spark, [("BUILDING", "a", 1), ("MACHINERY", "b", 2), ("X", "HOUSEHOLD", 3)], "code string, name string, value int")
    return relational.lookup(table(spark, d, "customer"), t, F.col("c_mktsegment"), F.col("c_mktsegment"), F.lit(0)).select("c_custkey", "value")


@query("""SELECT o_orderkey, count(l_orderkey) AS n, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS children FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def nested_children(spark, d):
    kids = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    out = relational.nested(table(spark, d, "orders").select("o_orderkey"), kids, "o_orderkey", ["l_linenumber", "l_partkey"], "kids")
    said = F.array_join(F.transform("kids", lambda x: F.concat_ws(":", x["l_linenumber"], x["l_partkey"])), ",")
    return out.select("o_orderkey", F.size("kids").cast("long").alias("n"), F.nullif(said, F.lit("")).alias("children"))


@query("""SELECT l_orderkey AS batch_id, l_linenumber AS line_no, max(l_partkey) AS part, CAST(max(l_quantity) AS DOUBLE) AS quantity, bool_or(l_returnflag = 'A' AND l_linestatus = 'F') AS candidate FROM lineitem WHERE l_linenumber > 0 GROUP BY 1, 2""")
def detail_pivot(spark, d):
    return files(spark, d).filter(F.coalesce("line_no", F.lit(0)) > 0).groupBy("batch_id", "line_no").agg(F.max("l_partkey").alias("part"), F.max("l_quantity").alias("quantity"), F.bool_or(F.col("status") == "NEED_REVIEW").alias("candidate"))


@query("""SELECT l_orderkey, l_linenumber, arg_min(CAST(l_partkey AS VARCHAR), l_partkey) AS value FROM lineitem GROUP BY 1, 2""")
def first_values(spark, d):
    f = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("field_key"), F.col("l_partkey").cast("string").alias("value"), "l_partkey")
    return facts.first_values(f, ["l_orderkey"], ["l_partkey"]).select("l_orderkey", F.col("field_key").alias("l_linenumber"), "value")


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, max(l_extendedprice) OVER (PARTITION BY l_orderkey, l_linenumber) AS m FROM lineitem) WHERE NOT (l_extendedprice < 20000 AND m >= 20000)""")
def fragment_removal(spark, d):
    rows = table(spark, d, "lineitem").withColumn("amount", F.col("l_extendedprice"))
    return facts.without_fragments(rows, ["l_orderkey", "l_linenumber"], 20000).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT n_nationkey, list_position([7, 3, 11], n_nationkey) AS place, CASE WHEN n_name = 'x' THEN 1 ELSE 0 END AS preferred FROM nation WHERE n_nationkey IN (3, 7, 11)")
def custom_order(spark, d):
    n = table(spark, d, "nation").filter(F.col("n_nationkey").isin(7, 3, 11))
    place = F.array_position(F.array(F.lit(7), F.lit(3), F.lit(11)), F.col("n_nationkey")).cast("int")
    return n.select("n_nationkey", place.alias("place"), relational.preferred_last(F.col("n_name"), "x").alias("preferred")).orderBy("place")


@query("SELECT p_partkey, left(regexp_replace(p_name, '[^A-Za-z0-9_가-힣-]', '_', 'g'), 20) AS name, CASE WHEN contains(lower(p_type), 'steel') THEN 'METAL' WHEN contains(lower(p_type), 'brass') THEN 'ALLOY' ELSE 'OTHER' END AS kind FROM part")
def part_labels(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", text.file_name(F.col("p_name"), 20).alias("name"), text.first_keyword(F.col("p_type"), [("METAL", ["STEEL"]), ("ALLOY", ["brass"])], "OTHER").alias("kind"))
