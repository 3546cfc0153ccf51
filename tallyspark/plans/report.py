"""Spend reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, text
from ..functions.money import stripped_money
from ..operators import facts, relational
from ..sources.scans import table
from .base import FILES, files, money

QUERIES = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


@query(f"""WITH {FILES} SELECT count(DISTINCT CASE WHEN status = 'CONFIRMED' THEN o_orderkey END) AS confirmed_batches, count(CASE WHEN status = 'CONFIRMED' THEN 1 END) AS confirmed_files,
  CAST(coalesce(sum(CASE WHEN status = 'CONFIRMED' THEN amount END), 0) AS DOUBLE) AS total_amount, count(CASE WHEN status IN ('NEED_REVIEW', 'NEED_SUPPLEMENT') THEN 1 END) AS open_files,
  count(CASE WHEN status = 'FAILED' THEN 1 END) AS failed_files, count(DISTINCT o_orderkey) AS batches FROM files JOIN orders ON batch_id = o_orderkey""")
def report_summary(spark, d):
    f = files(spark, d).join(table(spark, d, "orders"), F.col("batch_id") == F.col("o_orderkey"))
    ok = F.col("status") == "CONFIRMED"
    # a row for each batch first: distinct counts side by side would write every file three times
    each = f.groupBy("o_orderkey").agg(
        F.count(F.when(ok, 1)).alias("confirmed"),
        F.sum(F.when(ok, F.col("amount"))).alias("amount"),
        F.count(F.when(F.col("status").isin("NEED_REVIEW", "NEED_SUPPLEMENT"), 1)).alias("open"),
        F.count(F.when(F.col("status") == "FAILED", 1)).alias("failed"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("long"))
    return each.agg(
        F.count(F.when(F.col("confirmed") > 0, 1)).alias("confirmed_batches"),
        total("confirmed").alias("confirmed_files"),
        F.coalesce(F.sum("amount"), F.lit(0)).cast("double").alias("total_amount"),
        total("open").alias("open_files"),
        total("failed").alias("failed_files"),
        F.count("o_orderkey").alias("batches"),
    )


@query(f"""WITH {FILES}, sums AS (SELECT batch_id, count(*) AS n, sum(amount) AS amount FROM files GROUP BY 1)
  SELECT o_orderkey, c_name, coalesce(n_name, '-') AS department, coalesce(r_name, '-') AS site,
  CASE o_orderstatus WHEN 'F' THEN 'Finished' WHEN 'O' THEN 'Open' WHEN 'P' THEN 'Partial' ELSE '-' END AS status_label, coalesce(n, 0) AS n_files, CAST(coalesce(amount, 0) AS DOUBLE) AS amount
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN sums ON batch_id = o_orderkey""")
def report_star_list(spark, d):
    sums = files(spark, d).groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))
    # nation and region have a fixed, small number of rows; customers and batches grow and are joined by key
    star = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    star = star.join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    label = F.when(F.col("o_orderstatus") == "F", "Finished").when(F.col("o_orderstatus") == "O", "Open").when(F.col("o_orderstatus") == "P", "Partial").otherwise("-")
    out = star.join(sums, F.col("batch_id") == F.col("o_orderkey"), "left")
    return out.select("o_orderkey", "c_name", F.coalesce("n_name", F.lit("-")).alias("department"), F.coalesce("r_name", F.lit("-")).alias("site"), label.alias("status_label"), F.coalesce("n", F.lit(0)).alias("n_files"), F.coalesce("amount", F.lit(0)).cast("double").alias("amount"))


@query("""SELECT l_orderkey, max(CAST(CAST(l_quantity AS DECIMAL(18,2)) AS VARCHAR)) AS quantity, CAST(max(CAST(l_extendedprice AS DECIMAL(15,2))) AS DOUBLE) AS price, CAST(max(CAST(l_tax AS DECIMAL(15,2))) AS DOUBLE) AS tax FROM lineitem GROUP BY 1""")
def eav_pivot(spark, d):
    wide = table(spark, d, "lineitem").select("l_orderkey", *[money(f"l_{c}").alias(c) for c in ("quantity", "extendedprice", "tax")])
    out = facts.pivoted(facts.melted(wide, ["l_orderkey"], ["quantity", "extendedprice", "tax"]), ["l_orderkey"], {"quantity": ["quantity"]}, {"price": ["extendedprice", "total_amount"], "tax": ["tax"]})
    return out.select("l_orderkey", "quantity", F.col("price").cast("double").alias("price"), F.col("tax").cast("double").alias("tax"))


@query("""SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), '||' ORDER BY l_linenumber, l_partkey) AS parts FROM lineitem GROUP BY 1""")
def group_concat_ordered(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(facts.joined_text(F.col("l_partkey").cast("string"), ["l_linenumber", "l_partkey"]).alias("parts"))


@query(f"""WITH {FILES} SELECT strftime(CAST(o_orderdate AS DATE), '%Y-%m') AS period, count(*) AS n_files, CAST(sum(amount) AS DOUBLE) AS amount FROM files JOIN orders ON batch_id = o_orderkey
  WHERE o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1999-01-01' AND status = 'CONFIRMED' GROUP BY 1""")
def date_basis_period(spark, d):
    orders = relational.where(table(spark, d, "orders"), *relational.half_open(F.col("o_orderdate"), "1996-01-01", "1998-12-31"))
    f = relational.where(files(spark, d), *relational.equals({"status": F.col("status")}, {"status": "CONFIRMED", "site": ""}))
    rows = f.join(orders, F.col("batch_id") == F.col("o_orderkey"))
    day = dates.basis({"upload": F.to_date("o_orderdate"), "receipt": F.col("shipped")}, "unknown", "upload")
    return rows.groupBy(dates.period(day, "monthly").alias("period")).agg(F.count(F.lit(1)).alias("n_files"), F.sum("amount").cast("double").alias("amount"))


@query("""SELECT o_orderkey, o_orderpriority FROM orders WHERE (contains(lower(o_orderpriority), 'urgent') OR contains(CAST(o_custkey AS VARCHAR), 'urgent') OR contains(lower(o_orderstatus), 'urgent'))""")
def keyword_search(spark, d):
    o = table(spark, d, "orders")
    return relational.where(o, relational.keyword([F.col("o_orderpriority"), F.col("o_custkey"), F.col("o_orderstatus")], " URGENT ")).select("o_orderkey", "o_orderpriority")


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, p_name FROM lineitem LEFT JOIN part ON l_partkey = p_partkey),
  f AS (SELECT l_orderkey, count(*) AS n, min({'o': l_linenumber, 'k': l_partkey, 'name': p_name}).name AS first_item FROM x GROUP BY 1)
  SELECT l_orderkey, CASE WHEN trim(first_item) <> '' THEN CASE WHEN n > 1 THEN first_item || ' 외 ' || (n - 1) || '건' ELSE first_item END ELSE '미분류' END AS label FROM f""")
def representative_label(spark, d):
    x = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"), "left")
    f = x.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("l_linenumber"), F.col("l_partkey"), F.col("p_name"))).alias("f"))
    none = F.lit(None).cast("string")
    return f.select("l_orderkey", text.representative(none, F.col("f.p_name"), F.col("n"), none, none).alias("label"))


@query("""SELECT n.n_name AS creator, a.n_name AS approver, count(*) AS n FROM customer JOIN nation n ON c_nationkey = n.n_nationkey LEFT JOIN nation a ON (c_nationkey + 1) % 25 = a.n_nationkey GROUP BY 1, 2""")
def role_self_join(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    made = F.broadcast(n.select(F.col("n_nationkey").alias("ck"), F.col("n_name").alias("creator")))
    passed = F.broadcast(n.select(F.col("n_nationkey").alias("ak"), F.col("n_name").alias("approver")))
    return c.join(made, F.col("c_nationkey") == F.col("ck")).join(passed, (F.col("c_nationkey") + 1) % 25 == F.col("ak"), "left").groupBy("creator", "approver").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH f AS (SELECT l_orderkey, l_linenumber AS line, CAST(max(l_extendedprice) AS DECIMAL(15,2)) AS m, CAST(max(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END) AS DECIMAL(15,2)) AS t FROM lineitem GROUP BY 1, 2)
  SELECT l_orderkey, CAST(coalesce(max(t), sum(m)) AS DOUBLE) AS amount FROM f GROUP BY 1""")
def total_precedence(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("row_index"), F.when(F.col("l_returnflag") == "R", "total_amount").otherwise("line_amount").alias("kind"), money("l_extendedprice").cast("string").alias("value"))
    both = li.withColumn("field_key", F.explode(F.when(F.col("kind") == "total_amount", F.array(F.lit("total_amount"), F.lit("line_amount"))).otherwise(F.array(F.lit("line_amount"))))).drop("kind")
    return facts.total_amount(both, "l_orderkey", ["total_amount"], ["line_amount"], ["note"]).select("l_orderkey", F.col("amount").cast("double").alias("amount"))


@query("""WITH s AS (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS spent, max(l_linenumber) AS last FROM lineitem GROUP BY 1)
  SELECT l_orderkey AS batch_id, l_linenumber AS line_no, CAST(l_partkey AS VARCHAR) AS item, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS amount FROM lineitem
  UNION ALL SELECT o_orderkey, coalesce(last, 0) + 1, '기타/미분류 금액', CAST(CAST(o_totalprice AS DECIMAL(18,2)) - coalesce(spent, 0) AS DOUBLE) FROM orders LEFT JOIN s ON l_orderkey = o_orderkey WHERE CAST(o_totalprice AS DECIMAL(18,2)) > coalesce(spent, 0)""")
def residual_row(spark, d):
    details = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("batch_id"), F.col("l_linenumber").alias("line_no"), F.col("l_partkey").cast("string").alias("item"), money("l_extendedprice").alias("amount"))
    totals = table(spark, d, "orders").select(F.col("o_orderkey").alias("batch_id"), money("o_totalprice").alias("total"))
    return facts.residual(details, totals, "batch_id").withColumn("amount", F.col("amount").cast("double"))


@query(f"""WITH {FILES} SELECT batch_id, count(*) AS files, CAST(max(amount) AS DOUBLE) AS largest, max(CASE WHEN score >= 50 THEN status END) AS sound_status, min(shipped) AS first_day FROM files GROUP BY 1""")
def summary_per_parent(spark, d):
    return files(spark, d).groupBy("batch_id").agg(F.count(F.lit(1)).alias("files"), F.max("amount").cast("double").alias("largest"), F.max(F.when(F.col("score") >= 50, F.col("status"))).alias("sound_status"), F.min("shipped").alias("first_day"))


@query("""SELECT o_orderkey, CAST(try_cast(nullif(replace(replace(replace('₩' || CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR) || ' 원', '₩', ''), '원', ''), ' ', ''), '') AS DECIMAL(15,2)) AS DOUBLE) AS amount FROM orders""")
def money_text(spark, d):
    shown = F.concat(F.lit("₩"), F.format_number(money("o_totalprice"), 2), F.lit(" 원"))
    return table(spark, d, "orders").select("o_orderkey", stripped_money(shown).cast("double").alias("amount"))
