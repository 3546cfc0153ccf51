"""Lists and details: reviews, a user's files and batches, documents, templates, values, dimensions, updates.

Orders are batches, line items their files, customers the users, nations departments, regions sites, parts templates.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facts, lists, relational
from ..sources.scans import inline, table
from .base import FILES, files

QUERIES = {}
# The standard fields and the labels of mappings for the queries below.
FIELDS = [("shipped", "Day", "DATE", 10, True), ("score", "Score", "NUMBER", 20, False), ("status", "State", "TEXT", 30, True)]
LABELS = ("shipped", "amount", "score", "vendor", "status", "remark", "tax")
_FIELDS = "std(key, label, data_type, sort_order, required) AS (VALUES ('shipped', 'Day', 'DATE', 10, TRUE), ('score', 'Score', 'NUMBER', 20, FALSE), ('status', 'State', 'TEXT', 30, TRUE))"
BATCHES = """b AS (SELECT o_orderkey AS batch_id, o_custkey AS user_id, o_orderpriority AS title, o_orderstatus AS kind, CAST(o_orderdate AS DATE) AS day, c_name AS submitter, n_name AS department, r_name AS site
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey)"""
FACTS = f"""{FILES}, facts AS (SELECT batch_id, line_no, l_partkey, unnest(['status', 'score', 'shipped', 'l_partkey']) AS key,
  unnest([status, CAST(CAST(score AS BIGINT) AS VARCHAR), CAST(shipped AS VARCHAR), CAST(l_partkey AS VARCHAR)]) AS value FROM files)"""


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def batches(spark, d):
    """Batches with the names of their submitter, department and site, as far as they are known."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("batch_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("kind"), F.to_date("o_orderdate").alias("day"))
    o = lists.with_names(o, "user_id", table(spark, d, "customer"), "c_custkey", {"c_name": "submitter", "c_nationkey": "_nation"})
    o = lists.with_names(o, "_nation", table(spark, d, "nation"), "n_nationkey", {"n_name": "department", "n_regionkey": "_region"})
    return lists.with_names(o, "_region", table(spark, d, "region"), "r_regionkey", {"r_name": "site"}).drop("_nation", "_region")


def values(spark, d):
    f = files(spark, d).withColumn("score", F.col("score").cast("long"))
    wide = f.select("batch_id", "line_no", F.col("l_partkey").alias("part"), "status", "score", "shipped", "l_partkey")
    return facts.melted(wide, ["batch_id", "line_no", "part"], ["status", "score", "shipped", "l_partkey"]).withColumnRenamed("part", "l_partkey").withColumnRenamed("field_key", "key")


def standard_fields(spark):
    return inline(spark, FIELDS, "std_key string, label string, data_type string, sort_order int, required boolean")


@query(f"WITH {FILES}, {BATCHES} SELECT f.batch_id, line_no, l_partkey, status, CAST(amount AS DOUBLE) AS amount, title, kind, submitter, department, site, p_name AS template FROM files f JOIN b ON b.batch_id = f.batch_id LEFT JOIN part ON p_partkey = l_partkey")
def review_file_detail(spark, d):
    """Every file with its batch and the names around it."""
    f = files(spark, d).select("batch_id", "line_no", "l_partkey", "status", F.col("amount").cast("double").alias("amount")).join(batches(spark, d).drop("user_id", "day"), "batch_id")
    return lists.with_names(f, "l_partkey", table(spark, d, "part"), "p_partkey", {"p_name": "template"})


@query(f"""WITH {FACTS}, {_FIELDS} SELECT batch_id, line_no, l_partkey, facts.key, coalesce(label, facts.key) AS label, data_type, value,
  row_number() OVER (PARTITION BY batch_id, line_no, l_partkey ORDER BY coalesce(sort_order, 9999), facts.key, value) AS place FROM facts LEFT JOIN std ON std.key = facts.key""")
def review_fields(spark, d):
    """A file's values in the order of the standard fields; other fields come last."""
    v = lists.with_names(values(spark, d), "key", standard_fields(spark), "std_key", {"label": "label", "data_type": "data_type", "sort_order": "sort_order"})
    order = [F.coalesce("sort_order", F.lit(9999)), F.col("key"), F.col("value")]
    placed = relational.renumbered(v, ["batch_id", "line_no", "l_partkey"], order, "place")
    return placed.select("batch_id", "line_no", "l_partkey", "key", F.coalesce("label", "key").alias("label"), "data_type", "value", F.col("place").cast("long").alias("place"))


@query(f"WITH {FILES}, {BATCHES}, l AS (SELECT batch_id, count(*) AS n, string_agg(line_no || ':' || status, '|' ORDER BY line_no || ':' || status) AS children FROM files GROUP BY 1) SELECT b.batch_id, title, submitter, department, site, coalesce(n, 0) AS n, coalesce(children, '') AS children FROM b LEFT JOIN l ON l.batch_id = b.batch_id")
def batch_detail(spark, d):
    """Each batch with the list of its files; a batch's files fit in a task."""
    child = F.concat(F.col("line_no").cast("string"), F.lit(":"), F.col("status"))
    l = files(spark, d).groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list(child)), "|").alias("children"))  # noqa: E741
    b = batches(spark, d).select("batch_id", "title", "submitter", "department", "site").join(l, "batch_id", "left")
    return b.withColumns({"n": F.coalesce("n", F.lit(0).cast("long")), "children": F.coalesce("children", F.lit(""))})


@query(f"""WITH {FILES}, {BATCHES}, s AS (SELECT user_id, f.batch_id, line_no, l_partkey, title, department, site FROM files f JOIN b ON b.batch_id = f.batch_id WHERE status = 'NEED_SUPPLEMENT' AND user_id IS NOT NULL),
  p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY batch_id DESC, line_no DESC, l_partkey DESC) AS place, count(*) OVER (PARTITION BY user_id) AS total FROM s) SELECT * FROM p WHERE place <= 20""")
def my_supplements(spark, d):
    """The first page of every user's files that need a supplement, latest first, with their number."""
    f = files(spark, d).filter(F.col("status") == "NEED_SUPPLEMENT").select("batch_id", "line_no", "l_partkey")
    mine = f.join(batches(spark, d).select("batch_id", "user_id", "title", "department", "site"), "batch_id").filter("user_id IS NOT NULL")
    out = lists.pages_of_each(mine, ["user_id"], [F.desc("batch_id"), F.desc("line_no"), F.desc("l_partkey")])
    return out.withColumn("place", F.col("place").cast("long"))


@query(f"""WITH {FILES}, {BATCHES}, n AS (SELECT batch_id, count(*) AS n FROM files GROUP BY 1), j AS (SELECT user_id, b.batch_id, title, kind, day, department, site, coalesce(n, 0) AS files FROM b LEFT JOIN n ON n.batch_id = b.batch_id),
  p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY batch_id DESC) AS place, count(*) OVER (PARTITION BY user_id) AS total FROM j) SELECT * FROM p WHERE place BETWEEN 6 AND 10 AND user_id IS NOT NULL""")
def my_batches(spark, d):
    """The second page (of five) of every user's batches, with the number of their files."""
    n = files(spark, d).groupBy("batch_id").agg(F.count(F.lit(1)).alias("files"))
    b = batches(spark, d).drop("submitter").filter("user_id IS NOT NULL").join(n, "batch_id", "left").withColumn("files", F.coalesce("files", F.lit(0).cast("long")))
    return lists.pages_of_each(b, ["user_id"], [F.desc("batch_id")], 2, 5).withColumn("place", F.col("place").cast("long"))


@query(f"WITH {BATCHES} SELECT batch_id, title, department, site, submitter, day FROM b WHERE kind = 'F' AND day >= DATE '1996-01-01' AND day <= DATE '1998-06-30' ORDER BY batch_id DESC LIMIT 20 OFFSET 20")
def generated_documents(spark, d):
    """A page of finished documents within a range of days."""
    kept = relational.where(batches(spark, d), *relational.equals({"kind": F.col("kind")}, {"kind": "F"}), F.col("day") >= F.lit("1996-01-01").cast("date"), F.col("day") <= F.lit("1998-06-30").cast("date"))
    return relational.page(kept.select("batch_id", "title", "department", "site", "submitter", "day"), [F.desc("batch_id")], 2, 20)


@query("""SELECT p_partkey, p_brand AS template_group, p_size AS version, p_name, s_name AS author FROM part LEFT JOIN supplier ON s_suppkey = p_partkey % 7 WHERE p_type = 'ECONOMY' ORDER BY p_brand DESC, p_size DESC, p_partkey DESC LIMIT 20""")
def template_list(spark, d):
    """Templates by group, version and id, each falling."""
    p = table(spark, d, "part").filter(F.col("p_type") == "ECONOMY").withColumn("_by", F.col("p_partkey") % 7)
    p = lists.with_names(p, "_by", table(spark, d, "supplier"), "s_suppkey", {"s_name": "author"})
    order = [F.desc("p_brand"), F.desc("p_size"), F.desc("p_partkey")]
    return relational.page(p, order).select("p_partkey", F.col("p_brand").alias("template_group"), F.col("p_size").alias("version"), "p_name", "author")


_LABELS = ", ".join(f"'{x}'" for x in LABELS)


@query(f"""WITH {_FIELDS}, m AS (SELECT DISTINCT l_partkey, l_linenumber, [{_LABELS}][1 + l_linenumber % 7] AS key FROM lineitem) SELECT l_partkey, l_linenumber, m.key, coalesce(std.label, 'cell ' || m.key) AS name, data_type,
  row_number() OVER (PARTITION BY l_partkey ORDER BY coalesce(sort_order, 9999), l_linenumber) AS place FROM m LEFT JOIN std ON std.key = m.key""")
def template_mappings(spark, d):
    """A template's mapped cells; the standard field's name goes before the cell's own label."""
    m = table(spark, d, "lineitem").select("l_partkey", "l_linenumber").distinct()
    m = m.withColumn("key", F.element_at(F.array(*[F.lit(x) for x in LABELS]), (F.col("l_linenumber") % 7 + 1).cast("int")))
    m = lists.with_names(m, "key", standard_fields(spark), "std_key", {"label": "label", "data_type": "data_type", "sort_order": "sort_order"})
    placed = relational.renumbered(m, ["l_partkey"], [F.coalesce("sort_order", F.lit(9999)), F.col("l_linenumber")], "place")
    return placed.select("l_partkey", "l_linenumber", "key", F.coalesce("label", F.concat(F.lit("cell "), F.col("key"))).alias("name"), "data_type", F.col("place").cast("long").alias("place"))


@query(f"WITH {FACTS}, {_FIELDS} SELECT batch_id, line_no, l_partkey, facts.key, label, data_type, p_type AS category, value FROM facts JOIN std ON std.key = facts.key LEFT JOIN part ON p_partkey = l_partkey")
def extracted_values(spark, d):
    """Values of standard fields only, with their category if there is one."""
    v = values(spark, d).join(standard_fields(spark).drop("sort_order", "required"), F.col("key") == F.col("std_key")).drop("std_key")
    return lists.with_names(v, "l_partkey", table(spark, d, "part"), "p_partkey", {"p_type": "category"})


@query(f"""WITH {FILES}, {BATCHES} SELECT f.batch_id, line_no, l_partkey, coalesce(nullif(CASE WHEN line_no % 3 = 0 THEN 0 WHEN line_no % 3 = 1 THEN l_partkey END, 0), f.batch_id) AS template_id, coalesce(nullif(CASE WHEN line_no % 2 = 0 THEN '' ELSE status END, ''), CASE WHEN kind = 'O' THEN NULL ELSE kind END, 'RECEIPT') AS document_type,
  coalesce(department, '') AS department_name, coalesce(CASE WHEN site <> 'ASIA' THEN site END, 'batch site', '') AS site_name, coalesce(submitter, '') AS user_name, coalesce(title, '') AS expense_title FROM files f JOIN b ON b.batch_id = f.batch_id""")
def source_context(spark, d):
    """Every file with what it takes from itself, its batch, or neither."""
    line = F.col("line_no") % 3
    f = files(spark, d).select("batch_id", "line_no", "l_partkey", F.when(line == 0, F.lit(0).cast("long")).when(line == 1, F.col("l_partkey")).alias("file_template"), F.when(F.col("line_no") % 2 == 0, "").otherwise(F.col("status")).alias("file_type"))
    b = batches(spark, d).withColumns({"batch_template": F.col("batch_id"), "batch_type": F.when(F.col("kind") != "O", F.col("kind")), "batch_site": F.lit("batch site"), "site": F.when(F.col("site") != "ASIA", F.col("site"))})
    out = lists.source_context(f.join(b.drop("day", "kind", "user_id"), "batch_id"))
    return out.select("batch_id", "line_no", "l_partkey", "template_id", "document_type", "department_name", "site_name", "user_name", "expense_title")


@query(f"WITH {FILES} SELECT batch_id, line_no, l_partkey, CAST(amount AS DOUBLE) AS amount, row_number() OVER (PARTITION BY batch_id ORDER BY line_no, l_partkey, amount) AS place FROM files WHERE status IN ('CONFIRMED', 'NORMAL')")
def export_files(spark, d):
    """A batch's finished files in the order of their export."""
    f = files(spark, d).filter(F.col("status").isin("CONFIRMED", "NORMAL")).select("batch_id", "line_no", "l_partkey", F.col("amount").cast("double").alias("amount"))
    return relational.renumbered(f, ["batch_id"], [F.col("line_no"), F.col("l_partkey"), F.col("amount")], "place").withColumn("place", F.col("place").cast("long"))


@query("SELECT s_suppkey, s_name, s_nationkey FROM supplier WHERE s_acctbal > 0 ORDER BY s_suppkey")
def active_dimension(spark, d):
    return table(spark, d, "supplier").filter("s_acctbal > 0").select("s_suppkey", "s_name", "s_nationkey").orderBy("s_suppkey")


@query("SELECT event_id, event_type, c_name AS actor, CASE WHEN json_valid(props) THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k, props FROM events LEFT JOIN customer ON c_custkey = user_id")
def audit_detail(spark, d):
    """Every log row with its actor's name and its image, read where it is JSON; as text either way."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.try_variant_get(F.try_parse_json("props"), "$.k", "long").alias("k"), "props")
    return lists.with_names(e, "user_id", table(spark, d, "customer"), "c_custkey", {"c_name": "actor"}).drop("user_id")


@query(f"""WITH {FILES}, i AS (SELECT batch_id, line_no, l_partkey, unnest(list_filter([CASE WHEN score < 30 THEN 'LOW_SCORE' END, CASE WHEN status = 'FAILED' THEN 'FAILED_FILE' END, CASE WHEN amount > 50000 THEN 'LARGE' END], lambda x: x IS NOT NULL)) AS code FROM files),
  s AS (SELECT *, CASE code WHEN 'LARGE' THEN 'WARNING' ELSE 'ERROR' END AS severity FROM i) SELECT *, CASE code WHEN 'FAILED_FILE' THEN 'NEED_SUPPLEMENT' ELSE 'NEED_REVIEW' END AS result_status FROM s""")
def validation_rows(spark, d):
    """Issues as rows, errors first."""
    from ..operators import checks, validation

    found = validation.issues(validation.issue(F.col("amount") > 50000, "LARGE", "amount", "WARNING"), validation.issue(F.col("score") < 30, "LOW_SCORE", "score"), validation.issue(F.col("status") == "FAILED", "FAILED_FILE", "status", action="SUPPLEMENT"))
    rows = checks.issue_rows(files(spark, d).withColumn("found", found), ["batch_id", "line_no", "l_partkey"], "found")
    return rows.select("batch_id", "line_no", "l_partkey", "code", "severity", "result_status")


@query(f"""WITH {FACTS}, {_FIELDS}, v AS (SELECT batch_id, line_no, l_partkey, facts.key, coalesce(required, FALSE) AS required, CASE WHEN facts.key = 'status' AND value = 'QUEUED' THEN '' ELSE value END AS value, CASE WHEN facts.key = 'score' THEN CAST(value AS DOUBLE) / 100 END AS c FROM facts LEFT JOIN std ON std.key = facts.key),
  r AS (SELECT batch_id, line_no, l_partkey, count(*) AS n, count(CASE WHEN required AND coalesce(value, '') = '' THEN 1 END) AS missing, count(CASE WHEN coalesce(nullif(c, 0), 1) < 0.8 THEN 1 END) > 0 AS low FROM v GROUP BY 1, 2, 3)
  SELECT batch_id, line_no, l_partkey, missing + CAST(low AS INT) AS need_review, CASE WHEN missing + CAST(low AS INT) > 0 THEN 'NEED_REVIEW' ELSE 'NORMAL' END AS status, CASE WHEN missing + CAST(low AS INT) > 0 THEN 0 ELSE n END AS passed FROM r""")
def validation_on_demand(spark, d):
    """Every file's required values and confidences, checked anew."""
    from ..operators import checks

    v = lists.with_names(values(spark, d), "key", standard_fields(spark), "std_key", {"required": "required"})
    v = v.withColumns({"confidence": F.when(F.col("key") == "score", F.col("value").cast("double") / 100), "value": F.when((F.col("key") == "status") & (F.col("value") == "QUEUED"), "").otherwise(F.col("value"))})
    return checks.on_demand(v, ["batch_id", "line_no", "l_partkey"])


@query(f"WITH {FACTS}, {_FIELDS} SELECT DISTINCT std.key, label, data_type FROM std JOIN facts ON facts.key = std.key WHERE std.key IN ('shipped', 'status', 'other')")
def field_map(spark, d):
    """The standard fields of a list of keys that occur."""
    wanted = relational.where(standard_fields(spark), *relational.equals({"key": F.col("std_key")}, {"key": ["shipped", "status", "other"]}))
    used = values(spark, d).select("key").distinct()
    return wanted.join(used, F.col("std_key") == F.col("key"), "left_semi").select(F.col("std_key").alias("key"), "label", "data_type")


@query("""WITH roles(code, name) AS (VALUES ('FURNITURE', 'Manager'), ('BUILDING', 'Submitter'), ('MACHINERY', 'Auditor')) SELECT c_custkey, c_name, name AS role, n_name AS department, r_name AS site FROM customer JOIN roles ON code = c_mktsegment LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""")
def users_with_roles(spark, d):
    """Users who have a role, with the department and site that they may lack."""
    roles = inline(spark, [("FURNITURE", "Manager"), ("BUILDING", "Submitter"), ("MACHINERY", "Auditor")], "code string, role string")
    u = table(spark, d, "customer").join(roles, F.col("c_mktsegment") == F.col("code"))
    u = lists.with_names(u, "c_nationkey", table(spark, d, "nation"), "n_nationkey", {"n_name": "department", "n_regionkey": "_region"})
    return lists.with_names(u, "_region", table(spark, d, "region"), "r_regionkey", {"r_name": "site"}).select("c_custkey", "c_name", "role", "department", "site")


@query("""WITH last AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1) SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN c_mktsegment ELSE coalesce(CASE WHEN event_type <> 'view' THEN event_type END, c_mktsegment) END AS c_mktsegment FROM customer LEFT JOIN last ON user_id = c_custkey""")
def status_updates(spark, d):
    """Each user's last event sets the user's state, but a view sets none and locked users keep theirs."""
    last = table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("s"))
    new = last.select(F.col("user_id").alias("c_custkey"), F.when(F.col("s") != "view", F.col("s")).alias("c_mktsegment"))
    return lists.updated(table(spark, d, "customer"), "c_custkey", new, ["c_mktsegment"], unless=F.col("c_acctbal") < 0).select("c_custkey", "c_mktsegment")


@query("SELECT event_id, 'BATCH-' || strftime(ts, '%Y%m%d') || '-' || right(CAST(epoch_us(ts) // 1000 AS VARCHAR), 6) AS batch_no FROM events")
def batch_numbers(spark, d):
    return table(spark, d, "events").select("event_id", lists.batch_number(F.col("ts")).alias("batch_no"))


@query(f"""WITH {FILES}, n AS (SELECT batch_id, count(*) AS n, count(CASE WHEN status IN ('CONFIRMED', 'NORMAL') THEN 1 END) AS done FROM files GROUP BY 1), s AS (SELECT batch_id, n = done AS ready FROM n)
  SELECT 'document' AS part, batch_id, 'batch-' || batch_id || '.xlsx' AS name, 'DOWNLOADABLE' AS status FROM s WHERE ready UNION ALL SELECT 'batch', batch_id, NULL, CASE WHEN ready THEN 'GENERATED' ELSE 'NEED_REVIEW' END FROM s""")
def generate_documents(spark, d):
    """A document for every batch whose files are all finished, and the batches' states afterwards."""
    done = F.col("status").isin("CONFIRMED", "NORMAL")
    b = files(spark, d).groupBy("batch_id").agg(F.min(done).alias("ready")).withColumn("status", F.lit("NEED_REVIEW"))
    documents, after = lists.generated(b, F.col("ready"), F.concat(F.lit("batch-"), F.col("batch_id").cast("string"), F.lit(".xlsx")))
    one = documents.select(F.lit("document").alias("part"), "batch_id", F.col("file_name").alias("name"), "status")
    return one.unionAll(after.select(F.lit("batch").alias("part"), "batch_id", F.lit(None).cast("string").alias("name"), "status"))
