"""Single rules over the driver's tables: amounts in text, totals, cells, summaries, progress, presets, staging."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import money, receipts, text
from ..operators import changes, extraction, facts, lists, relational, spreadsheet
from ..sources.scans import by_key, columns_of, inline, staged, table
from .base import FILES, files
from .documents import LINES

QUERIES = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 7 LIMIT 1")
def point_lookup(spark, d):
    return by_key(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 7)


@query("SELECT user_id, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1")
def staged_actions(spark, d):
    """A staged set, used by name and gone afterwards."""
    pairs = table(spark, d, "events").select("user_id", "event_type").distinct()
    return staged(spark, pairs, lambda name: spark.sql(f"SELECT user_id, count(*) AS n FROM {name} GROUP BY user_id"))


@query("SELECT column_name AS name, CAST(ordinal_position AS BIGINT) AS place FROM information_schema.columns WHERE table_name = 'lineitem'")
def table_columns(spark, d):
    return columns_of(spark, table(spark, d, "lineitem"))


@query("""SELECT o_orderkey, o_orderstatus FROM orders WHERE upper(o_orderstatus) IN ('F', 'P') AND length(trim(o_orderstatus)) <= 1""")
def short_codes(spark, d):
    c = F.col("o_orderstatus")
    return table(spark, d, "orders").filter(F.upper(c).isin("F", "P") & (F.length(F.trim(c)) <= 1)).select("o_orderkey", "o_orderstatus")


@query(f"""WITH {FILES}, e AS (SELECT *, CASE WHEN line_no % 2 = 0 THEN 'error ' || line_no END AS error FROM files) SELECT batch_id, line_no, l_partkey, CASE status WHEN 'NEED_REVIEW' THEN coalesce(error, '검토가 필요한 항목입니다.') WHEN 'NEED_SUPPLEMENT' THEN coalesce(error, '증빙 보완이 필요한 항목입니다.')
  WHEN 'FAILED' THEN coalesce(error, '처리 중 오류가 발생했습니다.') WHEN 'QUEUED' THEN 'AI 처리 대기 중입니다.' WHEN 'NORMAL' THEN coalesce(NULL, '정상 처리되었습니다.') ELSE '확정 완료되었습니다.' END AS message FROM e""")
def status_messages(spark, d):
    f = files(spark, d).withColumn("error", F.when(F.col("line_no") % 2 == 0, F.concat(F.lit("error "), F.col("line_no").cast("string"))))
    return f.select("batch_id", "line_no", "l_partkey", receipts.status_message(F.col("status"), F.col("error")).alias("message"))


@query("""WITH a AS (SELECT c_custkey, CAST(floor(abs(c_acctbal)) AS BIGINT) AS v, CASE c_custkey % 5 WHEN 0 THEN CAST(floor(abs(c_acctbal)) AS BIGINT) || '원' WHEN 1 THEN '₩ ' || format('{:,}', CAST(floor(abs(c_acctbal)) AS BIGINT)) WHEN 2 THEN 'about' WHEN 3 THEN '' ELSE NULL END AS t FROM customer)
  SELECT c_custkey, CAST(CASE WHEN c_custkey % 5 < 2 THEN v ELSE 0 END AS DOUBLE) AS parsed, CAST(CASE WHEN c_custkey % 5 < 2 THEN v ELSE 0 END AS DOUBLE) AS digits, format('{:,}', v) || '원' AS won, CAST(least(5000, greatest(100, v)) AS BIGINT) AS clamped FROM a""")
def written_amounts(spark, d):
    """Amounts as they are written in texts; what is no number counts 0."""
    k, v = F.col("c_custkey"), F.floor(F.abs("c_acctbal")).cast("long")
    t = F.when(k % 5 == 0, F.concat(v.cast("string"), F.lit("원"))).when(k % 5 == 1, F.concat(F.lit("₩ "), F.format_number(v, 0))).when(k % 5 == 2, "about").when(k % 5 == 3, "")
    c = table(spark, d, "customer").select("c_custkey", v.alias("v"), t.alias("t"))
    return c.select("c_custkey", money.parsed_amount(F.col("t")).alias("parsed"), money.digits_amount(F.col("t")).alias("digits"), money.won(F.col("v")).alias("won"), money.clamped(F.col("v"), 100, 5000).cast("long").alias("clamped"))


@query("""WITH t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size || '.' || lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') WHEN 1 THEN p_size || '.5' WHEN 2 THEN '1,' || lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') || '.25' ELSE ' ' || p_name || ' ' END AS t FROM part)
  SELECT p_partkey, CASE WHEN regexp_matches(t, '^[0-9]{1,3}\\.[0-9]{3}$') THEN replace(t, '.', '') ELSE t END AS dotted, CASE WHEN regexp_matches(trim(t), '^-?[0-9]+(,[0-9]{3})*(\\.[0-9]+)?$') THEN TRY_CAST(replace(t, ',', '') AS DOUBLE) END AS number, CASE WHEN p_partkey % 4 = 3 THEN trim(t) END AS text FROM t""")
def cell_values(spark, d):
    """What a text becomes in a cell: a number where it is one."""
    k, tail = F.col("p_partkey"), F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0")
    size = F.col("p_size").cast("string")
    t = F.when(k % 4 == 0, F.concat(size, F.lit("."), tail)).when(k % 4 == 1, F.concat(size, F.lit(".5"))).when(k % 4 == 2, F.concat(F.lit("1,"), tail, F.lit(".25"))).otherwise(F.concat(F.lit(" "), F.col("p_name"), F.lit(" ")))
    p = table(spark, d, "part").select("p_partkey", t.alias("t")).withColumn("c", receipts.cell_value(F.col("t")))
    return p.select("p_partkey", money.dotted_thousands(F.col("t")).alias("dotted"), F.col("c.number").alias("number"), F.col("c.text").alias("text"))


_REPAIR = """r AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(floor(l_extendedprice) AS DOUBLE) AS v, l_partkey % 6 AS m FROM lineitem),
  s AS (SELECT *, CASE m WHEN 0 THEN NULL WHEN 1 THEN v + 800 WHEN 5 THEN v * 2 ELSE v + 90000 END AS total, CASE WHEN m >= 4 THEN 'max_money_fallback' ELSE 'label' END AS source, CASE WHEN m IN (3, 0) THEN 0 ELSE v END AS items, CASE WHEN m < 4 AND l_linenumber % 2 = 0 THEN v - 500 END AS supply, 500 AS tax FROM r)"""


@query(f"""WITH {_REPAIR}, t AS (SELECT *, supply + tax AS taxed FROM s), a AS (SELECT *, coalesce(items > 0 AND abs(items - taxed) <= greatest(10, taxed * 0.01), FALSE) AS agree FROM t),
  w AS (SELECT *, CASE WHEN agree AND total IS NULL THEN 'item_sum_matches_supply_tax' WHEN agree AND abs(total - items) <= greatest(1000, items * 0.04) THEN 'corrected_by_item_sum_and_supply_tax' WHEN taxed IS NOT NULL AND total IS NULL THEN 'supply_tax_sum' WHEN abs(total - taxed) <= greatest(1200, taxed * 0.05) THEN 'corrected_by_supply_tax_sum'
    WHEN items > 0 AND source = 'max_money_fallback' AND (total IS NULL OR total > items * 1.3) THEN 'corrected_by_item_sum_from_bad_max_fallback' ELSE source END AS why FROM a)
  SELECT l_orderkey, l_linenumber, l_partkey, why, CASE WHEN why LIKE '%item_sum%' THEN items WHEN why LIKE '%supply_tax%' THEN taxed ELSE total END AS total FROM w""")
def repaired_totals(spark, d):
    """Totals that supply and tax or the items' sum correct."""
    m, v, line = F.col("l_partkey") % 6, F.floor("l_extendedprice").cast("double"), F.col("l_linenumber")
    r = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.when(m == 1, v + 800).when(m == 5, v * 2).when(m != 0, v + 90000).alias("total"),
        F.when(m >= 4, "max_money_fallback").otherwise("label").alias("source"),
        F.when(m.isin(0, 3), 0.0).otherwise(v).alias("items"),
        F.when((m < 4) & (line % 2 == 0), v - 500).alias("supply"),
    )
    out = receipts.repaired_total(F.col("total"), F.col("source"), F.col("items"), F.col("supply"), F.lit(500.0))
    return r.withColumn("o", out).select("l_orderkey", "l_linenumber", "l_partkey", F.col("o.source").alias("why"), F.col("o.total").alias("total"))


@query(f"""WITH {FILES}, n AS (SELECT batch_id, count(*) AS total, count(CASE WHEN status IN ('CONFIRMED', 'NEED_SUPPLEMENT', 'FAILED') THEN 1 END) AS final, count(CASE WHEN status IN ('NEED_REVIEW', 'QUEUED') THEN 1 END) AS blocking FROM files GROUP BY 1)
  SELECT batch_id, total, final, CAST(floor(final * 100.0 / total + 0.5) AS BIGINT) AS percent, blocking, blocking = 0 AS can_complete FROM n""")
def batch_progress(spark, d):
    """How far each batch is, and whether it can be completed."""
    return lists.progress(files(spark, d), ["batch_id"])


@query(f"WITH {FILES} SELECT status, round(avg(CASE WHEN score <= 1 THEN round(score * 100) ELSE score END)) AS mean_percent, round(avg(CASE WHEN score / 60 BETWEEN 0 AND 1 THEN score / 60 END), 4) AS mean_share FROM files GROUP BY 1")
def mean_confidence(spark, d):
    f = files(spark, d)
    return f.groupBy("status").agg(F.round(F.avg(money.percent(F.col("score")))).alias("mean_percent"), receipts.mean_share(F.col("score") / 60).alias("mean_share"))


@query(f"""WITH {FILES} SELECT 'admin' AS role, count(*) AS n, count(CASE WHEN status = 'FAILED' THEN 1 END) AS open FROM files UNION ALL SELECT 'reviewer', count(CASE WHEN status IN ('NEED_REVIEW', 'NORMAL') THEN 1 END), count(CASE WHEN status = 'NEED_REVIEW' THEN 1 END) FROM files UNION ALL SELECT 'submitter', count(*), count(CASE WHEN status = 'NEED_SUPPLEMENT' THEN 1 END) FROM files""")
def role_dashboards(spark, d):
    """What each role sees and what waits for it: one aggregate over the files."""
    roles = {"admin": (None, ["FAILED"]), "reviewer": (["NEED_REVIEW", "NORMAL"], ["NEED_REVIEW"]), "submitter": (None, ["NEED_SUPPLEMENT"])}
    return lists.dashboards(files(spark, d), roles)


_PRESET = "preset(key, label, sort_order, advanced) AS (VALUES ('o_orderdate', 'Day', 1, 'N'), ('o_totalprice', 'Total', 2, 'N'), ('o_custkey', NULL, 3, 'Y'))"


@query(f"""WITH {_PRESET}, base AS (SELECT unnest(['o_orderkey', 'o_custkey', 'o_totalprice', 'o_orderdate']) AS key, unnest([4, 5, 6, 7]) AS own_order), u AS (SELECT count(*) AS n FROM orders)
  SELECT base.key, coalesce(label, base.key) AS label, coalesce(sort_order, own_order) AS sort_order, coalesce(advanced, 'N') AS advanced, CASE WHEN base.key LIKE '%date%' THEN 'DATE' ELSE 'ETC' END AS field_group FROM base LEFT JOIN preset ON preset.key = base.key, u WHERE n > 0 AND coalesce(advanced, 'N') <> 'Y'""")
def preset_fields(spark, d):
    """Fields with a document type's preset laid over them, in its order, without advanced ones."""
    names = [("o_orderkey", 4), ("o_custkey", 5), ("o_totalprice", 6), ("o_orderdate", 7)]
    known = table(spark, d, "orders").columns
    base = inline(spark, [x for x in names if x[0] in known], "key string, own_order int")
    preset = inline(spark, [("o_orderdate", "Day", 1, "N"), ("o_totalprice", "Total", 2, "N"), ("o_custkey", None, 3, "Y")], "key string, label string, sort_order int, advanced string")
    return lists.with_preset(base, preset).withColumn("field_group", text.field_group(F.col("key"))).select("key", "label", "sort_order", "advanced", "field_group")


@query("""WITH types(id, code, name) AS (VALUES (1, 'purchase', 'click'), (2, 'click', 'view'), (3, 'view', 'click'), (4, 'error', 'purchase')), w AS (SELECT DISTINCT event_type AS word FROM events),
  m AS (SELECT word, id, row_number() OVER (PARTITION BY word ORDER BY CASE WHEN code = word THEN 1 ELSE 0 END, id) AS r FROM w JOIN types ON code = word OR name = word) SELECT word, id FROM m WHERE r = 1""")
def code_or_name(spark, d):
    """The row that has a word as code or name; the exact code comes last, as it does today."""
    types = inline(spark, [(1, "purchase", "click"), (2, "click", "view"), (3, "view", "click"), (4, "error", "purchase")], "id int, code string, name string")
    words = table(spark, d, "events").select(F.col("event_type").alias("word")).distinct()
    return relational.by_code_or_name(words, "word", types, "id").select("word", "id")


@query("""WITH w AS (SELECT user_id, list(DISTINCT event_type ORDER BY event_type) AS c FROM events GROUP BY 1) SELECT user_id, array_to_string(list_sort(CASE WHEN list_has_all(c, ['click', 'view']) THEN list_filter(c, lambda x: x NOT IN ('click', 'view')) ELSE list_distinct(list_concat(c, ['click', 'view'])) END), ',') AS chosen FROM w""")
def toggled_sets(spark, d):
    w = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("c"))
    out = receipts.toggled(F.col("c"), F.array(F.lit("click"), F.lit("view")))
    return w.select("user_id", F.array_join(F.array_sort(out), ",").alias("chosen"))


@query(f"WITH {LINES}, p AS (SELECT doc_id, line_no, line, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM k) SELECT doc_id, line_no, md5(before) AS before FROM p WHERE contains(line, '@')")
def line_before(spark, d):
    """Of each line with an address the line before it."""
    rows = extraction.line_before(extraction.lines(table(spark, d, "documents"), "doc_id"), "doc_id").filter(F.contains("line", F.lit("@")))
    return rows.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.md5("before").alias("before"))


@query("""WITH n AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS votes FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, day DESC) AS r FROM n) SELECT user_id, day, votes AS n FROM r WHERE r = 1""")
def consensus_day(spark, d):
    """The day that most of a user's events name, the latest of equals."""
    return relational.mode(table(spark, d, "events").select("user_id", F.to_date("ts").alias("day")), ["user_id"], "day")


@query("""WITH o AS (SELECT l_orderkey, count(*) AS n, string_agg(DISTINCT p_name, '||' ORDER BY p_name) AS names FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1), s AS (SELECT *, string_split(names, '||') AS x FROM o)
  SELECT l_orderkey, x[1] AS first_name, array_to_string(x[1:3], ',') AS head, CASE WHEN len(x) >= 2 THEN x[1] || ' 외 ' || (len(x) - 1) || '건' ELSE x[1] END AS summary FROM s""")
def item_summaries(spark, d):
    """Each order's item names: the first, the first three, and the first with how many more."""
    l = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, d, "part").select("p_partkey", "p_name"), F.col("p_partkey") == F.col("l_partkey"))  # noqa: E741
    names = l.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("p_name")).alias("x"))
    return names.select("l_orderkey", F.substring_index(F.array_join("x", "||"), "||", 1).alias("first_name"), F.array_join(F.slice("x", 1, 3), ",").alias("head"), receipts.item_summary(F.col("x"), F.lit("-")).alias("summary"))


@query(f"""WITH {FILES}, b AS (SELECT batch_id, count(*) AS files, count(CASE WHEN status IN ('UPLOADED', 'EXTRACTING', 'FAILED', 'NEED_SUPPLEMENT') THEN 1 END) AS blocked FROM files GROUP BY 1) SELECT batch_id, blocked, blocked = 0 AS ready FROM b""")
def export_gate(spark, d):
    return spreadsheet.ready(files(spark, d), "batch_id")


_CELLS = "mp(key, sheet, row, col) AS (VALUES ('o_totalprice', 'S1', 2, 3), ('o_orderstatus', 'S1', 3, 3), ('o_orderpriority', 'S2', 1, 1))"


@query(f"""WITH {_CELLS}, h AS (SELECT o_orderkey AS document, unnest(['o_orderstatus', 'o_orderpriority']) AS key, unnest([o_orderstatus, o_orderpriority]) AS value FROM orders) SELECT document, sheet, row, col, value FROM h JOIN mp ON mp.key = h.key""")
def head_cells(spark, d):
    """Single values at their cells."""
    mappings = inline(spark, [("o_totalprice", "S1", 2, 3), ("o_orderstatus", "S1", 3, 3), ("o_orderpriority", "S2", 1, 1)], "field_key string, sheet string, row int, col int")
    o = table(spark, d, "orders").withColumn("document", F.col("o_orderkey"))
    return spreadsheet.single_cells(facts.melted(o, ["document"], ["o_orderstatus", "o_orderpriority"]), mappings)


@query("""WITH f AS (SELECT l_orderkey AS document, l_linenumber, l_partkey, l_returnflag, l_linestatus, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem)
  SELECT document, 'S1' AS sheet, CAST(10 + k - 1 AS BIGINT) AS row, 2 AS col, l_returnflag AS value FROM f WHERE k <= 4 UNION ALL SELECT document, 'S1', CAST(10 + k - 1 AS BIGINT), 27, l_linestatus FROM f WHERE k <= 4 UNION ALL SELECT document, 'S2', CAST(5 + k - 1 AS BIGINT), 1, l_linestatus FROM f WHERE k <= 9""")
def line_cells(spark, d):
    """Lines in their columns; columns of one sheet and start share the smallest room."""
    l = relational.renumbered(table(spark, d, "lineitem"), ["l_orderkey"], [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")], "k")  # noqa: E741
    long = facts.melted(l.select(F.col("l_orderkey").alias("document"), F.col("k").cast("long").alias("line_no"), "l_returnflag", "l_linestatus"), ["document", "line_no"], ["l_returnflag", "l_linestatus"])
    mappings = inline(spark, [("l_returnflag", "S1", "B", 10, 4), ("l_linestatus", "S1", "AA", 10, 8), ("l_linestatus", "S2", "A", 5, 9)], "field_key string, sheet string, column_letter string, start_row int, max_rows int")
    return spreadsheet.repeat_cells(long, mappings).select("document", "sheet", F.col("row").cast("long").alias("row"), "col", "value")


@query("""SELECT c_custkey, '{"c_mktsegment":"' || c_mktsegment || '"}' AS before_data, '{"c_mktsegment":"X"}' AS after_data FROM customer WHERE c_acctbal < 1000""")
def change_images(spark, d):
    """Before and after images of the customers whose segment changes."""
    c = table(spark, d, "customer")
    after = c.withColumn("c_mktsegment", F.when(F.col("c_acctbal") < 1000, "X").otherwise(F.col("c_mktsegment")))
    return changes.images(c, after, ["c_custkey"], ["c_mktsegment"])


@query("SELECT o_orderkey, o_orderstatus, CASE o_orderstatus WHEN 'F' THEN 'APPROVED' WHEN 'O' THEN 'PENDING' ELSE 'DISABLED' END AS image FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW')")
def status_images(spark, d):
    o = table(spark, d, "orders").filter(relational.not_in(F.col("o_orderpriority"), ["1-URGENT", "5-LOW"])).withColumn("status", F.col("o_orderstatus"))
    return o.select("o_orderkey", "o_orderstatus", changes.status_image({"F": "APPROVED", "O": "PENDING"}, "DISABLED").alias("image"))


@query("""WITH v AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'final' END AS f, CASE WHEN o_orderkey % 3 = 0 THEN 'modified' END AS m, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'normal' END AS n, 'read' AS e FROM orders)
  SELECT o_orderkey, coalesce(f, m, n, e) AS report, coalesce(m, f, n, e) AS export, coalesce(nullif(f, ''), nullif(n, ''), e) AS review FROM v""")
def resolved_values(spark, d):
    """One value for each of its three uses; blanks count in two of them."""
    k = F.col("o_orderkey")
    v = table(spark, d, "orders").select("o_orderkey", F.when(k % 2 == 0, "final").alias("final_value"), F.when(k % 3 == 0, "modified").alias("modified_value"), F.when(k % 5 == 0, "").otherwise("normal").alias("normalized_value"), F.lit("read").alias("extracted_value"))
    return v.select("o_orderkey", facts.resolved("report").alias("report"), facts.resolved("export").alias("export"), facts.resolved("review", blanks_count=False).alias("review"))


@query("""WITH o AS (SELECT r_name AS site, CAST(o_orderdate AS DATE) AS day, o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)
  SELECT * FROM (SELECT site, day, o_orderkey FROM o ORDER BY CASE site WHEN 'EUROPE' THEN 1 WHEN 'ASIA' THEN 2 ELSE 3 END, site, day DESC, o_orderkey LIMIT 100)""")
def grouped_order(spark, d):
    """The first 100 orders by the sites' own order, then the latest day."""
    from .lists import batches

    b = batches(spark, d).filter("site IS NOT NULL").select("site", "day", F.col("batch_id").alias("o_orderkey"))
    first = F.when(F.col("site") == "EUROPE", 1).when(F.col("site") == "ASIA", 2).otherwise(3)
    return b.orderBy(first, "site", F.desc("day"), "o_orderkey").limit(100)
