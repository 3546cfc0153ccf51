"""Live checks over line items read as extracted documents; evidence and text quality over texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks
from ..sources.scans import table
from .base import FILES, files

QUERIES = {}
#: An extracted document for every file: its facts follow from its keys so that every check meets both answers.
RECORDS = f"""{FILES}, rec AS (SELECT batch_id, line_no, l_partkey, l_partkey AS k, status AS file_status, CAST(floor(amount) AS DOUBLE) AS amount,
  CASE line_no % 5 WHEN 0 THEN 'ITEM_RECEIPT' WHEN 1 THEN 'TRANSPORT_RECEIPT' WHEN 2 THEN 'HANDWRITTEN_RECEIPT' ELSE 'RECEIPT' END AS document_type,
  CASE WHEN l_partkey % 13 = 0 THEN NULL WHEN l_partkey % 17 = 0 THEN 0 ELSE CAST(floor(amount) AS DOUBLE) END AS total,
  CASE WHEN l_partkey % 5 = 0 THEN CAST(floor(amount) AS DOUBLE) + (l_partkey % 3) * 100 END AS sale_total,
  CASE WHEN l_partkey % 7 = 0 THEN CAST(5000 AS DOUBLE) WHEN l_partkey % 3 <> 0 THEN CAST((l_partkey % 3) * 100 AS DOUBLE) END AS discount,
  CASE WHEN l_partkey % 11 <> 0 THEN CAST(shipped AS VARCHAR) END AS expense_date,
  CASE l_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '합계 매장' ELSE 'Shop' END AS vendor,
  CASE WHEN line_no % 2 = 0 THEN 'card' END AS payment_method,
  CASE l_partkey % 4 WHEN 0 THEN [] WHEN 1 THEN [('Item', CAST(floor(amount) AS DOUBLE))] WHEN 2 THEN [('', 1000.0::DOUBLE), ('포인트 1', NULL::DOUBLE)] ELSE [('A', CAST(floor(amount) AS DOUBLE)), ('B', CAST((l_partkey % 3) * 100 AS DOUBLE))] END AS items,
  CASE l_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS n_items,
  CASE l_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN CAST(floor(amount) AS DOUBLE) WHEN 2 THEN 1000 ELSE CAST(floor(amount) AS DOUBLE) + (l_partkey % 3) * 100 END AS item_sum,
  CASE WHEN l_partkey % 9 <> 0 THEN CAST(score * 10 + 5 AS DOUBLE) / 1000 END AS quality, CASE WHEN l_partkey % 10 <> 3 THEN CAST(70 + (l_partkey % 4) * 5 AS DOUBLE) / 100 END AS engine, CAST(50 + (l_partkey % 3) * 10 AS DOUBLE) / 100 AS text_quality,
  CAST(l_partkey % 6 AS INTEGER) AS n_amounts, l_partkey % 10 = 0 AS needs_review, l_partkey % 19 = 0 AS very_blurry, l_partkey % 8 = 0 AS blurry, l_partkey % 6 = 1 AS bad_vendor FROM files)"""
EXPECTED = "coalesce(sale_total, total + coalesce(discount, 0))"
KEYS = ("batch_id", "line_no", "l_partkey")


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def records(spark, d):
    k, line, amount = F.col("l_partkey"), F.col("line_no"), F.floor("amount").cast("double")
    extra = ((k % 3) * 100).cast("double")
    item = lambda name, value: F.struct(F.lit(name).alias("name"), value.cast("double").alias("amount"))
    none = F.lit(None).cast("double")
    return files(spark, d).select(
        *KEYS,
        F.when(line % 5 == 0, "ITEM_RECEIPT").when(line % 5 == 1, "TRANSPORT_RECEIPT").when(line % 5 == 2, "HANDWRITTEN_RECEIPT").otherwise("RECEIPT").alias("document_type"),
        F.when(k % 13 == 0, none).when(k % 17 == 0, 0.0).otherwise(amount).alias("total"),
        F.when(k % 5 == 0, amount + extra).alias("sale_total"),
        F.when(k % 7 == 0, 5000.0).when(k % 3 != 0, extra).alias("discount"),
        F.when(k % 11 != 0, F.col("shipped").cast("string")).alias("expense_date"),
        F.when(k % 6 == 0, None).when(k % 6 == 1, "합계 매장").otherwise("Shop").alias("vendor"),
        F.when(line % 2 == 0, "card").alias("payment_method"),
        F.when(k % 4 == 0, F.array().cast("array<struct<name:string,amount:double>>")).when(k % 4 == 1, F.array(item("Item", amount))).when(k % 4 == 2, F.array(item("", F.lit(1000)), item("포인트 1", none))).otherwise(F.array(item("A", amount), item("B", extra))).alias("items"),
        F.when(k % 9 != 0, (F.col("score") * 10 + 5) / 1000).alias("quality"),
        F.when(k % 10 != 3, (F.lit(70) + (k % 4) * 5) / 100).alias("engine"),
        ((F.lit(50) + (k % 3) * 10) / 100).alias("text_quality"),
        (k % 6).cast("int").alias("n_amounts"),
        (k % 10 == 0).alias("needs_review"),
        (k % 19 == 0).alias("very_blurry"),
        (k % 8 == 0).alias("blurry"),
        (k % 6 == 1).alias("bad_vendor"),
        (k % 6 == 1).alias("weak_vendor"),
        F.when(k % 14 == 0, F.array(F.lit("매우 흐림"))).when(k % 14 == 7, F.array(F.lit("저해상도"))).alias("image_issues"),
        F.when(k % 12 == 5, F.array(F.lit("total by guess"), F.lit(""))).alias("reasons"),
        F.when(k % 18 == 0, F.array(F.lit("Shop"))).alias("vendor_candidates"),
        F.when(k % 4 == 1, "MEAL").when(k % 4 == 2, "FUEL").alias("evidence"),
        F.when(k % 3 == 1, "meal ").alias("category"),
        F.when(k % 5 != 1, "Seoul").alias("departure"),
        F.when(k % 5 != 2, "Busan").alias("arrival"),
        F.when(k % 21 == 0, "max_money_fallback").alias("total_source"),
        F.when(k % 4 == 3, amount).when(k % 8 == 5, amount - 1).alias("receipt_amount"),
        F.when(k % 9 == 4, amount).alias("fare_amount"),
        F.when(k % 9 == 4, 100.0).when(k % 9 == 5, amount).alias("discount_amount_read"),
    )


def _given(*names: str):
    return {n: F.col(n) for n in names}


_FACTS = ("document_type", "total", "sale_total", "discount", "expense_date", "vendor", "payment_method", "items", "quality", "engine", "n_amounts", "needs_review", "very_blurry", "blurry", "bad_vendor", "departure", "arrival", "total_source")
_LIVE = ("weak_vendor", "text_quality", "image_issues", "reasons", "vendor_candidates", "evidence", "category", "receipt_amount", "fare_amount", "discount_amount_read")

# (condition in SQL, code) in the order of the checks
_CHECKS = [
    ("document_type = 'HANDWRITTEN_RECEIPT'", "HANDWRITTEN_RECEIPT_REVIEW"),
    ("expense_date IS NULL", "REQ_EXPENSE_DATE"),
    ("vendor IS NULL", "REQ_VENDOR_NAME"),
    ("vendor = '합계 매장'", "VENDOR_NAME_WEAK_OCR"),
    ("total IS NULL OR total <= 0", "REQ_TOTAL_AMOUNT"),
    ("k % 14 = 0 OR (k % 14 = 7 AND (coalesce(engine < 0.8, FALSE) OR text_quality < 0.62))", "OCR_INPUT_QUALITY_REVIEW"),
    ("engine < 0.78", "OCR_ENGINE_CONFIDENCE_LOW"),
    ("text_quality < 0.62", "OCR_TEXT_SEMANTIC_QUALITY_LOW"),
    ("vendor IS NULL AND k % 18 = 0", "VENDOR_CANDIDATE_NOT_CONFIRMED"),
    ("quality >= 0.9 AND engine < 0.8", "OCR_IMAGE_TEXT_CONFIDENCE_GAP"),
    ("k % 12 = 5", "PARSER_REVIEW_REQUIRED"),
    ("k % 3 = 1 AND k % 4 = 2", "CATEGORY_EVIDENCE_CONFLICT"),
    ("k % 4 = 2", "ITEM_NAME_EMPTY"),
    ("k % 4 = 2", "ITEM_NON_ITEM_KEYWORD"),
    ("document_type = 'ITEM_RECEIPT' AND n_items = 0", "ITEMS_EMPTY"),
    (f"n_items > 0 AND item_sum <> {EXPECTED}", "ITEM_SUM_TOTAL_MISMATCH"),
    ("discount <> 0 AND abs(sale_total - discount - total) > greatest(1, total * 0.01)", "SALE_DISCOUNT_PAID_MISMATCH"),
    ("document_type = 'TRANSPORT_RECEIPT' AND CASE WHEN k % 4 = 3 THEN amount WHEN k % 8 = 5 THEN amount - 1 END <> total", "TRANSPORT_RECEIPT_AMOUNT_MISMATCH"),
    ("document_type = 'TRANSPORT_RECEIPT' AND k % 9 = 4 AND total = amount", "TRANSPORT_FARE_USED_AS_TOTAL"),
    ("document_type = 'TRANSPORT_RECEIPT' AND CASE WHEN k % 9 = 4 THEN 100 WHEN k % 9 = 5 THEN amount END = total", "TRANSPORT_DISCOUNT_USED_AS_TOTAL"),
    ("document_type = 'TRANSPORT_RECEIPT' AND (k % 5 = 1 OR k % 5 = 2)", "TRANSPORT_ROUTE_UNCERTAIN"),
]
_CODES = ", ".join(f"CASE WHEN {c} THEN '{code}' END" for c, code in _CHECKS)


@query(f"WITH {RECORDS} SELECT batch_id, line_no, l_partkey, array_to_string(list_filter([{_CODES}], lambda x: x IS NOT NULL), ',') AS codes, CASE WHEN total IS NULL OR total <= 0 THEN 'NEED_SUPPLEMENT' WHEN len(list_filter([{_CODES}], lambda x: x IS NOT NULL)) > 0 THEN 'NEED_REVIEW' ELSE 'PASS' END AS verdict FROM rec")
def live_issues(spark, d):
    """Every document's issues, in the order of the checks, and what follows from them."""
    from ..operators import validation

    found = records(spark, d).withColumn("found", checks.live_issues(_given(*_FACTS, *_LIVE)))
    return found.select(*KEYS, F.array_join(F.transform("found", lambda x: x["code"]), ",").alias("codes"), validation.status(F.col("found")).alias("verdict"))


@query(f"""WITH {RECORDS}, s AS (SELECT *, 0.5 + CASE WHEN vendor IS NULL THEN 0 WHEN bad_vendor THEN -0.08 ELSE 0.1 END + CASE WHEN expense_date IS NOT NULL THEN 0.1 ELSE 0 END + CASE WHEN total IS NOT NULL THEN 0.12 ELSE 0 END + CASE WHEN line_no % 2 = 0 THEN 0.04 ELSE 0 END
    + CASE WHEN n_items = 0 THEN -0.1 WHEN {EXPECTED} IS NULL THEN 0.07 WHEN item_sum = {EXPECTED} THEN 0.15 ELSE -0.05 END + CASE WHEN quality IS NULL THEN 0 WHEN quality < 0.35 THEN -0.25 WHEN quality < 0.5 THEN -0.16 WHEN quality < 0.65 THEN -0.08 WHEN quality > 0.82 THEN 0.02 ELSE 0 END - CASE WHEN needs_review THEN 0.05 ELSE 0 END AS raw FROM rec),
  c AS (SELECT *, list_min(list_filter([CASE WHEN very_blurry THEN 0.35 WHEN blurry THEN 0.6 END, CASE WHEN document_type = 'HANDWRITTEN_RECEIPT' THEN CASE WHEN total IS NULL THEN 0.25 ELSE 0.35 END END, CASE WHEN n_items > 0 AND item_sum <> coalesce(sale_total, total) THEN 0.72 END,
    CASE WHEN n_amounts >= 3 AND n_items <= 1 THEN 0.7 END, CASE WHEN bad_vendor THEN 0.7 END, CASE WHEN total IS NULL THEN 0.3 END, CASE WHEN n_amounts >= 5 AND n_items <= 1 AND document_type <> 'TRANSPORT_RECEIPT' THEN 0.55 END, 0.99], lambda x: x IS NOT NULL)) AS cap FROM s)
  SELECT batch_id, line_no, l_partkey, CAST(greatest(0, least(raw, cap)) AS DOUBLE) AS confidence FROM c""")
def document_confidence(spark, d):
    return records(spark, d).select(*KEYS, checks.document_confidence(_given(*_FACTS)).alias("confidence"))


@query(f"""WITH {RECORDS} SELECT batch_id, line_no, l_partkey, CASE WHEN document_type = 'HANDWRITTEN_RECEIPT' OR needs_review OR very_blurry OR k % 4 = 2 OR coalesce(quality, 1) < 0.65 OR coalesce(engine, 1) < 0.82 OR (n_amounts >= 3 AND n_items <= 1) THEN FALSE ELSE TRUE END AS ok FROM rec""")
def auto_pass(spark, d):
    r = records(spark, d).withColumn("status", F.when(F.col("l_partkey") % 4 == 2, "NEED_REVIEW").otherwise("PASS"))
    return r.select(*KEYS, checks.passes(_given(*_FACTS, "status")).alias("ok"))


@query(f"""WITH {RECORDS}, w AS (SELECT *, CASE WHEN document_type = 'HANDWRITTEN_RECEIPT' THEN '수기 영수증: 텍스트 LLM 생략 후 검토' WHEN needs_review THEN '규칙 추출 결과에 검토 사유 존재' WHEN very_blurry OR quality < 0.65 THEN 'OCR 품질 낮음' WHEN engine < 0.82 THEN 'OCR 엔진 신뢰도 낮음'
    WHEN expense_date IS NULL THEN '필수 필드 누락: expense_date' WHEN vendor IS NULL THEN '필수 필드 누락: vendor_name' WHEN total IS NULL THEN '필수 필드 누락: total_amount' WHEN document_type = 'TRANSPORT_RECEIPT' AND k % 5 <> 1 AND k % 5 <> 2 THEN '교통 영수증 규칙 검증 충분' WHEN document_type = 'TRANSPORT_RECEIPT' THEN '교통 노선/금액 불확실'
    WHEN bad_vendor AND k % 2 = 0 THEN '사용처 후보 불확실' WHEN vendor LIKE '%합계%' THEN '사용처에 라벨/정산 문구 혼입' WHEN n_items = 0 THEN '품목 또는 총액 부족' WHEN n_amounts >= 3 AND n_items <= 1 THEN 'OCR 금액 후보 대비 상세 품목 부족' WHEN k % 21 = 0 THEN '총액 라벨 없는 최대금액 fallback'
    WHEN item_sum <> {EXPECTED} THEN '품목 합계와 기준금액 불일치' ELSE '규칙 추출 및 합계 검증 통과' END AS reason FROM rec)
  SELECT batch_id, line_no, l_partkey, reason, reason IN ('수기 영수증: 텍스트 LLM 생략 후 검토', '교통 영수증 규칙 검증 충분', '규칙 추출 및 합계 검증 통과') AS skip FROM w""")
def model_skips(spark, d):
    r = records(spark, d).withColumn("bad_vendor", F.col("bad_vendor") & (F.col("l_partkey") % 2 == 0))
    return r.withColumn("out", checks.skips_model(_given(*_FACTS))).select(*KEYS, "out.reason", "out.skip")


# Words for the query below; one category of those for which one word is enough.
WORDS = {"EN": ["the", "and", "tion", "ing"], "DE": ["sch", "ung", "heit", "keit", "über"], "FR": ["eau", "ique", "ment"], "TRANSPORT": ["ción"]}


def _sql_counts() -> str:
    parts = [f"SELECT doc_id, '{c}' AS code, {i} AS place, " + " + ".join(f"CAST(contains(c, '{w}') AS INT)" for w in ws) + " AS n FROM t" for i, (c, ws) in enumerate(WORDS.items())]
    return " UNION ALL ".join(parts)


@query(f"""WITH t AS (SELECT doc_id, lower(regexp_replace(coalesce(text, ''), '\\s+', '', 'g')) AS c FROM documents), s AS ({_sql_counts()}), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, place) AS spot, lead(n) OVER (PARTITION BY doc_id ORDER BY n DESC, place) AS nx FROM s)
  SELECT doc_id, n AS score, CASE WHEN (n >= 2 OR (n = 1 AND code = 'TRANSPORT')) AND (nx = 0 OR n - nx >= 2) THEN code END AS code FROM r WHERE spot = 1""")
def category_evidence(spark, d):
    e = checks.category_evidence(F.col("text"), WORDS)
    return table(spark, d, "documents").select("doc_id", e.alias("e")).select("doc_id", F.col("e.score").alias("score"), F.col("e.code").alias("code"))


@query(None)
def text_quality(spark, d):
    """Tested against a plain version: the oracle's expressions have no look-around."""
    return table(spark, d, "documents").select("doc_id", checks.text_quality(F.col("text")).alias("quality"))


# Names of items for the query below, good ones at 0 and 3.
NAMES = ("김치찌개", "합계 금액", "AB 12", "비닐봉투")
_GUARD = f"""{FILES}, it AS (SELECT o_orderkey AS doc, l_linenumber AS line_no, l_partkey, list_extract({list(NAMES)}, 1 + CAST(l_partkey % 4 AS INT)) AS name, l_partkey % 4 IN (1, 2) AS bad, CASE WHEN l_partkey % 10 = 3 THEN 50 WHEN l_partkey % 10 = 4 THEN NULL ELSE 1000 * (1 + l_partkey % 5) END AS amount,
    CASE WHEN l_partkey % 2 = 0 THEN 2 END AS quantity, CASE WHEN l_partkey % 8 = 0 THEN 500 * (1 + l_partkey % 5) WHEN l_partkey % 16 = 7 THEN 1 END AS unit_price FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderkey % 9 <> 4),
  v0 AS (SELECT doc, sum(amount) AS s FROM (SELECT DISTINCT doc, name, amount FROM it WHERE NOT bad AND amount >= 1000) GROUP BY 1),
  doc AS (SELECT o_orderkey AS doc, CASE WHEN o_orderkey % 8 = 0 THEN 'HANDWRITTEN' WHEN o_orderkey % 8 = 1 THEN 'TRANSPORT' ELSE 'RECEIPT' END AS kind, CASE WHEN o_orderkey % 6 = 0 THEN '결제' ELSE 'paid' END AS text, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 7 IN (1, 2) THEN 900 WHEN o_orderkey % 7 IN (3, 4) THEN coalesce(s, 5000) ELSE coalesce(s, 0) + 100 END AS total, o_orderkey % 6 AS n_amounts, o_orderkey % 11 = 0 AS money_false FROM orders LEFT JOIN v0 ON v0.doc = o_orderkey)"""


@query(f"""WITH {_GUARD}, j AS (SELECT it.*, total, NOT (bad OR coalesce(amount, 0) <= 0 OR (amount < 100 AND name <> '비닐봉투') OR coalesce(amount > greatest(total + 100, total * 1.05), FALSE) OR coalesce(abs(unit_price * coalesce(quantity, 1) - amount) > greatest(10, amount * 0.05), FALSE)) AS ok FROM it JOIN doc ON doc.doc = it.doc),
  u AS (SELECT doc, name, amount, min((line_no, name)) AS first FROM j WHERE ok GROUP BY 1, 2, 3), a AS (SELECT doc, count(*) AS n, sum(amount) AS s, min(first)[2] AS head FROM u GROUP BY 1), r AS (SELECT doc, count(*) AS rejected FROM j WHERE NOT ok GROUP BY 1),
  w AS (SELECT doc.*, coalesce(n, 0) AS n, s, head, coalesce(rejected, 0) AS rejected, CASE WHEN kind = 'HANDWRITTEN' THEN 'HANDWRITTEN_REVIEW_ONLY' WHEN kind = 'TRANSPORT' THEN NULL WHEN n > 0 AND s <> total THEN 'UNCONFIRMED_SUM_MISMATCH' WHEN n_amounts >= 5 AND coalesce(n, 0) <= 1 THEN 'UNCONFIRMED_TOO_FEW_ITEMS' WHEN n > 0 THEN 'CONFIRMED' WHEN rejected > 0 THEN 'UNCONFIRMED_ALL_REJECTED' END AS state
    FROM doc LEFT JOIN a ON a.doc = doc.doc LEFT JOIN r ON r.doc = doc.doc),
  x AS (SELECT *, (state IS NULL AND kind <> 'TRANSPORT') OR coalesce(state IN ('CONFIRMED', 'UNCONFIRMED_ALL_REJECTED'), FALSE) AS goes_on FROM w), y AS (SELECT *, coalesce(goes_on AND total < 1000 AND text = '결제', FALSE) AS odd, coalesce(kind = 'HANDWRITTEN' AND total < 1000, FALSE) AS lost FROM x)
  SELECT doc, state, CASE WHEN state = 'CONFIRMED' THEN n ELSE 0 END AS confirmed, rejected, CAST(s AS DOUBLE) AS item_sum, CAST(CASE WHEN NOT odd AND NOT lost THEN total END AS DOUBLE) AS total, CAST(CASE WHEN lost THEN total * 1000 END AS DOUBLE) AS estimated_total, CAST(CASE WHEN odd THEN total END AS DOUBLE) AS suspicious_total,
    CAST(least(1, CASE WHEN kind = 'HANDWRITTEN' THEN CASE WHEN total IS NULL OR lost THEN 0.25 ELSE 0.35 END END, CASE WHEN state = 'UNCONFIRMED_SUM_MISMATCH' THEN CASE WHEN abs(s - total) / greatest(total, 1) >= 0.1 THEN 0.55 ELSE 0.68 END END, CASE state WHEN 'UNCONFIRMED_TOO_FEW_ITEMS' THEN 0.45 WHEN 'UNCONFIRMED_ALL_REJECTED' THEN 0.3 END, CASE WHEN odd THEN 0.25 END, CASE WHEN goes_on AND money_false THEN 0.3 END) AS DOUBLE) AS cap,
    CASE WHEN kind = 'HANDWRITTEN' THEN '수기 영수증 검토 필요' WHEN state = 'CONFIRMED' THEN CASE WHEN n = 1 THEN head ELSE head || ' 외 ' || (n - 1) || '건' END WHEN state IS NOT NULL THEN '상세 품목 검토 필요' END AS description FROM y""")
def guarded_documents(spark, d):
    """What stays confirmed of documents whose totals may or may not agree with their items."""
    from ..operators import guards

    k, o = F.col("l_partkey"), F.col("o_orderkey")
    name = F.element_at(F.array(*[F.lit(x) for x in NAMES]), (k % 4 + 1).cast("int"))
    whole = ((k % 5 + 1) * 1000).cast("double")
    items = table(spark, d, "lineitem").filter(F.col("l_orderkey") % 9 != 4).select(
        F.col("l_orderkey").alias("doc"),
        F.col("l_linenumber").alias("line_no"),
        name.alias("name"),
        F.when(k % 10 == 3, 50.0).when(k % 10 == 4, None).otherwise(whole).alias("amount"),
        F.when(k % 2 == 0, 2.0).alias("quantity"),
        F.when(k % 8 == 0, whole / 2).when(k % 16 == 7, 1.0).alias("unit_price"),
    )
    sums = items.filter(F.col("name").isin(NAMES[0], NAMES[3]) & (F.col("amount") >= 1000)).select("doc", "name", "amount").distinct().groupBy("doc").agg(F.sum("amount").alias("s"))
    docs = table(spark, d, "orders").select(o.alias("doc")).join(sums, "doc", "left")
    o = F.col("doc")
    m = o % 7
    docs = docs.select(
        "doc",
        F.when(o % 8 == 0, "HANDWRITTEN").when(o % 8 == 1, "TRANSPORT").otherwise("RECEIPT").alias("document_type"),
        F.when(o % 6 == 0, "결제").otherwise("paid").alias("text"),
        F.when(m == 0, None).when(m.isin(1, 2), 900.0).when(m.isin(3, 4), F.coalesce("s", F.lit(5000.0))).otherwise(F.coalesce("s", F.lit(0.0)) + 100).alias("total"),
        F.lit(None).cast("double").alias("sale_total"),
        F.lit(None).cast("double").alias("discount"),
        (o % 6).alias("n_amounts"),
        (o % 11 == 0).alias("money_false"),
        F.lit(None).cast("double").alias("cap"),
    )
    return guards.guarded(docs, items, "doc")


@query(None)
def likely_dates(spark, d):
    """Tested against written examples: no SQL of the oracle gives all places of a pattern."""
    from ..operators import guards
    from .base import AS_OF

    return table(spark, d, "documents").select("doc_id", guards.likely_date(F.col("text"), AS_OF).alias("day"))
