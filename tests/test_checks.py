"""Live checks and lists against plain versions and at their edges."""

import re

from pyspark.sql import functions as F

from tallyspark.operators import checks, lists, validation


def plain_quality(text):
    lines = [x for x in (re.sub(r"\s+", " ", r.strip()) for r in (text or "").splitlines()) if x]
    if not lines:
        return 0.0
    short = 0
    for line in lines:
        c = re.sub(r"\s+", "", line)
        letters, digits = len(re.findall("[가-힣A-Za-z]", c)), len(re.findall("[0-9]", c))
        if len(c) <= 2 or (digits >= 4 and letters <= 1 and not re.search(r"[,.]\d{3}|원|합계|금액|결제|판매|영수|운임", c)) or letters == digits == 0:
            short += 1
    whole, share = "\n".join(lines), short / len(lines)
    score = 0.45
    score += 0.15 * (len(re.findall(r"(?<![0-9])(?:[0-9]{1,3}(?:[,.][0-9]{3})+|[0-9]{4,7})\s*원?(?![0-9])", whole)) >= 2)
    score += 0.12 * (len(re.findall(r"20[0-9]{2}[-./년\s]*[0-9]{1,2}[-./월\s]*[0-9]{1,2}", whole)) >= 1)
    score += 0.12 * (sum(w in whole for w in checks.RECEIPT_WORDS) >= 3)
    score += 0.08 * (len(re.findall("[가-힣]", whole)) >= 20) + 0.04 * (len(re.findall("[0-9]", whole)) >= 20)
    score -= 0.2 if share > 0.45 else 0.1 if share > 0.3 else 0
    return round(min(1.0, max(0.0, score)), 4)


RECEIPT = "영수증\n상품명 수량 단가 금액\n김치찌개 2 9,000 18,000원\n공기밥 1 1.000\n2024-03-05 12:30\n카드 승인 1234567890123456\n합계 19,000 감사합니다 또 오십시오"


def test_text_quality(spark):
    texts = [None, "", " \n\t\n", "a", "ab\n1\n--\n12345", RECEIPT, "1234\n5678\n9,000\n!!\n?", "1,234,5678 12.900원\r\n2024년 3월 5일\x0bline next 20240305", "x" * 300_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", checks.text_quality(F.col("text"))).collect()
    assert {r[0]: r[1] for r in rows} == {i: plain_quality(t) for i, t in enumerate(texts)}


def test_a_text_is_split_once(spark):
    """Written out wherever it is used, the split would be worked out dozens of times for each text."""
    plan = spark.createDataFrame([("a\r\nb",)], "text string").select(checks.text_quality(F.col("text")).alias("q"))
    assert plan._jdf.queryExecution().analyzed().toString().count("split(") == 1


def test_text_quality_of_documents(spark):
    from tallyspark import plans

    d = "/root/testdata/sf0.001"
    want = {r.doc_id: plain_quality(r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert {r.doc_id: r.quality for r in plans.QUERIES["text_quality"](spark, d).collect()} == want


def test_category_evidence(spark):
    texts = {"김치전 막걸리 소주": ("MEAL", 4), "K T X": ("TRANSPORT", 1), "호텔": ("LODGING", 1), "배관": (None, 1), "택시 호텔": (None, 1), "주유 경유 휘발유 커피": ("FUEL", 3), "": (None, 0), None: (None, 0), "탕": (None, 0), "두부김치 버스": (None, 2)}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", checks.category_evidence(F.col("t")).alias("e")).collect()
    assert {r.t: (r.e.code, r.e.score) for r in rows} == texts


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_no_facts(spark):
    """A document without any fact asks for a supplement, has little confidence, and goes to the model."""
    found = checks.live_issues({})
    assert one(spark, F.transform(found, lambda x: x["code"])) == ["REQ_EXPENSE_DATE", "REQ_VENDOR_NAME", "REQ_TOTAL_AMOUNT"]
    assert one(spark, validation.status(found)) == "NEED_SUPPLEMENT"
    assert one(spark, checks.document_confidence({})) == 0.3
    assert one(spark, checks.passes({})) is False
    assert one(spark, checks.passes({"status": F.lit("PASS")})) is True
    assert one(spark, checks.skips_model({})).reason == "필수 필드 누락: expense_date"


def test_forced(spark):
    for forced, needed, want in [(True, True, "강제 LLM 생략"), (False, True, "강제 LLM 사용"), (None, False, "환경설정상 LLM 항상 사용")]:
        assert one(spark, checks.skips_model({}, forced, needed)).reason == want


def test_strict_caps(spark):
    base = {"total": F.lit(100.0), "vendor": F.lit("Shop"), "expense_date": F.lit("2024-01-01"), "payment_method": F.lit("card"), "items": F.array(F.struct(F.lit("a").alias("name"), F.lit(100.0).alias("amount")))}
    cap = lambda **more: one(spark, checks.document_confidence(base | more))
    assert cap() == 0.99
    assert cap(item_state=F.lit("UNCONFIRMED_SUM")) == 0.55
    assert cap(item_state=F.lit("UNCONFIRMED_SUM"), candidate_sum=F.lit(100.0)) == 0.72
    assert cap(item_state=F.lit("HANDWRITTEN_REVIEW_ONLY")) == 0.35
    assert cap(small=F.lit(True)) == 0.85 and cap(small=F.lit(True), handwritten=F.lit(True)) == 0.25
    assert cap(money_false=F.lit(True)) == 0.3 and cap(vendor_like_item=F.lit(True)) == 0.4 and cap(strict_cap=F.lit(0.1)) == 0.1
    assert cap(dark=F.lit(True)) == 0.75 and cap(n_dates=F.lit(2)) == 0.8 and cap(n_amounts=F.lit(5)) == 0.55
    assert cap(n_amounts=F.lit(5), document_type=F.lit("TRANSPORT_RECEIPT")) == 0.7


def test_issue_rows_puts_errors_first(spark):
    found = validation.issues(validation.issue(F.lit(True), "W", "a", "WARNING"), validation.issue(F.lit(True), "E", "b", action="SUPPLEMENT"), validation.issue(F.lit(None), "N", "c"))
    df = spark.range(2).withColumn("found", F.when(F.col("id") == 0, found))
    assert [(r.id, r.place, r.code, r.result_status) for r in checks.issue_rows(df, ["id"], "found").orderBy("place").collect()] == [(0, 1, "E", "NEED_SUPPLEMENT"), (0, 2, "W", "NEED_REVIEW")]


def test_top_evidence(spark):
    rows = [(1, "MEAL", 3), (1, "FUEL", 1), (2, "MEAL", 3), (2, "FUEL", 2), (3, "MEAL", 1), (4, "FUEL", 1)]
    out = checks.top_evidence(spark.createDataFrame(rows, "id int, code string, score int"), ["id"])
    assert sorted(map(tuple, out.collect())) == [(1, "MEAL", 3), (4, "FUEL", 1)]


def test_updated(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, None, "x"), (None, "c", "x")], "id int, s string, other string")
    new = spark.createDataFrame([(1, "n"), (2, None), (3, "m"), (9, "z")], "id int, s string")
    out = lists.updated(df, "id", new, ["s"], unless=F.col("s") == "a")
    assert out.columns == df.columns
    assert sorted(out.collect(), key=str) == sorted([(1, "a", "x"), (2, "b", "x"), (3, "m", "x"), (None, "c", "x")], key=str)


def test_pages_of_each(spark):
    df = spark.createDataFrame([(u, i) for u in (1, 2) for i in range(u * 3)], "u int, i int")
    out = lists.pages_of_each(df, ["u"], [F.desc("i")], 2, 2)
    assert sorted((r.u, r.i, r.place, r.total) for r in out.collect()) == [(1, 0, 3, 3), (2, 2, 4, 6), (2, 3, 3, 6)]
    assert lists.pages_of_each(df.limit(0), ["u"], [F.desc("i")]).count() == 0


def test_names_of_unknown_keys_are_null(spark):
    df = spark.createDataFrame([(1, 7), (2, None), (3, 8)], "id int, k int")
    out = lists.with_names(df, "k", spark.createDataFrame([(7, "seven")], "k int, name string"), "k", {"name": "name"})
    assert sorted(map(tuple, out.select("id", "name").collect())) == [(1, "seven"), (2, None), (3, None)]


def test_sorts_of_the_review_list_are_dealt_to_small_parts(spark):
    from tallyspark import plans

    d = "/root/testdata/sf0.001"
    assert "RepartitionByExpression [o_orderkey" in plans.QUERIES["review_sorts"](spark, d)._jdf.queryExecution().optimizedPlan().toString()


def test_rows_of_orders_are_dealt_to_small_parts(spark):
    from tallyspark import plans

    assert "RepartitionByExpression [l_orderkey" in plans.QUERIES["anchor_repair"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
