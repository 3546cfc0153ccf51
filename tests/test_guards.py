"""Guards on written examples."""

import datetime as dt

from pyspark.sql import functions as F

from tallyspark.operators import guards

TODAY = dt.date(2024, 3, 10)


def each(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", make(F.col("v")).alias("out")).collect()
    return [r.out for r in sorted(rows, key=lambda r: r.i)]


def test_item_names(spark):
    good = ["김치찌개", "제육볶음 2인분", "콜라 500ml", "비닐봉투", "아메리카노(L)"]
    bad = [None, "", " ", "김", "합계", "카드 승인", "1234", "12,000", "010-1234-5678", "중앙로12", "Americano", "Cola 500", "★김치★", "김치/찌개/밥", "x" * 46, "가" * 46, "12abcd 김치"]
    assert each(spark, good + bad, guards.bad_item_name) == [False] * len(good) + [True] * len(bad)


def test_item_name_quality(spark):
    names = {"김치찌개": 1.0, "cold widget": 1.0, "제육 2인분": 1.0, "커피3": 1 - 0.55, "김치찌개3": 1 - 0.2 * 0.45, "": 0.0, "합계": 0.0, "김": 0.0, "카페라떼/ice": 1 - 0.45 - 1 / 8 * 1.7}
    got = each(spark, list(names), guards.item_name_quality)
    assert [round(x, 6) for x in got] == [round(x, 6) for x in names.values()]


def test_handwritten_form(spark):
    form = "영 수 증 (공급받는자용)\n사업자 번호\n품목 수량 단가\n위 금액을 정히 영수함"
    assert each(spark, [form, form.replace("사업자 번호", ""), "영수증", "", None], guards.handwritten_form) == [True, False, False, False, False]


def test_likely_date(spark):
    texts = {
        "2024-03-05 and 2024.3.5, 2024-03-06": "2024-03-05",
        "2024-03-06 2024-03-05 12:30": "2024-03-05",
        "2024-86-05": "2024-06-05",
        "2024-06-20 2024-02-81": "2024-02-01",
        "2025-01-01 20240301": "2024-03-01",
        "24년 3월 5일": "2024-03-05",
        "2024-02-30": None,
        "2024-03-07 2024-03-06": "2024-03-07",
        "": None,
    }
    got = each(spark, [*texts, None], lambda c: guards.likely_date(c, TODAY))
    assert [str(x) if x else None for x in got] == [*texts.values(), None]


DOC = "doc int, document_type string, text string, total double, sale_total double, discount double, n_amounts int, money_false boolean, cap double"
ITEM = "doc int, line_no int, name string, amount double, quantity double, unit_price double"


def test_guarded_edges(spark):
    docs = spark.createDataFrame([(1, None, None, None, None, None, None, None, None), (2, "RECEIPT", "x", 3000.0, None, None, 0, False, 0.2), (3, "RECEIPT", "x", 2000.0, None, 1000.0, 0, False, None)], DOC)
    items = spark.createDataFrame([(2, 1, "김치찌개", 3000.0, None, None), (2, 2, "김치 찌개", 3000.2, 0.0, None), (2, 3, None, None, None, None), (3, 1, "김치찌개", 1000.0, 1.0, 1000.0), (3, 2, "된장찌개", 2000.0, 2.0, 1000.0), (9, 1, "김치찌개", 1.0, None, None)], ITEM)
    out = {r.doc: r for r in guards.guarded(docs, items, "doc").collect()}
    assert (out[1].state, out[1].cap, out[1].description, out[1].confirmed) == (None, 1.0, None, 0)
    assert (out[2].state, out[2].cap, out[2].description, out[2].confirmed, out[2].rejected) == ("CONFIRMED", 0.2, "김치찌개", 1, 1)
    assert (out[3].state, out[3].description, out[3].item_sum) == ("CONFIRMED", "김치찌개 외 1건", 3000.0)
    assert guards.guarded(docs.limit(0), items, "doc").count() == 0
    assert guards.guarded(docs, items.limit(0), "doc").filter("state IS NULL").count() == 3


def test_a_name_is_trimmed_once(spark):
    """Written out wherever it is used, a name would be worked out dozens of times."""
    plan = spark.createDataFrame([("a",)], "x string").select(guards.bad_item_name(F.col("x")).alias("q"), F.lit(1).alias("r"))
    assert plan._jdf.queryExecution().analyzed().toString().count("x#") == 2
