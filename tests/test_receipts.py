"""Rules of single texts at their edges."""

from pyspark.sql import functions as F

from tallyspark.functions import receipts
from tallyspark.operators import extraction, lists, relational
from tallyspark.sources import scans


def each(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", make(F.col("v")).alias("out")).collect()
    return [r.out for r in sorted(rows, key=lambda r: r.i)]


def test_bad_vendor(spark):
    good = ["이마트 성수점", "Blue Bottle", "(주)한빛상사", "커피 전문점", "코레일"]
    bad = [None, "", " ", "A", "㈜", "x" * 41, "합계 매장", "Tel 02", "아이스 라떼", "12,000원", "가게 02-123-4567", "서울로 12", "1a2", "[A 1]"]
    assert each(spark, good + bad, receipts.bad_vendor) == [False] * len(good) + [True] * len(bad)


def test_payment_method(spark):
    texts = {"현금 카드": "현금", "간편결제 카드": "간편결제", "신용승인": "카드/간편결제", "없음": None, "": None}
    assert each(spark, [*texts, None], receipts.payment_method) == [*texts.values(), None]


def test_business_number(spark):
    texts = {"no 123-45-67890.": "123-45-67890", "1234567890": "123-45-67890", "123 45 67890": "123-45-67890", "91234567890": None, "": None}
    assert each(spark, [*texts, None], receipts.business_number) == [*texts.values(), None]


def test_cell_value(spark):
    texts = ["1,234.5", "-12", "12,34", "1.", " a ", "", None]
    assert [tuple(x) for x in each(spark, texts, receipts.cell_value)] == [(1234.5, None), (-12.0, None), (None, "12,34"), (None, "1."), (None, "a"), (None, ""), (None, None)]


def test_route_summary(spark):
    rows = [("서울", "부산", "KTX", None), ("서울", "부산", " ", ""), ("서울", "서울", "KTX", " 순환 "), (None, "부산", None, None)]
    out = spark.createDataFrame(rows, "a string, b string, c string, d string").select(receipts.route_summary(*[F.col(x) for x in "abcd"])).collect()
    assert [r[0] for r in out] == ["KTX 서울 → 부산", "버스 서울 → 부산", "순환", ""]


def test_item_summary(spark):
    names = [["a", "b", "a"], ["a", " ", "a"], [], None]
    assert each(spark, names, lambda c: receipts.item_summary(F.coalesce(c, F.array().cast("array<string>")), F.lit("shop")), "array<string>") == ["a 외 1건", "a", "shop", "shop"]


def test_status_message(spark):
    rows = [("FAILED", "e"), ("FAILED", None), ("NORMAL", "e"), ("?", "e"), ("?", None), (None, None)]
    out = spark.createDataFrame(rows, "s string, e string").select(receipts.status_message(F.col("s"), F.col("e"))).collect()
    assert [r[0] for r in out] == ["e", "처리 중 오류가 발생했습니다.", "정상 처리되었습니다.", "e", "-", "-"]


def test_repaired_total_without_anything(spark):
    null = F.lit(None).cast("double")
    assert tuple(spark.range(1).select(receipts.repaired_total(null, F.lit(None).cast("string"), null, null, null)).first()[0]) == (None, None)


def test_progress_of_unknown_states(spark):
    df = spark.createDataFrame([(1, "CONFIRMED"), (1, None), (1, "NEW"), (2, "FAILED"), (2, "NORMAL")], "b int, status string")
    assert sorted(map(tuple, lists.progress(df, ["b"]).collect())) == [(1, 3, 1, 33, 2, False), (2, 2, 1, 50, 0, True)]
    assert lists.progress(df.limit(0), ["b"]).count() == 0


def test_dashboards_of_nothing(spark):
    df = spark.createDataFrame([], "status string")
    assert [tuple(r) for r in lists.dashboards(df, {"admin": (None, ["FAILED"])}).collect()] == [("admin", 0, 0)]


def test_code_comes_last(spark):
    types = spark.createDataFrame([(1, "x", "x"), (2, "x", "y"), (3, "z", "x")], "id int, code string, name string")
    words = spark.createDataFrame([("x",), ("y",), ("n",), (None,)], "word string")
    assert sorted((r.word, r.id) for r in relational.by_code_or_name(words, "word", types, "id").collect()) == [("x", 3), ("y", 2)]


def test_staging_leaves_nothing(spark):
    before = {t.name for t in spark.catalog.listTables()}
    assert scans.staged(spark, spark.range(3), lambda n: spark.sql(f"SELECT count(*) AS n FROM {n}")).first().n == 3
    assert {t.name for t in spark.catalog.listTables()} == before


def test_line_before(spark):
    rows = extraction.lines(spark.createDataFrame([(1, "a\n\n b \nc"), (2, None)], "k int, text string"), "k")
    assert sorted((r.line, r.before) for r in extraction.line_before(rows, "k").collect()) == [("a", None), ("b", "a"), ("c", "b")]
