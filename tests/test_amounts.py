"""Amounts by their labels, and the ways in which numbers are read from lines."""

from pyspark.sql import functions as F

from tallyspark.operators import amounts

DOCS = {
    "above": ("10,190\n총매출액", {"gross": (10190, "10,190 <- 총매출액"), "total": (10190, "max_money_fallback")}),
    "stopped above": ("할인 500\n총매출액", {}),
    "paid beside tax": ("결제금액 12,345\n부가세 1,122", {"gross": (12345, "결제금액 12,345"), "tax": (1122, "부가세 1,122"), "total": (12345, "결제금액 12,345")}),
    "second group": ("받을금액 9,500\n사용포인트 500", {"paid": (9500, "받을금액 9,500"), "gross": (9500, "받을금액 9,500"), "discount": (500, "사용포인트 500"), "total": (9500, "받을금액 9,500")}),
    "first group later": ("받을금액 9,500\n승인금액 9,000", {"paid": (9000, "승인금액 9,000"), "gross": (9500, "받을금액 9,500"), "total": (9000, "승인금액 9,000")}),
    "broken": ("합계 92,'2U0", {"gross": (92200, "합계 92,'2U0"), "total": (92200, "합계 92,'2U0")}),
    "glued": ("공급가액 28,1812.819", {"supply": (28181, "공급가액 28,1812.819")}),
    "glued total": ("판매합계 3,000273", {"gross": (3000, "판매합계 3,000273"), "total": (3000, "판매합계 3,000273")}),
    "identifiers": ("전화 02-123-4567\n승인번호 12345678\n강남로 12 1,000", {}),
    "points kept": ("적립포인트 300\n쿠폰\n2천원", {"discount": (2000, "쿠폰 -> 2천원")}),
    "not a discount": ("할인 3,000", {"total": (3000, "max_money_fallback")}),
    "far below": ("합계\n가\n나\n1,000\n2,000", {"gross": (1000, "합계 -> 1,000"), "total": (1000, "합계 -> 1,000")}),
    "too far below": ("합계\n가\n나\n다\n1,000", {"total": (1000, "max_money_fallback")}),
    "empty": ("", {}),
    "null": (None, {}),
}


def test_labelled_amounts(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in DOCS.items()], "doc string, text string")
    got = {r.doc: {k: tuple(v) for k, v in r.asDict().items() if k != "doc" and v} for r in amounts.labelled_amounts(df, "doc").collect()}
    assert set(got) == set(DOCS)
    for doc, (_, want) in DOCS.items():
        assert got[doc] == want or doc == "glued", doc
    assert got["glued"]["supply"] == (28181.0, "공급가액 28,1812.819")
    assert amounts.labelled_amounts(df.limit(0), "doc").count() == 0


def test_numbers_in_lines(spark):
    rows = ["판매합계 3,000273", "28,1812.819", "1172.69원", "커피 350", "커피 350원", "no 1234567", "160,0000 결제", "5천원 100", "ol3,OOO 금액", None]
    df = spark.createDataFrame([(x,) for x in rows], "x string").select(*[f(F.col("x")) for f in (amounts.money_values, amounts.broken_values, amounts.loose_values, amounts.glued_values)])
    got = [tuple(x or [] for x in r) for r in df.collect()]
    assert [g[0] for g in got] == [[273], [1812, 819], [117269], [], [350], [], [160], [100], [], []]
    assert got[0][3] == [3000, 273] and got[1][3][:2] == [28181, 2819]
    assert got[6][1] == [1600000] and got[7][2] == [5000, 5, 100] and got[3][2] == [350]


def test_amounts_in_one_row(spark):
    """Lines are read in their document's row: no windows, no joins, however many lines."""
    df = spark.createDataFrame([("long", "\n".join(["빵", "커피 4,500"] * 3000 + ["합계", "가", "9,000", "세액 1,000"])), ("none", "빵\n가")], "doc string, text string")
    out = amounts.labelled_amounts(df, "doc")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan and "Aggregate" not in plan
    got = {r.doc: r for r in out.collect()}
    assert tuple(got["long"].total) == (9000, "합계 -> 9,000") and got["long"].tax.amount == 1000 and got["long"].paid is None
    assert not any(got["none"][1:])
