"""Vendors from the first lines of receipts."""

from tallyspark.operators import vendors

DOCS = {
    "label": ("[매장명] 초록 식당 성명 홍길동\n서울시 강남구 테헤란로 1", ("초록 식당", "points")),
    "beside a number": ("영수증\n초록문구123-45-67890TEL 02-1\n파란마트", ("파란마트", "points")),
    "points": ("어느 골목\n파란마트\n커피 4,500", ("파란마트", "points")),
    "dictionary": ("영수증\nACME MART 1호점", (None, None)),
    "contains": ("영수증\n아크메 본점\n파란마트", ("ACME", "dictionary")),
    "stopped": ("판매처 모음\n파란마트", (None, None)),
    "titles": ("[중간계산서77]\n영수증\n합계 1,000", (None, None)),
    "numbers": ("12,345\n2024-03-05\nhttp://a.b", (None, None)),
    "beyond": ("\n".join(["합계"] * 28 + ["파란마트"]), (None, None)),
    "telephone": ("파란상회 전화", ("파란상회", "points")),
    "empty": ("", (None, None)),
    "null": (None, (None, None)),
}


def test_vendors(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in DOCS.items()], "doc string, text string")
    got = {r.doc: (r.vendor, r.by) for r in vendors.vendors(df, "doc", corrections=[("아크메", "old"), ("아크메", "ACME")]).collect()}
    assert got == {k: v for k, (_, v) in DOCS.items()}
    assert vendors.vendors(df.limit(0), "doc").count() == 0


def test_vendors_in_one_row(spark):
    """Lines are judged in their document's row: no windows and no joins."""
    df = spark.createDataFrame([(k, t) for k, (t, _) in DOCS.items()], "doc string, text string")
    plan = vendors.vendors(df, "doc")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan and "Aggregate" not in plan
