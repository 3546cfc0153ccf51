"""Column functions and operators on small tables: nulls, blanks, quirks."""

import datetime as dt
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import dates, money, review, text
from tallyspark.operators import changes, extraction, facts, relational, rules, spreadsheet, validation
from tallyspark.sources import scans, sinks
from tallyspark.streaming import intake

DAY = dt.date(2024, 1, 20)


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_money(spark):
    rows = [("12,900원",), ("₩3,000",), ("",), ("abc",), (None,), ("12abc",)]
    got = values(spark, rows, "x string", money.stripped_money(F.col("x")).cast("double"), money.parsed_amount(F.col("x")), money.digits_amount(F.col("x")))
    assert got == [(12900, 12900, 12900), (3000, 3000, 3000), (None, 0, 0), (None, 0, 0), (None, 0, 0), (None, 0, 12)]
    assert values(spark, [("total 28,181 and 2,819 id A1,234 9",)], "x string", money.money_in(F.col("x"))) == [([28181, 2819],)]
    assert values(spark, [(0.5,), (82.4,), (None,), (170.0,)], "x double", money.percent(F.col("x"))) == [(50,), (82,), (None,), (100,)]
    assert values(spark, [("12.900",), ("1.25",)], "x string", money.dotted_thousands(F.col("x"))) == [("12900",), ("1.25",)]


def test_dates(spark):
    rows = [("2024-1-5",), ("20240105",), ("2024년1월5일",), ("24.1.5",), ("no 240105",), ("2024 1 5",), ("at 24/1/5 7",), ("2024년 1월 5일",), ("2024-13-01",), ("2024-02-30 20240105",), ("x240105",), ("",), (None,)]
    assert [r[0] for r in values(spark, rows, "x string", dates.date_only(F.col("x")))] == [dt.date(2024, 1, 5)] * 7 + [None] * 6
    assert values(spark, [(dt.date(2024, 1, 31),), (None,)], "d date", dates.settlement_due(F.col("d"))) == [(dt.date(2024, 2, 5),), (None,)]
    states = values(spark, [("", None), ("x", None), ("x", DAY.replace(year=2010)), ("x", DAY + dt.timedelta(2)), ("x", DAY - dt.timedelta(370)), ("x", DAY)], "r string, d date", dates.expense_date_status(F.col("r"), F.col("d"), DAY))
    assert [s for (s,) in states] == ["MISSING", "SUSPICIOUS", "TOO_FAR_YEAR", "FUTURE_DATE", "TOO_OLD", "NORMAL"]


def test_preset_ranges_keep_their_open_ends():
    assert dates.preset_range("THIS_MONTH", DAY) == (DAY.replace(day=1), None)
    assert dates.preset_range("LAST_MONTH", DAY) == (None, None)
    assert dates.preset_range(None, DAY, DAY, DAY) == (None, None)


def test_text(spark):
    ghosts = [("감바스 알 아히요요요요", "감바스 알 아히요"), ("월간 모히또 하이볼볼볼볼", "월간 모히또 하이볼"), ("월간 피치 얼그레이이이이", "월간 피치 얼그레이")]
    assert all(a == b for a, b in values(spark, ghosts, "x string, y string", text.without_ghosts(F.col("x")), F.col("y")))
    assert values(spark, [(" a  b ",), ("NaN",), ("",), (None,)], "x string", text.cleaned(F.col("x"))) == [("a b",), (None,), (None,), (None,)]
    assert values(spark, [("A",), ("AA",), ("1",), (None,)], "x string", text.column_number(F.col("x"))) == [(1,), (27,), (None,), (None,)]
    assert values(spark, [("food",), ("MEAL",), (None,), ("other",)], "x string", text.category_name(F.col("x"))) == [("식비",), ("식비",), ("",), ("other",)]
    assert values(spark, [('```{"a": 1}``` ',), ("{no",)], "x string", text.json_inside(F.col("x"))) == [('{"a": 1}',), (None,)]


def test_states_as_fixed_by_counts(spark):
    """Every branch of the stored and of the shown state."""
    names = ("total", "processing", "failed", "supplement", "review", "confirmed", "normal")
    cases = [((0, 0, 0, 0, 0, 0, 0), "UPLOADED", "EMPTY"), ((3, 1, 1, 0, 1, 0, 0), "PROCESSING", "PROCESSING"), ((3, 0, 1, 0, 1, 0, 1), "NEED_REVIEW", "NEED_REVIEW"), ((3, 0, 1, 1, 0, 0, 1), "READY_TO_CONFIRM", "READY_TO_CONFIRM"),
             ((3, 0, 1, 1, 0, 1, 0), "REVIEW_COMPLETED", "REVIEW_COMPLETED"), ((2, 0, 0, 0, 0, 2, 0), "READY_TO_GENERATE", "REVIEW_COMPLETED"), ((3, 0, 1, 1, 0, 0, 0), "NEED_SUPPLEMENT", "HAS_FAILED"), ((3, 0, 0, 1, 0, 0, 0), "NEED_SUPPLEMENT", "NEED_SUPPLEMENT"),
             ((3, 0, 1, 0, 0, 0, 0), "NEED_REVIEW", "HAS_FAILED"), ((3, 0, 0, 0, 0, 1, 0), "NEED_REVIEW", "MIXED")]
    n = {k: F.col(k) for k in names}
    got = values(spark, [c[0] for c in cases], ", ".join(f"{k} int" for k in names), review.batch_state(n), review.shown_state(n))
    assert got == [c[1:] for c in cases]


def test_amount_repairs(spark):
    """Misread zeros, the total, and amounts that unit and quantity bear out."""
    rows = [(16880, None), (15088, None), (31888, None), (12345, None), (980, None), (1800, None), (16900, 17000), (500, 1400)]
    got = values(spark, rows, "n int, t int", money.zero_repairs(F.col("n"), F.col("t")))
    assert [g for (g,) in got] == [[16880, 16000], [15088, 15000], [31888, 31000], [12345], [980], [1800, 1000], [16900, 17000], [500, 1400]]
    amounts = [(16880, 8000, 2, 16000), (16880, None, 2, 16000), (16880, 8440, 2, 16880), (12345, 100, 1, 12345), (16880, 8000, 0, 16000)]
    got = values(spark, [a[:3] for a in amounts], "a int, u int, q int", money.corrected_amount(F.col("a"), F.col("u"), F.col("q")))
    assert [g for (g,) in got] == [a[3] for a in amounts]
    units = [(8088, 16000, 2, 8000), (8088, 16176, 2, 8088), (5000, 16000, 2, 5000), (5000, 16000, 0, 5000)]
    got = values(spark, [u[:3] for u in units], "u int, a int, q int", money.corrected_unit(F.col("u"), F.col("a"), F.col("q")))
    assert [g for (g,) in got] == [u[3] for u in units]


def test_names_groups_and_types(spark):
    ghosts = [("하이볼볼", "하이볼"), ("얼그레이이", "얼그레이"), ("라떼 2A", "라떼"), ("커피커피커피", "커피"), (None, None)]
    assert values(spark, [g[:1] for g in ghosts], "x string", text.without_ghosts(F.col("x"))) == [g[1:] for g in ghosts]
    assert values(spark, [("라떼 2A",)], "x string", text.without_ghosts(F.col("x"), drop_tail=False)) == [("라떼 2A",)]
    names = [("* 12345 우유", "우유"), ("880123AB 라면", "라면"), ("[A-123] 커피 --", "커피"), ("12 사과", "12 사과"), (None, "")]
    assert values(spark, [n[:1] for n in names], "x string", text.candidate_item_name(F.col("x"))) == [n[1:] for n in names]
    groups = [("site_name", "BASIC"), ("paid_date", "DATE"), ("vendor_phone", "VENDOR"), ("cost_center", "ACCOUNT"), ("amount", "ITEM"), ("tax_amount", "AMOUNT"), ("card_no", "PAYMENT"), ("weather", "WORK"), ("x", "ETC"), (None, "ETC")]
    assert values(spark, [g[:1] for g in groups], "x string", text.field_group(F.col("x"))) == [g[1:] for g in groups]
    kinds = [("영수증", "RECEIPT"), (" DAILY_REPORT ", "DAILY_REPORT"), ("", "RECEIPT"), (None, "RECEIPT"), ("other", "other")]
    assert values(spark, [k[:1] for k in kinds], "x string", text.document_type(F.col("x"))) == [k[1:] for k in kinds]


def test_urgency(spark):
    rows = [("OVERDUE", "CONFIRMED", 95.0), ("NONE", "CONFIRMED", 95.0), ("NONE", "FAILED", 10.0), ("NONE", "NEED_REVIEW", None), ("NORMAL", "NEED_REVIEW", 60.0)]
    got = values(spark, rows, "d string, s string, x double", review.urgency_rank(F.col("d"), F.col("s"), F.col("x")))
    assert [r for (r,) in got] == [100, 20, 88, 78, 62]


def test_value_orders_differ(spark):
    row = [("e", "n", None, "m")]
    schema = "extracted_value string, normalized_value string, final_value string, modified_value string"
    assert values(spark, row, schema, facts.resolved("report"), facts.resolved("export"), facts.resolved("review")) == [("m", "m", "n")]


def test_changes(spark):
    target = spark.createDataFrame([(1, "a"), (None, "b")], "k int, v string")
    rows = spark.createDataFrame([(2, "c"), (2, "d"), (1, "x"), (None, "y")], "k int, v string")
    once = changes.insert_missing(target, rows, ["k"], [F.col("v")], default=-1)
    assert sorted(map(str, once.collect())) == sorted(map(str, changes.insert_missing(once, rows, ["k"], [F.col("v")], default=-1).collect()))
    assert sorted((r["k"] or 0, r["v"]) for r in once.collect()) == [(0, "b"), (1, "a"), (2, "c")]


@pytest.mark.parametrize("few", [0, 64])
def test_rules(spark, monkeypatch, few):
    monkeypatch.setattr(rules, "FEW_RULES", few)
    docs = spark.createDataFrame([(1, "coffee shop coffee"), (2, "taxi ["), (3, None)], "id long, text string")
    r = spark.createDataFrame([("MEAL", "CONTAINS", "coffee", 10, "Y", "APPROVED"), ("MOVE", "REGEX", "tax[iy]", 10, "Y", ""), ("MOVE", "REGEX", "[", 10, "Y", "Y"), ("X", "CONTAINS", "o", 1, "Y", "Y"), ("X", "EXACT", "taxi", 1, "N", "Y")], "code string, match_type string, keyword string, priority int, active_yn string, status string")
    got = {(x["id"], x["code"]): x["score"] for x in rules.scored(docs, "id", "text", rules.usable(r)).collect()}
    assert got[(1, "MEAL")] == 45 + 36 + 23.5 and (2, "MOVE") in got and not any(k[0] == 3 or k[1] == "X" for k in got)
    names = spark.createDataFrame([("스타벅스",), ("스타벅스 강남점",), ("starbukcs",), ("qq",), (None,)], "v string")
    found = [(x["match"], x["source"]) for x in rules.nearest_names(names, "v", ["스타벅스", "Starbucks"]).collect()]
    assert found == [("스타벅스", "DICTIONARY"), ("스타벅스", "CONTAINS"), ("Starbucks", "FUZZY"), ("qq", "RAW"), (None, "RAW")]


@pytest.mark.parametrize("few", [0, 64])
def test_keys_keep_signs_that_tell_rules_apart(spark, monkeypatch, few):
    monkeypatch.setattr(rules, "FEW_RULES", few)
    rows = [("C++ 17",), ("1+1",), ("R&D",), ("A×B",), (" 'a' “b” (c)[d]{e}:/|*_-.,",), ("\u3000a\u00a0b",), (None,)]
    assert values(spark, rows, "x string", text.rule_key(F.col("x"))) == [("c++17",), ("1+1",), ("r&d",), ("ab",), ("abcde",), ("ab",), ("",)]
    assert values(spark, [("(주) A㈜B",), ("주식회사 C+",)], "x string", text.vendor_key(F.col("x"))) == [("ab",), ("c+",)]
    docs = spark.createDataFrame([(1, "11"), (2, "1 + 1"), (3, "an R&D unit"), (4, "rd")], "id int, text string")
    r = spark.createDataFrame([("1+1", "EXACT", "A", 1), ("R&D", "CONTAINS", "B", 1)], "keyword string, match_type string, code string, priority int")
    assert sorted((x["id"], x["code"]) for x in rules.scored(docs, "id", "text", r).collect()) == [(2, "A"), (3, "B")]


def test_a_hundred_thousand_rules_are_searched_in_one_pass(spark):
    r = spark.range(100_001).select(F.concat(F.lit("word"), "id", F.lit("x")).alias("keyword"), F.lit("CONTAINS").alias("match_type"), (F.col("id") % 7).cast("string").alias("code"), F.lit(1).alias("priority"))
    docs = spark.range(500).select("id", F.concat(F.lit("a WORD"), F.col("id") * 200, F.lit("X and word5x.")).alias("text"))
    out = rules.scored(docs, "id", "text", r)
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(x["id"], x["code"]): x["hits"] for x in out.collect()}
    want = {}
    for i in range(500):
        for n in (i * 200, 5):
            want[i, str(n % 7)] = want.get((i, str(n % 7)), 0) + 1
    assert got == want


def test_corrections_see_each_other(spark):
    r = spark.createDataFrame([(2, "OCR_TEXT", "b", "c", "CONTAINS", 1, "APPROVED", "Y"), (1, "OCR_TEXT", "a", "b", "CONTAINS", 1, "", None), (3, "OCR_TEXT", "c(.)", r"<\1>", "REGEX", 100, "Y", "Y"), (4, "OCR_TEXT", "z", "no", "CONTAINS", 1, "APPROVED", "N"), (5, "VENDOR", "c.", "$x", "CONTAINS", 0, "APPROVED", "Y")], "id int, dictionary_type string, wrong_text string, corrected_text string, match_type string, priority int, status string, active_yn string")
    df = spark.createDataFrame([("aB d",), ("z",), ("",), (None,)], "t string")
    assert [x.t for x in rules.corrected(df, "t", r, ("OCR_TEXT",)).collect()] == ["<c> d", "z", "", None]
    assert [x.t for x in rules.corrected(df.limit(0), "t", r, ("OCR_TEXT",)).collect()] == []
    value = r.limit(0).union(spark.createDataFrame([(1, "ITEM", "하이볼!", "모히또", "EXACT", 1, "", "")], r.schema))
    assert [x.t for x in rules.corrected(spark.createDataFrame([("하이볼!",), (" 하이볼볼볼 ab",)], "t string"), "t", value, ("ITEM",), whole=True).collect()] == ["모히또", "하이볼"]


def test_rule_lookups(spark):
    sections = spark.createDataFrame([("ITEM", "합계 ", "RECEIPT", "Y", 1, 1), ("ITEM", "x", "SLIP", None, 1, 2), ("item", " ", "ALL", "Y", 1, 3), ("TOTAL", "y", "ALL", "N", 1, 4)], "section_type string, keyword string, document_type string, active_yn string, priority int, id int")
    assert [x.keyword for x in rules.section_keywords(sections, "item", "invoice").collect()] == ["합계"]
    assert [x.keyword for x in rules.section_keywords(sections, "ITEM").orderBy("id").collect()] == ["합계", "x"]
    fields = spark.createDataFrame([("receipt", "a", "Y", 0), ("SLIP", "b", "y", 2), ("SLIP", "c", None, 1)], "document_type string, field_key string, required_yn string, sort_order int")
    assert sorted(map(tuple, rules.required_fields(fields, "slip").collect())) == [("a", 1000), ("b", 2)]
    assert values(spark, [("meal",), ("교통비",), ("?",), (None,)], "x string", rules.category_of(F.col("x"))) == [("MEAL",), ("TRANSPORT",), (None,), (None,)]


@pytest.mark.parametrize("few", [0, 64])
def test_many_rules_are_not_cut(spark, monkeypatch, few):
    monkeypatch.setattr(rules, "FEW_RULES", few)
    rows = [(w, k, c, 1) for w, k, c in (("taxi", "CONTAINS", "A"), ("hotel", "CONTAINS", "B"), ("coffee", "CONTAINS", "C"), ("(bus", "REGEX", "D"), ("[train", "REGEX", "E"), ("plane(", "REGEX", "F"))]
    r = spark.createDataFrame(rows, "keyword string, match_type string, code string, priority int")
    docs = spark.createDataFrame([(1, "taxi hotel coffee (bus [train plane(")], "id int, text string")
    monkeypatch.setattr(rules, "MOST_RULES", 2)
    assert {x["code"] for x in rules.scored(docs, "id", "text", r).collect()} == set("ABCDEF")


def test_page_lines(spark):
    tokens = spark.createDataFrame([(1, 50.0, 10.0, 8.0, "b"), (1, 1.0, 12.0, 8.0, "a"), (1, 1.0, 40.0, 8.0, "c")], "page long, x double, cy double, h double, word string")
    assert [(r[1], r[2]) for r in extraction.page_lines(tokens).collect()] == [(0, "a b"), (1, "c")]


def test_distinct_lines_keep_their_digits(spark):
    """Only blanks are cut off, not a digit that is the line's own number."""
    docs = spark.createDataFrame([(1, "0950 a\n 1219 b \n1219 b\n\n c1"), (2, None)], "k int, text string")
    assert sorted((r.k, r.text) for r in extraction.distinct_lines(docs, "k").collect()) == [(1, "0950 a\n1219 b\nc1"), (2, "")]


def test_zero_penalty_counts_as_the_default(spark):
    found = validation.issues(validation.issue(F.lit(True), "A", "x", penalty=0.0), validation.issue(F.lit(None), "B", "y"))
    assert spark.range(1).select(F.round(validation.penalty(found), 4)).first()[0] == 0.08


def test_exact_code_sorts_last(spark):
    df = spark.createDataFrame([("MEAL", 1), ("x", 2)], "c string, id int")
    assert [r["id"] for r in df.orderBy(relational.preferred_last(F.col("c"), "MEAL"), "id").collect()] == [2, 1]


def test_cells(spark):
    details = spark.createDataFrame([(1, k, "item", f"v{k}") for k in range(1, 5)], "document int, line_no int, field_key string, value string")
    m = spark.createDataFrame([("item", "S", "B", 10, 3)], "field_key string, sheet string, column_letter string, start_row int, max_rows int")
    assert sorted((r["row"], r["col"], r["value"]) for r in spreadsheet.repeat_cells(details, m).collect()) == [(10, 2, "v1"), (11, 2, "v2"), (12, 2, "v3")]


def test_sources_and_sinks(spark, tmp_path):
    assert scans.or_empty(spark, lambda: spark.read.parquet(str(tmp_path / "none")), "a int").collect() == []
    sinks.csv(spark.createDataFrame([(1, 'a"b'), (2, None)], "x int, y string").coalesce(1), str(tmp_path / "c"))
    lines = [x for f in (tmp_path / "c").glob("*.csv") for x in f.read_text("utf-8").splitlines()]
    assert lines[0].startswith('"﻿x"') and '"1","a""b"' in lines
    clock = [0.0]
    cache = scans.Cached(10, lambda: clock[0])
    a = cache.get("k", lambda: spark.range(1))
    assert cache.get("k", lambda: spark.range(2)) is a
    clock[0] = 11
    assert cache.get("k", lambda: spark.range(2)).count() == 2


def test_intake(spark, tmp_path):
    rows = [(1, 9, dt.datetime(2024, 1, 1), "x" * 50 + "1"), (1, 9, dt.datetime(2024, 1, 1), "again"), (2, 9, dt.datetime(2024, 1, 1), None)]
    spark.createDataFrame(rows, intake.SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = intake.start(intake.arriving(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["file_id"], r["status"]) for r in got.collect())[1] == (2, "FAILED") and got.count() == 2
    counts = intake.batch_counts(got).first()
    assert counts["files"] == 2 and counts["failed"] == 1


@pytest.mark.parametrize("size,expected", [(1, 5), (500, 100)])
def test_page_size_is_kept_in_bounds(spark, size, expected):
    assert relational.page(spark.range(300), [F.col("id")], 0, size).count() == expected


def test_document_types_at_the_edges(spark):
    from tallyspark.operators import rules

    kinds = spark.createDataFrame([("a", "CONTAINS", "X", 20, 1), ("b", "CONTAINS", "Y", 20, 0), ("c", "EXACT", "z", 19, 2), ("d", "REGEX", "", 99, 3)], "keyword string, match_type string, code string, score int, place int")
    docs = spark.createDataFrame([(1, "a b", None), (2, "c", None), (3, None, "영수증"), (4, "", " slip "), (5, "a", "RECEIPT"), (6, "d", None)], "k int, text string, asked string")
    out = rules.document_types(docs, "k", "text", F.col("asked"), kinds, F.lit(False), F.lit(None).cast("boolean"))
    assert {r.k: r.document_type for r in out.collect()} == {1: "Y", 2: "RECEIPT", 3: "RECEIPT", 4: "SLIP", 5: "X", 6: "RECEIPT"}
    assert rules.document_types(docs, "k", "text", F.col("asked"), kinds.limit(0), F.lit(True), F.lit(False)).filter("document_type = 'HANDWRITTEN_FORM_RECEIPT'").count() == 5
