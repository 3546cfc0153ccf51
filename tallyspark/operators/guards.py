"""Guards: what is known too weakly stays a candidate. Item names, single items, and whole documents."""

from __future__ import annotations

import datetime as dt
import re
from collections import defaultdict
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.item_lines import any_of
from ..functions.text import bound, compact
from .checks import expected_total

# Words that no item's name holds, hints of handwritten forms, and how numbers may stand in a name.
NON_ITEM_WORDS = ["합계", "총계", "총액", "판매합계", "받을금액", "받은금액", "결제", "카드", "승인", "공급가", "공급가액", "부가세", "세액", "과세", "면세", "입금계좌", "사업자", "전화", "주소", "대표", "매장명", "영수증", "계산서", "주문자", "고객수", "테이블", "일시불", "포인트", "멤버십", "가맹점", "카드번호", "승인번호", "승인일시"]
FORM_HINTS = ["공급받는자용", "공급대가총액", "위금액을정히", "정히영수", "입금계좌", "품목수량단가", "공급대가금액", "부가가치세법시행규칙", "영수증으로개정"]
SIZES = r"[0-9]+\s*(개|개입|입|매|장|롤|팩|봉|병|잔|인분|인|세트|SET|set|종|호|ml|mL|ML|g|G|kg|KG|L|l)|제로|ZERO|zero|1\+1|2\+1"
NOISE = r"[ρπγ∗×Ω℃♥★◆◇□■●○▲△▼▽♣♠※^{}<>_=|`~]"
NUMBERS_ONLY = r"^[0-9,.'`~\-:;_/\\()\[\]{}\s]+$"
IDENTIFIER = r"[0-9]{3}-?[0-9]{2}-?[0-9]{5}|[0-9]{2,4}-?[0-9]{3,4}-?[0-9]{4}"
ADDRESS = r"[가-힣0-9]+(?:길|로)[0-9]+|번지|[0-9]+호"
TOTAL_LABELS = "합계|총액|공급대가|결제|승인"


def _left(text: Column, kept: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{kept}]+", ""))


def _impossible(text: Column, c: Column) -> Column:
    return c.rlike(any_of(NON_ITEM_WORDS)) | text.rlike(NUMBERS_ONLY) | c.rlike(IDENTIFIER) | c.rlike(ADDRESS)


def _letters_mean_something(text: Column) -> Column:
    def means(bare: Column) -> Column:
        latin, digits = _left(bare, "A-Za-z"), _left(text, "0-9")
        return bare.rlike("[가-힣]{2,}") | bound(latin, lambda latin: ((latin >= 2) & (digits == 0)) | ((latin >= 4) & (digits <= 1)))

    return bound(F.regexp_replace(F.regexp_replace(text, r"[0-9,.'`~\-:;_/\\()\[\]{}\s]+", ""), "^(개|EA|ea|x|X)+", ""), means)


def item_name_quality(name: Column) -> Column:
    """0 to 1: how much a text looks like an item's name. Null, empty and impossible names are 0."""
    return _trimmed(name, lambda text, c: F.when((c == "") | _impossible(text, c), 0.0).otherwise(_counted(c, lambda *counts: _points(text, c, *counts))))


def _trimmed(name: Column, body: Callable[[Column, Column], Column]) -> Column:
    """``body`` of the trimmed name, and of that without white space."""
    return bound(F.trim(F.coalesce(name, F.lit(""))), lambda text: bound(compact(text), lambda c: body(text, c)))


def _counted(c: Column, body: Callable[[Column, Column, Column], Column]) -> Column:
    """``body`` of the numbers of letters, digits and other signs."""
    counts = F.struct(_left(c, "가-힣A-Za-z").alias("letters"), _left(c, "0-9").alias("digits"), F.length(F.regexp_replace(c, "[가-힣A-Za-z0-9]+", "")).alias("signs"))
    return bound(counts, lambda n: body(n["letters"], n["digits"], n["signs"]))


def _points(text: Column, c: Column, letters: Column, digits: Column, signs: Column) -> Column:
    """``item_name_quality`` of a possible name."""
    n = F.greatest(F.length(c), F.lit(1))
    less = lambda holds, points: F.when(holds, points).otherwise(0.0)
    share = digits / n
    digit_points = F.when((letters >= 3) & (share <= 0.45), F.least(F.lit(0.22), share * 0.45)).otherwise(F.least(F.lit(0.55), share + 0.25))
    score = (
        F.lit(1.0)
        - less((F.length(c) < 2) | (F.length(c) > 45), 0.45)
        - less(letters < 2, 0.65)
        - less(~_letters_mean_something(text), 0.70)
        - less(text.rlike(NOISE), 0.50)
        - less(text.rlike(r"[\\/]"), 0.45)
        - less(signs / n >= 0.08, F.least(F.lit(0.50), signs / n * 1.7))
        - less((digits > 0) & ~text.rlike(SIZES), digit_points)
        - less(letters / n < 0.65, 0.30)
        - less(c.rlike("[A-Za-z]") & c.rlike("[가-힣]") & ~text.rlike("[가-힣A-Za-z]{2,}"), 0.25)
    )
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))


def bad_item_name(name: Column) -> Column:
    """Whether a text can't be kept as an item's name; names of Latin letters and digits alone never are. Null: true."""
    return _trimmed(name, lambda text, c: (c == "") | (F.length(c) < 2) | (F.length(c) > 45) | _impossible(text, c) | _counted(c, lambda *counts: _bad(text, c, *counts)))


def _bad(text: Column, c: Column, letters: Column, digits: Column, signs: Column) -> Column:
    """``bad_item_name`` of a possible name."""
    word = text.rlike("[가-힣A-Za-z]{2,}")
    return (
        bound(_points(text, c, letters, digits, signs), lambda quality: (quality < 0.70) & ~(word & (quality >= 0.55)))
        | (letters < 2)
        | ~_letters_mean_something(text)
        | (F.length(F.regexp_replace(text, r"[가-힣A-Za-z0-9\s]+", "")) >= 3)
        | ((digits >= letters) & ~word)
        | text.rlike(r"[{}πγρΩ<>^]|['`’]{2,}|[0-9][A-Za-z]{3,}")
        | (text.rlike("[A-Za-z]{4,}[0-9]") & (letters < 4))
        | text.rlike(r"^[A-Za-z0-9\-_. ]+$")
    )


def handwritten_form(text: Column) -> Column:
    """Whether a text is a printed form that is filled in by hand. Null: false."""
    c = compact(F.coalesce(text, F.lit("")))
    has = lambda w: F.contains(c, F.lit(w))
    hints = sum((has(h).cast("int") for h in FORM_HINTS), F.lit(0))
    columns = has("품목") & has("수량") & has("단가")
    return has("영수증") & columns & (has("입금계좌") | has("정히영수") | has("위금액")) & (has("사업자") | has("등록번호") | c.rlike("[0-9]{3}-?[0-9]{2}-?[0-9]{5}")) & (hints >= 2)


def rejection(name: Column, amount: Column, quantity: Column, unit: Column, expected: Column) -> Column:
    """Why an item can't be confirmed: NAME, AMOUNT, SMALL, ABOVE_TOTAL or UNIT; null if it can. A null or 0 quantity is 1."""
    times = F.coalesce(F.nullif(quantity, F.lit(0.0)), F.lit(1.0))
    return (
        F.when(bad_item_name(name), "NAME")
        .when(F.coalesce(amount, F.lit(0.0)) <= 0, "AMOUNT")
        .when((amount < 100) & ~name.rlike("봉투|쇼핑백|비닐|포장"), "SMALL")
        .when(amount > F.greatest(expected + 100, expected * 1.05), "ABOVE_TOTAL")
        .when(F.abs(unit * times - amount) > F.greatest(F.lit(10.0), amount * 0.05), "UNIT")
    )


def guarded(docs: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """What of each document stays confirmed.

    ``docs``: key (unique; a document without one has no items), document_type, text, total, sale_total, discount, n_amounts, money_false, cap (null: 1).
    ``items``: key, line_no, name, amount, quantity, unit_price, of known documents; others are left out.
    Returns key, state, confirmed (number of items), rejected, item_sum, total, estimated_total, suspicious_total, cap,
    description. Equal names with equal rounded amounts count once. Rejected items and sums are added up before they
    are shuffled, so a document of many items is no burden to one task. State is null if nothing was to decide.
    """
    docs = docs.withColumn("_expected", expected_total(F.col("total"), F.col("sale_total"), F.col("discount")))
    judged = items.join(docs.select(key, "_expected"), key).withColumn("_why", rejection(F.col("name"), F.col("amount"), F.col("quantity"), F.col("unit_price"), F.col("_expected")))
    # rejected rows are told apart only by their being rejected; valid ones by name and amount
    same = F.when(F.col("_why").isNull(), F.struct(F.lower(compact(F.col("name"))), F.bround("amount")))
    once = judged.groupBy(key, same.alias("_same")).agg(F.count(F.lit(1)).alias("_rows"), F.min(F.struct("line_no", F.trim("name").alias("name"), "amount")).alias("_first"))
    valid = F.col("_same").isNotNull()
    summed = once.groupBy(key).agg(
        F.count_if(valid).alias("_valid"),
        F.sum(F.when(valid, F.col("_first.amount"))).alias("_sum"),
        F.coalesce(F.sum(F.when(~valid, F.col("_rows"))), F.lit(0)).alias("_rejected"),
        F.min(F.when(valid, F.col("_first"))).alias("_head"),
    )
    d = docs.join(summed, key, "left").withColumns({"_valid": F.coalesce("_valid", F.lit(0)), "_rejected": F.coalesce("_rejected", F.lit(0))})
    kind, n, expected, total = F.upper(F.coalesce("document_type", F.lit(""))), F.col("_valid"), F.col("_expected"), F.col("total")
    by_hand = F.contains(kind, F.lit("HANDWRITTEN")) | handwritten_form(F.col("text"))
    transport = ~by_hand & F.contains(kind, F.lit("TRANSPORT"))
    off = F.abs(F.bround("_sum") - F.bround(expected))
    mismatch = F.coalesce((n > 0) & (off > 0), F.lit(False))
    few = (F.coalesce("n_amounts", F.lit(0)) >= 5) & (n <= 1)
    state = (
        F.when(by_hand, "HANDWRITTEN_REVIEW_ONLY").when(transport, None).when(mismatch, "UNCONFIRMED_SUM_MISMATCH").when(few, "UNCONFIRMED_TOO_FEW_ITEMS").when(n > 0, "CONFIRMED").when(F.col("_rejected") > 0, "UNCONFIRMED_ALL_REJECTED")
    )
    d = d.withColumn("state", state)
    ended = F.coalesce(F.col("state").isin("HANDWRITTEN_REVIEW_ONLY", "UNCONFIRMED_SUM_MISMATCH", "UNCONFIRMED_TOO_FEW_ITEMS"), F.lit(False)) | transport
    lost = by_hand & (total < 1000)
    suspicious = F.coalesce(~ended & (total < 1000) & F.col("text").rlike(TOTAL_LABELS), F.lit(False))
    gone = F.coalesce(lost, F.lit(False)) | suspicious
    caps = [
        F.when(by_hand, F.when(total.isNull() | gone, 0.25).otherwise(0.35)),
        F.when(F.col("state") == "UNCONFIRMED_SUM_MISMATCH", F.when(off / F.greatest(expected, F.lit(1.0)) >= 0.10, 0.55).otherwise(0.68)),
        F.when(F.col("state") == "UNCONFIRMED_TOO_FEW_ITEMS", 0.45),
        F.when(F.col("state") == "UNCONFIRMED_ALL_REJECTED", 0.30),
        F.when(suspicious, 0.25),
        F.when(~ended & F.coalesce("money_false", F.lit(False)), 0.30),
    ]
    name = F.col("_head.name")
    described = F.when(by_hand, "수기 영수증 검토 필요").when(F.col("state") == "CONFIRMED", F.when(n == 1, name).otherwise(F.concat(name, F.lit(" 외 "), (n - 1).cast("string"), F.lit("건")))).when(F.col("state").isNotNull(), "상세 품목 검토 필요")
    return d.select(
        key,
        "state",
        F.when(F.col("state") == "CONFIRMED", n).otherwise(F.lit(0)).cast("long").alias("confirmed"),
        F.col("_rejected").cast("long").alias("rejected"),
        F.col("_sum").alias("item_sum"),
        F.when(~gone, total).alias("total"),
        F.when(lost, total * 1000).alias("estimated_total"),
        F.when(suspicious, total).alias("suspicious_total"),
        F.least(F.coalesce(F.nullif(F.col("cap"), F.lit(0.0)), F.lit(1.0)), *caps).alias("cap"),
        described.alias("description"),
    )


# How dates are written.
DATES = (r"(20\d{2})[.\-/년\s]+(\d{1,2})[.\-/월\s]+(\d{1,2})", r"(20\d{2})(\d{2})(\d{2})", r"(\d{2})\s*년\s*(\d{1,2})\s*월?\s*(\d{1,2})")


def _part(written: str, most: int) -> int | None:
    """A month or day, where 6, 8 or 9 may be a misread 0."""
    two = written.zfill(2)
    readings = [two] + [two[:k] + "0" + two[k + 1 :] for k in (0, 1) if two[k] in "689"]
    return next((int(r) for r in readings if 1 <= int(r) <= most), None)


def dates_in(text: str, today: dt.date) -> str | None:
    votes, first = defaultdict(list), {}
    for pattern in DATES:
        for m in re.finditer(pattern, text):
            year, month, day = int(m[1]) + (2000 if len(m[1]) == 2 else 0), _part(m[2], 12), _part(m[3], 31)
            try:
                found = dt.date(year, month or 0, day or 0)
            except ValueError:
                continue
            repaired = (month, day) != (int(m[2]), int(m[3]))
            timed = re.search(r"\d{1,2}:\d{2}", text[m.end() : m.end() + 12]) is not None
            votes[found].append((0.72 if repaired else 1.0) + 0.8 * timed - 1.2 * ((found - today).days > 30))
            first[found] = min(first.get(found, m.start()), m.start())
    best = max(votes, key=lambda d: (sum(votes[d]), len(votes[d]), -first[d]), default=None)
    return None if best is None else best.isoformat()


def likely_date(text: Column, today: dt.date) -> Column:
    """The date that a text names most often, as yyyy-mm-dd; none, and a null text: null.

    Repaired readings count .72; a time within 12 characters adds .8, lying over 30 days ahead takes 1.2. Ties: more
    mentions, then the earlier one. All positions of a pattern are needed, which no built-in function gives.
    """

    @F.pandas_udf("string")
    def read(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: dates_in(t, today) if isinstance(t, str) else None).astype(object)

    return read(text).cast("date")
