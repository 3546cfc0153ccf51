"""The live checks of an extracted document: issues, text quality, evidence, confidence, and what need not be looked at again.

Functions that take ``given`` read a document's facts as columns by name; a fact that is not given counts as missing.
Numbers: total, claim, paid, sale_total, gross, discount, quality, ocr_confidence, engine, confidence, text_quality,
n_amounts, n_dates, candidate_sum, strict_cap, receipt_amount, fare_amount, discount_amount_read. Texts: document_type,
vendor, expense_date, payment_method, category, evidence, departure, arrival, item_state, total_source, status. Flags:
text_empty, handwritten, bad_vendor, weak_vendor, label_vendor, needs_review, llm_used, very_blurry, blurry, dark, small,
low_contrast, supplement_candidate, money_false, vendor_like_item, auto_pass_allowed. Lists: items and candidates
(name, amount), image_issues, reasons, vendor_candidates (texts).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bound
from .validation import ISSUE

# Words that show a category; single letters are no evidence.
EVIDENCE = {
    "MEAL": ["식당", "음식점", "분식", "한식", "중식", "일식", "양식", "국밥", "찌개", "탕", "김치", "두부김치", "전집", "김치전", "모듬전", "파전", "전병", "소주", "맥주", "막걸리", "하이볼", "음료", "커피", "라떼", "카페", "베이커리", "빵", "샌드위치", "치킨", "피자", "버거", "도시락", "메뉴", "테이블명"],
    "TRANSPORT": ["택시", "버스", "지하철", "KTX", "SRT", "철도", "승차권", "운임", "요금", "주차", "통행료", "터미널", "출발", "도착", "승차"],
    "LODGING": ["호텔", "모텔", "숙박", "리조트", "게스트하우스", "객실", "체크인", "체크아웃"],
    "FUEL": ["주유", "휘발유", "경유", "LPG", "충전소", "유류", "리터"],
    "COMMUNICATION": ["통신", "휴대폰", "인터넷", "전화요금", "통신요금"],
    "MATERIAL": ["자재", "철물", "건재", "배관", "전선", "케이블", "시멘트", "레미콘", "목재"],
    "SUPPLIES": ["문구", "소모품", "비품", "사무용품", "테이프", "장갑", "마스크", "봉투", "파일", "클립"],
}
# Categories for which one word is enough.
ONE_IS_ENOUGH = ("TRANSPORT", "FUEL", "LODGING")
# Words of settlement, payment and promotion, which name no item.
NON_ITEMS = ("합계", "총액", "부가세", "공급가액", "승인금액", "결제금액", "카드번호", "승인번호", "포인트", "거스름돈", "이벤트", "응모")
# Image faults that always ask for a review.
SEVERE = ("심한 흐림", "매우 흐림", "너무 어두움", "너무 밝음", "파일 판독 실패")
# Words of receipts that text quality counts.
RECEIPT_WORDS = ("영수", "판매", "상품", "수량", "단가", "금액", "부가세", "공급", "승인", "카드", "테이블", "사업자")
# Facts without which a document goes to the language model.
REQUIRED = ("expense_date", "vendor", "total")


class _Facts:
    def __init__(self, given: Mapping[str, Column]):
        self.given = given

    def number(self, *names: str) -> Column:
        """The first that is there and not 0, else the last."""
        found = [self.given[n].cast("double") if n in self.given else F.lit(None).cast("double") for n in names]
        return F.coalesce(*[F.nullif(c, F.lit(0.0)) for c in found[:-1]], found[-1])

    def text(self, name: str) -> Column:
        return F.nullif(self.given[name].cast("string"), F.lit("")) if name in self.given else F.lit(None).cast("string")

    def flag(self, name: str) -> Column:
        return F.coalesce(self.given[name], F.lit(False)) if name in self.given else F.lit(False)

    def list(self, name: str, of: str = "struct<name:string,amount:double>") -> Column:
        empty = F.array().cast(f"array<{of}>")
        return F.coalesce(self.given[name].cast(f"array<{of}>"), empty) if name in self.given else empty

    def count(self, name: str) -> Column:
        return F.coalesce(self.given[name], F.lit(0)) if name in self.given else F.lit(0)

    @property
    def kind(self) -> Column:
        return F.upper(F.coalesce(self.text("document_type"), F.lit("")))

    @property
    def by_hand(self) -> Column:
        return F.contains(self.kind, F.lit("HANDWRITTEN")) | self.flag("handwritten")


def item_sum(items: Column) -> Column:
    """A missing amount counts 0."""
    return F.aggregate(items, F.lit(0.0), lambda a, x: a + F.coalesce(x["amount"], F.lit(0.0)))


def expected_total(total: Column, sale_total: Column, discount: Column) -> Column:
    """What the items should come to: the sale's total, else the total and its discount."""
    return F.coalesce(sale_total, total + F.coalesce(discount, F.lit(0.0)))


def _made(holds: Column, code: str, field: str | Column, severity: str = "WARNING", action: str = "REVIEW", penalty: float | None = None) -> Column:
    field = F.lit(field) if isinstance(field, str) else field
    return F.when(F.coalesce(holds, F.lit(False)), F.struct(F.lit(code), field, F.lit(severity), F.lit(action), F.lit(penalty).cast("double")).cast(ISSUE))


def _item_issues(items: Column) -> Column:
    def each(x: Column, i: Column) -> Column:
        field = F.concat(F.lit("items["), i.cast("string"), F.lit("].item_name"))
        name = F.coalesce(x["name"], F.lit(""))
        no_item = F.exists(F.array(*[F.lit(w) for w in NON_ITEMS]), lambda w: F.contains(name, w))
        return F.coalesce(_made(name == "", "ITEM_NAME_EMPTY", field), _made(no_item, "ITEM_NON_ITEM_KEYWORD", field, "ERROR"))

    return F.transform(items, each)


def live_issues(given: Mapping[str, Column]) -> Column:
    """array<issue> in the order in which the checks are made. A null in any fact is a missing fact."""
    f = _Facts(given)
    total, sale, discount = f.number("claim", "paid", "total"), f.number("sale_total", "gross"), F.coalesce(f.number("discount"), F.lit(0.0))
    items = f.list("items")
    spent, expected = item_sum(items), expected_total(total, sale, discount)
    engine, quality, text_quality = f.number("engine"), f.number("quality", "ocr_confidence"), f.number("text_quality")
    faults = f.list("image_issues", "string")
    severe = F.array(*[F.lit(x) for x in SEVERE])
    weak_read = F.coalesce(f.number("engine", "ocr_confidence") < 0.80, F.lit(False)) | (F.coalesce(text_quality, F.lit(0.0)) < 0.62)
    minor = F.size(F.array_except(faults, severe)) > 0
    vendor, evidence, category = f.text("vendor"), f.text("evidence"), F.upper(F.trim(f.text("category")))
    transport = f.kind == "TRANSPORT_RECEIPT"
    reasons = F.filter(f.list("reasons", "string"), lambda r: r != "")
    fare, cut, received = f.number("fare_amount"), f.number("discount_amount_read"), f.number("receipt_amount")
    before = [
        _made(f.by_hand, "HANDWRITTEN_RECEIPT_REVIEW", "document_type"),
        _made(f.flag("text_empty"), "OCR_TEXT_EMPTY", "ocr_text", "ERROR", "SUPPLEMENT"),
        _made(f.text("expense_date").isNull(), "REQ_EXPENSE_DATE", "expense_date"),
        _made(vendor.isNull(), "REQ_VENDOR_NAME", "vendor_name"),
        _made(vendor.isNotNull() & f.flag("weak_vendor"), "VENDOR_NAME_WEAK_OCR", "vendor_name"),
        _made(F.coalesce(total, F.lit(0.0)) <= 0, "REQ_TOTAL_AMOUNT", "total_amount", "ERROR", "SUPPLEMENT"),
        _made(F.arrays_overlap(faults, severe) | (minor & weak_read), "OCR_INPUT_QUALITY_REVIEW", "ocr_text"),
        _made(engine < 0.78, "OCR_ENGINE_CONFIDENCE_LOW", "ocr_text"),
        _made(text_quality < 0.62, "OCR_TEXT_SEMANTIC_QUALITY_LOW", "ocr_text"),
        _made(vendor.isNull() & (F.size(f.list("vendor_candidates", "string")) > 0), "VENDOR_CANDIDATE_NOT_CONFIRMED", "vendor_name"),
        _made((quality >= 0.90) & (engine < 0.80), "OCR_IMAGE_TEXT_CONFIDENCE_GAP", "ocr_text"),
    ]
    asked = F.transform(reasons, lambda r: _made(r.isNotNull(), "PARSER_REVIEW_REQUIRED", "extracted_data"))
    conflict = [_made(evidence != category, "CATEGORY_EVIDENCE_CONFLICT", "expense_category_name", penalty=0.15)]
    after = [
        _made((f.kind == "ITEM_RECEIPT") & (F.size(items) == 0), "ITEMS_EMPTY", "items"),
        _made((F.size(items) > 0) & (spent != expected), "ITEM_SUM_TOTAL_MISMATCH", "amount"),
        _made((discount != 0) & (F.abs(sale - discount - total) > F.greatest(F.lit(1.0), total * 0.01)), "SALE_DISCOUNT_PAID_MISMATCH", "amount"),
        _made(transport & (received != total), "TRANSPORT_RECEIPT_AMOUNT_MISMATCH", "total_amount", "ERROR"),
        _made(transport & cut.isNotNull() & (total == fare), "TRANSPORT_FARE_USED_AS_TOTAL", "total_amount", "ERROR"),
        _made(transport & (total == cut), "TRANSPORT_DISCOUNT_USED_AS_TOTAL", "total_amount", "ERROR"),
        _made(transport & (f.text("departure").isNull() | f.text("arrival").isNull()), "TRANSPORT_ROUTE_UNCERTAIN", "route"),
    ]
    return F.array_compact(F.concat(F.array(*before), asked, F.array(*conflict), _item_issues(items), F.array(*after)))


def text_quality(text: Column) -> Column:
    """0 to 1: amounts, dates, receipt words, letters and digits speak for a text, short and noisy lines against it.

    Null, empty and blank texts are 0.
    """
    # an empty line between a carriage return and a line feed is dropped with the others; single blanks stay as they are
    clean = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[\n\r\x0B\f\x1C-\x1E\x85  ]"), lambda x: F.trim(F.regexp_replace(x, r"\s{2,}|[\t\n\x0B\f\r]", " "))), lambda x: x != "")
    return bound(clean, lambda lines: bound(F.array_join(lines, "\n"), lambda whole: _quality_of(lines, whole)))


def _quality_of(clean: Column, whole: Column) -> Column:
    """``text_quality`` of the lines and of all of them together."""
    digits = lambda c: F.length(F.regexp_replace(c, "[^0-9]+", ""))
    letter = "[가-힣A-Za-z]"

    def noisy(c: Column) -> Column:
        amount = c.rlike(r"[,.][0-9]{3}|원|합계|금액|결제|판매|영수|운임")
        one_letter = ~c.rlike(f"{letter}[^가-힣A-Za-z]*{letter}")
        return (F.length(c) <= 2) | (one_letter & (((digits(c) >= 4) & ~amount) | ~c.rlike("[가-힣A-Za-z0-9]")))

    n = F.size(clean)
    short = F.size(F.filter(clean, lambda line: bound(F.replace(line, F.lit(" ")), noisy))) / F.greatest(n, F.lit(1))
    words = sum((F.contains(whole, F.lit(w)).cast("int") for w in RECEIPT_WORDS), F.lit(0))
    plus = lambda holds, points: F.when(holds, points).otherwise(0.0)
    score = (
        F.lit(0.45)
        + plus(F.regexp_count(whole, F.lit(r"(?=[0-9])(?<![0-9])(?:[0-9]{1,3}(?:[,.][0-9]{3})+|[0-9]{4,7})\s*원?(?![0-9])")) >= 2, 0.15)
        + plus(F.regexp_count(whole, F.lit(r"20[0-9]{2}[-./년\s]*[0-9]{1,2}[-./월\s]*[0-9]{1,2}")) >= 1, 0.12)
        + plus(words >= 3, 0.12)
        + plus(F.length(F.regexp_replace(whole, "[^가-힣]+", "")) >= 20, 0.08)
        + plus(digits(whole) >= 20, 0.04)
        - bound(short, lambda s: F.when(s > 0.45, 0.20).when(s > 0.30, 0.10).otherwise(0.0))
    )
    return F.when(n == 0, 0.0).otherwise(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 4))


def category_evidence(text: Column, words: Mapping[str, Sequence[str]] = EVIDENCE) -> Column:
    """struct(code, score): the category with the most different words in the text, without blanks and case.

    The code is null below two words (below one for ``ONE_IS_ENOUGH``) and if the next category is less than two
    words behind; equal counts go by the order of ``words``. No words, or a null text: (null, 0).
    """
    compact = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", ""))
    counts = []
    for place, (code, each) in enumerate(words.items()):
        keys = [k for k in (w.replace(" ", "").lower() for w in each) if len(k) > 1]
        hits = sum((F.contains(compact, F.lit(k)).cast("int") for k in keys), F.lit(0))
        counts.append(F.struct(hits.alias("n"), F.lit(-place).alias("at"), F.lit(code).alias("code")))
    ranked = F.reverse(F.array_sort(F.filter(F.array(*counts), lambda x: x["n"] > 0)))
    top, second = F.try_element_at(ranked, F.lit(1)), F.coalesce(F.try_element_at(ranked, F.lit(2))["n"], F.lit(0))
    enough = (top["n"] >= 2) | top["code"].isin(*ONE_IS_ENOUGH)
    clear = (second == 0) | (top["n"] - second >= 2)
    return F.struct(F.when(enough & clear, top["code"]).alias("code"), F.coalesce(top["n"], F.lit(0)).alias("score"))


def document_confidence(given: Mapping[str, Column]) -> Column:
    """.5 and what the facts add or take away, below every cap that applies, within 0 and .99, to four digits."""
    f = _Facts(given)
    sale, total = f.number("sale_total", "gross"), f.number("total")
    expected = expected_total(total, sale, f.number("discount"))
    items, candidates = f.list("items"), f.list("candidates")
    vendor, quality = f.text("vendor"), f.number("quality", "ocr_confidence")
    agrees = lambda rows, yes, no: F.when(expected.isNull(), 0.0).when(F.bround(item_sum(rows)) == F.bround(expected), yes).otherwise(no)
    plus = lambda holds, points: F.when(holds, points).otherwise(0.0)
    score = (
        F.lit(0.50)
        + F.when(vendor.isNull(), 0.0).when(f.flag("bad_vendor"), -0.08).otherwise(0.10)
        + plus(f.text("expense_date").isNotNull(), 0.10)
        + plus(total.isNotNull(), 0.12)
        + plus(f.text("payment_method").isNotNull(), 0.04)
        + F.when(F.size(items) > 0, agrees(items, 0.08, -0.12) + 0.07).when(F.size(candidates) > 0, agrees(candidates, 0.05, -0.06) + 0.02).otherwise(-0.10)
        + F.when(quality < 0.35, -0.25).when(quality < 0.50, -0.16).when(quality < 0.65, -0.08).when(quality > 0.82, 0.02).otherwise(0.0)
        - plus(f.flag("llm_used"), 0.01)
        - plus(f.flag("needs_review"), 0.05)
    )
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(0.99), score, *_caps(f, items))), 4)


def _caps(f: _Facts, items: Column) -> list[Column]:
    """The caps that a document's facts set, null where they set none; ``least`` passes nulls over."""
    total, n_amounts, few = f.number("total"), f.count("n_amounts"), F.size(items) <= 1
    goal = F.coalesce(f.number("sale_total", "gross"), total)
    strict_goal = expected_total(f.number("total", "claim", "paid"), f.number("sale_total", "gross"), f.number("discount"))
    borne_out = F.coalesce(F.bround(strict_goal) == F.bround(f.number("candidate_sum")), F.lit(False))
    unsure = F.when(borne_out, 0.72).otherwise(0.55)
    by_hand = F.when(total.isNull(), 0.25).otherwise(0.35)
    state = F.coalesce(f.text("item_state"), F.lit(""))
    return [
        F.when(f.flag("very_blurry"), 0.35).when(f.flag("blurry"), 0.60),
        F.when(f.flag("dark"), 0.75),
        F.when(f.flag("small"), F.when(f.by_hand, 0.25).otherwise(0.85)),
        F.when(f.flag("low_contrast"), 0.85),
        F.when(f.count("n_dates") >= 2, 0.80),
        F.when(f.by_hand | (state == "HANDWRITTEN_REVIEW_ONLY"), by_hand),
        F.when((F.size(items) > 0) & (F.bround(item_sum(items)) != F.bround(goal)), 0.72),
        F.when((n_amounts >= 3) & few, 0.70),
        F.when(f.text("vendor").isNotNull() & f.flag("bad_vendor"), 0.70),
        f.number("strict_cap"),
        F.when(F.startswith(state, F.lit("UNCONFIRMED")), unsure),
        F.when(total.isNull(), 0.30),
        F.when((n_amounts >= 5) & few & ~F.contains(f.kind, F.lit("TRANSPORT")), unsure),
        F.when(f.flag("money_false"), 0.30),
        F.when(f.flag("vendor_like_item"), 0.40),
    ]


def passes(given: Mapping[str, Column]) -> Column:
    """Whether a document needs no second look. A quality, engine score or confidence that is missing doesn't stop it."""
    f = _Facts(given)
    below = lambda value, least: F.coalesce(value < least, F.lit(False))
    allowed = F.coalesce(given["auto_pass_allowed"], F.lit(True)) if "auto_pass_allowed" in given else F.lit(True)
    stops = [
        F.coalesce(f.text("status"), F.lit("")) != "PASS",
        f.flag("needs_review"),
        F.startswith(f.kind, F.lit("HANDWRITTEN")) | f.flag("handwritten"),
        ~allowed,
        f.flag("very_blurry") | f.flag("supplement_candidate"),
        below(f.number("quality", "ocr_confidence"), 0.65),
        below(f.number("engine"), 0.82),
        (f.count("n_amounts") >= 3) & (F.size(f.list("items")) <= 1),
        below(f.number("confidence"), 0.82),
    ]
    out = F.lit(True)
    for stop in stops:
        out = out & ~stop
    return out


def skips_model(given: Mapping[str, Column], forced: bool | None = None, only_when_needed: bool = True) -> Column:
    """struct(skip, reason): whether the rules' result needs no language model, by the first outcome that holds.

    The reasons are fixed values.
    """
    out: Callable[[bool, str], Column] = lambda skip, reason: F.struct(F.lit(skip).alias("skip"), F.lit(reason).alias("reason"))
    if forced is not None:
        return out(True, "강제 LLM 생략") if forced else out(False, "강제 LLM 사용")
    if not only_when_needed:
        return out(False, "환경설정상 LLM 항상 사용")
    f = _Facts(given)
    total, quality, items, vendor = f.number("claim", "paid", "total"), f.number("quality", "ocr_confidence"), f.list("items"), f.text("vendor")
    below = lambda value, least: F.coalesce(value < least, F.lit(False))
    transport = F.contains(f.kind, F.lit("TRANSPORT"))
    fields = {"expense_date": "expense_date", "vendor": "vendor_name", "total": "total_amount"}
    cases = [
        (f.by_hand, True, "수기 영수증: 텍스트 LLM 생략 후 검토"),
        (f.flag("needs_review"), False, "규칙 추출 결과에 검토 사유 존재"),
        (f.flag("very_blurry") | below(quality, 0.65), False, "OCR 품질 낮음"),
        (below(f.number("engine"), 0.82), False, "OCR 엔진 신뢰도 낮음"),
        *[(f.text(k).isNull(), False, f"필수 필드 누락: {fields[k]}") for k in REQUIRED],
        (transport & f.text("departure").isNotNull() & f.text("arrival").isNotNull() & total.isNotNull(), True, "교통 영수증 규칙 검증 충분"),
        (transport, False, "교통 노선/금액 불확실"),
        (f.flag("bad_vendor"), False, "사용처 후보 불확실"),
        (vendor.rlike("매장명|영수증|계산서|상품명|합계|총액"), False, "사용처에 라벨/정산 문구 혼입"),
        ((F.size(items) == 0) | total.isNull(), False, "품목 또는 총액 부족"),
        ((f.count("n_amounts") >= 3) & (F.size(items) <= 1), False, "OCR 금액 후보 대비 상세 품목 부족"),
        (F.coalesce(f.text("total_source"), F.lit("")) == "max_money_fallback", False, "총액 라벨 없는 최대금액 fallback"),
        (F.bround(item_sum(items)) != F.bround(expected_total(total, f.number("sale_total", "gross"), f.number("discount"))), False, "품목 합계와 기준금액 불일치"),
    ]
    return F.coalesce(*[F.when(F.coalesce(holds, F.lit(False)), out(skip, reason)) for holds, skip, reason in cases], out(True, "규칙 추출 및 합계 검증 통과"))


def issue_rows(df: DataFrame, keys: Sequence[str], found: str) -> DataFrame:
    """(keys, place, issue's fields, result_status): a row an issue, a document's errors before its warnings."""
    errors, rest = F.filter(found, lambda x: x["severity"] == "ERROR"), F.filter(found, lambda x: x["severity"] != "ERROR")
    rows = df.select(*keys, F.posexplode(F.concat(errors, rest)).alias("place", "_i")).select(*keys, (F.col("place") + 1).alias("place"), "_i.*")
    return rows.withColumn("result_status", F.when(F.col("action") == "SUPPLEMENT", "NEED_SUPPLEMENT").otherwise("NEED_REVIEW"))


def on_demand(values: DataFrame, keys: Sequence[str], least: float = 0.8) -> DataFrame:
    """(keys, need_review, status, passed): one for each required value that is empty, and one if any confidence is low.

    ``values`` has value, required and confidence; a missing or zero confidence counts as 1.
    """
    empty = F.coalesce("required", F.lit(False)) & (F.coalesce("value", F.lit("")) == "")
    low = F.coalesce(F.nullif(F.col("confidence"), F.lit(0.0)), F.lit(1.0)) < least
    counted = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.count_if(empty) + F.max(low.cast("long"))).alias("need_review"))
    return counted.select(*keys, "need_review", F.when(F.col("need_review") > 0, "NEED_REVIEW").otherwise("NORMAL").alias("status"), F.when(F.col("need_review") > 0, 0).otherwise(F.col("n")).cast("long").alias("passed"))


def top_evidence(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, code, score): like ``category_evidence``, from counted rows (keys, code, score); unclear keys give none."""
    next_score = F.lead("score").over(Window.partitionBy(*keys).orderBy(F.desc("score"), "code"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "code"))
    ranked = scores.withColumns({"_next": F.coalesce(next_score, F.lit(0)), "_place": place}).filter("_place = 1")
    enough = (F.col("score") >= 2) | F.col("code").isin(*ONE_IS_ENOUGH)
    return ranked.filter(enough & ((F.col("_next") == 0) | (F.col("score") - F.col("_next") >= 2))).select(*keys, "code", "score")
