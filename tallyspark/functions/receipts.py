"""What single texts and amounts of receipts say: vendors, payment, numbers of businesses, totals, cell values, summaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import first_present, vendor_key

# What a vendor's name never holds.
NO_VENDOR = (
    r"영수증|매출전표|고객용|재발행|전표|\[[0-9A-Za-z\s]+\]",
    r"상품명|제품명|품명|상품|수량|단가|금액|테이블명|판매시간|판매사원",
    r"합계|총액|부가세|공급가액|공급가|과세|면세|판매|가액|세액",
    r"카드|승인|결제|일시불|포인트|멤버십|스탬프|스탭프",
    r"전화|tel|fax|주소|본사|대표|사업자|번호",
    r"문의|교환|환불|이벤트|쿠폰|적립",
)
# Products and options, which are vendors only beside one of the words after them.
PRODUCTS = (
    r"라떼|커피|아메리카노|에이드|스무디|티|차|버거|샌드|샌드위치|빵|케이크|"
    r"우동|카츠|가라아게|치킨|라멘|국수|돈까스|돈가스|소주|맥주|김치전|모듬전|파전|"
    r"물티슈|키친타올|타올|티슈|봉투|쇼핑백|컵|비누|가위|패치|핸드워시|"
    r"ICE|HOT|SIZE|아이스|옵션|단품"
)
SHOPS = r"점|마트|식당|카페|전집|베이커리|익스프레스|프레스|바게뜨|BAGUETTE"
# Messages of states; those of the first list give way to an error message.
OPEN_MESSAGES = {"NEED_REVIEW": "검토가 필요한 항목입니다.", "NEED_SUPPLEMENT": "증빙 보완이 필요한 항목입니다.", "FAILED": "처리 중 오류가 발생했습니다."}
MESSAGES = {"QUEUED": "AI 처리 대기 중입니다.", "UPLOADED": "업로드 접수 상태입니다.", "EXTRACTING": "AI 처리 중입니다.", "OCR_PROCESSING": "OCR 처리 중입니다.", "AI_PROCESSING": "AI 처리 중입니다.", "NORMAL": "정상 처리되었습니다.", "CONFIRMED": "확정 완료되었습니다."}


def bad_vendor(name: Column) -> Column:
    """Whether a text can't be a vendor: too short or long, settlement words, products, numbers, addresses. Null: true."""
    text = F.trim(F.coalesce(name, F.lit("")))
    key = vendor_key(text)
    tests = [
        (F.length(key) < 2) | (F.length(key) > 40),
        *[text.rlike("(?i)" + p) for p in NO_VENDOR],
        text.rlike("(?i)" + PRODUCTS) & ~text.rlike("(?i)" + SHOPS),
        text.rlike(r"^[0-9\s,.:/\-()원]+$"),
        text.rlike(r"[0-9]{2,4}-[0-9]{3,4}-[0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{5}"),
        text.rlike(r"[가-힣A-Za-z0-9]+로\s*[0-9]+|[가-힣A-Za-z0-9]+길\s*[0-9]+|번길"),
        F.length(F.regexp_replace(text, "[^가-힣A-Za-z]", "")) < 2,
    ]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def payment_method(text: Column) -> Column:
    """Cash before easy payment before card; none of them: null. The names are fixed values."""
    has = lambda *words: text.rlike("|".join(words))
    return F.when(has("현금"), "현금").when(has("간편결제"), "간편결제").when(has("카드", "신용", "체크", "승인"), "카드/간편결제")


def business_number(text: Column) -> Column:
    """The first number of ten digits written 3-2-5, with hyphens, blanks or nothing between; none: null."""
    pattern = r"(?<![0-9])([0-9]{3})[-\s]?([0-9]{2})[-\s]?([0-9]{5})(?![0-9])"
    part = lambda k: F.regexp_extract(text, pattern, k)
    return F.when(text.rlike(pattern), F.concat_ws("-", part(1), part(2), part(3)))


def repaired_total(total: Column, source: Column, items: Column, supply: Column, tax: Column) -> Column:
    """struct(total, source): the total, or what supply and tax or the items' sum say instead where they are near it.

    ``items`` is the sum of the items' amounts (0 or null: none). A null total takes what there is; source names why.
    """
    items, taxed = F.coalesce(items, F.lit(0.0)), supply + tax
    agree = (items > 0) & (F.abs(items - taxed) <= F.greatest(F.lit(10.0), taxed * 0.01))
    out = lambda value, name: F.struct(value.cast("double").alias("total"), name.alias("source"))
    cases = [
        (agree & total.isNull(), F.bround(items), "item_sum_matches_supply_tax"),
        (agree & (F.abs(total - items) <= F.greatest(F.lit(1000.0), items * 0.04)), F.bround(items), "corrected_by_item_sum_and_supply_tax"),
        (taxed.isNotNull() & total.isNull(), F.bround(taxed), "supply_tax_sum"),
        (F.abs(total - taxed) <= F.greatest(F.lit(1200.0), taxed * 0.05), F.bround(taxed), "corrected_by_supply_tax_sum"),
        ((items > 0) & (source == "max_money_fallback") & (total.isNull() | (total > items * 1.3)), F.bround(items), "corrected_by_item_sum_from_bad_max_fallback"),
    ]
    return F.coalesce(*[F.when(F.coalesce(holds, F.lit(False)), out(value, F.lit(name))) for holds, value, name in cases], out(total, source))


def cell_value(text: Column) -> Column:
    """struct(number, text): a number, also with thousands commas, else the trimmed text; null gives nulls."""
    one = F.trim(text)
    number = F.when(one.rlike(r"^-?[0-9]+(,[0-9]{3})*(\.[0-9]+)?$"), F.replace(one, F.lit(","), F.lit("")).try_cast("double"))
    return F.struct(number.alias("number"), F.when(number.isNull(), one).alias("text"))


def status_message(status: Column, error: Column) -> Column:
    """What a file's state says; an error message goes first where the state is open, and alone if it is unknown."""
    out = None
    for code, message in OPEN_MESSAGES.items():
        out = F.when(status == code, F.coalesce(error, F.lit(message))) if out is None else out.when(status == code, F.coalesce(error, F.lit(message)))
    for code, message in MESSAGES.items():
        out = out.when(status == code, message)
    return out.otherwise(F.coalesce(error, F.lit("-")))


def route_summary(start: Column, end: Column, vehicle: Column, route: Column) -> Column:
    """``vehicle start → end`` if both are there and differ, else the route as it was written; blank texts are missing."""
    there = lambda c: F.nullif(F.trim(c), F.lit(""))
    s, e = there(start), there(end)
    return F.coalesce(F.when(s != e, F.concat(F.coalesce(there(vehicle), F.lit("버스")), F.lit(" "), s, F.lit(" → "), e)), F.trim(route), F.lit(""))


def item_summary(names: Column, otherwise: Column) -> Column:
    """The first of the different names and how many more there are; no name: ``otherwise``."""
    kept = F.array_distinct(F.filter(names, lambda x: F.trim(x) != ""))
    n = F.size(kept)
    return F.when(n >= 2, F.concat(kept[0], F.lit(" 외 "), (n - 1).cast("string"), F.lit("건"))).when(n == 1, kept[0]).otherwise(first_present(otherwise))


def toggled(chosen: Column, visible: Column) -> Column:
    """All visible keys go if all are chosen, else those that are missing come. Orders stay."""
    return F.when(F.size(F.array_except(visible, chosen)) == 0, F.array_except(chosen, visible)).otherwise(F.array_union(chosen, visible))


def mean_share(values: Column) -> Column:
    """Aggregate: the mean of the values within 0 and 1, to four digits; none: null."""
    return F.bround(F.avg(F.when(values.between(0, 1), values)), 4)
