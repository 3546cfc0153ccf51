"""The vendor of a receipt, from its first lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.receipts import bad_vendor
from ..functions.text import bound, compact, vendor_key
from .amounts import PARTS, has_money, tidy_lines

#: Lines that are looked at.
FIRST_LINES = 28
# Words of lines that name no vendor, and titles of documents.
BAD_WORDS = [
    "영수증", "매출전표", "사업자", "주소", "전화", "대표", "상품", "품명", "번호", "합계", "부가세", "카드", "승인", "일시불", "고객", "문의", "환불", "교환", "감사",
    "포인트", "멤버십", "스탬프", "스탭프", "테이블명", "판매시간", "판매사원", "수량", "단가", "금액", "교환권", "포광번호", "주번호", "주문번호",
    "사업자번호", "사업자등록번호", "상품명", "제품명", "총액", "공급가", "공급가액", "테이블", "주문자", "고객수", "받을금액", "받은금액", "결제금액",
]
TITLES = [
    "중간계산", "중간계산서", "숲간계산서", "계산서", "간이영수증", "카드영수증", "현금영수증", "카드매출전표", "신용승인", "승인전표", "거래명세서", "거래명세표", "주문서", "접수증",
    "판매영수증", "매출영수증", "영수증서", "전표번호", "전표출력",
]
LABELS = r"(?i)^\s*[\[(【]?(매장명|가맹점명|상호명|상호|업체명|상\s*호)[\])】]?\s*[:：]?\s*"
OWNERS = r"(?isU)\s+(성명|대표자|사업장|주소|전화|TEL)\b.*$"
BESIDE = r"(?s)^(.*?)(?:[0-9]{3}[-\s]?[0-9]{2}[-\s]?[0-9]{5}|TEL|Tel|tel|전화).*$"
STOPS = "상품명|제품명|품명|수량|합계|총액|판매|결제|승인|부가세|공급가액|공급가|과세"
PLACES = r"[가-힣0-9]+로[0-9]*|[가-힣0-9]+길[0-9]*|번길|상가동|[0-9]+층|[0-9]+호"
SHOPS = "㈜|주식회사|점|마트|매장|상점|상회|상사|센터|가게"


def labelled_name(line: Column) -> Column:
    """A tidy line without a label before the vendor's name and without the owner, address or telephone behind it."""
    text = F.trim(F.regexp_replace(F.trim(F.regexp_replace(line, LABELS, "")), OWNERS, ""))
    return F.regexp_replace(text, r"^[ :\-/\[\]]+|[ :\-/\[\]]+$", "")


def excluded(text: Column) -> Column:
    """Whether a text is a title, has a word that rules a vendor out, or numbers, amounts, addresses."""
    small = F.lower(F.regexp_replace(text, r"(?U)[\s\[\](){}【】<>:：,._\-|/\\'\"`·]+", ""))

    def judged(c: Column) -> Column:
        # a title at the start is among the titles that rule out anywhere
        return (c == "") | c.rlike("|".join(BAD_WORDS + TITLES)) | c.rlike(r"[0-9]{2,}|@|www|http|\.com") | c.rlike(PLACES)

    return bound(small, judged) | has_money(text)


def vendors(docs: DataFrame, key: str, text: str = "text", corrections: list[tuple[str, str]] | None = None) -> DataFrame:
    """(key, vendor, by) of each document; without a likely line vendor is null.

    Of the first lines, up to one of sale or payment: the first whose name stands before a number or telephone, or is
    in ``corrections`` (a short list of wrong and right names, the later of equal ones counting), by ``line`` or ``dictionary``;
    else the line with most points, by ``points``: early lines, words of shops, nothing but letters. ``key`` is unique.
    """
    known = {}
    for wrong, right in corrections or []:
        known[wrong] = right
    keys = F.array(*[F.struct(vendor_key(F.lit(w)).alias("k"), F.lit(r).alias("v")) for w, r in known.items()]) if known else F.array().cast("array<struct<k:string,v:string>>")

    def corrected(name: Column) -> Column:
        same = lambda own: F.get(F.filter(keys, lambda x: x["k"] == own), F.lit(0))["v"]
        within = lambda own: F.get(F.filter(keys, lambda x: (x["k"] != "") & F.contains(own, x["k"])), F.lit(0))["v"]
        return bound(vendor_key(name), lambda own: F.coalesce(same(own), within(own))) if known else F.lit(None).cast("string")

    def usable(text: Column) -> Column:
        return ~excluded(text) & ~bad_vendor(text)

    def beside(name: Column) -> Column:
        """What stands before a number or telephone, corrected, if it can be a vendor."""
        part = F.when(name.rlike(BESIDE), F.regexp_replace(F.regexp_extract(name, BESIDE, 1), r"^[ :\-/\t]+|[ :\-/\t]+$", ""))
        right = bound(part, lambda x: F.when((x != "") & F.length(compact(x)).between(2, 30), F.coalesce(corrected(x), x)))
        return bound(right, lambda x: F.when((F.length(F.regexp_replace(x, "[^가-힣A-Za-z]", "")) >= 2) & usable(x), F.trim(x)))

    def sure(name: Column) -> Column:
        listed = bound(corrected(name), lambda x: F.when(usable(x), F.trim(x)))
        told = lambda by: lambda x: F.when(x.isNotNull(), F.struct(x.alias("v"), F.lit(by).alias("by")))
        return F.coalesce(bound(beside(name), told("line")), bound(listed, told("dictionary")))

    def rank(no: Column, name: Column, c: Column) -> Column:
        possible = (
            (F.length(c) <= 42)
            & ~c.rlike(r"^[\[\]0-9A-Za-z\-_.:]+$")
            & ((F.length(c) > 2) | c.rlike("[가-힣]{2,}"))
            & ~(name.rlike(r"^[A-Za-z\s]+$") & (F.length(name) < 4))
            & ~c.rlike("[가-힣0-9]+로[0-9]*|[가-힣0-9]+길[0-9]*|번길|상가동|층")
        )
        points = F.lit(100) - no + F.when(name.rlike(SHOPS), 40).otherwise(0) + F.when(name.rlike("^[가-힣A-Za-z ]{3,20}$"), 20).otherwise(0)
        return F.when(possible, F.struct(points.alias("p"), (-no).alias("n"), name.alias("name")))

    def before_stop(rows: Column) -> Column:
        stop = F.array_position(F.transform(rows, lambda r: r["c"].rlike(STOPS)), True)
        return bound(stop, lambda at: F.when(at > 0, F.slice(rows, F.lit(1), at.cast("int") - 1)).otherwise(rows))

    def chosen(rows: Column) -> Column:
        first = F.get(F.filter(F.transform(rows, lambda r: sure(r["name"])), lambda x: x.isNotNull()), F.lit(0))
        most = F.array_max(F.transform(rows, lambda r: rank(r["no"], r["name"], r["c"])))["name"]
        by_points = bound(most, lambda name: F.when(name.isNotNull() & ~bad_vendor(name), F.struct(name.alias("v"), F.lit("points").alias("by"))))
        return F.coalesce(first, by_points)

    # all in one row of each document; they are dealt first: few bytes, much work, so the parts are many and never put together
    docs = docs.select(key, text).repartition(PARTS, key)
    named = F.transform(F.slice(tidy_lines(F.col(text)), 1, FIRST_LINES), lambda x, i: bound(labelled_name(x), lambda name: F.struct(i.alias("no"), name.alias("name"), compact(name).alias("c"))))
    rows = bound(F.filter(named, lambda r: (F.length(r["c"]) >= 2) & ~excluded(r["name"])), before_stop)
    return docs.select(key, F.explode(F.array(bound(rows, chosen))).alias("found")).select(key, F.col("found.v").alias("vendor"), F.col("found.by").alias("by"))
