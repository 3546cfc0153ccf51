"""Amounts of receipts by their labels: what was paid, the gross sum, discount, supply, tax and total, each with its source.

A line's amounts are worked out once; every line sees its next five and the one before, so that each label
says what it would give; of each kind the first line that gives something counts. All this is done in
the document's own row: one shuffle by key, whatever the number of kinds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound, compact

#: Parts to which documents are dealt before they are read.
PARTS = 257
# Labels, each list in its order, and what stops the look at the lines below a label.
TOTAL_LABELS = [
    "합계", "총계", "총액", "판매합계", "받을금액", "받은금액", "결제금액", "승인금액", "청구금액", "실결제", "총매출액", "영수액", "영수금액", "갑세", "갑 세", "합세",
    "합계글액", "할계금액", "층매출액", "합계금액", "원금액", "학겨결처금액", "원제금액", "판매 합계", "합계5금액", "합계액", "일계", "일 계", "할계", "할 계", "할거", "합게", "합 계", "총판매금액",
]
TAX_LABELS = ["부가세", "부가가치세", "세액", "부 가 세", "부가", "YIC", "Y1C", "박세", "가치세", "부가 세"]
SUPPLY_LABELS = ["공급가액", "공급가", "물품가액", "과세금액", "공 급가", "커C큰운", "급가액", "급간염가", "관세금액", "과세합계", "과세 합계"]
DISCOUNT_LABELS = ["사용포인트", "포인트사용", "포인트", "할인", "할인금액", "쿠폰", "에누리", "토스페이할인", "할인결제", "할인내역", "쿠폰할인"]
PAID_LABELS = (["승인금액", "결제금액", "실결제금액", "카드결제", "간편결제", "토스페이머니", "머니/계좌"], ["받은금액", "받을금액", "제금액", "영수액", "영수금액"])
GROSS_LABELS = ["합계금액", "합계글액", "할계금액", "총매출액", "층매출액", "판매합계", "판매합계액", "총계", "총액", "합계", "갑세"]
STOPS = {
    "label": "합계|총매출|받은금액|받을금액|결제|승인|카드번호|공급가|물품가액|과세|부가세|세액",
    "paid": "공급가|물품가액|과세|부가세|부가|가세|세액|멤버십|포인트",
    "gross": "받은금액|받을금액|결제|승인|카드|부가세|세액|포인트|할인|멤버십",
    "discount": "적립|가용|승인|카드|멤버십|상품명|수량",
    "alone": "카드번호|승인번호|전화|TEL|포인트|적립",
    "total": "부가세|세액|포인트|승인번호|카드번호|전화",
}
TAX_CONTEXT = "공급가|물품가액|과세|부가세|부가|가세|세액"
NO_DISCOUNT = "적립포인트|가용포인트|적립대상|멤버십번호|상품명|제품명|품명|수량|포인트카드|카드/간편결제|간편결제|승인금액"
DISCOUNT_KINDS = "포인트|쿠폰|에누리|할인금액|할인결제|천원할인"
NO_FALLBACK = "사업자|전화|TEL|승인번호|카드번호|거래번호|주문번호|적립|포인트|멤버십|번호:|체번호"
IDENTIFIERS = "tel|phone|카드번호|승인번호|거래번호|주문번호|멤버십|적립|포인트|사업자|대표|주소|번호:|체번호"
MONEY_WORDS = "원|금액|합계|결제|판매|받은|영수|운임|요금"
MONEY = r"(?<![0-9])([0-9]{4,6}\.[0-9]{2}|[0-9]{1,3}(?:[,.][0-9]{3})+|[0-9]{3,8})\s*원?(?![0-9])"
BROKEN = r"(?<![0-9])([0-9]{1,3}\s*[,.'’`~\-\s]{1,3}\s*[0-9OoUuDdIl|]{2,5})(?![0-9])"
BROKEN_ANYWHERE = r"[0-9]{1,3}\s*[,.'’`~\-\s]{1,3}\s*[0-9OoUuDdIl|]{2,4}"
LABELLED = "합계|총액|금액|결제|승인|받은|받을|영수|공급대가|일계|할계|할거"


def _words(labels: list[str]) -> str:
    """A pattern of labels as they stand in a line without blanks."""
    return "|".join(dict.fromkeys(x.replace(" ", "") for x in labels))


def tidy_lines(text: Column) -> Column:
    """The lines of a text that are not blank, without marks of currency, white space collapsed; a null text has none."""
    tidy = F.transform(F.split(F.coalesce(text, F.lit("")), "[\r\n]"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "[₩￦]", ""), r"(?U)\s+", " ")))
    return F.filter(tidy, lambda x: x != "")


def label_number(raw: Column) -> Column:
    """A double of the digits, letters that stand for 0 and 1 read so; 0 or 100,000,000 and more is none."""
    digits = F.regexp_replace(F.translate(raw, "OoAaIl|", "0000111"), "[^0-9]", "")
    return bound(digits, lambda d: F.when(F.length(d) <= 18, d.try_cast("double")).cast("double"))


def _numbers(line: Column, pattern: str, group: int, keep: Callable[[Column], Column] | None = None, below: float = 1e8) -> Column:
    raw = F.regexp_extract_all(line, F.lit(pattern), F.lit(group))
    raw = F.filter(raw, keep) if keep else raw
    return F.filter(F.transform(raw, label_number), lambda n: (n > 0) & (n < below))


def identifier_line(line: Column) -> Column:
    """Telephone, card, approval and business numbers, addresses, and long numbers without a mark of money."""
    digits = lambda c: F.length(F.regexp_replace(c, "[^0-9]", ""))
    return bound(
        compact(line),
        lambda c: (c != "")
        & (F.lower(c).rlike(IDENTIFIERS) | c.rlike("[가-힣0-9]+로[0-9]*|[가-힣0-9]+길[0-9]*|번길|[0-9]+층") | ((digits(c) >= 7) & ~c.rlike(rf"[,.][0-9]{{3}}|{MONEY_WORDS}")) | c.rlike("[0-9]{2,4}-[0-9]{2,4}-[0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{5}")),
    )


def _plain_money(line: Column) -> Column:
    n = lambda raw: F.length(F.regexp_replace(raw, "[^0-9]", ""))
    return bound(line.rlike(f"[,.]|{MONEY_WORDS}"), lambda marked: _numbers(line, MONEY, 1, lambda raw: marked | n(raw).between(4, 5)))


def money_values(line: Column) -> Column:
    """array<double>: amounts in a line, in order; bare numbers of up to three or from six digits on need a word of money."""
    return F.when(identifier_line(line), F.array().cast("array<double>")).otherwise(_plain_money(line))


def has_money(line: Column) -> Column:
    """Whether a line is one of identifiers or has an amount."""
    return identifier_line(line) | (F.size(_plain_money(line)) > 0)


def broken_values(line: Column) -> Column:
    """Amounts whose digits are torn apart or misread, beside a label or where nothing else would look like them."""
    context = compact(line).rlike(LABELLED) | line.rlike(BROKEN_ANYWHERE)
    raw = F.transform(F.regexp_extract_all(line, F.lit(BROKEN), F.lit(1)), lambda r: F.regexp_replace(F.translate(r, "OoUuDdIl|", "000000111"), "[^0-9]", ""))
    found = F.filter(F.transform(F.filter(raw, lambda d: F.length(d).between(4, 7)), lambda d: d.cast("double")), lambda x: (x > 0) & (x < 1e7))
    return F.when(context, F.array_distinct(found)).otherwise(F.array().cast("array<double>"))


def label_values(line: Column) -> Column:
    """Amounts beside a label: as written, then broken ones that are not among them."""
    money = money_values(line)
    return F.concat(money, F.array_except(broken_values(line), money))


def loose_values(line: Column) -> Column:
    """Amounts of discounts and taxes, where small ones count, thousands in words first."""
    thousands = F.transform(F.regexp_extract_all(line, F.lit(r"(?<![0-9])([0-9]{1,3})\s*천\s*원?"), F.lit(1)), lambda r: r.cast("double") * 1000)
    return F.concat(thousands, _numbers(line, r"(?<![0-9])([0-9]{1,3}(?:[,.][0-9]{3})+|[0-9]{1,7})(?![0-9])", 1, below=1e7))


def glued_values(line: Column) -> Column:
    """Two amounts written as one: both of 28,1812,819, and both of 3,000273."""
    pair, tail = r"(?<![0-9])([0-9]{1,3}[,.][0-9]{3})([0-9]{1,3}[,.][0-9]{3})(?![0-9])", r"(?<![0-9])([0-9]{1,3}[,.][0-9]{3})([0-9]{1,3})(?![0-9])"

    def both(pattern: str) -> Column:
        firsts, seconds = _every(line, pattern, 1), _every(line, pattern, 2)
        return F.flatten(F.zip_with(firsts, seconds, lambda a, b: F.array_compact(F.array(_positive(a), _positive(b)))))

    # both have a group of three digits with another digit behind it
    return F.when(line.rlike("[,.][0-9]{4}"), F.concat(both(pair), both(tail))).otherwise(F.when(line.isNotNull(), F.array().cast("array<double>")))


def _every(line: Column, pattern: str, group: int) -> Column:
    return F.transform(F.regexp_extract_all(line, F.lit(pattern), F.lit(group)), label_number)


def _positive(n: Column) -> Column:
    return F.when(n > 0, n)


def total_label(c: Column) -> Column:
    """Whether a line without blanks has a label of a total, also a misread one."""
    bare = F.translate(c, "5SsOo", "")
    return (
        c.rlike(_words(TOTAL_LABELS))
        | (c.rlike("합계") & c.rlike("금액|액|계"))
        | (c.rlike("총") & c.rlike("금액|액|계|매출"))
        | (c.rlike("합.?계") & c.rlike("금.?액|액"))
        | (c.rlike("할.?계|할.?거|일.?계") & c.rlike("[0-9]"))
        | bare.rlike("합계금액|합계액|총액|총계|받은금액|받을금액")
    )


def _last(values: Column) -> Column:
    return F.get(F.reverse(values), F.lit(0))


def _said(value: Column, source: Column) -> Column:
    return F.when(value.isNotNull(), F.struct(value.alias("amount"), source.alias("source")))


def _below(row: Column, n: int, stop: str | None, value: Callable[[Column], Column] = lambda r: _last(r["label"])) -> Column:
    """Of the next ``n`` lines, up to the first that stops, the first that gives a value."""
    near = F.slice(row["ahead"], 1, n)
    if stop:
        at = F.array_position(F.transform(near, lambda r: r["c"].rlike(stop)), True)
        near = bound(at, lambda k: F.slice(row["ahead"], F.lit(1), F.when(k > 0, (k - 1).cast("int")).otherwise(n)))
    found = F.transform(near, lambda r: F.struct(value(r).alias("v"), r["line"].alias("line")))
    first = F.get(F.filter(found, lambda r: r["v"].isNotNull()), F.lit(0))
    return bound(first, lambda x: _said(x["v"], F.concat(row["line"], F.lit(" -> "), x["line"])))


def _own(row: Column, values: Column) -> Column:
    return bound(values, lambda v: _said(v, row["line"]))


def by_labels(row: Column, labels: list[str], tax: bool = False, supply: bool = False) -> Column:
    """What a line with one of the labels gives: its own last amount, or that of the next three lines, none of them a label.

    ``tax``: small amounts count, of glued ones the last, and a label of the supply beside it is none. ``supply``: of glued ones the first.
    """
    def of(r: Column) -> Column:
        glued = _last(r["glued"]) if tax else F.get(r["glued"], F.lit(0)) if supply else F.lit(None).cast("double")
        return F.coalesce(glued, _last(r["loose"] if tax else r["label"]))

    c = row["c"]
    skipped = c.rlike("물품가액|공급가액|공급가|과세금액|과세합계|과세") & ~c.rlike("부가세액|부가가치세|세액") if tax else F.lit(False)
    own = F.when(skipped & (F.size(row["glued"]) == 0), F.lit(None).cast("double")).otherwise(of(row))
    return F.when(c.rlike(_words(labels)), F.coalesce(_own(row, own), _below(row, 3, STOPS["label"], of)))


def _line_facts(line: Column) -> Column:
    """A line, without blanks too, and the amounts in it; there are none without a digit."""
    none = F.array().cast("array<double>")
    amounts = lambda label, money: [label.alias("label"), money.alias("money")]
    of = lambda c: F.when(
        c.rlike("[0-9]"),
        bound(money_values(line), lambda m: F.struct(line.alias("line"), c.alias("c"), *amounts(F.concat(m, F.array_except(broken_values(line), m)), m), loose_values(line).alias("loose"), glued_values(line).alias("glued"))),
    ).otherwise(F.struct(line.alias("line"), c.alias("c"), *amounts(none, none), none.alias("loose"), none.alias("glued")))
    return bound(compact(line), of)


def _line_says(row: Column) -> Column:
    """What a line gives of each kind. ``row``: its facts with ``no``, ``ahead`` and ``before``. Every label has Hangul or a Y."""
    c, ahead, before = row["c"], row["ahead"], row["before"]
    own = lambda values: _own(row, values)
    taxed = c.rlike(TAX_CONTEXT) | F.exists(F.slice(ahead, 1, 2), lambda r: r["c"].rlike(TAX_CONTEXT))

    def paid(labels: list[str]) -> Column:
        return F.when(c.rlike(_words(labels)) & ~taxed, F.coalesce(own(_last(row["glued"])), own(_last(row["label"])), _below(row, 3, STOPS["paid"])))

    split = F.when(c.isin("판매", "결제", "결제수단") & F.exists(ahead, lambda r: r["c"].rlike("카드|간편결제")), _below(row, 5, None))
    above = _said(F.when((row["no"] > 0) & ~c.rlike("[0-9]") & ~before["c"].rlike(STOPS["gross"]), _last(before["label"])), F.concat(before["line"], F.lit(" <- "), row["line"]))
    gross = F.when(~c.rlike("I합계|과세합계|과세금액") & (c.rlike(_words(GROSS_LABELS)) | row["total_like"]), F.coalesce(own(F.array_max(row["glued"])), own(_last(row["label"])), above, _below(row, 3, STOPS["gross"])))
    kinds = c.rlike(DISCOUNT_KINDS)
    discount = F.when(~c.rlike(NO_DISCOUNT) & c.rlike(_words(DISCOUNT_LABELS)), bound(F.array_max(row["loose"]), lambda cut: F.when(cut.isNotNull(), _said(F.when(kinds | c.rlike("[-−]"), cut), row["line"])).when(kinds, _below(row, 2, STOPS["discount"], lambda r: F.array_max(r["loose"])))))
    alone = F.when(c.isin("계", "합계", "총계", "총액", "일계", "할계", "할거"), _below(row, 3, STOPS["alone"]))
    total = F.when(~c.rlike("I합계|과세합계") & row["total_like"], F.coalesce(own(F.array_max(row["glued"])), own(_last(row["label"])), _below(row, 3, STOPS["total"])))
    largest = F.when(~c.rlike(NO_FALLBACK), F.array_max(F.filter(row["money"], lambda v: v.between(10, 5_000_000))))
    said = {"paid1": paid(PAID_LABELS[0]), "paid2": paid(PAID_LABELS[1]), "paid3": split, "gross": gross, "discount": discount, "supply": by_labels(row, SUPPLY_LABELS, supply=True), "tax": by_labels(row, TAX_LABELS, tax=True), "alone": alone, "total": total}
    return F.struct(largest.alias("largest"), *[F.when(row["labelled"], v).alias(k) for k, v in said.items()])


def labelled_amounts(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, paid, gross, discount, supply, tax, total), each a struct (amount, source) or null.

    The source is the line, or the label's line and the one with the amount, or ``max_money_fallback``
    where no label gives a total and the largest amount is taken. ``key`` is unique; a null text has none of them.
    """
    # dealt first: few bytes, much work, so the parts are many and never put together
    docs = docs.select(key, text).repartition(PARTS, key)
    facts = F.transform(tidy_lines(F.col(text)), _line_facts)

    def seen(lines: Column) -> Column:
        near = lambda r, i: F.struct(*[r[f].alias(f) for f in ("line", "c", "money", "label", "loose", "glued")], i.alias("no"), r["c"].rlike("[가-힣Y]").alias("labelled"), (r["c"].rlike("[가-힣]") & total_label(r["c"])).alias("total_like"), F.slice(lines, i + 2, 5).alias("ahead"), F.get(lines, i - 1).alias("before"))
        return F.transform(lines, lambda r, i: bound(near(r, i), _line_says))

    def found(rows: Column) -> Column:
        first = lambda k: F.get(F.filter(rows, lambda r: r[k].isNotNull()), F.lit(0))[k]
        largest = _said(F.array_max(F.transform(rows, lambda r: r["largest"])), F.lit("max_money_fallback"))
        paid = F.coalesce(first("paid1"), first("paid2"), first("paid3"))
        return bound(paid, lambda p: F.struct(p.alias("paid"), *[first(k).alias(k) for k in ("gross", "discount", "supply", "tax")], F.coalesce(p, first("alone"), first("total"), largest).alias("total")))

    per = docs.select(key, F.explode(F.array(bound(bound(facts, seen), found))).alias("found"))
    return per.select(key, *[F.col(f"found.{k}").alias(k) for k in ("paid", "gross", "discount", "supply", "tax", "total")])
