"""Text: normalising, classifying and labelling. The word lists are fixed values."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Category codes, their names, and other codes for them.
CATEGORY_NAMES = {"MEAL": "식비", "TRANSPORT": "교통비", "LODGING": "숙박비", "SUPPLIES": "소모품비", "FUEL": "유류비", "COMMUNICATION": "통신비", "MATERIAL": "자재비", "ETC": "기타"}
CATEGORY_ALIASES = {"FOOD": "MEAL", "TRAFFIC": "TRANSPORT", "TRAVEL": "TRANSPORT"}
# Marks that don't count when rules and vendors are compared; other signs, such as + and &, do.
RULE_MARKS = r"(?U)[\s\x1C-\x1F\"'‘’“”_\-.,()\[\]{}:/\\|*×]+"
NULL_WORDS = ("none", "null", "undefined", "nan")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` where the value is worked out once for each row, however often the body names it.

    Otherwise an expression is written out wherever it is used; in filters, branches and lambdas Spark works each one out anew.
    """
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def compact(text: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(text, r"\s+", "")


def rule_key(text: Column) -> Column:
    """Lower case without white space and the marks of ``RULE_MARKS``: what rules are compared by. Null: empty."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), RULE_MARKS, "")


def vendor_key(text: Column) -> Column:
    """``rule_key`` less the marks of a company."""
    return rule_key(F.regexp_replace(F.lower(text), r"㈜|\(주\)|주식회사", ""))


def field_key(text: Column) -> Column:
    return F.lower(F.translate(F.trim(text), "- ", "_"))


def cleaned(text: Column) -> Column:
    """White space collapsed; blank texts and words for nothing are null."""
    one = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when((one != "") & ~F.lower(one).isin(*NULL_WORDS), one)


def first_present(*columns: Column) -> Column:
    """The first value that is neither null nor blank."""
    return F.coalesce(*[F.when(F.trim(c.cast("string")) != "", c) for c in columns])


def without_ghosts(text: Column, rounds: int = 4, drop_tail: bool = True) -> Column:
    """Hangul syllables that a misreading repeats: three or more in a row are one, and a tail that repeats its last
    syllable or last two is cut to one of them. ``drop_tail``: a last word of up to three letters or digits goes too."""
    text = F.regexp_replace(F.trim(text), r"([가-힣])\1{2,}", "$1")
    for _ in range(rounds):
        text = F.regexp_replace(text, r"([가-힣])\1+$", "$1")
        text = F.regexp_replace(text, r"([가-힣]{2})\1+$", "$1")
    return F.trim(F.regexp_replace(text, r"\s+[A-Za-z0-9]{1,3}$", "")) if drop_tail else text


def candidate_item_name(text: Column) -> Column:
    """An item's name without the product codes before it and the marks after it."""
    out = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s{2,}|[\t\n\x0B\f\r]", " "))
    for pattern in (r"^\*?\s*\d{3,8}\s+", r"^\d{3,8}[A-Za-z]{1,5}\s*(?=[가-힣A-Za-z])", r"^\[[0-9A-Za-z-]{3,30}\]\s*", r"[\x00-\x1F]"):
        out = F.regexp_replace(out, pattern, "")
    return F.trim(F.regexp_replace(F.trim(out), r"[\s\-_*\[\]]+$", ""))


# Document types by their names and codes.
DOCUMENT_TYPES = {"영수증": "RECEIPT", "거래명세서": "TRANSACTION_STATEMENT", "납품서": "DELIVERY_NOTE", "자재검수증": "MATERIAL_INSPECTION", "작업일보": "DAILY_REPORT"}
# Groups of fields, each by whole names, beginnings and parts of names; the first that fits counts.
FIELD_GROUPS = (
    ("BASIC", ("department_name", "site_name", "user_name", "expense_title", "document_type", "document_no", "document_title"), (), ()),
    ("DATE", (), (), ("date", "time")),
    ("VENDOR", ("business_number",), ("vendor",), ()),
    ("ACCOUNT", (), (), ("category", "account", "budget", "cost_center")),
    ("ITEM", ("line_no", "quantity", "unit", "unit_price", "amount", "description"), ("item",), ()),
    ("AMOUNT", (), (), ("amount",)),
    ("PAYMENT", (), (), ("payment", "card", "approval", "receipt")),
    ("WORK", (), (), ("work", "equipment", "material", "weather", "progress")),
)


def document_type(name: Column) -> Column:
    """The code of a document type's name; other texts stay, blank ones are receipts."""
    raw = F.trim(F.coalesce(name, F.lit("")))
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in DOCUMENT_TYPES.items()))
    return F.coalesce(F.element_at(table, raw), F.nullif(raw, F.lit("")), F.lit("RECEIPT"))


def field_group(key: Column) -> Column:
    """The group that a field is shown in."""
    key, out = F.coalesce(key, F.lit("")), None
    for name, whole, starts, parts in FIELD_GROUPS:
        tests = [key.isin(*whole)] * bool(whole) + [F.startswith(key, F.lit(x)) for x in starts] + [F.contains(key, F.lit(x)) for x in parts]
        hit = tests[0]
        for t in tests[1:]:
            hit = hit | t
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("ETC")


# Words of meals, of a register's receipt, and of restaurants.
MEAL_WORDS = (
    "피자", "파스타", "감바스", "샐러드", "버거", "샌드", "샌드위치", "베이커리", "빵",
    "갈비", "프렌치랙", "양갈비", "삼겹", "고기", "김치", "전", "마늘밥", "밥", "국밥",
    "우동", "라멘", "면", "찌개", "탕", "커피", "라떼", "아메리카노", "카페",
    "소주", "맥주", "참이슬", "하이볼", "와인", "막걸리", "코젤", "음료", "주류",
)
REGISTER_WORDS = "상품명|메뉴|테이블|홀|단가|수량|금액|판매시간|매출일"
RESTAURANT_WORDS = "식당|분식|전집|카페|커피|베이커리|파리바게|치킨|피자|고기|갈비"


def meal_receipt(text: Column) -> Column:
    """Two words of meals, or one beside a word of a register or a restaurant. Null: false."""
    c = compact(F.coalesce(text, F.lit("")))
    hits = sum((F.contains(c, F.lit(w)).cast("int") for w in MEAL_WORDS), F.lit(0))
    return (hits >= 2) | ((hits >= 1) & c.rlike(f"{REGISTER_WORDS}|{RESTAURANT_WORDS}"))


def file_name(text: Column, most: int = 50) -> Column:
    return F.substring(F.regexp_replace(text, r"[^\w가-힣-]", "_"), 1, most)


def summary(text: Column, category: Column, most: int = 42) -> Column:
    """Null for numbers, dates, single characters and the category's own name; long texts end in an ellipsis."""
    one = F.trim(text)
    dull = one.rlike(r"^[0-9.,\s원₩]*$") | one.rlike(r"^[0-9]{2,4}[-./][0-9]{1,2}[-./][0-9]{1,2}$") | (F.length(one) <= 1) | (one == F.coalesce(category, F.lit("")))
    return F.when(~dull, F.when(F.length(one) > most, F.concat(F.substring(one, 1, most), F.lit("…"))).otherwise(one))


def category_name(code: Column) -> Column:
    """The name of a category's code, also of a code written as a field key; other texts stay, null is blank."""
    names = CATEGORY_NAMES | {a: CATEGORY_NAMES[c] for a, c in CATEGORY_ALIASES.items()}
    table, raw = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in names.items())), F.trim(F.coalesce(code, F.lit("")))
    return F.coalesce(F.element_at(table, F.upper(field_key(raw))), F.element_at(table, F.upper(raw)), raw)


def first_keyword(text: Column, lists: list[tuple[str, list[str]]], default: str | None = None) -> Column:
    """The name of the first list that has a keyword in the text (without case)."""
    low = F.lower(text)
    out = None
    for name, words in lists:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w.lower()))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def chips(text: Column, tags: list[tuple[str, list[str]]], most: int = 4) -> Column:
    """The tags that have a keyword in the text, in order, the first ``most``."""
    return F.slice(F.array_compact(F.array(*[first_keyword(text, [t]) for t in tags])), 1, most)


def representative(route: Column, first_item: Column, n_items: Column, description: Column, category: Column) -> Column:
    """What a document is called in a list: route, first item and how many more, description, category, or unclassified."""
    item = F.when(n_items > 1, F.concat(first_item, F.lit(" 외 "), (n_items - 1).cast("string"), F.lit("건"))).otherwise(first_item)
    return first_present(route, F.when(F.trim(first_item) != "", item), description, category, F.lit("미분류"))


def char_shares(text: Column) -> dict[str, Column]:
    """Counts of Hangul, Latin letters, digits and other signs that are no blanks."""
    of = lambda c: F.length(F.regexp_replace(text, f"[^{c}]", ""))
    hangul, latin, digits = of("가-힣"), of("A-Za-z"), of("0-9")
    return {"hangul": hangul, "latin": latin, "digits": digits, "other": F.length(compact(text)) - hangul - latin - digits}


def json_inside(text: Column) -> Column:
    """From the first { to the last }, if that is JSON."""
    body = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(body).isNotNull(), body)


def column_number(letters: Column) -> Column:
    """A spreadsheet column: A -> 1, AA -> 27. Other texts: null."""
    up = F.upper(F.trim(letters))
    codes = F.transform(F.split(up, ""), lambda c: F.ascii(c) - 64)
    return F.when(up.rlike("^[A-Z]{1,3}$"), F.aggregate(codes, F.lit(0), lambda a, c: a * 26 + c))
