"""Rules in tables: keyword scores, classification by a clear lead, correction dictionaries, nearest names."""

from __future__ import annotations

import difflib
import re
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import pandas as pd
import pyarrow as pa
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import CATEGORY_NAMES, first_keyword, meal_receipt, rule_key, vendor_key, without_ghosts

#: Rules that are searched at once; more are searched in blocks of about so many.
MOST_RULES = 100_000
#: Rules that are tested one by one in Spark's own expressions, without Python.
FEW_RULES = 64
#: The document types whose rules hold for every document, besides its own.
COMMON_TYPES = ("RECEIPT", "ITEM_RECEIPT", "TRANSPORT_RECEIPT", "CARD_RECEIPT", "GENERIC_RECEIPT", "COMMON", "ALL")
_KINDS = ("EXACT", "CONTAINS", "REGEX", "FUZZY")


def context(rules: DataFrame, document_type: str | None, column: str = "document_type") -> DataFrame:
    """The rules that hold for a document type: its own and the common ones. A blank type is a plain receipt."""
    own = (document_type or "").strip().upper()
    return rules.filter(F.col(column).isin(own if own not in ("", "영수증") else "RECEIPT", *COMMON_TYPES))


def active(rules: DataFrame) -> DataFrame:
    """Rules that are switched on and approved; blanks count as such."""
    state = lambda c, default: F.upper(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default)))
    return rules.filter((state("active_yn", "Y") != "N") & state("status", "APPROVED").isin("APPROVED", "Y"))


def by_type(rules: DataFrame, kind: str = "dictionary_type") -> DataFrame:
    """(type, rules): each type's rules in the order in which they are tried, by priority (null and 0 are 100), then id."""
    priority = F.coalesce(F.nullif(F.col("priority"), F.lit(0)), F.lit(100))
    others = [c for c in rules.columns if c not in (kind, "priority", "id")]
    named = rules.filter(F.trim(F.coalesce(kind, F.lit(""))) != "")
    return named.groupBy(F.upper(kind).alias("type")).agg(F.sort_array(F.collect_list(F.struct(priority.alias("priority"), "id", *others))).alias("rules"))


def kind_of(match_type: Column) -> Column:
    """EXACT, REGEX, FUZZY or CONTAINS, which all else is too."""
    kind = F.upper(F.trim(F.coalesce(match_type, F.lit(""))))
    return F.when(kind.isin(*_KINDS), kind).otherwise("CONTAINS")


def usable(rules: DataFrame) -> DataFrame:
    """Active rules whose keyword has a key; broad ones (one character, or two letters or digits) don't count for CONTAINS and FUZZY."""
    key = rule_key(F.col("keyword"))
    broad = (F.length(key) <= 1) | key.rlike("^[a-z0-9]{2}$")
    return active(rules).filter((key != "") & ~(kind_of(F.col("match_type")).isin("CONTAINS", "FUZZY") & broad))


def rule_score() -> Column:
    """By kind, with more for long keywords and early priorities."""
    kind = kind_of(F.col("match_type"))
    base = F.when(kind == "EXACT", 100).when(kind == "REGEX", 70).otherwise(45)
    priority = F.coalesce(F.nullif(F.col("priority"), F.lit(0)), F.lit(100))
    return base + F.least(F.lit(40), 6 * F.length(rule_key(F.col("keyword")))) + F.greatest(F.lit(0.0), F.lit(25) - 0.15 * priority)


def _compiles(spark: SparkSession, pattern: str) -> bool:
    """By Java's compiler, which runs the patterns later."""
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException:
        return False
    return True


def _searcher(words: dict[str, list[int]]) -> Callable[[str], set[int]]:
    """The numbers of all words that a text holds, in one pass over it."""
    import ahocorasick

    if not words:
        return lambda text: set()
    automaton = ahocorasick.Automaton()
    for word, numbers in words.items():
        automaton.add_word(word, numbers)
    automaton.make_automaton()
    return lambda text: {n for _, numbers in automaton.iter(text) for n in numbers}


def _grouped(rows: list, kinds: tuple[str, ...], key: str) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {}
    for i, r in enumerate(rows):
        if r["_kind"] in kinds and r[key]:
            out.setdefault(r[key], []).append(i)
    return out


def _hits(docs: DataFrame, key: str, text: str, rules: DataFrame, *columns: str) -> DataFrame:
    """(key, columns of the rule) for each rule (keyword, match_type, ...) that fits a document.

    EXACT compares keys; CONTAINS and FUZZY look for the key in the text's key, or where a keyword has
    none, for the keyword in the text. A few rules are tested one by one by Spark itself; many are looked
    for all at once, by an automaton that each task makes of them. REGEX is Spark's own, without case; a
    pattern that is none is looked for as it stands.
    Rules come to the driver in blocks of a bounded size, and a document passes by each block once.
    """
    spark = docs.sparkSession
    keyword = F.trim("keyword")
    table = rules.select(keyword.alias("_word"), rule_key(keyword).alias("_key"), F.lower(keyword).alias("_low"), kind_of(F.col("match_type")).alias("_kind"), *columns).filter("_word <> ''")
    blocks = -(-table.count() // MOST_RULES)
    keyed = docs.select(key, F.col(text).alias("_text"), rule_key(F.col(text)).alias("_key"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_low"))
    result = T.StructType([docs.select(key).schema[0], *table.select(*columns).schema])

    def found(rows: list) -> DataFrame:
        rows = [r.asDict() for r in rows]
        patterns = []
        for i, r in enumerate(rows):
            if r["_kind"] == "REGEX" and _compiles(spark, r["_word"]):
                patterns.append((i, r["_word"]))
            elif r["_kind"] == "REGEX":
                r["_kind"], r["_key"] = "CONTAINS", ""
        if len(rows) <= FEW_RULES:
            compacted, low = F.col("_key"), F.col("_low")

            def fit(r: dict) -> Column:
                if r["_kind"] == "REGEX":
                    return F.col("_text").rlike("(?i)" + r["_word"])
                if r["_kind"] == "EXACT":
                    return compacted == F.lit(r["_key"])
                return F.contains(compacted, F.lit(r["_key"])) if r["_key"] else F.contains(low, F.lit(r["_low"]))

            said = [F.when(fit(r), F.struct(*[F.lit(r[c]).cast(result[c].dataType).alias(c) for c in columns])) for r in rows]
            return keyed.select(key, F.inline(F.array_compact(F.array(*said)))) if said else spark.createDataFrame([], result)
        shared = spark.sparkContext.broadcast(rows)
        fits = F.array_compact(F.array(*[F.when(F.col("_text").rlike("(?i)" + p), F.lit(i)) for i, p in patterns])) if patterns else F.array().cast("array<int>")

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = shared.value
            exact = _grouped(rows, ("EXACT",), "_key")
            within, literally = _searcher(_grouped(rows, ("CONTAINS", "FUZZY"), "_key")), _searcher(_grouped([r if not r["_key"] else r | {"_low": ""} for r in rows], ("CONTAINS", "FUZZY"), "_low"))
            for batch in batches:
                ids, numbers = [], []
                for i, (compacted, low, by_pattern) in enumerate(zip(batch.column("_key").to_pylist(), batch.column("_low").to_pylist(), batch.column("_fits").to_pylist())):
                    hit = sorted({*exact.get(compacted, ()), *within(compacted), *literally(low), *by_pattern})
                    ids += [i] * len(hit)
                    numbers += hit
                arrays = [batch.column(0).take(pa.array(ids, pa.int32()))]
                arrays += [pa.array([rows[n][c] for n in numbers], to_arrow_type(result[c].dataType)) for c in columns]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in result])

        return keyed.select(key, "_key", "_low", fits.alias("_fits")).mapInArrow(search, result)

    if blocks <= 1:
        return found(table.collect())
    in_block = F.pmod(F.xxhash64("_word", "_kind"), F.lit(blocks))
    return reduce(DataFrame.unionAll, [found(table.filter(in_block == b).collect()) for b in range(blocks)])


def scored(docs: DataFrame, key: str, text: str, rules: DataFrame) -> DataFrame:
    """(key, code, score, hits): what the rules of each code add up to."""
    hit = _hits(docs, key, text, rules.withColumn("_points", rule_score().cast("double")), "code", "_points")
    return hit.groupBy(key, "code").agg(F.sum("_points").alias("score"), F.count(F.lit(1)).alias("hits"))


def document_types(docs: DataFrame, key: str, text: str, requested: Column, rules: DataFrame, by_hand: Column, transport: Column, least: int = 20) -> DataFrame:
    """(key, document_type): the type asked for, unless it is a plain receipt or blank; else by hand, transport, rules, receipt.

    ``rules(keyword, match_type, code, score, place)``: a null or zero score counts 10; the type whose rules add up to
    the most wins from ``least`` on, the one with the first rule of equals. ``key`` is unique. Null texts fit no rule.
    """
    usual = rules.filter(F.trim("keyword") != "").withColumn("_points", F.coalesce(F.nullif(F.col("score"), F.lit(0)), F.lit(10)))
    sums = _hits(docs, key, text, usual, "code", "_points", "place").groupBy(key, F.upper("code").alias("code")).agg(F.sum("_points").alias("points"), F.min("place").alias("place")).filter("code <> ''")
    best = sums.groupBy(key).agg(F.max_by("code", F.struct("points", -F.col("place"))).alias("_code"), F.max("points").alias("_most"))
    asked = F.upper(F.trim(requested))
    asked = F.when(~asked.isin("", "RECEIPT", "영수증"), asked)
    facts = docs.select(key, asked.alias("_asked"), F.when(by_hand, "HANDWRITTEN_FORM_RECEIPT").when(transport, "TRANSPORT_RECEIPT").alias("_seen"))
    return facts.join(best, key, "left").select(key, F.coalesce("_asked", "_seen", F.when(F.col("_most") >= least, F.col("_code")), F.lit("RECEIPT")).alias("document_type"))


def categories(docs: DataFrame, key: str, text: str, rules: DataFrame, hints: list[tuple[str, list[str]]], transport: Column) -> DataFrame:
    """(key, category, by): transport, else a clear lead by the rules (code, ...), else the first list of hints with a word in
    the text, else a meal, else ETC. ``key`` is unique."""
    led = clear_winner(scored(docs, key, text, rules), key).select(key, F.col("code").alias("_led"))
    rows = docs.select(key, F.coalesce(transport, F.lit(False)).alias("_moved"), first_keyword(F.coalesce(F.col(text), F.lit("")), hints).alias("_hint"), meal_receipt(F.col(text)).alias("_meal")).join(led, key, "left")
    meal = F.when(F.col("_meal"), "MEAL")
    code = F.when(F.col("_moved"), "TRANSPORT").otherwise(F.coalesce("_led", "_hint", meal, F.lit("ETC")))
    by = F.when(F.col("_moved"), "transport").when(F.col("_led").isNotNull(), "rules").when(F.col("_hint").isNotNull(), "hints").when(F.col("_meal"), "meal").otherwise("none")
    return rows.select(key, code.alias("category"), by.alias("by"))


def clear_winner(scores: DataFrame, key: str, least: float = 55, gap: float = 20) -> DataFrame:
    """(key, code, score): the best code if it scores enough and leads the next one by enough. Ties by code."""
    best = Window.partitionBy(key).orderBy(F.desc("score"), "code")
    ranked = scores.withColumn("_n", F.row_number().over(best)).withColumn("_next", F.lead("score").over(best))
    return ranked.filter((F.col("_n") == 1) & (F.col("score") >= least) & (F.col("score") - F.coalesce("_next", F.lit(0.0)) >= gap)).select(key, "code", "score")


def _ordered(rules: DataFrame, types: tuple[str, ...]) -> list[tuple[str, str, str]]:
    """(wrong, right, kind) of the types' active corrections, by priority, type and id; without a wrong or right text none counts."""
    rows = active(rules).filter(F.upper("dictionary_type").isin(*types) & (F.trim("wrong_text") != "") & (F.trim("corrected_text") != ""))
    priority = F.coalesce(F.nullif(F.col("priority"), F.lit(0)), F.lit(100))
    rows = rows.select(priority.alias("p"), F.upper("dictionary_type").alias("t"), "id", F.trim("wrong_text").alias("w"), F.trim("corrected_text").alias("c"), kind_of(F.col("match_type")).alias("k")).orderBy("p", "t", "id")
    if (n := rows.count()) > MOST_RULES:
        raise ValueError(f"{n} corrections are tried one after the other; more than {MOST_RULES} are not")
    return [(r.w, r.c, r.k) for r in rows.collect()]


def corrected(df: DataFrame, column: str, rules: DataFrame, types: tuple[str, ...], whole: bool = False) -> DataFrame:
    """``column`` corrected by dictionaries (dictionary_type, wrong_text, corrected_text, match_type, priority, id, status, active_yn),
    each correction seeing what the ones before made.

    A correction replaces its wrong text wherever it stands, first as written, then without case; REGEX replaces matches,
    \\1 being a group. ``whole``: the column is a value and not a text; then EXACT replaces all of it if the keys are equal, and
    ghost repeats go. A pattern that is none changes nothing. Null stays null. Python runs the corrections over Arrow batches;
    the order in which they see each other's results leaves no built-in way for many of them.
    """
    steps = df.sparkSession.sparkContext.broadcast(_ordered(rules, types))

    @F.pandas_udf("string")
    def change(texts: pd.Series) -> pd.Series:
        ready = []
        for wrong, right, kind in steps.value:
            try:
                ready.append((wrong, wrong.lower(), right, kind, re.compile(wrong if kind == "REGEX" else re.escape(wrong), re.IGNORECASE), compared_key(wrong)))
            except re.error:
                continue

        def one(text: str | None) -> str | None:
            if not text:
                return text
            out = text.strip() if whole else text
            for wrong, low, right, kind, pattern, key in ready:
                if kind == "REGEX":
                    out = pattern.sub(right, out)
                elif kind == "EXACT" and whole:
                    out = right if compared_key(out) == key else out
                elif low in out.lower():
                    out = pattern.sub(lambda _, right=right: right, out.replace(wrong, right))
            return out

        return texts.map(one)

    out = df.withColumn(column, change(F.col(column)))
    return out.withColumn(column, without_ghosts(F.col(column))) if whole else out


def compared_key(text: str) -> str:
    """``functions.text.rule_key`` of one text."""
    return re.sub(r"[\s\"'‘’“”_\-.,()\[\]{}:/\\|*×]+", "", text.strip().lower())


def category_of(corrected_text: Column) -> Column:
    """The category code that a correction names by code or name; null if it names none."""
    raw = F.trim(F.coalesce(corrected_text, F.lit("")))
    by_name = F.create_map(*chain.from_iterable((F.lit(n), F.lit(c)) for c, n in CATEGORY_NAMES.items()))
    return F.coalesce(F.when(F.upper(raw).isin(*CATEGORY_NAMES), F.upper(raw)), F.element_at(by_name, raw))


def vendor_corrections(rules: DataFrame) -> DataFrame:
    """(key, vendor): approved, active corrections of vendors and recognised texts by the wrong text's key; of equal keys the last one."""
    approved = (F.upper(F.coalesce("status", F.lit("APPROVED"))) == "APPROVED") & (F.upper(F.coalesce("active_yn", F.lit("Y"))) == "Y")
    rows = rules.filter(approved & F.upper("dictionary_type").isin("VENDOR", "OCR_TEXT") & (F.col("wrong_text") != "") & (F.col("corrected_text") != ""))
    return rows.groupBy(vendor_key(F.col("wrong_text")).alias("key")).agg(F.max_by(F.trim("corrected_text"), "id").alias("vendor"))


def section_keywords(rules: DataFrame, section: str, document_type: str | None = None) -> DataFrame:
    """(keyword, priority, id) of a section's active rules for a document type and the common ones; any type without one."""
    doc = (document_type or "").upper()
    rows = rules.filter((F.upper(F.coalesce("active_yn", F.lit("Y"))) != "N") & (F.upper("section_type") == section.upper()) & (F.trim("keyword") != ""))
    return (rows.filter(F.upper(F.coalesce("document_type", F.lit(""))).isin(doc, "RECEIPT", "ITEM_RECEIPT", "ALL", "COMMON")) if doc else rows).select(F.trim("keyword").alias("keyword"), "priority", "id")


def required_fields(fields: DataFrame, document_type: str | None) -> DataFrame:
    """(field_key, sort_order) of the fields that a document type or a plain receipt requires; a null or 0 order is 1000."""
    doc = (document_type or "RECEIPT").upper()
    rows = fields.filter(F.upper("document_type").isin(doc, "RECEIPT") & (F.upper(F.coalesce("required_yn", F.lit("N"))) == "Y"))
    return rows.select("field_key", F.coalesce(F.nullif(F.col("sort_order"), F.lit(0)), F.lit(1000)).alias("sort_order"))


def nearest_names(names: DataFrame, column: str, known: list[str], least: float = 0.82) -> DataFrame:
    """Adds match, source and confidence: equal key .96, containing .90, nearest by ratio, else itself .70 (blank .40).

    ``known`` is a short list kept by hand.
    """
    keys = [(k, re.sub(r"[\s\W_]+", "", k.lower())) for k in known]

    @F.pandas_udf("match string, source string, confidence double")
    def of(raw: pd.Series, compacted: pd.Series) -> pd.DataFrame:
        rows = []
        for text, key in zip(raw, compacted):
            hit = next(((k, "DICTIONARY", 0.96) for k, c in keys if key and c == key), None) or next(((k, "CONTAINS", 0.90) for k, c in keys if key and c and (c in key or key in c)), None)
            if hit is None and key:
                ratio, name = max(((difflib.SequenceMatcher(None, key, c).ratio(), k) for k, c in keys), default=(0.0, None))
                hit = (name, "FUZZY", ratio) if ratio >= least else None
            rows.append(hit or (text, "RAW", 0.70 if key else 0.40))
        return pd.DataFrame(rows, columns=["match", "source", "confidence"])

    return names.withColumn("_m", of(F.col(column), vendor_key(F.coalesce(F.col(column), F.lit(""))))).select(*names.columns, "_m.*")
