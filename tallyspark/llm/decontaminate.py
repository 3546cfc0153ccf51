"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the 13-word windows of the benchmark items (an item of fewer words is one
window). For each window length there is a shift table keyed by blocks of two consecutive words:
a block that ends no window lets the search jump ahead by up to the window's length. Where the
shift is zero, the suffix block's bucket names the windows that may end there, and comparing the
words confirms an occurrence. Documents only pass by the table; no row is shuffled.
"""

import re
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, free_name

WINDOW = 13
_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_FOUND = "n_words long, hits array<int>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode().lower())


class WuManber:
    """Search tables for windows of words, one set for each window length."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        patterns: dict[int, dict[tuple, set[str]]] = defaultdict(lambda: defaultdict(set))
        for name, text in items:
            if words := words_of(text):
                n = min(window, len(words))
                for i in range(len(words) - n + 1):
                    patterns[n][tuple(words[i : i + n])].add(name)
        self.engines = []
        for n, windows in sorted(patterns.items()):
            block = min(2, n)
            shift: dict[tuple, int] = {}
            buckets: dict[tuple, dict[tuple, set[str]]] = defaultdict(dict)
            for words, names in windows.items():
                for end in range(block, n + 1):
                    key = words[end - block : end]
                    shift[key] = min(shift.get(key, n), n - end)
                buckets[words[n - block :]][words] = names
            self.engines.append((n, block, shift, dict(buckets)))

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(first word, length) of each occurrence, and the names of the items that have one."""
        spans, names, total = [], set(), len(words)
        for n, block, shift, buckets in self.engines:
            default, end, get = n - block + 1, n, shift.get
            while end <= total:
                key = tuple(words[end - block : end])
                if skip := get(key, default):
                    end += skip
                    continue
                whole = tuple(words[end - n : end])
                if hit := buckets[key].get(whole):
                    spans.append((end - n, n))
                    names |= hit
                end += 1
        return spans, names


def _hits(spans: list[tuple[int, int]], before: list[int]) -> list[int]:
    """Disjoint runs of hit words as start, end, start, end, ..."""
    runs = sorted([(s, s + n) for s, n in spans] + list(zip(before[::2], before[1::2])))
    out: list[int] = []
    for s, e in runs:
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def _list(values) -> list:
    return list(values) if isinstance(values, (list, np.ndarray)) else []


def _searching(tables, window: int):
    """The pandas function of one pass; ``tables`` is the broadcast block of items."""

    def search(texts: pd.Series, found: pd.DataFrame) -> pd.DataFrame:
        engine, rows = WuManber(tables.value, window), []
        for text, hits, items in zip(texts, found["hits"], found["items"]):
            words = words_of(text)
            spans, names = engine.search(words)
            rows.append((len(words), _hits(spans, _list(hits)), sorted(names | set(_list(items)))))
        return pd.DataFrame(rows, columns=["n_words", "hits", "items"])

    return F.pandas_udf(search, _FOUND).asNondeterministic()


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, words_per_pass: int = 2_000_000) -> DataFrame:
    """All columns of ``docs`` and ``found`` (n_words, hit word runs, sorted item names).

    The search tables go to every task, so their size is checked first: items of more than
    ``words_per_pass`` words together are taken in blocks, one pass over the documents each.
    The new column takes another name if ``found`` exists; it is always the last one.
    """
    sized = benchmark.select(F.col("item_id").cast("string").alias("name"), F.col("text").alias("body"))
    total = sized.agg(F.sum(F.regexp_count("body", F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")))).first()[0] or 0
    passes = 1 + 2 * total // words_per_pass if total > words_per_pass else 1
    column = free_name(docs, "found")
    before = F.lit(None).cast(f"struct<{_FOUND.replace(' ', ':').replace(',:', ',')}>")
    out = docs.withColumn(column, before)
    for k in range(passes):
        part = sized.filter(F.pmod(F.xxhash64("name", "body"), F.lit(passes)) == k) if passes > 1 else sized
        tables = docs.sparkSession.sparkContext.broadcast([(r["name"] or "", r["body"]) for r in part.collect()])

        out = out.withColumn(column, _searching(tables, window)(F.col("text"), F.col(column)))
        if k + 1 < passes:
            out = checkpointed(out)
    return out


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A null or empty text has no words, so it is not contaminated; an item without words or with
    a null text has no window; a null item_id is named by the empty string. Repeated documents
    give repeated rows. Other columns are not read. An empty benchmark contaminates nothing.
    """
    found = occurrences(docs.select("doc_id", "text"), benchmark, window).select("doc_id", "found.*")
    n_hit = F.aggregate(F.sequence(F.lit(0), F.size("hits") - 2, F.lit(2)), F.lit(0).cast("long"), lambda total, i: total + F.get("hits", i + 1) - F.get("hits", i))
    return found.select(
        "doc_id",
        "n_words",
        F.when(F.size("hits") > 0, n_hit).otherwise(F.lit(0)).cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without contaminated rows, same columns."""
    found = occurrences(docs, benchmark, window)
    column = found.columns[-1]
    spans = f"`{column}`.hits"
    n_hit = F.expr(f"aggregate(transform({spans}, (x, i) -> if(i % 2 = 0, -x, x)), 0L, (a, x) -> a + x)")
    return found.filter(~((n_hit > 0) & (20 * n_hit >= F.col(f"`{column}`.n_words")))).drop(column)
