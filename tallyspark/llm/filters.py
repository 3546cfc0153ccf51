"""Filter interaction audit: what each of five text filters removes in every order of the five.

Texts are scanned in Arrow's own buffers. Byte classes (white space, capitals, symbols, first
bytes of a code point) are looked up for a whole block of documents at once; prefix sums give each
document's counts, and prefix sums of a polynomial give each word's hash. A document's hashes are
sorted, so equal words stand side by side; their bytes are compared before they count as one. A
document leaves the scan as a mask of the filters that it fails and an identity of its text; the
filter for repeats needs the least id of each identity, which is a grouped minimum. From there on
only counts per part and mask are kept: 32 masks, from which every order follows by sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

LETTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 2
SYMBOLS = b"#$%&*|"
#: Bytes scanned at once; the polynomial's powers are kept for so many.
BLOCK = 1 << 20

_SPACE, _CAPITAL, _SYMBOL, _POINT = (np.zeros(256, bool) for _ in range(4))
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_CAPITAL[ord("A") : ord("Z") + 1] = True
_SYMBOL[list(SYMBOLS)] = True
_POINT[:] = True
_POINT[0x80:0xC0] = False
#: An odd number, so it has an inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)


class Scanner:
    """Counts of the documents of a block; the tables of powers are made once a task."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        self.up = _powers(_BASE, block + 1)
        self.down = _powers(pow(_BASE, -1, 1 << 64), block + 1)

    def words(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte of each word, and the byte after its last."""
        blank = np.concatenate([[True], _SPACE[data], [True]])
        turns = np.flatnonzero(blank[1:] != blank[:-1])
        return turns[::2], turns[1::2]

    def small(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """``data``: bytes of documents that stand between ``bounds``, each ended by a blank -> rows of counts."""
        n = len(bounds) - 1
        counted = [np.diff(np.concatenate([[0], np.cumsum(c[data])])[bounds]) for c in (_CAPITAL, _SYMBOL, _POINT)]
        starts, ends = self.words(data)
        doc = np.searchsorted(bounds, starts, side="right") - 1
        total = np.bincount(doc, minlength=n)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + 1) * self.up[: len(data)], dtype=np.uint64)])
        hashes = (sums[ends] - sums[starts]) * self.down[starts]
        order = np.lexsort((hashes, doc))
        same = (hashes[order][1:] == hashes[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        a, b = order[:-1][same], order[1:][same]
        distinct = total - np.bincount(doc[b], minlength=n)
        for d in np.unique(doc[b[~self.equal(data, starts, ends, a, b)]]):  # unequal words with one hash
            mine = doc == d
            distinct[d] = len({data[s:e].tobytes() for s, e in zip(starts[mine], ends[mine])})
        return np.stack([total, distinct, *counted], axis=1)

    @staticmethod
    def equal(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether words a[i] and b[i] have the same bytes."""
        length = ends[a] - starts[a]
        out = length == ends[b] - starts[b]
        for at in range(int(length[out].max(initial=0))):
            left = np.flatnonzero(out & (length > at))
            out[left] = data[starts[a[left]] + at] == data[starts[b[left]] + at]
        return out

    def large(self, data: np.ndarray) -> np.ndarray:
        """A document of more than a block, read in pieces: counts add up, and its words are a set."""
        seen, total, counted, rest = set(), 0, np.zeros(3, np.int64), b""
        for at in range(0, len(data), self.block):
            piece = data[at : at + self.block]
            counted += [np.count_nonzero(c[piece]) for c in (_CAPITAL, _SYMBOL, _POINT)]
            words = (rest + piece.tobytes()).translate(bytes.maketrans(bytes([9, 10, 11, 12, 13]), b" " * 5))
            done, _, rest = words.rpartition(b" ") if at + self.block < len(data) else (words, b"", b"")
            split = done.split(b" ")
            total += len(split) - split.count(b"")
            seen.update(split)
        return np.array([total, len(seen - {b""}), *counted])

    def counts(self, texts: pa.Array) -> np.ndarray:
        """One row a text, a null being empty: words, distinct words, capitals, symbols, code points."""
        texts = texts.cast(pa.large_string()).fill_null("")
        _, offsets, values = texts.buffers()
        at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(values, np.uint8) if values else np.zeros(0, np.uint8)
        out = np.zeros((len(texts), 5), np.int64)
        sizes, i = np.diff(at), 0
        while i < len(texts):
            if sizes[i] >= self.block:
                out[i] = self.large(data[at[i] : at[i + 1]])
                i += 1
                continue
            # as many documents as fit with a blank after each
            j = i + max(1, int(np.searchsorted(at[i + 1 :] - at[i] + np.arange(1, len(texts) - i + 1), self.block, side="right")))
            bounds = at[i : j + 1] - at[i]
            joined = np.insert(data[at[i] : at[j]], bounds[1:], 0x20)
            out[i:j] = self.small(joined, bounds + np.arange(j - i + 1))
            out[i:j, 4] -= 1  # the blank
            i = j
        return out


def fails(counts: np.ndarray) -> np.ndarray:
    """Rows of counts -> mask of the filters A to D that fail (A is 1, B 2, C 4, D 8)."""
    words, distinct, capitals, symbols, points = counts.T
    tests = (words < MIN_WORDS, 100 * distinct < DISTINCT_PERCENT * words, 100 * capitals > CAPITAL_PERCENT * points, symbols > 0)
    return sum((t.astype(np.int8) << i for i, t in enumerate(tests)), np.zeros(len(counts), np.int8))


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, h1, h2): filters A to D, and 128 bits that stand for the text; a null text is empty."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            mask = fails(scanner.counts(batch.column("text")))
            digest = b"".join(xxhash.xxh3_128_digest(t.as_buffer() if t.is_valid else b"") for t in batch.column("text"))
            h = np.frombuffer(digest, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(mask), pa.array(h[:, 0]), pa.array(h[:, 1])], names=["doc_id", "part", "mask", "h1", "h2"])

    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), "text")
    return rows.mapInArrow(scan, f"doc_id {dict(rows.dtypes)['doc_id']}, part string, mask byte, h1 long, h2 long")


def masked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by the filters that they fail, 32 rows a part at most."""
    rows = stored(scanned(docs))  # the texts are scanned once
    first = rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    marks = labels.groupBy(F.col("doc_id").alias("of")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("bad"))
    rows = rows.join(first, ["h1", "h2"], "left").select("doc_id", "part", (F.col("mask").cast("int") + F.when(F.col("doc_id") > F.col("first"), 16).otherwise(0)).alias("mask"))
    rows = rows.join(marks, F.col("doc_id") == F.col("of"), "left")
    return rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("bad"), F.lit(0)).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs(doc_id, text, source)``, ``labels(doc_id, quality, toxic)`` -> a row per part, order and step.

    A: under 200 words; B: fewer than half of the words distinct; C: over 2 % capitals; D: a symbol;
    E: the text of a smaller doc_id. Null texts are empty and equal to other empty texts. Rows of
    one doc_id are no repeats of each other; a null doc_id is neither smaller nor greater and has
    no label. A null source is the empty part. Of labels that repeat a doc_id, one that says 1
    decides. Other columns are not read. Without documents the result is empty.
    """
    per_mask = [F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)).alias(f"{c}{m}") for c in ("n", "good", "toxic") for m in range(1 << len(LETTERS))]
    table = masked(docs, labels).groupBy("part").agg(*per_mask)
    table = table.select("part", *[F.array(*[F.col(f"{c}{m}") for m in range(1 << len(LETTERS))]).alias(c) for c in ("n", "good", "toxic")])
    steps = []
    for order in permutations(range(len(LETTERS))):
        before = 0
        for i, f in enumerate(order):
            steps.append(("".join(LETTERS[x] for x in order), i + 1, before, 1 << f))
            before |= 1 << f
    literal = ", ".join(f"struct('{o}', {i}, {b}, {f})" for o, i, b, f in steps)
    table = table.withColumn("s", F.explode(F.expr(f"array({literal})"))).select("part", "n", "good", "toxic", F.col("s.col1").alias("filter_order"), F.col("s.col2").alias("step"), F.col("s.col3").alias("before"), F.col("s.col4").alias("own"))

    def total(of: str, when: str, times: str = "1") -> F.Column:
        return F.expr(f"aggregate({of}, 0L, (s, x) -> s + x)" if when == "true" else f"aggregate(transform({of}, (x, m) -> if({when}, x * {times}, 0L)), 0L, (s, x) -> s + x)")

    removed = "(m & before) = 0 and (m & own) > 0"
    return table.select(
        "part", "filter_order", "step",
        total("n", "(m & (before | own)) = 0").alias("kept"),
        total("n", removed).alias("removed"),
        total("n", "(m & before) > 0 and (m & own) > 0").alias("redundant"),
        total("n", "m = own").alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        # each of the filters that a document fails comes first of them in equally many of the 120 orders
        total("n", "(m & own) > 0", "(120 div bit_count(m))").alias("shapley"),
    )


ORACLE = r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS bad FROM labels GROUP BY doc_id),
f AS (
  SELECT w.doc_id, part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
    [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * len(t), regexp_matches(t, '[#$%&*|]'),
     coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false)] AS fails
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id
), one AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
orders AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM one a, one b, one c, one d, one e
  WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5
), steps AS (SELECT filter_order, CAST(unnest([1, 2, 3, 4, 5]) AS INTEGER) AS step FROM orders),
hit AS (
  SELECT doc_id, part, good, bad, fails, filter_order, list_position(list_transform(string_split(filter_order, ''), lambda c: fails[ascii(c) - 64]), true) AS first FROM f, orders
), counts AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS own,
    count(*) FILTER (first IS NULL OR first > step) AS kept, count(*) FILTER (first = step) AS removed,
    count(*) FILTER (first < step AND fails[ascii(substr(filter_order, step, 1)) - 64]) AS redundant,
    count(*) FILTER (fails[ascii(substr(filter_order, step, 1)) - 64] AND len(list_filter(fails, lambda x: x)) = 1) AS unique_fails,
    CAST(coalesce(sum(good) FILTER (first = step), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(bad) FILTER (first = step), 0) AS BIGINT) AS toxic_lost
  FROM hit JOIN steps USING (filter_order) GROUP BY part, filter_order, step
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM counts
"""
