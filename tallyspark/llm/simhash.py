"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most ``radius`` bits share a variant that differs from each in
at most ``radius / 2``. So every distinct fingerprint emits all variants of that kind (65 for
radius 2), rows meet on the variant, and neighbours within a variant's group are verified and
linked. A group holds distinct fingerprints within half the radius of one value, 65 at most, so it
stays small however many copies a text has; copies are one row before anything is emitted.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, connected_components, free_name

SEED = 42


def fingerprint(text: str | None, words: int = 3) -> int:
    """Signed 64-bit SimHash of the whole text; 0 without words."""
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    joined, n = b" ".join(found), max(1, len(found) - words + 1)
    ends = list(accumulate(len(w) + 1 for w in found))
    starts = [0, *ends][:n]
    hashed = xxhash.xxh64_intdigest
    hashes = np.array([hashed(joined[s : e - 1], SEED) for s, e in zip(starts, ends[min(words, len(found)) - 1 :])], dtype="<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        counts += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(text: F.Column, words: int = 3) -> F.Column:
    """``fingerprint`` of each text (null: as empty), as a long column."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, words) for t in texts], dtype="int64")

    return of(text)


def links(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """``nodes(fp)``, distinct -> edges ``(a, b)`` that join all fingerprints within ``radius`` bits.

    Not each pair is an edge, but each pair within the radius is joined by a chain of edges
    that all lie within it.
    """
    if radius < 2 or radius % 2:
        raise ValueError("the radius must be even and positive")
    masks = [sum(1 << b for b in bits) for k in range(radius // 2 + 1) for bits in combinations(range(64), k)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    variants = nodes.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(m).cast("long")) for m in signed])).alias("variant"))
    pairs = variants.select(F.lag("fp").over(Window.partitionBy("variant").orderBy("fp")).alias("a"), F.col("fp").alias("b"))
    return pairs.filter(F.col("a").isNotNull() & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).distinct()


def _rooted(nodes: DataFrame, radius: int) -> DataFrame:
    """``nodes(fp, least)`` -> (fp, least, component)."""
    found = connected_components(links(nodes.select("fp"), radius))
    return nodes.join(found.select(F.col("node").alias("fp"), "component"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> one row per document: doc_id, fingerprint, component_id.

    A null text counts as empty; its fingerprint is zero and links like any other. Rows without a
    doc_id keep their row; the component_id is the smallest doc_id that is not null (null if there
    is none). Repeated rows stay and share a component. Other columns are not read. An empty
    table gives an empty result.
    """
    marked = checkpointed(docs.select("doc_id", fingerprints(F.col("text"), words).alias("fp")))
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = _rooted(nodes, radius)
    least = rooted.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = rooted.join(least, "component").select("fp", "component_id")
    return marked.join(ids, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """All columns of the one document kept of each near-duplicate group.

    Kept is the row with the smallest doc_id (rows without one last), then text hash. Rows that
    agree in both are one document: one of them stays.
    """
    key = free_name(docs, "text_hash")
    marked = checkpointed(docs.select("doc_id", F.xxhash64("text").alias("h"), fingerprints(F.col("text"), words).alias("fp")))
    row = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "h")
    nodes = marked.groupBy("fp").agg(F.min(row).alias("least"))
    first = _rooted(nodes, radius).groupBy("component").agg(F.min("least").alias("least")).select(F.col("least.doc_id").alias("_id"), F.col("least.h").alias("_h")).distinct()
    keyed = docs.withColumn(key, F.xxhash64(docs["text"]))
    kept = keyed.join(first, keyed["doc_id"].eqNullSafe(first["_id"]) & (keyed[key] == first["_h"]), "left_semi")
    return kept.dropDuplicates(["doc_id", key]).drop(key)
