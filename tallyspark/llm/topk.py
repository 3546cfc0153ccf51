"""Exact top-k inner products by no-random-access aggregation (NRA).

Candidates are dealt into cells. In a cell every dimension is a list sorted by the component,
read one entry after the other from either end. What a candidate has shown so far, plus the most
(least) that the unread middle of each list can hold for a query, bounds its score from above
(below). Reading stops when few candidates outside the k with the highest lower bounds can still
reach the k-th of them; only those are resolved. All queries of a cell read in step, so the bounds
are matrix products. The cells' answers are merged per query. Queries and candidates meet in a
grid of cells of bounded size, so neither side is broadcast or gathered.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Shares of a list that are read from either end when the bounds are looked at.
STEPS = (0.36, 0.45)
#: Open scores per query below which reading further costs more than resolving.
FEW = 200
_CHUNK = 256


class SortedLists:
    """The sorted lists of a cell: for each dimension, candidates by ascending component."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.x = ids, vectors
        order = np.argsort(vectors, axis=0, kind="stable")
        n, looks = len(ids), []
        for share in STEPS:
            low, high = int(share * n), n - int(share * n)
            if high - low < n:
                unread = np.zeros(vectors.shape)
                np.put_along_axis(unread, order[low:high], 1.0, axis=0)
                edges = np.take_along_axis(vectors, order[[max(0, low - 1), min(n - 1, high)]], axis=0)
                looks.append((unread, np.where(unread > 0, 0.0, vectors), edges))
        self.looks = looks

    def top(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query_id, vec_id, score) of the k best of this cell for each query, ties to the smaller id."""
        own = self.ids[None, :] == query_ids[:, None]
        open_ = ~own
        for unread, shown, (low, high) in self.looks:
            seen = queries @ shown.T
            worst, best = np.minimum(queries * low, queries * high), np.maximum(queries * low, queries * high)
            lower = seen + worst @ unread.T
            lower[own] = -np.inf
            if lower.shape[1] > k:
                kth = np.partition(lower, lower.shape[1] - k, axis=1)[:, lower.shape[1] - k]
                open_ = (seen + best @ unread.T >= kth[:, None]) & ~own
            if open_.sum() <= FEW * len(queries):
                break
        q, c = np.nonzero(open_)
        scores = np.concatenate([np.einsum("ij,ij->i", queries[q[i : i + 65536]], self.x[c[i : i + 65536]]) for i in range(0, len(q), 65536)] or [np.zeros(0)])
        order = np.lexsort((self.ids[c], -scores, q))
        q, c, scores = q[order], c[order], scores[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q, side="left")
        kept = rank < k
        return query_ids[q[kept]], self.ids[c[kept]], scores[kept].astype(np.int64)


def usable(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, v): rows whose id and vector are there and whose components are all finite; v = floor(256 x)."""
    x = F.col(vector)
    sound = F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df.filter(sound).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * 256).cast("double")).alias("v"))


def search(df: DataFrame, queries: DataFrame, k: int = 5, cell_rows: int = 8192, cell_queries: int = 2048) -> DataFrame:
    """``usable`` candidates and queries -> query_id, rank, vec_id, score.

    Scores are exact while they stay below 2^53. A vector meets only vectors of its own length.
    Rows with the query's own vec_id are the query; repeated queries are one, repeated candidates
    keep their rows. Empty tables give an empty result.
    """
    n, m = df.count(), queries.count()
    rows, cols = 1 + n // cell_rows, 1 + m // cell_queries
    left = df.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(rows)).alias("row"), F.size("v").alias("dim")).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))
    asked = queries.dropDuplicates(["vec_id"]).select("vec_id", "v", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(cols)).cast("int").alias("col"), F.size("v").alias("dim"))
    right = asked.withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rows - 1).cast("long"))))

    def answer(key: tuple, candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = [(np.zeros(0, np.int64),) * 3]
        if len(candidates) and len(queries):
            lists = SortedLists(candidates["vec_id"].to_numpy(), np.stack(candidates["v"].to_numpy()))
            ids, vectors = queries["vec_id"].to_numpy(), np.stack(queries["v"].to_numpy())
            found += [lists.top(ids[i : i + _CHUNK], vectors[i : i + _CHUNK], k) for i in range(0, len(ids), _CHUNK)]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*found)))))

    keys = ["row", "col", "dim"]
    cells = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(answer, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return cells.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def every_nth(df: DataFrame, n: int = 50, k: int = 5) -> DataFrame:
    """The rows whose id is divisible by ``n`` against all rows; see ``usable`` and ``search``."""
    rows = usable(df)
    return search(rows, rows.filter(F.col("vec_id") % n == 0), k)
