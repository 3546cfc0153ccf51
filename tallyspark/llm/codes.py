"""Vector code compression: product quantisation in whole numbers.

Components become whole numbers, vectors are cut into equal parts, and each part position has a
codebook of a few entries. The codebooks (parts x entries x width numbers, whatever the input's
size) travel to the tasks; a task computes the distances of an Arrow batch to all entries by norm
expansion, |a|^2 - 2 a b + |b|^2, with int64 matrix products, takes the first least one and adds
up its vectors per entry. Each task hands on one row per part and entry; a grouped shuffle merges
them, and the floored means are the next round's codebooks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Label sums of at most this many labels are broadcast.
FEW_LABELS = 100_000


def whole_numbers(df: DataFrame, vector: str = "embedding", scale: int = 4096) -> DataFrame:
    """(vec_id, label, v): rows whose vector is there with finite components; v = floor(scale * x).

    A component of a vector of n numbers is held within sqrt(2^61 / n), so that no distance leaves
    64 bits; at 64 numbers and a scale of 4096 that is reached by components beyond 46,000 only.
    """
    x = F.col(vector)
    sound = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    bound = F.least(F.floor(F.sqrt(F.lit(2.0**61) / F.greatest(F.size(x), F.lit(1)))), F.lit(2**31 - 1)).cast("double")
    held = F.transform(x, lambda c: F.greatest(F.least(F.floor(c.cast("double") * scale).cast("double"), bound), -bound).cast("int"))
    return df.filter(sound).select("vec_id", "label", held.alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def nearest(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest entry of every row, and its squared distance; int64 all through."""
    distances = (part * part).sum(axis=1)[:, None] - 2 * (part @ book.T) + (book * book).sum(axis=1)[None, :]
    first = distances.argmin(axis=1)
    return first, distances[np.arange(len(part)), first]


def trained(vectors: DataFrame, books: np.ndarray, rounds: int) -> np.ndarray:
    """``vectors(v)``, all of one length; books: parts x entries x width, int64 -> the last round's books."""
    parts, entries, width = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            rows = _matrix(batch.column(0), parts * width)
            for p in range(parts):
                part = rows[:, p * width : (p + 1) * width]
                code, _ = nearest(part, books[p])
                order = np.argsort(code, kind="stable")
                used, starts = np.unique(code[order], return_index=True)
                if len(used):
                    totals[p, used] += np.add.reduceat(part[order], starts, axis=0)
                counts[p] += np.bincount(code, minlength=entries)
        p, e = np.nonzero(counts)
        if len(p):
            yield pa.RecordBatch.from_pydict({"part": pa.array(p, pa.int32()), "entry": pa.array(e, pa.int32()), "n": pa.array(counts[p, e]), "total": pa.array(list(totals[p, e]), pa.list_(pa.int64()))})

    for _ in range(rounds):
        partial = vectors.select("v").mapInArrow(sums, "part int, entry int, n long, total array<long>")
        merged = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("total", F.lit(i)).cast("decimal(20,0)")) for i in range(width)]).alias("total"))
        following = books.copy()
        for row in merged.collect():  # parts x entries rows at most
            following[row.part, row.entry] = [int(t) // row.n for t in row.total]
        if (following == books).all():  # every later round would repeat this one
            break
        books = following
    return books


def compress(df: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """``df(vec_id, embedding, label)`` -> vec_id, code, error, label_error, codebooks_sha256.

    Vectors that are null or hold null or non-finite components are dropped. The codebooks start
    from the smallest vec_ids (nulls last, ties by the vector); with fewer rows than entries they
    have as many entries as rows. Repeated rows and ids are rows like any other. Vectors must have
    the length of the first one, a positive multiple of ``parts``; others keep their row with a null
    code and error and take no part in the codebooks. Errors of null labels are summed together.
    Other columns are not read. An empty table gives an empty result.
    """
    rows = stored(whole_numbers(df, scale=scale))
    fitting = rows.filter((F.size("v") > 0) & (F.size("v") % parts == 0))
    first = fitting.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(1).collect()
    length = len(first[0].v) if first else parts
    fitting, others = rows.filter(F.size("v") == length), rows.filter(F.size("v") != length)
    width = length // parts
    start = fitting.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    books = np.array([r.v for r in start], np.int64).reshape(-1, parts, width).transpose(1, 0, 2)
    books = trained(fitting, books, rounds) if start else books
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column("v"), length)
            codes, error = np.zeros((len(vectors), parts), np.uint8), np.zeros(len(vectors), np.int64)
            for p in range(parts):
                codes[:, p], least = nearest(vectors[:, p * width : (p + 1) * width], books[p])
                error += least
            text = codes.tobytes().hex()
            step = 2 * parts
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([text[i : i + step] for i in range(0, len(text), step)], pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    kinds = dict(rows.dtypes)
    coded = fitting.mapInArrow(assign, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")
    coded = stored(coded.unionByName(others.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))))
    totals = coded.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"))
    few = totals.limit(FEW_LABELS + 1).count() <= FEW_LABELS
    out = coded.join(F.broadcast(totals) if few else totals, F.col("label").eqNullSafe(F.col("of")), "left")
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def oracle(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The same in SQL for vectors of one length, a round after the other."""
    steps = [
        f"""WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS k, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), p AS MATERIALIZED (
  SELECT k, part, v[part * (len(v) // {parts}) + 1:(part + 1) * (len(v) // {parts})] AS x FROM v, (SELECT unnest(generate_series(0, {parts - 1})) AS part)
), b0 AS (SELECT part, k - 1 AS entry, x AS e FROM p WHERE k <= {entries})"""
    ]
    near = "SELECT k, part, min_by(entry, (d, entry)) AS entry, min(d) AS d FROM (SELECT k, p.part, entry, list_sum(list_transform(list_zip(x, e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p JOIN b{i} USING (part)) GROUP BY k, part"
    for i in range(rounds):
        steps.append(f"a{i} AS MATERIALIZED ({near.format(i=i)})")
        steps.append(f"s{i} AS (SELECT part, entry, pos, CAST(floor(sum(y) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS m FROM (SELECT part, entry, unnest(x) AS y, unnest(generate_series(1, len(x))) AS pos FROM p JOIN a{i} USING (k, part)) GROUP BY part, entry, pos)")
        steps.append(f"b{i + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.l, b.e) AS e FROM b{i} b LEFT JOIN (SELECT part, entry, list(m ORDER BY pos) AS l FROM s{i} GROUP BY part, entry) m USING (part, entry))")
    steps.append(f"f AS MATERIALIZED ({near.format(i=rounds)})")
    steps.append("c AS (SELECT k, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM f GROUP BY k)")
    steps.append(f"h AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS s FROM b{rounds})")
    return ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h.s AS codebooks_sha256 FROM v JOIN c USING (k), h"
