"""Vector codes against whole numbers in plain Python."""

import hashlib
import math
import random
from collections import defaultdict

from pyspark.sql import types as T

from tallyspark.llm import codes

ROWS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("Code", T.StringType())])


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], ROWS)


def plain(rows, parts, entries, rounds):
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            got = defaultdict(list)
            for c in cut:
                got[near(c[p], books[p])[1]].append(c[p])
            for i, xs in got.items():
                books[p][i] = [sum(col) // len(xs) for col in zip(*xs)]
    final = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    totals = defaultdict(int)
    for (_, _, label), f in zip(kept, final):
        totals[label] += sum(d for d, _ in f)
    return [(i, "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f), totals[label], digest) for (i, _, label), f in zip(kept, final)]


def rows_of(seed, n, length):
    rnd = random.Random(seed)
    rows = [(i, [round(rnd.gauss(0, 1) * 8) / 8 for _ in range(length)], rnd.choice([0, 1, None])) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [None] * length, 1), (n + 2, [math.nan] * length, 0), (n + 3, [math.inf] + [0.0] * (length - 1), None)]
    rows += [rows[3], rows[3], (None, [0.5] * length, None), (7, [-0.0001] * length, 2)]
    return rows


def same(got, want):
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_against_plain(spark):
    rows = rows_of(1, 150, 16)
    same(codes.compress(frame(spark, rows)).collect(), plain(rows, 8, 16, 6))
    same(codes.compress(frame(spark, rows).repartition(7), parts=4, entries=5, rounds=3).collect(), plain(rows, 4, 5, 3))


def test_ties_and_few_rows(spark):
    rows = [(i, [float(i // 2)] * 8, 0) for i in range(6)] + [(9, [0.5] * 8, None)] * 40
    same(codes.compress(frame(spark, rows)).collect(), plain(rows, 8, 16, 6))


def test_label_sums_of_many_labels(spark, monkeypatch):
    monkeypatch.setattr(codes, "FEW_LABELS", 1)
    rows = rows_of(2, 60, 8)
    same(codes.compress(frame(spark, rows)).collect(), plain(rows, 8, 16, 6))


def test_empty_and_odd_lengths(spark):
    assert codes.compress(frame(spark, [])).count() == 0
    assert codes.compress(frame(spark, [(1, None, 0)])).count() == 0
    rows = rows_of(3, 40, 8)
    got = codes.compress(frame(spark, rows + [(1, [1.0, 2.0], 0), (2, [], 1)])).collect()
    assert sorted(map(repr, [tuple(r)[:3] for r in got])) == sorted(map(repr, [r[:3] for r in plain(rows, 8, 16, 6)] + [(1, None, None), (2, None, None)]))


def test_huge_components_are_held(spark):
    rows = [(i, [3e38 if i % 2 else -3e38] * 8, i) for i in range(4)]
    got = codes.compress(frame(spark, rows)).collect()
    assert sorted((r.code, r.error) for r in got) == [("00" * 8, 0), ("00" * 8, 0), ("01" * 8, 0), ("01" * 8, 0)]
