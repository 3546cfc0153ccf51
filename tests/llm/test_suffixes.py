"""Repeated passages against brute force, and the suffix array against sorting."""

import hashlib
import random

import numpy as np

from tallyspark.llm import suffixes

SCHEMA = "doc_id long, text string, h1 string, DOC int, kind int"


def slow(docs):
    first = {}
    key = lambda d: (d is None, d or 0)
    raws = [(key(d), (t or "").encode()) for d, t in docs]
    for k, raw in raws:
        for i in range(len(raw) - 49):
            w = raw[i : i + 50]
            first[w] = min(first.get(w, k), k)
    out = []
    for (d, _), (k, raw) in zip(docs, raws):
        gone = bytearray(len(raw))
        for i in range(len(raw) - 49):
            if first[raw[i : i + 50]] < k:
                gone[i : i + 50] = b"\1" * 50
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((str(d), len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest()))
    return sorted(out)


def some(seed, n=150):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 7))) for _ in range(80)]
    say = lambda k: " ".join(rnd.choice(vocab) for _ in range(k))
    passages = [say(rnd.choice([8, 20, 60])) for _ in range(6)]
    docs = []
    for i in range(n):
        text = say(rnd.choice([0, 3, 30, 90]))
        for _ in range(rnd.choice([0, 0, 1, 2])):
            text += rnd.choice([" ", "\n", ""]) + rnd.choice(passages) + " " + say(rnd.choice([0, 5]))
        docs.append((rnd.randrange(10_000), text))
    docs += [(20_000 + i, docs[rnd.randrange(n)][1][rnd.choice([0, 0, 3]) :]) for i in range(30)]
    docs += [docs[4], (docs[5][0], docs[6][1]), (None, docs[7][1]), (None, passages[0] + "x"), (None, passages[0] + "y"), (1, None), (2, ""), (3, "a" * 3000), (4, "a" * 70 + "b" + "a" * 80), (5, "ab" * 900), (6, "\x00" * 200), (0, passages[2])]
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(d, t, "x", 1, 2) for d, t in docs], SCHEMA)


def test_removed(spark):
    for seed in (1, 2):
        docs = some(seed)
        got = suffixes.removed_repeats(frame(spark, docs).repartition(5)).collect()
        assert sorted((str(r[0]), *r[1:]) for r in got) == slow(docs)


def test_common_anchors(spark, monkeypatch):
    docs = some(3)
    plain = suffixes._shared
    monkeypatch.setattr(suffixes, "_shared", lambda buckets, width, hot: plain(buckets, width, 3))
    got = suffixes.removed_repeats(frame(spark, docs).repartition(3)).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == slow(docs)


def test_nothing(spark):
    assert suffixes.removed_repeats(frame(spark, [])).collect() == []
    assert [tuple(r)[:4] for r in suffixes.removed_repeats(frame(spark, [(None, None)])).collect()] == [(None, 0, 0, 0)]


def test_suffix_array():
    rnd = np.random.default_rng(5)
    for size, letters in ((1, 1), (40, 1), (500, 2), (3000, 4), (3000, 200)):
        x = np.zeros(size + 80, np.uint8)
        x[:size] = rnd.integers(1, 1 + letters, size)
        x[rnd.integers(0, size, size // 90)] = 0
        x[size - 1] = 0
        wanted = rnd.random(size) < 0.7
        raw = x.tobytes()
        order = suffixes.suffix_array(x, wanted)
        assert sorted(order) == list(np.flatnonzero(wanted))
        keys = [raw[i : i + 50] for i in order]
        assert keys == sorted(keys)
        lcp = suffixes.common_prefixes(x, order)
        for a, b, n in zip(order, order[1:], lcp[1:]):
            k = 0
            while k < 50 and raw[a + k] == raw[b + k]:
                k += 1
            assert k == n


def test_identity_is_two_hashes(spark):
    """The second hash isn't a function of the first: seeded with the first one, it would be another number."""
    from pyspark.sql import functions as F

    from tallyspark.llm.common import identity

    df = spark.createDataFrame([("a",), ("b",), ("",)], "t string")
    rows = df.select(*[c.alias(n) for n, c in identity("t", "h1", "h2").items()], F.xxhash64("t").alias("h"), F.xxhash64("t", F.lit(1)).alias("chained")).collect()
    assert len({r["h1"] for r in rows}) == len({r["h2"] for r in rows}) == 3
    assert all(r["h2"] not in (r["h1"], r["h"], r["chained"]) for r in rows)
