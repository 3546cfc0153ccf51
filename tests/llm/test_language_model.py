"""Language-model scores: base against brute force, normalisation, and better held-out scores than the base's."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tallyspark.llm import language_model as lm

SCHEMA = "doc_id long, text string, rid int, C string"


def corpus(n=400, seed=3):
    rnd = random.Random(seed)
    nouns = [f"n{i}" for i in range(30)]
    verbs = [f"v{i}" for i in range(30)]
    docs = []
    for i in range(n):
        words = []
        for _ in range(rnd.randint(1, 60)):
            words += ["The" if rnd.random() < 0.5 else "a", rnd.choice(nouns), rnd.choice(verbs), "x" + str(rnd.randrange(3000))]
        docs.append((i, " ".join(words)))
    return docs + [(5000, None), (5001, ""), (5002, " \t\n"), (None, "the n1 Éa é"), docs[3], (5003, "n1 " * 50_000)]


def fold(d):
    return zlib.crc32(str("" if d is None else d).encode()) % 5


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["\n"]


def test_scores(spark, monkeypatch):
    monkeypatch.setattr(lm, "HELD", 600)
    docs = corpus()
    c = Counter(t for d, text in docs if fold(d) != 1 for t in tokens(text))
    n, v = sum(c.values()), len(c)
    got = lm.scores(spark.createDataFrame([(d, t, 1, "z") for d, t in docs], SCHEMA).repartition(3)).collect()
    assert len(got) == len(docs)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], r)
    gain = 0
    for d, text in docs:
        r, words = by[d], tokens(text)
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (fold(d) == 1, len(words), sum(c[w] > 0 for w in words), n)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base))
        assert r["score"] < 0 and math.isfinite(r["score"])
        if r["held_out"] and d is not None and d < 400:
            gain += r["score"] - r["base_score"]
    assert gain > 0.1 * sum(len(tokens(t)) for d, t in docs if fold(d) == 1 and d is not None and d < 400)


def test_scores_are_what_the_model_says(spark, monkeypatch):
    """Softmax over the classes and a word's share of its class, token by token, with few tokens held."""
    monkeypatch.setattr(lm, "HELD", 120)
    monkeypatch.setattr(lm, "SINGLE", 40)
    monkeypatch.setattr(lm, "ENDINGS", 30)
    kept = {}
    real = lm.fit
    monkeypatch.setattr(lm, "fit", lambda *a: kept.setdefault("fit", real(*a)))
    docs = [x for x in corpus(120) if x[0] != 5003]
    got = {r["doc_id"]: r for r in lm.scores(spark.createDataFrame([(d, t, 1, "z") for d, t in docs], SCHEMA)).collect()}
    held, _, model = kept["fit"]
    c = Counter(t for d, text in docs if fold(d) != 1 for t in tokens(text))
    n, v = sum(c.values()), len(c)
    unigram = {w: (c[w] + 0.5) / (n + 0.5 * (v + 1)) for w in {t for _, text in docs for t in tokens(text)}}
    class_of = lambda w: int(held.of_held[held.number[w]]) if w in held.number else held.endings.get(w[-lm.TAIL :], len(held.share) - 1)
    mass = [0.0] * len(held.share)
    for w in c:
        mass[class_of(w.encode())] += unigram[w]
    for k, m in enumerate(mass[:-1]):
        assert abs(m - held.share[k]) < 1e-9
    assert len(held.number) < len(c) and any(class_of(w.encode()) == len(held.share) - 1 for w in c)
    pad = len(held.share)
    for d, text in docs:
        before, total = [pad] * lm.CONTEXT, 0.0
        for w in tokens(text):
            k = class_of(w.encode())
            logits = model.hidden(np.array(before)[:, None])[0] @ model.target.T + model.bias
            total += math.log10(np.exp(logits - logits.max())[k] / np.exp(logits - logits.max()).sum())
            if k > held.single:
                total += math.log10(unigram[w] / held.share[k])
            before = [k, *before[:-1]]
        assert abs(got[d]["score"] - total) < 1e-3 * max(1, abs(total))


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_held_out_documents_score_better_than_the_base(spark, size):
    docs = spark.read.parquet(f"/root/testdata/{size}/documents.parquet")
    one = lm.scores(docs.repartition(1)).toPandas()
    out = one[one["held_out"]]
    assert (out["score"].sum() - out["base_score"].sum()) / out["n_tokens"].sum() > 0.3
    assert (out["score"] > out["base_score"]).mean() > 0.95
    other = lm.scores(docs.repartition(5)).toPandas()
    both = one.merge(other, on="doc_id")
    assert (both["score_x"] - both["score_y"]).abs().max() < 1e-6


def test_normalised():
    model = lm.Bilinear.start(np.full(20, 0.05))
    logs = model.normalisers()
    for a, b in ((0, 0), (20, 20), (3, 20)):
        p = np.exp((model.near[0][a] + model.near[1][b]) @ model.target.T + model.bias - logs[a, b])
        assert abs(p.sum() - 1) < 1e-4


def test_nothing(spark):
    assert lm.scores(spark.createDataFrame([], SCHEMA)).collect() == []
    r = lm.scores(spark.createDataFrame([(1, "one two one", 1, "z")], SCHEMA)).collect()[0]
    assert r["n_tokens"] == 4 and math.isfinite(r["score"])


def test_what_comes_to_the_driver(spark):
    """The most frequent tokens, as many as fit, and whole texts of a bounded size."""
    from tallyspark.llm import language_model as lm

    rows = [(f"w{i}", 1000 // (i + 1) + 1) for i in range(400)]
    counts = spark.createDataFrame(rows, "token string, c long")
    assert lm.most_frequent(counts, 1000) == sorted(((w.encode(), c) for w, c in rows), key=lambda x: (-x[1], x[0]))
    few = lm.most_frequent(counts, 50)
    assert 20 <= len(few) <= 80 and few[:20] == [(w.encode(), c) for w, c in rows[:20]]
    assert lm.most_frequent(counts.limit(0)) == []
    texts = spark.createDataFrame([(i, "a b " * (1_000_000 if i == 7 else 3)) for i in range(50)] + [(3, "a b " * 3)], "key long, text string")
    sample = lm.sample_texts(texts, 50)
    assert len(sample) == 49 and max(map(len, sample)) == 12
