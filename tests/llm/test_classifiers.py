"""Quality and toxicity: held-out accuracy on planted cases, spans, and odd inputs."""

import random
import zlib

from tallyspark.llm import quality, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, SCORE string, id string"


def corpus(n=700, seed=4):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("aeioubcdfglmnprst") for _ in range(rnd.randint(3, 8))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        words = [rnd.choice(vocab) for _ in range(rnd.randint(20, 120))]
        toxic, good = rnd.random() < 0.25, rnd.random() < 0.8
        if toxic:
            for _ in range(rnd.randint(1, 4)):
                words[rnd.randrange(len(words))] = rnd.choice(["grumph", "blargle", "snorkly"])
        if not good:
            words = [w.upper() + "!!" for w in words]
        text = " ".join(words)
        docs.append((i, text, "en" if good else "xx", f"s{i % 7}", len(text), "x", "y"))
        labels.append((i, int(good), int(toxic)))
    return docs, labels


ODD = [(None, "grumph blargle", None, None, None, "x", "y"), (5000, None, None, None, -1, "x", "y"), (5001, "", "en", "s1", 0, "x", "y"), (5002, "1 2 3 ...", "en", "s1", 9, "x", "y"), (5003, "word " * 60_000, "en", "s1", 300_000, "x", "y")]


def held(doc_id):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 5 == 0


def test_toxicity(spark):
    docs, labels = corpus()
    lab = spark.createDataFrame(labels + [(None, 1, 1), (3, None, None), (99_999, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.classify(spark.createDataFrame(docs + ODD + docs[:2], SCHEMA), lab).collect()
    assert len(got) == len(docs) + len(ODD) + 2
    truth = {i: t for i, _, t in labels}
    tested = [(r["predicted"], truth[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(tested) > 80 and sum(a == b for a, b in tested) >= 0.95 * len(tested)
    assert all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[5000]["score"] == by[5001]["score"] < 0.5 and by[5003]["predicted"] == 0
    assert by[None]["predicted"] == 1 and by[None]["spans"] == "0:6,7:14"


def test_marginals_against_enumeration():
    import itertools

    import numpy as np

    own, moves = np.array([0.3, -1.0, 2.0, 0.1, -0.4]), np.array([0.0, -0.7, 0.2, 0.9])
    for starts in ([0, 5], [0, 2, 2, 5], [0, 1, 5]):
        want = []
        for a, b in zip(starts, starts[1:]):
            total, one = 0.0, np.zeros(b - a)
            for y in itertools.product((0, 1), repeat=b - a):
                w = np.exp(sum(own[a + i] for i, v in enumerate(y) if v) + sum(moves[2 * u + v] for u, v in zip(y, y[1:])))
                total += w
                one += w * np.array(y)
            want += list(one / total) if b > a else []
        assert np.allclose(toxicity.marginals(own, np.array(starts), moves)[2], want)


def test_quality(spark):
    docs, labels = corpus(900, 6)
    lab = spark.createDataFrame(labels[:500] + [(None, 0, 1), (3, None, None), (99_999, 1, 1)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(docs + ODD, SCHEMA)
    got = quality.classify(df, lab).collect()
    truth = {i: q for i, q, _ in labels}
    tested = [(r["predicted"], truth[r["doc_id"]]) for r in got if r["doc_id"] in truth]
    assert len(got) == len(docs) + len(ODD) and sum(a == b for a, b in tested) >= 0.97 * len(tested)
    kept = quality.keep_good(df, lab)
    assert kept.columns == df.columns and kept.count() == sum(r["predicted"] for r in got)


def test_without_labels_or_rows(spark):
    docs, labels = corpus(30)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(docs, SCHEMA)
    for module in (toxicity, quality):
        assert module.classify(df, none).count() == 30
        assert module.classify(df.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect() == []
    assert quality.classify(df.select("doc_id", "text"), none).count() == 30
