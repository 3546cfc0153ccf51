"""The filter audit against a plain version, and the scanner's counts against words in Python."""

import random
import re
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from tallyspark.llm import filters

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), T.StructField("mask", T.StringType()), T.StructField("PART", T.StringType())])
LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType()), T.StructField("text", T.StringType())])


def some_texts(seed=3, n=150):
    rnd = random.Random(seed)
    words = ["a", "B", "ABC", "naïve", "x$", "50%", "日本", "long" * 9, "\x0b", " ", "Zz", "😀"] + ["w%d" % i for i in range(300)]
    words = [w.replace("%", "") if rnd.random() < 0.7 else w for w in words]
    texts = [rnd.choice([" ", "  ", "\n", "\t \r\n"]).join(rnd.choices(words[: rnd.choice([3, 30, 320])], k=rnd.choice([0, 1, 5, 199, 200, 260]))) for _ in range(n)]
    return texts + ["", None, " ", "A" * 3, "é" * 98 + "AB", "é" * 97 + "AB", " ".join(["a", "b"] * 100), " ".join(str(i) for i in range(250))]


def slow_counts(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    return [len(words), len(set(words)), len(re.findall("[A-Z]", t)), len(re.findall("[#$%&*|]", t)), len(t)]


def test_counts():
    texts = some_texts()
    want = [slow_counts(t) for t in texts]
    for block in (64, 700, 1 << 20):  # documents of more than a block are read in pieces
        scanner = filters.Scanner(block)
        assert scanner.counts(pa.array(texts)).tolist() == want
        assert scanner.counts(pa.array(["skipped", *texts, "skipped"])[1:-1]).tolist() == want
    assert scanner.counts(pa.array([], pa.string())).tolist() == []


def test_equal_hashes_are_verified(monkeypatch):
    scanner = filters.Scanner()
    scanner.up = np.zeros_like(scanner.up)  # every word of a document now has the same hash
    texts = some_texts()
    assert scanner.counts(pa.array(texts)).tolist() == [slow_counts(t) for t in texts]


def slow_audit(docs, labels):
    rows = []
    for doc_id, text, source in docs:
        n, distinct, capitals, symbols, points = slow_counts(text)
        again = any(i is not None and doc_id is not None and i < doc_id and (t or "") == (text or "") for i, t, _ in docs)
        bad = dict(zip("ABCDE", (n < 200, 100 * distinct < 50 * n, 100 * capitals > 2 * points, symbols > 0, again)))
        mine = [x for x in labels if x[0] == doc_id and doc_id is not None]
        rows.append((source or "", bad, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out = []
    for part in {r[0] for r in rows}:
        removed_by = dict.fromkeys("ABCDE", 0)
        mine = [r for r in rows if r[0] == part]
        table = []
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order):
                left = [r for r in mine if not any(r[1][x] for x in order[:step])]
                gone = [r for r in left if r[1][f]]
                removed_by[f] += len(gone)
                table.append((f, (part, order, step + 1, len(left) - len(gone), len(gone), sum(r[1][f] for r in mine) - len(gone), sum(r[1][f] and sum(r[1].values()) == 1 for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone))))
        out += [(*row, removed_by[f]) for f, row in table]
    return sorted(out)


def frames(spark, docs, labels):
    return spark.createDataFrame([(*d, "m", "p") for d in docs], DOCS), spark.createDataFrame([(*x, "t") for x in labels], LABELS)


def test_audit(spark):
    rnd = random.Random(8)
    texts = some_texts(n=60)
    docs = [(i, t, rnd.choice(["a", "b", None, ""])) for i, t in enumerate(texts)]
    docs += [(500 + i, rnd.choice(texts), "hot") for i in range(80)] + [docs[5], docs[5], (None, texts[5], "b"), (None, None, None)]
    labels = [(rnd.choice([*range(70), 510, 520, None]), rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for _ in range(60)]
    got = filters.audit(*frames(spark, docs, labels)).collect()
    assert sorted(map(tuple, got)) == slow_audit(docs, labels)
    assert {r.part for r in got} == {"", "a", "b", "hot"} and len(got) == 4 * 600


def test_empty(spark):
    assert filters.audit(*frames(spark, [], [])).count() == 0
    got = filters.audit(*frames(spark, [(1, None, "s")], [])).collect()
    assert len(got) == 600 and sum(r.removed for r in got) == 120 and {r.good_lost for r in got} == {0}
