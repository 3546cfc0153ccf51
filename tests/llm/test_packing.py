"""Packing: exact round trips, padding, the rule of the sums of squares, and the ids of the file's own library."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from tallyspark.llm import packing

PATH = packing.vocabulary()
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("START", T.StringType()), T.StructField("ids", T.StringType())])


@pytest.fixture(scope="module")
def plain():
    tokenizer = tokenizers.Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab'stre  \n\t　é한1²!?\U0001f600"), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_ids(plain, text):
    assert packing.token_ids(text, PATH).tolist() == plain(text)


def test_ids_of_long_texts(plain, monkeypatch):
    texts = ["word " * 500, "<|endoftext|> is text", " " * 9000 + "x", "a" * 5000, "don't we'll A b1 c\n d  e " * 300, None, ""]
    want = [plain(t) for t in texts]
    assert [packing.token_ids(t, PATH).tolist() for t in texts] == want
    for text in texts[:-2]:
        pieces = list(packing.blocks(text, 50))
        assert "".join(pieces) == text
        assert [i for p in pieces for i in packing.token_ids(p, PATH).tolist()[:-1]] == plain(text)[:-1]
    assert len(list(packing.blocks(texts[0], 50))) > 20


def test_level_is_the_least_sum_of_squares():
    rnd = random.Random(4)
    for _ in range(300):
        packer = packing.Packer(size=24)
        packer.counts[1:24] = [rnd.choice([0, 0, 1, 2, 5]) for _ in range(23)]
        n = rnd.randint(1, 23)

        def squares(level):
            counts = packer.counts.copy()
            counts[level] -= level > 0
            if level + n < 24:
                counts[level + n] += 1
            return int((counts[1:24] ** 2).sum()), -level

        assert packer.level(n) == min((h for h in range(24 - n + 1) if h == 0 or packer.counts[h]), key=squares)


def check(pieces, docs, size, path=PATH):
    """Every id lies in one piece, sequences are gapless and need no padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p["length"] > 0
        by_doc[p["doc_id"]].append((p["start"], p["length"], p["ids"], p["doc_tokens"]))
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
    for doc_id, text in docs.items():
        mine, at = sorted(by_doc.pop(doc_id)), 0
        ids = packing.token_ids(text, path)
        for start, length, content, total in mine:
            assert (start, total) == (at, len(ids)) and content == ids[start : start + length].tobytes()
            at += length
        assert at == len(ids)
    assert not by_doc
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == size or at < size and at & (at - 1) == 0
    return by_sequence


def packed(sizes, size, most_open):
    packer, ids = packing.Packer(size, most_open), [np.arange(n, dtype="<u4") + 1000 * i for i, n in enumerate(sizes)]
    for i, x in enumerate(ids):
        packer.add(i, x)
        assert packer.open <= most_open
    packer.settle(end=True)
    per, fill = defaultdict(list), defaultdict(list)
    for document, start, x, sequence, offset in packer.taken():
        per[document].append((start, x.tolist()))
        fill[sequence].append((offset, len(x)))
    assert [[v for _, part in sorted(per[i]) for v in part] for i in range(len(ids))] == [x.tolist() for x in ids]
    for parts in fill.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]]
        assert ends[-1] == size or ends[-1] & (ends[-1] - 1) == 0
    return sum(len(p) > 1 for p in per.values())


def test_packer():
    rnd = random.Random(9)
    for size, most, sizes in ((16, 3, [9] * 50), (16, 1000, [11] * 70), (32, 8, [rnd.randint(1, 90) for _ in range(400)]), (2048, 4096, [1500] * 300), (8, 2, [8, 16, 1, 1, 1]), (8, 2, [])):
        packed(sizes, size, most)
    cut = packed([rnd.randint(1, 1023) for _ in range(6000)], 1024, 4096)
    assert cut < 600, "most documents stay whole"


def test_pack(spark):
    rnd = random.Random(2)
    texts = [" ".join(rnd.choices(["the", "Über", "naïve", "x1", "日本語", "long-ish", "\n"], k=rnd.choice([0, 1, 30, 400, 3000]))) for _ in range(120)]
    docs = dict(enumerate([*texts, None, "", " ", texts[3], "w " * 30000]))
    frame = spark.createDataFrame([(i, t, "s", "i") for i, t in docs.items()], DOCS).repartition(3)
    pieces = packing.pack(frame).collect()
    sequences = check(pieces, docs, packing.SIZE)
    digests = {(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in packing.report(frame).collect()}
    assert sum(n for (_, _, n, _, _) in digests) == sum(p["length"] for p in pieces)
    for doc_id, start, length, crc, total in digests:
        ids = packing.token_ids(docs[doc_id], PATH)
        assert total == len(ids) and crc == zlib.crc32(ids[start : start + length].astype("<u4").tobytes())
    whole = packing.sequences(packing.pack(frame.coalesce(1).sortWithinPartitions("doc_id"))).collect()
    assert all(len(r.ids) == 4 * (r.n_tokens if r.n_tokens & (r.n_tokens - 1) == 0 else packing.SIZE) for r in whole)
    assert len(sequences) == len({p.sequence_id for p in pieces})


def test_repeated_and_missing_ids_and_empty(spark):
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(None, "a b c", "", ""), (None, "d", "", ""), (5, "same", "", ""), (5, "same", "", "")]
    got = packing.pack(spark.createDataFrame(rows, DOCS).coalesce(1)).collect()
    assert sorted((str(r.doc_id), r.doc_tokens) for r in got if not r.start) == [("5", 2), ("5", 2), ("None", 2), ("None", 4)]
    assert sum(r.length for r in got) == 10
