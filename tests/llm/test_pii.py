"""Personal data against a brute-force reading of the contract."""

import hashlib
import random
import re

from tallyspark.llm import pii

SPEC = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, spec) in enumerate(SPEC.items()):
        for m in re.finditer(spec, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x or 0) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [x for *_, x in sorted(out)]


CASES = [
    None,
    "",
    "Ü é😀 x.y@b.co_c@d-e.org..f@g.h.i@j.k a@@b.c a@b. @x.y é@b.de",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0255 1..2.3.4 99999999999.1.1.1 1.2.3.4",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 1111 1111 41111111111111112 - 5555555555554444",
    "4111 1111 1111 1111 1.2.3.4 +1 (017) 555-7713 rethsh +49 30 1234567 +1+2 5555555555 +1 2",
    'Dr. Anna Meier called, token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" tel: 030-123-4567, version 1.2.3.4',
    "1 " * 10000,
    "7" * 10_000,
    "a" * 10_000,
    "a@b" + ".c" * 20_000,
    "a." * 20_000 + "@b.co",
    "+1" * 20_000,
    "+1 " + "2 " * 30_000,
    "1." * 30_000,
    "1@1.1 " * 5000,
]


def test_base_spans(spark):
    rnd = random.Random(3)
    pieces = ["a", "1", "12", "255", "256", ".", "-", " ", "@", "+", "(", ")", "_", "%", "é", "😀", "\n", "4111111111111111", "x.y", "\t", "5555 5555 5555 4444"]
    texts = CASES + ["".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 80))) for _ in range(1500)]
    rows = [(i if i % 11 else None, t, "m", 1) for i, t in enumerate(texts)] + [(3, CASES[3], "m", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string, rid int")
    got = pii.detect(df).collect()
    want = []
    for i, t, *_ in rows:
        spans = base_spans(t or "")
        n = [sum(s.startswith(k) for s in spans) for k in SPEC]
        want.append((str(i), *n, hashlib.sha256(",".join(spans).encode()).hexdigest()))
    assert sorted((str(r[0]), *r[1:6]) for r in got) == sorted(want)
    by = {r["doc_id"]: r["spans"].split(",") for r in got if r["doc_id"] is not None}
    for i, t, *_ in rows:
        if i is not None:
            assert [s for s in by[i] if s.split(":")[0] in SPEC] == base_spans(t or "")
            ends = [tuple(map(int, s.split(":")[1:])) for s in by[i] if s]
            assert ends == sorted(ends, key=lambda x: x[0])


def test_added_spans(spark):
    rows = [(i, f'und mail{i}.x@mail7.example.com geie token = "{hashlib.sha1(str(i).encode()).hexdigest()}" ende Dr. Anna Meier +1 (017) 555-{7000 + i}') for i in range(40)]
    rows += [(100 + i, f"version 2.0 page 12 {i}") for i in range(40)]
    got = {r["doc_id"]: r["spans"] for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(f"{k}:" in got[i] for i in range(40) for k in ("email", "phone", "name"))
    assert sum("secret:" in got[i] for i in range(40)) >= 36
    assert not any(got[100 + i] for i in range(40))


def test_empty(spark):
    assert pii.detect(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_em_finds_the_bad_labeler():
    # labelers 0 and 1 agree; labeler 2 says yes to everything
    patterns = [((1, 1, 1, None, None, None), 400), ((0, 0, 1, None, None, None), 500), ((1, 0, 1, None, None, None), 20)]
    _, weights = pii.reliabilities(patterns)
    assert weights[0] > 1 and weights[1] > 1 and weights[2] < 0.5
