"""SimHash near-duplicates, decontamination, top-k and mixing against brute force."""

import hashlib
import random
import re

import xxhash
from pyspark.sql import types as T

from tallyspark.llm import decontaminate, mixing, simhash, topk

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), T.StructField("FOUND", T.StringType()), T.StructField("fp", T.StringType())])


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", "y") for i, t, s in rows], DOCS)


def some_docs(seed=1, n=120):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(1, 6))) for _ in range(60)]
    docs = []
    for i in range(n):
        words = [rnd.choice(vocab) for _ in range(rnd.choice([0, 1, 2, 3, 30, 120]))]
        docs.append((i, " ".join(words) if i % 17 else None, rnd.choice(["a", "b", "ü", None])))
    for i in range(40):
        _, t, s = docs[rnd.randrange(n)]
        docs.append((n + i, t if t is None or i % 3 else t.upper() + "\tx", s))
    return docs + [docs[5], (None, docs[6][1], "a"), (None, "solo words here", None)]


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_components(spark):
    docs = some_docs()
    fps = [slow_fingerprint(t) for _, t, _ in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    want = sorted((str(d), f"{fps[i]:016x}", str(least.get(find(i)))) for i, (d, _, _) in enumerate(docs))
    got = simhash.near_duplicates(frame(spark, docs)).collect()
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got) == want
    kept = {r["doc_id"] for r in simhash.keep_one(frame(spark, docs)).collect()}
    assert kept - {None} == {v for v in least.values()}


def test_keep_one_decides_by_row(spark):
    one, two, three = (" ".join(f"{w}{i}" for i in range(60)) for w in ("alpha", "beta", "gamma"))
    rows = [(1, one), (2, one), (2, two), (3, three), (3, three), (None, three), (None, "only here and without an id"), (None, "only here and without an id"), (7, "first of two texts"), (7, "another text, same id")]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(((str(r[0]), r[1]) for r in got)) == sorted([("1", one), ("2", two), ("3", three), ("None", "only here and without an id"), ("7", "first of two texts"), ("7", "another text, same id")])


def test_simhash_chain_and_empty(spark):
    chain = [0, 0b11, 0b1111, 0b111111, 1 << 63, (1 << 63) | 0b11 << 40]
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in chain]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"))
    from tallyspark.llm.common import connected_components

    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert len({got[x] for x in (0, 3, 15, 63)}) == 1 and got[signed[4][0]] == got[0] == got[signed[5][0]]
    assert simhash.near_duplicates(frame(spark, [])).collect() == []


def test_components_of_a_long_chain(spark):
    from tallyspark.llm.common import connected_components

    nodes = list(range(300))
    random.Random(3).shuffle(nodes)
    edges = spark.createDataFrame([*zip(nodes, nodes[1:]), (1000, 1001)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert {got[n] for n in range(300)} == {0} and got[1000] == got[1001] == 1000


def slow_contamination(docs, items):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    out = []
    for d, t, _ in docs:
        w, hit, names = words(t), set(), set()
        for item, text in items:
            p = words(text)
            n = min(13, len(p))
            for i in range(len(p) - n + 1) if p else ():
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == p[i : i + n]:
                        hit |= set(range(j, j + n))
                        names.add("" if item is None else str(item))
        out.append((str(d), len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def test_contamination(spark):
    rnd = random.Random(5)
    docs = some_docs(2, 60)
    words = (docs[4][1] or docs[7][1] or "a b c").split()
    items = [(1, " ".join(words[:20])), (2, "Zzz, never.seen"), (10, words[0].upper()), (3, None), (None, " ".join(words[5:30])), (4, "ab"), (5, ""), (6, "a " * 15), (7, " ".join(rnd.choice(words) for _ in range(14)))]
    docs += [(900, "x y zzz!never?SEEN tail", "a"), (901, "a " * 5000, "b"), (902, "q " * 4000 + "ab", "b")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = slow_contamination(docs, items)
    for per_pass in (2_000_000, 20):
        found = decontaminate.occurrences(frame(spark, docs).select("doc_id", "text"), bench, words_per_pass=per_pass).collect()
        assert sum(len(r["found"]["items"]) for r in found) == sum(x[3] for x in want)
    got = decontaminate.report(frame(spark, docs), bench).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == want
    left = decontaminate.clean(frame(spark, docs), bench)
    assert left.columns == DOCS.names and left.count() == sum(not x[5] for x in want)
    assert decontaminate.clean(frame(spark, docs), bench.limit(0)).count() == len(docs)
    assert decontaminate.report(frame(spark, []), bench).collect() == []


def test_top_k(spark):
    rnd = random.Random(7)
    rows = [(i, [rnd.gauss(0, 0.2) for _ in range(8)]) for i in range(400)]
    rows += [(1000 + i, rows[i][1]) for i in range(60)]
    sound = [(i, [int(256 * x // 1) for x in v]) for i, v in rows]
    odd = [(50_000, None), (50_050, [1.0, None]), (50_100, [float("nan")] * 8), (50_150, [float("inf")] * 8), (50_200, [0.5, 0.5]), (None, [0.1] * 8)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").selectExpr("vec_id", "embedding", "1 as rank")
    want = []
    for q, a in sound:
        if q % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in sound if c != q)[:5]
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert sorted(map(tuple, topk.every_nth(df).collect())) == sorted(want)
    part = topk.usable(df)
    small = topk.search(part, part.filter("vec_id % 50 = 0"), cell_rows=40, cell_queries=3)
    assert sorted(map(tuple, small.collect())) == sorted(want)
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert topk.every_nth(few).collect() == [(0, 1, 1, 256 * 512)]
    assert topk.every_nth(few.limit(0)).collect() == []


def slow_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        free -= full
    return target


def test_mixing(spark):
    docs = some_docs(9, 900)
    sizes = {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = slow_targets(sizes)
    one = sorted(map(str, mixing.mix(frame(spark, docs)).collect()))
    got = mixing.mix(frame(spark, docs[::-1]).repartition(5), bucket_rows=50).collect()
    assert sorted(map(str, mixing.mix(frame(spark, docs[::-1]).repartition(5)).collect())) == one
    assert len(got) == len(docs) and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert {round(r["target"], 6) for r in got} == {round(x, 6) for x in want.values()}
    by = {}
    for r in got:
        by.setdefault(r["target"], []).append(r["taken"])
    assert all(abs(sum(v) - t) <= 0.03 * t + 2 for t, v in by.items())
    assert {(r["source_size"]) for r in got} == set(sizes.values())


def test_mixing_edges(spark):
    assert mixing.mix(frame(spark, [])).collect() == []
    blank = mixing.mix(frame(spark, [(1, None, None), (2, "", "a")])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in blank] == [(0, 0.0, 0)] * 2
    tiny = mixing.mix(frame(spark, [(1, "w " * 100_000, "a"), (2, "one", "b"), (None, "x y", None)])).collect()
    assert {r["doc_id"]: r["target"] for r in tiny} == {1: 200000.0 - 50000 + 1.5 * 3 - 6, 2: 2.0, None: 4.0} or sum(r["target"] for r in tiny) == 1.5 * 100_003


def test_sainte_lague(spark):
    rnd = random.Random(11)
    goals = [(i, rnd.choice([0.0, 1.0, 17.5, 400.0, 9000.0])) for i in range(12)]
    seats, total = 977, sum(t for _, t in goals)
    got = mixing.quotas(spark.createDataFrame(goals, "place int, target double"), 1, 100).collect()
    seats = round(total)
    won = [0] * 12
    for house in range(1, seats + 1):
        best = max((p for p, t in goals if t), key=lambda p: (goals[p][1] / (2 * won[p] + 1), -p))
        won[best] += 1
        if house % 100 == 0 or house == seats:
            so_far = {p: sum(r["blocks"] for r in got if r["place"] == p and r["shard"] <= (house - 1) // 100) for p, t in goals if t}
            assert all(so_far[p] == won[p] for p in so_far)
