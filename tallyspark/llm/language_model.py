"""Language-model scores: a log-bilinear neural model by noise-contrastive estimation.

1. Token counts cover all training documents, combined map-side. The base score is a unigram model
   smoothed over all distinct tokens.
2. The vocabulary has two levels: classes, and words within them. The most frequent tokens and the
   end are classes of their own; all others are told apart by their last bytes, the most frequent
   endings being classes, the rest one class. Within a class words share its probability as the
   smoothed counts say, so every token has a class as a target and as a context.
3. The log-bilinear model adds up a vector for each of the classes before and compares the sum with
   the vectors of all classes. It is trained in numpy against noise drawn from the classes' shares:
   first on a bounded sample, then from there on all training documents, as class numbers, in
   shards by their hash; the shards' parameters are averaged by the tokens behind them. A shard
   is learnt in the order of its keys, so how rows are dealt to tasks makes no difference.
4. Scores are normalised. There are few contexts of classes, so the logarithm of each one's sum
   over the classes is computed once, by batched matrix products, and a token costs one dot product.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .toxicity import fold

END = b"\n"  # no word holds a line feed, so this stands for the end of a text
#: Tokens that are classes of their own, endings that are classes, an ending's bytes, the vectors' length, and classes looked back.
SINGLE, ENDINGS, TAIL, SIZE, CONTEXT = 256, 254, 2, 16, 2
#: Most frequent tokens whose counts every task holds; those of the rest are joined.
HELD = 131_072
#: About how many texts the first parameters come from, and how many bytes they have at most.
SAMPLE_DOCS, SAMPLE_BYTES = 1000, 2_000_000
#: Noise classes that a batch's tokens share, tokens of a batch and speed: on the sample, and on all documents.
ON_SAMPLE, ON_ALL, PASSES = (64, 256, 0.1), (64, 1024, 0.05), 3
#: Least number of shards, and tokens of a shard from which on there are more of them.
SHARDS, SHARD_TOKENS = 8, 4_000_000
#: Tokens that are put into one order before they are cut into batches.
_ORDERED = 65_536
#: Distinct words that a task counts before it sends them on, and bytes of text taken at once.
_WORDS, _GROUP = 200_000, 2_000_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def contexts(ids: np.ndarray, starts: np.ndarray, pad: int) -> np.ndarray:
    """For each token of texts laid end to end, the ids of the CONTEXT tokens before it, nearest first."""
    place = np.arange(len(ids)) - np.repeat(starts[:-1], np.diff(starts))
    out = np.full((CONTEXT, len(ids)), pad, np.int32)
    for k in range(CONTEXT):
        far = np.flatnonzero(place > k)
        out[k, far] = ids[far - k - 1]
    return out


def _added(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of ``values`` by number."""
    size = values.shape[1]
    return np.bincount((rows[:, None] * size + np.arange(size)).ravel(), values.ravel(), n * size).reshape(n, size).astype(np.float32)


@dataclass
class Bilinear:
    """Vectors of the words before, by distance (the last row stands before the text), of the words to come, and biases."""

    near: np.ndarray  # (CONTEXT, V + 1, SIZE)
    target: np.ndarray  # (V, SIZE)
    bias: np.ndarray  # (V,)

    @staticmethod
    def start(noise: np.ndarray, seed: int = 7) -> Bilinear:
        rnd, v = np.random.default_rng(seed), len(noise)
        draw = lambda *shape: rnd.normal(0, 0.1, shape).astype(np.float32)
        return Bilinear(draw(CONTEXT, v + 1, SIZE), draw(v, SIZE), np.log(noise).astype(np.float32))

    def flat(self) -> np.ndarray:
        return np.concatenate([self.near.ravel(), self.target.ravel(), self.bias])

    @staticmethod
    def of(flat: np.ndarray, v: int) -> Bilinear:
        a, b = CONTEXT * (v + 1) * SIZE, v * SIZE
        f = flat.astype(np.float32)
        return Bilinear(f[:a].reshape(CONTEXT, v + 1, SIZE).copy(), f[a : a + b].reshape(v, SIZE).copy(), f[a + b :].copy())

    def hidden(self, before: np.ndarray) -> np.ndarray:
        return sum(self.near[k][before[k]] for k in range(CONTEXT))

    def normalisers(self) -> np.ndarray:
        """Log of the sum over the vocabulary for every pair of words before."""
        v = len(self.bias)
        out = np.empty((v + 1, v + 1), np.float32)
        for a in range(v + 1):
            s = (self.near[0][a] + self.near[1]) @ self.target.T + self.bias
            top = s.max(axis=1, keepdims=True)
            out[a] = (top + np.log(np.exp(s - top).sum(axis=1, keepdims=True)))[:, 0]
        return out


class Trainer:
    """AdaGrad over minibatches; the noise of a batch is shared, so that it is a few matrix products.

    ``grown``: the sums of squares so far, flat; a trained model goes on with those that it was trained with.
    """

    def __init__(self, model: Bilinear, noise: np.ndarray, how: tuple[int, int, float], seed: int = 7, grown: np.ndarray | None = None):
        self.model, self.v = model, len(noise)
        self.noise, self.batch, self.speed = how
        self.log_noise = np.log(self.noise * noise).astype(np.float32)
        self.cumulative = np.cumsum(noise) / noise.sum()
        self.rnd = np.random.default_rng(seed)
        squares = Bilinear.of(np.full(len(model.flat()), 0.1) if grown is None else grown, self.v)
        self.grown = [*squares.near, squares.target, squares.bias]
        self.tokens = 0

    def squares(self) -> np.ndarray:
        return np.concatenate([g.ravel() for g in self.grown])

    def learn(self, ids: np.ndarray, starts: np.ndarray) -> None:
        before, order = contexts(ids, starts, self.v), self.rnd.permutation(len(ids))
        for at in range(0, len(order), self.batch):
            pick = order[at : at + self.batch]
            self._step(before[:, pick], ids[pick])
        self.tokens += len(ids)

    def _step(self, before: np.ndarray, true: np.ndarray) -> None:
        m = self.model
        drawn = np.minimum(np.searchsorted(self.cumulative, self.rnd.random(self.noise)), self.v - 1)
        h = m.hidden(before)
        vectors, others = m.target[true], m.target[drawn]
        g_true = 1 / (1 + np.exp(np.clip(np.einsum("ij,ij->i", h, vectors) + m.bias[true] - self.log_noise[true], -30, 30)))
        g_noise = -1 / (1 + np.exp(-np.clip(h @ others.T + m.bias[drawn] - self.log_noise[drawn], -30, 30)))
        g_h = g_true[:, None] * vectors + g_noise @ others
        g_t = _added(true, g_true[:, None] * h, self.v)
        np.add.at(g_t, drawn, g_noise.T @ h)
        g_b = np.bincount(true, g_true, self.v)
        np.add.at(g_b, drawn, g_noise.sum(axis=0))
        gradients = [*(_added(before[k], g_h, self.v + 1) for k in range(CONTEXT)), g_t, g_b]
        for p, g, seen in zip((*m.near, m.target, m.bias), gradients, self.grown):
            seen += g * g
            p += (self.speed * g / np.sqrt(seen)).astype(np.float32)


@dataclass
class Vocabulary:
    """The held tokens and the classes: single tokens, the end, endings, and one for all others."""

    number: dict[bytes, int]
    single: int  # held tokens before this number are classes of their own, this one is the end
    endings: dict[bytes, int]  # class by ending
    share: np.ndarray  # each class's smoothed unigram probability, that of all others last
    base: np.ndarray  # log10 of each held token's
    of_held: np.ndarray  # each held token's class

    def ids(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Held numbers (-1: not held) and classes of texts laid end to end, each with its end, and where each one starts."""
        get, flat, starts = self.number.get, [], [0]
        for words in texts:
            flat += words
            flat.append(END)
            starts.append(len(flat))
        ids = np.array([get(w, -1) for w in flat], np.int64)
        classes = self.of_held[ids]
        rare, other, ending = np.flatnonzero(ids < 0), len(self.share) - 1, self.endings.get
        classes[rare] = [ending(flat[i][-TAIL:], other) for i in rare]
        return ids, classes, np.array(starts)


def _groups(texts: Iterator) -> Iterator[list[list[bytes]]]:
    group, size = [], 0
    for text in texts:
        group.append(words_of(text))
        size += len(text or "")
        if size > _GROUP:
            yield group
            group, size = [], 0
    if group:
        yield group


def token_counts(training: DataFrame) -> DataFrame:
    """(token, c) over all texts, without their ends."""
    schema = pa.schema([("token", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def sent() -> Iterator[pa.RecordBatch]:
            words = list(seen)
            for i in range(0, len(words), 50_000):
                part = words[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()).cast(pa.string()), pa.array([seen[w] for w in part], pa.int64())], schema=schema)
            seen.clear()

        for batch in batches:
            for group in _groups(x.as_py() for x in batch.column(0)):
                for words in group:
                    seen.update(words)
                    if len(seen) > _WORDS:
                        yield from sent()
        yield from sent()

    return training.select("text").mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("c"))


def _averaged(training: DataFrame, words, start: Trainer, tokens: int) -> Bilinear:
    """Every shard of ``training(key, text)`` learns from all of its texts, from ``start`` on; the results are averaged in Spark."""
    v = start.v
    first = training.sparkSession.sparkContext.broadcast((start.model.flat(), start.squares()))
    shards = max(SHARDS, tokens // SHARD_TOKENS)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it = words.value
        for batch in batches:
            keys, at = batch.column("key").to_numpy(), 0
            for group in _groups(x.as_py() for x in batch.column("text")):
                _, classes, starts = it.ids(group)
                of = keys[at : at + len(group)]
                at += len(group)
                yield pa.RecordBatch.from_pydict({"shard": pa.array(of % shards, pa.int32()), "key": pa.array(of), "classes": pa.array([classes[a:b].astype("<u2").tobytes() for a, b in zip(starts, starts[1:])], pa.binary())})

    def learn(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        it, (flat, squares) = words.value, first.value
        shard, trainer, texts, waiting = None, None, [], 0

        def taken() -> None:
            trainer.learn(np.concatenate(texts), np.cumsum([0, *map(len, texts)]))

        def averaged() -> pd.DataFrame:
            if texts:
                taken()
            out = trainer.model.flat()
            return pd.DataFrame({"place": np.arange(len(out)), "value": out.astype(float) * trainer.tokens, "tokens": trainer.tokens})

        for part in parts:
            for of, classes in zip(part["shard"], part["classes"]):
                if of != shard:
                    if trainer:
                        yield averaged()
                    shard, trainer, texts, waiting = of, Trainer(Bilinear.of(flat, v), it.share, ON_ALL, seed=int(of), grown=squares), [], 0
                texts.append(np.frombuffer(classes, "<u2").astype(np.int64))
                waiting += len(texts[-1])
                if waiting >= _ORDERED:
                    taken()
                    texts, waiting = [], 0
        if trainer:
            yield averaged()

    encoded = training.select("key", "text").mapInArrow(encode, "shard int, key long, classes binary").repartition("shard").sortWithinPartitions("shard", "key")
    learned = encoded.mapInPandas(learn, "place long, value double, tokens long").groupBy("place").agg((F.sum("value") / F.sum("tokens")).alias("value"))
    rows = learned.orderBy("place").collect()  # as many as the model has parameters
    return Bilinear.of(np.array([r["value"] for r in rows]), v) if rows else start.model


def most_frequent(counts: DataFrame, most: int = HELD) -> list[tuple[bytes, int]]:
    """At most about ``most`` tokens of ``counts(token, c)`` with their counts, the most frequent ones, in order.

    A histogram of the counts says from which one on tokens fit, so no more than these come to the driver,
    however many tasks there are; of the tokens at the border some are taken by their hash.
    """
    step = counts.withColumn("step", F.floor(8 * F.log2("c")))
    steps, room = sorted(((r["step"], r["count"]) for r in step.groupBy("step").count().collect()), reverse=True), most
    least, share = 0, 1000
    for at, size in steps:
        if size > room:
            least, share = at, 1000 * room // size
            break
        room -= size
    inside = (F.col("step") > least) | ((F.col("step") == least) & (F.pmod(F.xxhash64("token"), F.lit(1000)) < share))
    return sorted(((r["token"].encode(), r["c"]) for r in step.filter(inside).select("token", "c").collect()), key=lambda x: (-x[1], x[0]))


def sample_texts(training: DataFrame, rows: int) -> list[str]:
    """About ``SAMPLE_DOCS`` whole texts of ``training(key, text)``, ``SAMPLE_BYTES`` at most. Keys and sizes are looked at first."""
    some = training.filter(F.pmod("key", F.lit(max(1, rows // SAMPLE_DOCS))) == 0)
    sizes, left, chosen = sorted(tuple(r) for r in some.select("key", F.octet_length("text").alias("n")).distinct().collect()), SAMPLE_BYTES, []
    for key, n in sizes:
        if n <= left:
            chosen.append(key)
            left -= n
    texts = some.filter(F.col("key").isin(chosen)).dropDuplicates(["key"]).collect() if chosen else []
    return [r["text"] for r in sorted(texts, key=lambda r: r["key"])]


def endings(counts: DataFrame, single: list[bytes], scale: float) -> list[tuple[bytes, float]]:
    """The endings of tokens other than ``single`` that hold most of the text, and the smoothed probability of all their tokens."""
    tail = F.substring(F.encode("token", "UTF-8"), -TAIL, TAIL)
    rest = counts.filter(~F.col("token").isin([w.decode() for w in single])) if single else counts
    sums = rest.groupBy(tail.alias("ending")).agg((F.sum("c") + 0.5 * F.count(F.lit(1))).alias("m"))
    return [(bytes(r["ending"]), r["m"] / scale) for r in sums.orderBy(F.desc("m"), "ending").limit(ENDINGS).collect()]


def fit(training: DataFrame, counts: DataFrame, ends: int, scale: float, tokens: int):
    """``training(key, text)``, its token counts -> the vocabulary, the broadcast vocabulary, and the model."""
    spark = training.sparkSession
    top = most_frequent(counts, HELD)
    cut = min(len(top), SINGLE)
    tails = endings(counts, [w for w, _ in top[:cut]], scale)
    order = [*top[:cut], (END, ends), *top[cut:]]
    base = np.log10((np.array([c for _, c in order]) + 0.5) / scale)
    share = np.array([*10 ** base[: cut + 1], *(m for _, m in tails), 0.0])
    share[-1] = max(0.5 / scale, 1 - share.sum())
    by_ending, other = {e: cut + 1 + i for i, (e, _) in enumerate(tails)}, len(share) - 1
    of_held = np.array([i if i <= cut else by_ending.get(w[-TAIL:], other) for i, (w, _) in enumerate(order)])
    held = Vocabulary({w: i for i, (w, _) in enumerate(order)}, cut, by_ending, share / share.sum(), base, of_held)
    words = spark.sparkContext.broadcast(held)
    texts = [words_of(t) for t in sample_texts(training, ends)]
    start = Trainer(Bilinear.start(held.share), held.share, ON_SAMPLE)
    if texts:
        _, classes, starts = held.ids(texts)
        for _ in range(PASSES):
            start.learn(classes, starts)
    return held, words, _averaged(training, words, start, tokens)


def _scoring(words, model):
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        it, (m, logs) = words.value, model.value
        classes_log = np.log10(it.share)
        for part in parts:
            rows = []
            for group in _groups(part):
                ids, classes, starts = it.ids(group)
                before = contexts(classes, starts, len(it.share))
                log = (np.einsum("ij,ij->i", m.hidden(before), m.target[classes]) + m.bias[classes] - logs[before[0], before[1]]).astype(float) / np.log(10)
                known = np.where(ids >= 0, it.base[ids], 0.0)
                # a word's share of its class; counts of words that are not held come later
                inside = np.where(classes > it.single, known - classes_log[classes], 0.0)
                sums = [np.diff(np.concatenate([[0.0], np.cumsum(x)])[starts]) for x in (log + inside, known, ids >= 0)]
                for i, w in enumerate(group):
                    rare = [x.decode() for x, n in zip(w, ids[starts[i] :]) if n < 0]
                    rows.append((len(w) + 1, int(sums[2][i]), float(sums[1][i]), float(sums[0][i]), rare))
            yield pd.DataFrame(rows, columns=["n_tokens", "n_held", "base", "model", "rare"])

    return F.pandas_udf(score, "n_tokens long, n_held long, base double, model double, rare array<string>").asNondeterministic()


def scores(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score.

    A null text counts as empty: its only token is the end. A null doc_id counts as empty text in the
    fold, so it is in training. Repeated rows count as often as they stand there, and stay. If there is
    no training text, every token counts 0. Other columns are not read.
    """
    spark = docs.sparkSession
    marked = docs.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    training = marked.filter(~F.col("held_out")).select(F.xxhash64("doc_id", "text").alias("key"), "text")
    counts = checkpointed(token_counts(training))
    ends = training.count()
    inside, distinct = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    total, distinct = (inside or 0) + ends, distinct + (ends > 0)
    scale = total + 0.5 * (distinct + 1)
    _, words, model = fit(training, counts, ends, scale, total)
    shared = spark.sparkContext.broadcast((model, model.normalisers()))
    first = checkpointed(marked.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "held_out", _scoring(words, shared)(F.col("text")).alias("f")).select("rid", "doc_id", "held_out", "f.*"))
    rare = first.select("rid", F.explode("rare").alias("token"))
    log = F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(float(scale)))
    each = rare.join(counts, "token", "left").groupBy("rid").agg(F.sum(log).alias("rare_base"), F.count("c").alias("rare_known"))
    out = first.drop("rare").join(each, "rid", "left")
    rest = F.coalesce("rare_base", F.lit(0.0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.when(F.lit(ends > 0), F.col("n_held")).otherwise(F.col("n_held") - 1) + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + rest).alias("base_score"),
        (F.col("model") + rest).alias("score"),
    )
