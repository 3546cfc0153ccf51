"""Quality by co-training: a text-content view and a page-metadata view teach each other.

Both views are logistic regressions over binned features. In every round each view labels the
unlabelled documents that it is surest of for the other one. At the end both are calibrated on
labelled documents that neither was fitted on, their log-odds are added (less the prior that both
hold), and all documents are scored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name
from .toxicity import _logistic, _sigmoid, fold

#: Labelled and unlabelled documents that the model is fitted on, at most.
LABELLED, UNLABELLED = 8000, 8000
ROUNDS, SURE, BINS = 4, 0.97, 12
_PUNCTUATION = [c for c in range(33, 127) if not chr(c).isalnum()]


def text_features(text: str | None) -> list[float]:
    """Figures of the whole text: bytes by kind, words, repetition, lines."""
    raw = (text or "").encode()
    counts, n = np.bincount(np.frombuffer(raw, np.uint8), minlength=256), max(1, len(raw))
    upper, lower = counts[65:91].sum(), counts[97:123].sum()
    words, lines = raw.split(), raw.split(b"\n")
    distinct = set(words)
    most = 0
    if words:
        most = np.unique(np.fromiter((hash(w) for w in words), np.int64, len(words)), return_counts=True)[1].max()
    m = max(1, len(words))
    wide = [counts[c] / n for c in _PUNCTUATION]
    return [upper / max(1, upper + lower), counts[48:58].sum() / n, counts[128:].sum() / n, counts[10] / n, counts[:33].sum() / n, sum(wide), max(wide), len(raw) / m, len(distinct) / m, most / m, len(set(lines)) / len(lines), np.log1p(len(words)), len(words) / len(lines), *wide]


def meta_features(lang: str | None, source: str | None, n_chars: float | None) -> list[float]:
    """Figures of the record: size, language and source, the latter two hashed to small ranges."""
    size = 0.0 if n_chars is None or n_chars != n_chars else float(np.log1p(max(0.0, n_chars)))
    kinds = np.zeros(8 + 64)
    kinds[zlib.crc32((lang or "").encode()) % 8] = 1
    kinds[8 + zlib.crc32((source or "").encode()) % 64] = 1
    return [size, *kinds]


@dataclass
class View:
    """A binned logistic regression; ``edges`` are each feature's cuts."""

    edges: list[np.ndarray]
    beta: np.ndarray
    scale: tuple[float, float] = (1.0, 0.0)

    @staticmethod
    def cuts(x: np.ndarray) -> list[np.ndarray]:
        return [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]

    def design(self, x: np.ndarray) -> np.ndarray:
        parts = [np.ones((len(x), 1))]
        for c, edge in zip(x.T, self.edges):
            parts.append((c[:, None] > edge[None, :]).astype(float))  # one step at each cut
        return np.concatenate(parts, axis=1)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.scale[0] * (self.design(x) @ self.beta) + self.scale[1]


@dataclass
class Model:
    text: View | None
    meta: View | None
    prior: float

    def probability(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        if self.text is None:
            return np.full(len(text), 1 / (1 + np.exp(-self.prior)))
        return _sigmoid(self.text.logit(text) + self.meta.logit(meta) - self.prior)


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool_text: np.ndarray, pool_meta: np.ndarray) -> Model:
    """``y``: 1 for good; the pool has no labels."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    prior = float(np.log(share / (1 - share)))
    if len(y) < 10 or y.min() == y.max():
        return Model(None, None, prior)
    views = (text, meta)
    held = np.arange(len(y)) % 5 == 4 if min(np.bincount(y.astype(int))) >= 25 else np.zeros(len(y), bool)
    fit_on = ~held
    pools, edges = (pool_text, pool_meta), [View.cuts(np.concatenate([a, b])) for a, b in zip(views, (pool_text, pool_meta))]
    given: list[dict[int, float]] = [{}, {}]  # pool rows that each view has been told
    models: list[View] = []
    designs = [View(e, np.zeros(0)).design(v) for e, v in zip(edges, views)]
    pool_designs = [View(e, np.zeros(0)).design(v) for e, v in zip(edges, pools)]
    for turn in range(ROUNDS + 1):
        models = []
        for k in (0, 1):
            told = np.array(sorted(given[k]), int)
            x = np.concatenate([designs[k][fit_on], pool_designs[k][told]])
            z = np.concatenate([y[fit_on], [given[k][i] for i in told]])
            models.append(View(edges[k], _logistic(x, z, np.concatenate([np.ones(fit_on.sum()), np.full(len(told), 0.5)]), ridge=1.0, rounds=12)))
        if turn == ROUNDS or not len(pools[0]):
            break
        quota = max(10, len(pools[0]) // (4 * ROUNDS))
        for k in (0, 1):
            p = _sigmoid(pool_designs[k] @ models[k].beta)
            for want in (0, 1):
                sure = np.abs(p - (1 - want)) > SURE
                few = max(1, int(quota * (share if want else 1 - share)))
                for i in np.argsort(-np.abs(p - 0.5), kind="stable"):
                    if few and sure[i] and i not in given[1 - k]:
                        given[1 - k][int(i)] = float(want)
                        few -= 1
                    elif not few:
                        break
    calibrate = held if held.any() else fit_on
    for k in (0, 1):
        raw = designs[k][calibrate] @ models[k].beta
        a = _logistic(np.stack([raw, np.ones(len(raw))], axis=1), y[calibrate], np.ones(len(raw)), ridge=0.1)
        models[k].scale = (float(a[0]), float(a[1]))
    return Model(models[0], models[1], prior)


_FEATURES = "t array<float>, m array<float>"


def _inputs(docs: DataFrame) -> list:
    have = {c.lower() for c in docs.columns}
    return [F.col("text"), *(F.col(c).cast(kind) if c in have else F.lit(None).cast(kind) for c, kind in (("lang", "string"), ("source", "string"), ("n_chars", "double")))]


def _described(texts: pd.Series, langs: pd.Series, sources: pd.Series, sizes: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    t = np.array([text_features(x) for x in texts], np.float32).reshape(len(texts), -1)
    m = np.array([meta_features(a, b, c) for a, b, c in zip(langs, sources, sizes)], np.float32).reshape(len(texts), -1)
    return t, m


def _features(*inputs):
    def described(texts: pd.Series, langs: pd.Series, sources: pd.Series, sizes: pd.Series) -> pd.DataFrame:
        t, m = _described(texts, langs, sources, sizes)
        return pd.DataFrame({"t": list(t), "m": list(m)})

    return F.pandas_udf(described, _FEATURES)(*inputs)


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, unlabelled: int = UNLABELLED) -> Model:
    """Fit on at most ``labelled`` documents of the folds 1 to 4 and a pool of ``unlabelled`` others.

    Which ones is fixed by a hash of the id. A document with several labels counts as bad if one says so.
    """
    marked = labels.filter("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").alias("label"))
    some = marked.filter(fold(F.col("id")) != 0).orderBy(F.xxhash64("id"), "id").limit(labelled)
    ids = docs.filter("doc_id is not null").select(F.col("doc_id").alias("id")).distinct()
    pool = ids.join(marked, "id", "left_anti").orderBy(F.xxhash64("id"), "id").limit(unlabelled).select("id", F.lit(None).cast("int").alias("label"))
    picked = F.broadcast(some.select("id", F.col("label").cast("int").alias("label")).union(pool))
    described = [c.alias(f"c{i}") for i, c in enumerate(_inputs(docs))]
    joined = docs.select(F.col("doc_id").alias("doc"), *described).join(picked, F.col("doc") == F.col("id"))
    rows = joined.select("id", "label", _features("c0", "c1", "c2", "c3").alias("f")).select("id", "label", "f.*").dropDuplicates(["id"]).collect()
    rows.sort(key=lambda r: r["id"])
    known, new = [r for r in rows if r["label"] is not None], [r for r in rows if r["label"] is None]
    width = len(text_features("")), len(meta_features("", "", 0))
    table = lambda part, f, n: np.array([r[f] for r in part], float).reshape(len(part), n)
    return co_train(table(known, "t", width[0]), table(known, "m", width[1]), np.array([r["label"] for r in known], float), table(new, "t", width[0]), table(new, "m", width[1]))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` and, last, the probability that a row is good (named score where that is free)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def probability(texts: pd.Series, langs: pd.Series, sources: pd.Series, sizes: pd.Series) -> pd.Series:
        return pd.Series(shared.value.probability(*_described(texts, langs, sources, sizes)), dtype="float64")

    return docs.withColumn(free_name(docs, "score"), F.pandas_udf(probability, "double").asNondeterministic()(*_inputs(docs)))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (1: good), predicted.

    Null texts count as empty, null metadata as a value of its own; missing metadata columns
    count as null. Repeated rows stay. With fewer than ten labels, or of one kind only, every row
    gets the share of good ones.
    """
    kept = docs.select("doc_id", "text", *(c for c in docs.columns if c.lower() in ("lang", "source", "n_chars")))
    found = scored(kept, train(docs, labels))
    return found.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score below ``threshold``, same columns."""
    found = scored(docs, train(docs, labels))
    return found.filter(F.col(f"`{found.columns[-1]}`") >= threshold).drop(found.columns[-1])
