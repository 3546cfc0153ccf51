"""Toxic spans by a linear-chain conditional random field over the tokens of a document.

Labels come per document, so the labelled tokens are derived first: in toxic training documents a
token is toxic if its word or a stem of it occurs in far more toxic than clean documents; all
other tokens are not. The field has two states; a token's own score sums the weights of its word
and its stems, and four transition weights tie neighbours together. Forward-backward
marginals give the offending tokens; their sums, calibrated on the training documents,
give the document's score.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"[^\W\d_]+")
#: Documents of each label that the model is fitted on, at most.
TOXIC_DOCS, CLEAN_DOCS = 2000, 3000
MAX_FEATURES = 50_000
#: For the gradient, long documents are cut into pieces of so many tokens; scores run over whole ones.
PIECE = 400
_SCORED = "score double, spans string"


def features(word: str) -> tuple[str, ...]:
    word = word.lower()
    return (word, *(f"{n}<{word[:n]}" for n in (4, 5, 6, 7) if len(word) > n))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Field:
    """Weights: start and bias, the transitions between the states, and a weight for each feature."""

    bias: float
    moves: np.ndarray  # log weights of the moves 0-0, 0-1, 1-0, 1-1
    weights: dict[str, float]
    calibration: np.ndarray

    def own(self, word: str) -> float:
        get = self.weights.get
        return self.bias + sum(get(f, 0.0) for f in features(word))


def marginals(own: np.ndarray, starts: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward log-odds of state 1, and its marginal, for chains laid end to end.

    Chain i is own[starts[i]:starts[i + 1]]. All chains advance together, the longest ones first,
    so each step is a few array operations over the chains that still run.
    """
    lengths = np.diff(starts)
    order = np.argsort(-lengths, kind="stable")
    first, n = starts[:-1][order], lengths[order]
    running = np.searchsorted(-n, -np.arange(n[0] if len(n) else 0), side="left")  # chains longer than t
    t00, t01, t10, t11 = np.exp(moves)
    ahead, back = np.zeros(len(own)), np.zeros(len(own))
    p = np.zeros(0)
    for t, live in enumerate(running):
        at = first[:live] + t
        move = 0.0 if not t else np.log(t01 + (t11 - t01) * p[:live]) - np.log(t00 + (t10 - t00) * p[:live])
        odds = own[at] + move
        ahead[at] = odds
        p = _sigmoid(odds)
    p = np.zeros(0)
    last = first + n - 1
    for t, live in enumerate(running):
        at = last[:live] - t
        move = 0.0 if not t else np.log(t10 + (t11 - t10) * p[:live]) - np.log(t00 + (t01 - t00) * p[:live])
        back[at] = move
        p = _sigmoid(own[at] + move)
    return ahead, back, _sigmoid(ahead + back)


def _indexed(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Word numbers of all tokens end to end, where each text starts, and the words."""
    numbers: dict[str, int] = {}
    ids, starts = [], [0]
    for text in texts:
        ids += [numbers.setdefault(w, len(numbers)) for w in TOKEN.findall(text)]
        starts.append(len(ids))
    return np.array(ids, np.int64), np.array(starts), list(numbers)


def _per_chain(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[starts[1:]] - total[starts[:-1]]


def _summary(p: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """What the document's score is made of: its clearest token, the sum of clear marginals, and of all that are not tiny."""
    clear = _per_chain(np.where(p > 0.5, p, 0), starts)
    some = _per_chain(np.where(p > 0.05, p, 0), starts)
    most = np.zeros(len(clear))
    full = np.flatnonzero(np.diff(starts) > 0)
    if len(full):
        most[full] = np.maximum.reduceat(p, starts[:-1][full])
    odds = np.log((most + 1e-4) / (1 - most + 1e-4))
    return np.stack([np.ones(len(clear)), np.maximum(odds, 0), np.log1p(clear), np.log1p(some)], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.5, rounds: int = 30) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = _sigmoid(x @ beta)
        h = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(beta))
        beta = beta + np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * beta)
    return beta


def _without_copies(texts: list[str]) -> list[int]:
    """Numbers of the texts whose smallest word hashes no earlier text has: copies must not make words telling."""
    first: dict[tuple, int] = {}
    for i, text in enumerate(texts):
        hashes = sorted({zlib.crc32(w.lower().encode()) for w in TOKEN.findall(text) if len(w) > 4})
        first.setdefault(tuple(hashes[:3]) if len(hashes) > 3 else (i,), i)
    return sorted(first.values())


def fit(texts: list[str], toxic: np.ndarray, rates: tuple[float, float] = (1.0, 1.0), rounds: int = 25) -> Field:
    """Train on whole documents; ``rates``: how many documents each clean (toxic) one stands for."""
    toxic = np.asarray(toxic, bool)
    if not toxic.any() or toxic.all():
        share = toxic.mean() if len(toxic) else 0.0
        return Field(-8.0, np.zeros(4), {}, np.array([np.log((share + 0.01) / (1.01 - share)), 0, 0, 0]))
    alone = _without_copies(texts)
    texts, toxic = [texts[i] for i in alone], toxic[alone]
    ids, starts, words = _indexed(texts)
    seen = [Counter(), Counter()]
    for i, y in enumerate(toxic):
        names = {f for w in np.unique(ids[starts[i] : starts[i + 1]]) for f in features(words[w])}
        seen[int(y)].update(names)
    n = np.bincount(toxic, minlength=2)
    ratio = {f: np.log(((c + 0.05) / (n[1] + 0.1)) / ((seen[0][f] + 0.5) / (n[0] + 1.0))) for f, c in seen[1].items() if c >= max(3, n[1] / 100)}
    telling = {f for f, r in ratio.items() if r > 2.5}
    kept = sorted((f for f, r in ratio.items() if r > 0.5), key=lambda f: (-abs(ratio[f]), f))[:MAX_FEATURES]
    number = {f: i for i, f in enumerate(kept)}
    marked = np.array([any(f in telling for f in features(w)) for w in words], bool)
    pairs = [(i, number[f]) for i, w in enumerate(words) for f in features(w) if f in number]
    rows, cols = (np.array(x, np.int64) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
    label = marked[ids] & np.repeat(toxic, np.diff(starts))
    whole = starts
    starts = np.unique(np.concatenate([starts, *(np.arange(a, b, PIECE) for a, b in zip(starts, starts[1:]))]))
    inner = np.ones(len(ids), bool)  # tokens that a next one follows
    inner[starts[1:][np.diff(starts) > 0] - 1] = False
    now = np.flatnonzero(inner)
    y01 = label.astype(int)
    true_moves = np.bincount(2 * y01[now] + y01[now + 1], minlength=4)

    size = len(kept)
    theta = np.zeros(size + 5)
    theta[0] = np.log((label.sum() + 1) / (len(label) + 1))
    speed, grown = 0.5, np.full(size + 5, 1e-6)
    for _ in range(rounds):
        own = (theta[0] + np.bincount(rows, theta[5 + cols], len(words)))[ids]
        ahead, back, p = marginals(own, starts, theta[1:5])
        rest = label - p
        by_word = np.bincount(ids, rest, len(words))
        a, b = _sigmoid(ahead[now]), _sigmoid((own + back)[now + 1])
        t = np.exp(theta[1:5])
        joint = np.stack([(1 - a) * (1 - b) * t[0], (1 - a) * b * t[1], a * (1 - b) * t[2], a * b * t[3]])
        step = np.concatenate([[rest.sum()], true_moves - (joint / joint.sum(axis=0)).sum(axis=1), np.bincount(cols, by_word[rows], size)])
        step -= 0.3 * np.concatenate([[0], theta[1:]])
        step[1] = 0.0  # the move 0-0 stays at weight 1
        grown += step**2
        theta += speed * step / np.sqrt(grown)
    own = (theta[0] + np.bincount(rows, theta[5 + cols], len(words)))[ids]
    p = marginals(own, whole, theta[1:5])[2]
    calibration = _logistic(_summary(p, whole), toxic.astype(float), np.where(toxic, rates[1], rates[0]) / max(rates))
    return Field(float(theta[0]), theta[1:5].copy(), {f: float(theta[5 + i]) for f, i in number.items() if theta[5 + i]}, calibration)


class Known(dict):
    """The own scores of words met so far; forgets all when it has grown too large."""

    def __init__(self, field: Field, most: int = 300_000):
        super().__init__()
        self.field, self.most = field, most

    def __missing__(self, word: str) -> float:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = self.field.own(word)
        return value


def score(field: Field, texts: list[str], known: Known | None = None) -> tuple[np.ndarray, list[str]]:
    """Document scores, and the offending spans as start:end in code points, comma-joined."""
    get = (Known(field) if known is None else known).__getitem__
    own, starts = array("d"), [0]
    for text in texts:
        own.extend(map(get, TOKEN.findall(text)))
        starts.append(len(own))
    at = np.array(starts)
    p = marginals(np.frombuffer(own, float) if own else np.zeros(0), at, field.moves)[2]
    scores = _sigmoid(_summary(p, at) @ field.calibration)
    spans = [""] * len(texts)
    for i in np.flatnonzero(_per_chain((p > 0.5).astype(float), at) > 0):
        own_p = p[at[i] : at[i + 1]]
        spans[i] = ",".join(f"{m.start()}:{m.end()}" for m, x in zip(TOKEN.finditer(texts[i]), own_p) if x > 0.5)
    return scores, spans


def fold(doc_id: Column) -> Column:
    """crc32 of the doc_id as text, modulo 5; a null doc_id counts as empty text (0)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(5))


def train(docs: DataFrame, labels: DataFrame, toxic_docs: int = TOXIC_DOCS, clean_docs: int = CLEAN_DOCS) -> Field:
    """Fit on at most ``toxic_docs`` and ``clean_docs`` labelled documents of the folds 1 to 4.

    Which ones is fixed by a hash of the id. A document with several labels counts as toxic if
    one says so; labels that are neither 0 nor 1, or without a document, take no part.
    """
    marked = labels.filter("toxic in (0, 1) and doc_id is not null").filter(fold(F.col("doc_id")) != 0).groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("label"))
    counts = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    most = {1: toxic_docs, 0: clean_docs}
    picks = [marked.filter(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(most[y]) for y in (1, 0)]
    picked = F.broadcast(picks[0].union(picks[1]))
    rows = docs.select("doc_id", "text").join(picked, F.col("doc_id") == F.col("id")).select("id", "text", "label").dropDuplicates(["id"]).collect()
    rows.sort(key=lambda r: r["id"])
    rates = tuple(counts.get(y, 0) / max(1, min(most[y], counts.get(y, 0))) for y in (0, 1))
    return fit([r["text"] or "" for r in rows], np.array([r["label"] for r in rows], bool), rates if all(rates) else (1.0, 1.0))


def _scoring(field):
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = Known(field.value)
        for texts in parts:
            values, group, size = [], [], 0
            for text in texts:
                group.append(text or "")
                size += len(group[-1])
                if size > 8_000_000:
                    values += zip(*score(field.value, group, known))
                    group, size = [], 0
            if group:
                values += zip(*score(field.value, group, known))
            yield pd.DataFrame(values, columns=["score", "spans"])

    return F.pandas_udf(scored, _SCORED)


def spans(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, score (0 to 1) and spans (start:end, ...) of each row of ``docs(doc_id, text, ...)``."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    return docs.select("doc_id", _scoring(shared)(F.col("text")).alias("out")).select("doc_id", "out.*")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted, spans.

    Null and empty texts have no tokens and get the score of a document without findings. Without
    labels of both kinds every document gets the share of toxic ones. Repeated rows stay. Only
    doc_id and text are read, and only text makes the score.
    """
    found = spans(docs, train(docs, labels))
    return found.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
