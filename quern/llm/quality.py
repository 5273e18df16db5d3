"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled text train a logistic scorer under the non-negative risk
    prior * E_pos[loss(+)] + max(0, E_unl[loss(-)] - prior * E_pos[loss(-)]).
The class prior is estimated from the positives and the unlabelled texts alone: a plain classifier tells the two apart, and
above its best threshold, where hardly any negatives are left, the share of unlabelled texts over that of positives is
the prior. Labels of 0 are not read. Features are byte and byte-class frequencies and
word statistics of whole texts; id, language, source and label are never features.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import SOLID, Texts, crc_remainder, list_array, map_texts, word_hashes, word_spans

#: Bounds of the training sample, in rows: trusted positives and unlabelled texts.
MOST_POSITIVE, MOST_UNLABELLED = 6000, 12000
FOLDS, HELD_OUT = 3, 1

# Byte classes.
_CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n\r", ".", ",;:", "!?", "'\"", "|", "#$%&*", "<>{}[]\\/=_+", "()-"]
_CLASS = np.full(256, len(_CLASSES), np.int64)
for _k, _c in enumerate(_CLASSES):
    _CLASS[[ord(x) for x in _c]] = _k
_CLASS[128:] = len(_CLASSES) + 1
_N = len(_CLASSES) + 2
N_FEATURES = 256 + _N * _N + 13


def features(column: pa.Array) -> np.ndarray:
    """One row of N_FEATURES floats for each text; null and empty texts have zeros but for the bias."""
    texts = Texts(column)
    n, size = len(texts), np.diff(texts.offsets)
    doc = np.repeat(np.arange(n), size)
    full = np.maximum(size, 1)[:, None]
    single = np.bincount(doc * 256 + texts.data, minlength=n * 256).reshape(n, 256) / full
    kind = _CLASS[texts.data]
    inner = doc[1:] == doc[:-1]
    pair = (doc[1:] * (_N * _N) + kind[:-1] * _N + kind[1:])[inner]
    double = np.bincount(pair, minlength=n * _N * _N).reshape(n, -1) / full
    starts, ends, first = word_spans(texts.data, texts.offsets, SOLID)
    words = np.diff(first)
    of = np.repeat(np.arange(n), words)
    some = np.maximum(words, 1)
    h = word_hashes(texts.data, starts, ends)
    order = np.lexsort((h, of))
    hs, ds = h[order], of[order]
    new = np.r_[True, (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])] if len(hs) else np.empty(0, bool)
    at = np.flatnonzero(new)
    counts = np.diff(np.r_[at, len(hs)])
    distinct = np.bincount(ds[at], minlength=n) / some if len(at) else np.zeros(n)
    top = np.zeros(n)
    if len(at):
        np.maximum.at(top, ds[at], counts)
    again = np.zeros(n)
    if len(h) > 1:
        same = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
        again = np.bincount(of[1:][same], minlength=n)
    long = ends - starts
    lead = kind[starts] if len(starts) else np.empty(0, np.int64)
    tail = kind[ends - 1] if len(ends) else np.empty(0, np.int64)
    share = lambda which: np.bincount(of[which], minlength=n) / some
    stats = np.column_stack([
        np.log1p(words) / 8, np.bincount(of, weights=long, minlength=n) / some / 10, distinct, top / some, again / some,
        share(long > 15), share(lead == 1), share(tail >= 10) if len(tail) else np.zeros(n), share((tail >= 9) & (tail <= 11)), share(tail == 7), share(long <= 2), np.log1p(again) / 4, np.ones(n),
    ])
    return np.column_stack([np.sqrt(single), np.sqrt(double), stats]).astype(np.float32)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) * self.scale) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -40, 40)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, least: float = 0.5, folds: int = 4) -> float:
    """The share of positives among the unlabelled rows; one half without rows of either kind.

    Each fold is scored by a plain classifier of positive against unlabelled that the other folds train. The ratio of
    the shares above a threshold is at least the prior, whatever the threshold, and least where no negatives are left;
    thresholds that at least `least` of the positives pass are tried. Four folds were chosen on training rows alone: over five subsamples of
    those of 1,000 documents the estimate's spread was 0.018 with two folds and 0.009 with three, four and eight.
    """
    if min(len(positive), len(unlabelled)) < folds:
        return 0.5
    scores: tuple[list, list] = ([], [])
    for f in range(folds):
        out = [np.arange(len(x)) % folds == f for x in (positive, unlabelled)]
        model = fit(positive[~out[0]], unlabelled[~out[1]], 0.5, steps=150, plain=True)
        for own, x, held in zip(scores, (positive, unlabelled), out, strict=True):
            own.append(model.score(x[held]))
    p, u = (np.sort(np.concatenate(x)) for x in scores)
    at = p[: max(1, int(len(p) * (1 - least)) + 1)]
    of_p = 1 - np.searchsorted(p, at, "left") / len(p)
    of_u = 1 - np.searchsorted(u, at, "left") / len(u)
    return float(min(1.0, np.min(of_u / of_p)))


def risk(zp: np.ndarray, zu: np.ndarray, prior: float) -> float:
    """The non-negative risk of logits of positives and unlabelled rows."""
    loss = lambda z: float(np.logaddexp(0, z).mean())
    return prior * loss(-zp) + max(0.0, loss(zu) - prior * loss(zp))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 600, rate: float = 0.02, decay: float = 3e-4, seed: int = 7, plain: bool = False) -> Model:
    """Adam on the non-negative risk; where the negative part falls below zero its gradient is followed back up.

    plain: positives against unlabelled rows as if those were all negative.
    """
    prior = float(min(max(prior, 0.01), 0.99))  # log odds of 0 or 1 are no starting point
    every = np.concatenate([positive, unlabelled]) if len(unlabelled) else positive
    if not len(every):
        return Model(np.zeros(N_FEATURES, np.float32), np.ones(N_FEATURES, np.float32), np.zeros(N_FEATURES, np.float32), 0.0, prior)
    mean, spread = every.mean(0), every.std(0)
    scale = np.where(spread > 1e-6, 1 / np.maximum(spread, 1e-3), 0).astype(np.float32)
    p, u = ((np.clip((x - mean) * scale, -8, 8)).astype(np.float32) for x in (positive, unlabelled))
    w, b = np.zeros(p.shape[1], np.float32), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    rng = np.random.default_rng(seed)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    if not len(p) or not len(u):
        return Model(mean, scale, w, b, prior)
    for t in range(1, steps + 1):
        bp, bu = p[rng.integers(len(p), size=min(len(p), 1500))], u[rng.integers(len(u), size=min(len(u), 3000))]
        zp, zu = bp @ w + b, bu @ w + b
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gu, gp = sigmoid(zu) / len(zu), -prior * sigmoid(zp) / len(zp)
        if plain:
            gp = (sigmoid(zp) - 1) / len(zp)
        elif negative < 0:
            gu, gp = -gu, -gp
        else:
            gp = gp + prior * (sigmoid(zp) - 1) / len(zp)
        g = np.r_[bu.T @ gu + bp.T @ gp + decay * w, gu.sum() + gp.sum()]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = (w - move[:-1]).astype(np.float32), b - move[-1]
    return Model(mean, scale, w, float(b), prior)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED) -> Model:
    """Fit on rows whose crc32(id as text) mod 3 is not 1.

    Positives: rows labelled 1, at most most_positive; unlabelled: rows with any or no label, at most
    most_unlabelled; both by smallest hash of the id. The prior is estimated from these two. Null ids and labels
    other than 1 are left out; labels and rows that share an id count once, the row by its features.
    """
    train_fold = crc_remainder(F.col("doc_id"), FOLDS) != HELD_OUT
    trusted = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(train_fold & (F.col("y") == 1)).select("doc_id").distinct()
    ids = docs.select(F.col(id_col).alias("doc_id")).where(train_fold)
    by = F.xxhash64("doc_id", F.lit(17))
    positive = trusted.join(ids, "doc_id", "left_semi").orderBy(by, "doc_id").limit(most_positive).select("doc_id", F.lit(1).alias("y"))
    unlabelled = ids.distinct().orderBy(by, "doc_id").limit(most_unlabelled).select("doc_id", F.lit(0).alias("y"))
    picked = positive.unionByName(unlabelled)  # at most most_positive + most_unlabelled rows of two numbers
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).join(F.broadcast(picked), "doc_id")
    x = map_texts(rows, F.col("t"), {"doc_id": F.col("doc_id"), "y": F.col("y")}, "x array<float>", lambda: lambda c: [_lists(features(c))])
    got = x.groupBy("doc_id", "y").agg(F.min("x").alias("x")).select("y", "x").toArrow()  # a row for each of picked at most
    y = got.column("y").to_numpy()
    flat = got.column("x").combine_chunks()
    values = flat.flatten() if len(flat) else pa.array([], pa.float32())
    matrix = np.asarray(values, np.float32).reshape(-1, N_FEATURES)
    order = np.lexsort((matrix[:, 0], matrix[:, -13], y)) if len(y) else np.empty(0, int)  # whatever order tasks ended in
    matrix, y = matrix[order], y[order]
    shuffled = np.random.default_rng(3).permutation(len(y))
    matrix, y = matrix[shuffled], y[shuffled]
    return fit(matrix[y == 1], matrix[y == 0], estimate_prior(matrix[y == 1], matrix[y == 0]))


def _lists(x: np.ndarray) -> pa.Array:
    return list_array(x.reshape(-1), np.full(len(x), x.shape[1]), pa.float32())


def score(docs: DataFrame, model: Model, keep: dict[str, Column], text: Column) -> DataFrame:
    """`keep` columns of each row with its score, from 0 to 1."""
    return map_texts(docs, text, keep, "score double", lambda: lambda c: [pa.array(model.score(features(c)))])


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row for each row of `docs`: doc_id, held_out, score, predicted (1 where score >= 0.5).

    held_out is crc32(doc_id as text) mod 3 = 1, null for a null id. Null and empty texts are scored as empty ones.
    Without positives or documents every score is one half, the prior then. Repeated rows are each returned; columns but id and
    text are not read.
    """
    model = train(docs, labels, id_col, text_col, **options)
    df = score(docs, model, {"doc_id": F.col(id_col)}, F.col(text_col))
    return df.select("doc_id", (crc_remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` that the classifier accepts (score >= 0.5), with all their columns.

    Null and empty texts are judged as empty ones, rows without an id and repeated rows like any other. Without
    positives all rows stay; an empty table gives an empty result.
    """
    model = train(docs, labels, text_col=text_col, **options)
    return score(docs, model, {"row": F.struct("*")}, F.col(text_col)).where("score >= 0.5").select("row.*")
