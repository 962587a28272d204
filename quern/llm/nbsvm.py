"""Quality by naive-Bayes support vectors: n-gram indicators scaled by log-count ratios, then a linear hinge-loss model.

Indicators (present or not, hashed into 2^18 places) are word unigrams and bigrams, and uni-, bi- and trigrams of word
forms: a form says which kind of byte a word begins and ends with, whether it is in capitals, has digits or marks, how
long it is, and whether it repeats the word before it.  With p and q the smoothed counts of an indicator in rows of
label 1 and 0, its value is log((p / |p|) / (q / |q|)).  On these values a linear model with hinge loss and squared
weights is fitted by dual coordinate descent.  The two are folded into one weight per place, so scoring is one sum over
a text's distinct indicators.  Margins become probabilities by a logistic fit on a fifth of the sample that the hinge
model has not seen.

Defined results: null and empty texts have the indicator of emptiness only, and a score like any other; repeated rows
get equal scores; null ids stay null; with one class of labels only the score is that class.  Labels, language, source
and id are no inputs of a score.  Other columns are not read.

At scale: the fit is on at most ``max_train`` labelled rows, the model is 2^18 numbers, and scoring one map without a
shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import labelled
from quern.llm.storage import modest_batches
from quern.llm.textcore import Words, chunks, mix, text_buffers, trimmed

PLACE_BITS = 18
MAX_TRAIN = 6000

_KIND = np.arange(256, dtype=np.uint64)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 4


def _place(h: np.ndarray, salt: int) -> np.ndarray:
    return (mix(h + np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(64 - PLACE_BITS)).astype(np.int32)


def indicators(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct places of each document's indicators."""
    words, n_docs = Words(data, offsets), len(offsets) - 1
    start, end, first, h = words.start, words.end, words.first, words.hash
    n = len(start)
    doc = np.repeat(np.arange(n_docs), np.diff(first))
    if n:
        upto = lambda mask: np.concatenate(([0], np.cumsum(mask, dtype=np.int32)))
        kind = _KIND[data]
        upper, lower, digit = (upto(kind == k) for k in (2, 1, 3))
        marks = upto(kind > 4)
        within = lambda c: c[end] - c[start]
        capitals = (within(upper) > 1) & (within(lower) == 0)
        again = np.zeros(n, bool)
        again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        form = kind[start] | (kind[end - 1] << np.uint64(8)) | (np.minimum(within(marks), 3).astype(np.uint64) << np.uint64(16))
        form |= (np.minimum(end - start, 15) // 4).astype(np.uint64) << np.uint64(20)
        for bit, flag in enumerate((capitals, within(digit) > 0, again)):
            form |= flag.astype(np.uint64) << np.uint64(24 + bit)
    else:
        form = np.zeros(0, np.uint64)
    form = mix(form + np.uint64(1))
    two, three = doc[1:] == doc[:-1], doc[2:] == doc[:-2]
    k = [np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
    parts = [
        (doc, _place(h, 1)), (doc, _place(form, 2)), (doc[1:][two], _place(h[:-1] * k[0] + h[1:], 3)[two]),
        (doc[1:][two], _place(form[:-1] * k[0] + form[1:], 4)[two]), (doc[2:][three], _place(form[:-2] * k[1] + form[1:-1] * k[0] + form[2:], 5)[three]),
    ]
    blank = np.flatnonzero(np.diff(first) == 0)
    parts.append((blank, np.zeros(len(blank), np.int32)))
    row, place = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(row, kind="stable")
    return [np.unique(x) for x in np.split(place[order], np.searchsorted(row[order], np.arange(1, n_docs)))] if n_docs else []


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, c: float = 1.0, rounds: int = 30, tolerance: float = 1e-3, seed: int = 3) -> tuple[np.ndarray, float]:
    """Weights and bias of min 1/2 |w|^2 + c sum max(0, 1 - y w x) over rows x = scale on their places and a constant 1."""
    values = [scale[r] for r in rows]
    square = np.array([v @ v for v in values]) + 1.0
    w, bias, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    rng = np.random.Generator(np.random.PCG64(seed))
    for _ in range(rounds):
        worst = 0.0
        for i in rng.permutation(len(rows)).tolist():
            slope = y[i] * (values[i] @ w[rows[i]] + bias) - 1
            if (slope >= 0 and alpha[i] == 0) or (slope <= 0 and alpha[i] == c):
                continue
            worst = max(worst, abs(slope))
            new = min(max(alpha[i] - slope / square[i], 0.0), c)
            step = (new - alpha[i]) * y[i]
            if step:
                w[rows[i]] += step * values[i]
                bias += step
            alpha[i] = new
        if worst < tolerance:
            break
    return w, bias


def logistic(margins: np.ndarray, label: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """(a, b) of P(1) = 1 / (1 + exp(-(a margin + b))), by Newton steps with a small ridge and smoothed targets."""
    n1, n0 = label.sum(), (~label).sum()
    target = np.where(label, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, beta = np.stack([margins, np.ones(len(margins))], 1), np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (target - p) - 1e-6 * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return float(max(beta[0], 1e-3)), float(beta[1])


@dataclass
class Model:
    weight: np.ndarray
    bias: float
    a: float
    b: float

    def score(self, places: np.ndarray) -> float:
        z = self.a * (float(self.weight[places].sum(dtype=np.float64)) + self.bias) + self.b
        return float(1 / (1 + np.exp(-min(max(z, -700.0), 700.0))))


def train(rows: list[np.ndarray], label: np.ndarray, c: float = 1.0) -> Model:
    """Fits on rows' places and boolean labels."""
    n_places = 1 << PLACE_BITS
    if label.all() or not label.any():
        return Model(np.zeros(n_places, np.float32), 0.0, 1.0, 700.0 if len(label) and label.all() else (-700.0 if len(label) else 0.0))
    check = np.arange(len(rows)) % 5 == 4
    if not (label[check].any() and (~label[check]).any() and label[~check].any() and (~label[~check]).any()):
        check = np.zeros(len(rows), bool)
    own = np.flatnonzero(~check)
    count = lambda keep: np.bincount(np.concatenate([rows[i] for i in own if keep(i)]), minlength=n_places) + 1.0
    p, q = count(lambda i: label[i]), count(lambda i: not label[i])
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    w, bias = dual_coordinate_descent([rows[i] for i in own], np.where(label[own], 1.0, -1.0), ratio, c)
    weight = (w * ratio).astype(np.float32)
    held = np.flatnonzero(check) if check.any() else own
    a, b = logistic(np.array([weight[rows[i]].sum(dtype=np.float64) + bias for i in held]), label[held])
    return Model(weight, bias, a, b)


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, label_col: str = "quality", c: float = 1.0) -> Model:
    """Fits on at most ``max_train`` labelled rows outside the held-out fold."""
    modest_batches(docs.sparkSession)
    rows = labelled.sample(docs, labels, label_col, max_train).select("doc_id", "text", "label")

    def work(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            got = []
            for a, b in chunks(offsets):
                got += [x.tobytes() for x in indicators(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(got, pa.binary())], names=["doc_id", "label", "places"])

    got = sorted(rows.mapInArrow(trimmed(work), "doc_id long, label int, places binary").collect())
    return train([np.frombuffer(r.places, np.int32) for r in got], np.array([r.label == 1 for r in got], bool), c)


def score(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""

    def work(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            scores = []
            for a, b in chunks(offsets):
                scores += [model.score(x) for x in indicators(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), labelled.held_out(id_col).alias("held_out"))
    return rows.mapInArrow(trimmed(work), "doc_id long, held_out boolean, score double, predicted int")
