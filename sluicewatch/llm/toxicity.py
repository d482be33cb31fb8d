"""Toxicity: a linear classifier over character n-grams, scaled by naive Bayes.

Features are the character n-grams of a lower-cased text with single blanks between
words, hashed to ``2 ** BITS`` places; a feature's value is the logarithm of one plus its
count, times the log-count ratio between the classes. Ratios that their counts don't
bear out are zero, and so are those of n-grams seen in few texts. An L2-regularised
logistic regression with both classes weighed alike is fitted over the scaled features
of a bounded sample of labelled rows, and its weights (a fixed size) go to every task.

Texts are scored whole, however long, by a sum over what they hold, so that harmless
text around a few words doesn't hide them. Null and empty texts have no n-grams: their
score is that of the intercept. Repeated rows get equal scores, and ties of the threshold
are toxic. A sample without both classes gives every text the share of label 1, no label
at all 0; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from sluicewatch.llm.arrow_rows import Compute, texts_of, with_results
from sluicewatch.llm.labelled import labelled_sample, remainder

BITS = 20
ORDERS = (3, 4, 5)
#: Labelled rows of each class that the fit uses at most, about.
PER_CLASS = 3000
#: Texts of the sample that a feature must occur in.
LEAST_TEXTS = 3
#: Standard errors that a log-count ratio must be away from zero.
LEAST_ERRORS = 3.0
#: Weight of the squared norm, and steps of the fit.
L2 = 0.01
STEPS = 300
HELD_OUT = 5

_STEP = np.uint32(0x01000193)

#: Distinct places of a text in order, and the logarithm of one plus the count of each.
Features = tuple[np.ndarray, np.ndarray]


def places(text: bytes | None) -> np.ndarray:
    """Places of all character n-grams of a text, one for each occurrence."""
    words = (text or b"").decode("utf-8", "replace").lower().split()
    line = f" {' '.join(words)} ".encode("utf-32-le", "replace")
    codes = np.frombuffer(line, np.uint32)
    parts, h = [], codes
    for n in range(2, max(ORDERS) + 1):
        if codes.size < n:
            break
        h = h[:-1] * _STEP ^ codes[n - 1 :]
        if n in ORDERS:
            x = h * np.uint32(0x85EBCA6B)
            parts.append((x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35) >> np.uint32(32 - BITS))
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32)


def features(text: bytes | None, used: np.ndarray | None = None) -> Features:
    """Features of a text; of ``used`` places only, if given."""
    found = places(text)
    if used is not None:
        found = found[used[found]]
    distinct, counts = np.unique(found, return_counts=True)
    return distinct, np.log1p(counts).astype(np.float32)


def log_count_ratios(rows: list[Features], labels: np.ndarray) -> np.ndarray:
    """Of every place the logarithm of its smoothed weight per text of label 1 over that of
    label 0; zero where too few texts, or too few for the size of the ratio, bear it out."""
    totals, texts = np.ones((2, 1 << BITS)), np.zeros((2, 1 << BITS))
    for (distinct, values), y in zip(rows, labels):
        totals[int(y), distinct] += values
        texts[int(y), distinct] += 1
    ratio = np.log(totals[1] / (labels.sum() + 2)) - np.log(totals[0] / ((1 - labels).sum() + 2))
    error = np.sqrt(1 / (texts[1] + 1) + 1 / (texts[0] + 1))
    ratio[(np.abs(ratio) < LEAST_ERRORS * error) | (texts.sum(axis=0) < LEAST_TEXTS)] = 0
    return ratio


def fit(texts: list, labels: np.ndarray, share: float, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights of the places and the intercept.

    Log-count ratios first, then logistic regression by accelerated gradient steps. The
    classes weigh alike, so that rare label 1 isn't given up for the sake of label 0.
    Without rows of both classes every score is ``share``.
    """
    weights = np.zeros(1 << BITS, dtype=np.float32)
    if labels.size == 0 or labels.min() == labels.max():
        return weights, math.log((share + 1e-6) / (1 - share + 1e-6))
    rows = [features(t) for t in texts]
    ratio = log_count_ratios(rows, labels)
    used = np.flatnonzero(ratio)
    column = np.zeros(1 << BITS, dtype=np.int64)
    column[used] = np.arange(used.size)
    kept = [ratio[distinct] != 0 for distinct, _ in rows]
    at = np.concatenate([distinct[k] for (distinct, _), k in zip(rows, kept)])
    value = np.concatenate([values[k] for (_, values), k in zip(rows, kept)]) * ratio[at]
    at, owner = column[at], np.repeat(np.arange(len(rows)), [int(k.sum()) for k in kept])
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean())) / len(rows)

    def scores(w: np.ndarray) -> np.ndarray:
        return np.bincount(owner, value * w[at], len(rows))

    def gradient(errors: np.ndarray) -> np.ndarray:
        return np.bincount(at, value * errors[owner], used.size)

    # The largest curvature, by power iteration, bounds the steps.
    probe, curvature = np.random.default_rng(seed).normal(size=used.size), 0.0
    for _ in range(20 if used.size else 0):
        probe = gradient(weight * scores(probe / np.linalg.norm(probe)))
        curvature = float(np.linalg.norm(probe))
    step, w, bias, momentum = 1 / (curvature / 4 + L2), np.zeros(used.size), 0.0, 1.0
    ahead, ahead_bias = w, bias
    for _ in range(STEPS):
        z = np.clip(scores(ahead) + ahead_bias, -30, 30)
        errors = weight * (1 / (1 + np.exp(-z)) - labels)
        new, new_bias = ahead - step * (gradient(errors) + L2 * ahead), ahead_bias - errors.sum()
        after = (1 + math.sqrt(1 + 4 * momentum * momentum)) / 2
        share_of_last = (momentum - 1) / after
        ahead, ahead_bias = new + share_of_last * (new - w), new_bias + share_of_last * (new_bias - bias)
        w, bias, momentum = new, new_bias, after
    weights[used] = w * ratio[used]
    return weights, float(bias)


def fit_model(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id",
              label: str = "toxic", per_class: int = PER_CLASS) -> tuple[np.ndarray, float]:
    """A model of the labelled rows whose id is not held out.

    One task fits it; it gets about ``2 * per_class`` texts however many there are.
    Without any label no text is toxic.
    """
    sample, known = labelled_sample(
        docs, labels, label, remainder(id, HELD_OUT) != 0, per_class, id, text
    )
    share = 0.0 if known is None else known

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, marks = [], []
        for batch in batches:
            marks.extend(batch.column(0).to_pylist())
            texts.extend(texts_of(batch.column(1)))
        weights, bias = fit(texts, np.array(marks, dtype=np.float64), share)
        yield pa.RecordBatch.from_arrays(
            [pa.array([weights.tobytes()]), pa.array([bias])], names=["weights", "bias"]
        )

    rows = sample.select("y", "text").repartition(1).sortWithinPartitions("y", "text")
    model = rows.mapInArrow(run, "weights binary, bias double").first()
    if model is None:
        return fit([], np.zeros(0), share)
    return np.frombuffer(model.weights, np.float32), model.bias


FIELDS = StructType([StructField("score", DoubleType()), StructField("predicted", IntegerType())])


def score(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` of the whole text.

    Null and empty texts have a score too: that of a text without n-grams. Columns named
    like results give way to them.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make() -> Compute:
        weights, bias = shared.value
        used = weights != 0

        def compute(texts: list) -> list[pa.Array]:
            z = np.full(len(texts), bias, dtype=np.float64)
            for i, t in enumerate(texts):
                distinct, values = features(t, used)
                z[i] += float(weights[distinct].astype(np.float64) @ values)
            s = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            return [pa.array(s), pa.array((s >= threshold).astype(np.int32))]

        return compute

    return with_results(docs, text, FIELDS, make)
