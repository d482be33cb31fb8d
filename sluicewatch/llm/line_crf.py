"""Quality: a linear-chain conditional random field that marks lines good or bad.

A line's features are shape measures of itself and of the lines before and after it,
each cut into bins. Lines of a good text are good and lines of a bad text bad when the
field is fitted. Forward-backward gives each line its probability of being good; their
mean, weighted by length, is the quality of the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from sluicewatch.llm.arrow_rows import Compute, texts_of, with_results
from sluicewatch.llm.labelled import labelled_sample, remainder

#: Labelled rows of each class that the fit uses at most, about.
PER_CLASS = 3000
BINS = 8
STEPS = 150
HELD_OUT, HELD_OUT_REST = 4, 2
THRESHOLD = 0.7
MEASURES = 11

_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_SIGNS = re.compile(r"[#*$%&|<>!=~^_{}\[\]\\@]")
_DIGITS = re.compile(r"[0-9]")
_STOPS = re.compile(r"[.,;:?!]")


def measures(lines: list[str]) -> np.ndarray:
    """One row of shape measures per line."""
    out = np.zeros((len(lines), MEASURES))
    earlier: set[str] = set()
    for i, line in enumerate(lines):
        words = line.split()
        n, chars = len(words), max(len(line), 1)
        lower = [w.lower() for w in words]
        distinct = len(set(lower))
        repeated = sum(a == b for a, b in zip(lower, lower[1:]))
        out[i] = (
            np.log1p(chars),
            np.log1p(n),
            chars / max(n, 1),
            len(_UPPER.findall(line)) / chars,
            len(_SIGNS.findall(line)) / max(n, 1),
            line.count("|") / max(n, 1),
            len(_DIGITS.findall(line)) / chars,
            len(_STOPS.findall(line)) / max(n, 1),
            distinct / max(n, 1),
            repeated / max(n, 1),
            line in earlier,
        )
        earlier.add(line)
    return out


def lines_of(text: bytes | None) -> list[str]:
    """The lines with something in them; at least one, so that every text has a chain."""
    found = [x for x in (text or b"").decode("utf-8", "replace").split("\n") if x.strip()]
    return found or [""]


class Chains:
    """Many texts' lines as one batch of chains, stored step by step.

    Longest chains first, so that the chains still going at a step are a prefix.
    """

    def __init__(self, texts: list):
        lines = [lines_of(t) for t in texts]
        lengths = np.array([len(x) for x in lines], dtype=np.int64)
        self.order = np.argsort(-lengths, kind="stable")
        self.lengths = lengths[self.order]
        steps = int(lengths.max()) if lengths.size else 0
        self.going = np.array([np.count_nonzero(self.lengths > t) for t in range(steps)], dtype=np.int64)
        self.start = np.cumsum([0, *self.going])
        total = int(self.start[-1])
        self.features = np.zeros((total, 3 * MEASURES))
        self.weights = np.zeros(total)
        self.owner = np.zeros(total, dtype=np.int64)
        for rank, doc in enumerate(self.order.tolist()):
            own = measures(lines[doc])
            at = self.start[: len(own)] + rank
            edge = np.full((1, MEASURES), -1.0)
            self.features[at, :MEASURES] = own
            self.features[at, MEASURES : 2 * MEASURES] = np.vstack([edge, own[:-1]])
            self.features[at, 2 * MEASURES :] = np.vstack([own[1:], edge])
            self.weights[at] = [len(x) + 1 for x in lines[doc]]
            self.owner[at] = doc


def _binned(features: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Bin numbers, of all features in one range."""
    out = np.empty(features.shape, dtype=np.int32)
    for k in range(features.shape[1]):
        out[:, k] = np.searchsorted(cuts[k], features[:, k], side="right") + k * BINS
    return out


def forward_backward(chains: Chains, unary: np.ndarray, moves: np.ndarray):
    """Probability of good per line, expected moves, and log partition per chain.

    ``unary`` is each line's score of good (bad has 0), ``moves[a, b]`` that of b after a.
    """
    steps, start = chains.going.size, chains.start
    score = np.stack([np.zeros_like(unary), unary], axis=1)
    alpha, beta = score.copy(), np.zeros_like(score)
    for t in range(1, steps):
        n = chains.going[t]
        before = alpha[start[t - 1] : start[t - 1] + n]
        alpha[start[t] : start[t] + n] += np.logaddexp(before[:, :1] + moves[0], before[:, 1:] + moves[1])
    expected = np.zeros((2, 2))
    last = start[chains.lengths - 1] + np.arange(chains.lengths.size)
    log_z = np.logaddexp(alpha[last, 0], alpha[last, 1])
    for t in range(steps - 1, 0, -1):
        n = chains.going[t]
        now, before = slice(start[t], start[t] + n), slice(start[t - 1], start[t - 1] + n)
        ahead = score[now] + beta[now]
        beta[before] = np.logaddexp(ahead[:, :1] + moves[:, 0], ahead[:, 1:] + moves[:, 1])
        for a in (0, 1):
            joint = alpha[before][:, a : a + 1] + moves[a] + ahead - log_z[:n, None]
            expected[a] += np.exp(joint).sum(axis=0)
    rank = np.arange(start[-1]) - np.repeat(start[:-1], chains.going)
    good = np.exp(alpha[:, 1] + beta[:, 1] - log_z[rank])
    return np.clip(good, 0, 1), expected, log_z


def fit(texts: list, labels: np.ndarray, share: float) -> dict:
    """The field: bins, weights, moves. Without rows of both classes all lines are ``share``."""
    prior = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    width = 3 * MEASURES
    model = {"cuts": np.zeros((width, BINS - 1)), "weights": np.zeros(width * BINS), "moves": np.zeros((2, 2)), "bias": prior}
    if labels.size == 0 or labels.min() == labels.max():
        return model
    chains = Chains(texts)
    own = chains.features[:, :MEASURES]
    cuts = np.quantile(own, np.arange(1, BINS) / BINS, axis=0).T
    spread = np.linspace(own.min(axis=0), own.max(axis=0), BINS + 1)[1:-1].T
    cuts[:, ::2] = spread[:, ::2]
    cuts = np.sort(cuts, axis=1)
    model["cuts"] = np.vstack([cuts, cuts, cuts])
    bins = _binned(chains.features, model["cuts"])
    y = labels[chains.owner]
    balance = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    per_line = 1 / chains.lengths[np.argsort(chains.order)]
    weight = (balance * per_line)[chains.owner]
    total = len(texts)

    theta = np.zeros(width * BINS + 5)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        weights, moves, bias = theta[: width * BINS], theta[-5:-1].reshape(2, 2), theta[-1]
        unary = weights[bins].sum(axis=1) + bias
        good, expected, _ = forward_backward(chains, unary, moves)
        error = (good - y) * weight
        gradient = np.zeros_like(theta)
        gradient[: width * BINS] = np.bincount(bins.ravel(), np.repeat(error, width), width * BINS) / total
        gradient[-1] = error.sum() / total
        same = np.zeros((2, 2))
        for label in (0, 1):
            same[label, label] = np.sum(chains.lengths[labels[chains.order] == label] - 1)
        gradient[-5:-1] = ((expected - same) / chains.owner.size).ravel()
        gradient += 1e-4 * theta
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        theta -= 0.1 * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    model |= {"weights": theta[: width * BINS], "moves": theta[-5:-1].reshape(2, 2), "bias": float(theta[-1])}
    return model


def line_marginals(model: dict, chains: Chains) -> np.ndarray:
    unary = model["weights"][_binned(chains.features, model["cuts"])].sum(axis=1) + model["bias"]
    return forward_backward(chains, unary, model["moves"])[0]


def fit_model(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id",
              label: str = "quality", per_class: int = PER_CLASS) -> dict:
    """A field fitted on the labelled rows whose id is not held out.

    One task fits it; it gets about ``2 * per_class`` texts however many there are, an id
    once however often it occurs. Without any label every text is good.
    """
    sample, known = labelled_sample(
        docs, labels, label, remainder(id, HELD_OUT) != HELD_OUT_REST, per_class, id, text
    )
    share = 1.0 if known is None else known

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, marks = [], []
        for batch in batches:
            marks.extend(batch.column(0).to_pylist())
            texts.extend(texts_of(batch.column(1)))
        model = fit(texts, np.array(marks, dtype=np.float64), share)
        flat = np.concatenate([model["cuts"].ravel(), model["weights"], model["moves"].ravel(), [model["bias"]]])
        yield pa.RecordBatch.from_arrays([pa.array([flat.tobytes()])], names=["model"])

    rows = sample.select("y", "text").repartition(1).sortWithinPartitions("y", "text")
    row = rows.mapInArrow(run, "model binary").first()
    if row is None:
        return fit([], np.zeros(0), share)
    flat, width = np.frombuffer(row.model), 3 * MEASURES
    cuts, weights, moves, bias = np.split(flat, np.cumsum([width * (BINS - 1), width * BINS, 4]))
    return {"cuts": cuts.reshape(width, -1), "weights": weights, "moves": moves.reshape(2, 2), "bias": float(bias[0])}


FIELDS = StructType(
    [
        StructField("score", DoubleType()),
        StructField("predicted", IntegerType()),
        StructField("good_lines", LongType()),
        StructField("bad_lines", LongType()),
    ]
)


def score(docs: DataFrame, model: dict, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score``, ``predicted``, and its numbers of good and bad lines.

    Lines are split at \\n; blank lines count for nothing. A null, empty or blank text
    is scored as one empty line, a long one by all of its lines. Repeated rows get equal
    scores, and a score equal to the threshold is good. An empty table gives an empty
    result. Columns named like results give way to them.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make() -> Compute:
        def compute(texts: list) -> list[pa.Array]:
            chains = Chains(texts)
            good = line_marginals(shared.value, chains)
            n = len(texts)
            length = np.bincount(chains.owner, chains.weights, n)
            s = np.clip(np.bincount(chains.owner, chains.weights * good, n) / length, 0, 1)
            is_good = np.bincount(chains.owner, good >= 0.5, n).astype(np.int64)
            bad = np.bincount(chains.owner, minlength=n) - is_good
            return [pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(is_good), pa.array(bad)]

        return compute

    return with_results(docs, text, FIELDS, make)
