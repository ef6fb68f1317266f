"""Document quality from a linear-chain conditional random field over lines (operator 8).

Method: every line is good or bad. A line's features are shares of letters, capitals,
digits, marks and symbols, of repeated words and repeated lines, and its length; the
features of both neighbouring lines stand beside its own. A two-state chain with learned
transitions gives each line a forward-backward marginal of being bad; a document's
quality is a logistic curve over the length-weighted mean of its lines' marginals, their
maximum and the number of lines.

Only documents are labelled, so lines start with their document's label; then lines of
bad documents that the field finds good are taken as good (but for the worst one of each)
and the field is fitted again, ``rounds`` times. It is fitted on at most ``per_class``
labelled rows of each class that together have at most ``most_lines`` lines. Rows are taken
in the order of a hash of doc_id, but those of more than ``row_lines`` lines last, the
shorter first, so that one very long text costs no other its place. Their line features, not
texts, come to the driver, where chains are fitted in pieces of at most ``PIECE`` lines. In
the curve each weighs as many rows as it stands for, so that the caps do not move the score.

Cases: blank lines are left out; a text that is null, empty or blank has no line and gets
the score of a document without bad lines; without labels of both classes, or without a
line in any labelled text, every score is 0.5; texts count whole, line by line.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import exp

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import labelled_sample, saved, text_function
from .logistic import Logistic

N_FEATURES = 13
PIECE = 500
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers = {"base": np.ones(1, np.uint64), "inverse": np.ones(1, np.uint64)}

CLASS = np.zeros((5, 256), np.float32)  # letter, capital, digit, blank, full stop or comma
CLASS[0, [*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
CLASS[1, 65:91] = 1
CLASS[2, 48:58] = 1
CLASS[3, [9, 11, 12, 13, 32]] = 1
CLASS[4, [44, 46]] = 1


def powers(kind: str, n: int) -> np.ndarray:
    held = _powers[kind]
    if len(held) < n:
        step = np.full(2 * n, BASE if kind == "base" else INVERSE, np.uint64)
        step[0] = 1
        _powers[kind] = held = np.cumprod(step)
    return held[:n]


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal spans of bytes have equal hashes (polynomials modulo 2^64)."""
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers("base", len(codes)))])
        h = (sums[ends] - sums[starts]) * powers("inverse", len(codes) + 1)[starts]
        return (h ^ (h >> np.uint64(31))) * BASE + (ends - starts).astype(np.uint64)


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines, N_FEATURES) of the lines that are not blank, and their lengths."""
    codes = np.frombuffer((text or "").encode("utf-8"), np.uint8)
    none = np.zeros((0, N_FEATURES), np.float32), np.zeros(0, np.float32)
    if not len(codes):
        return none
    breaks = np.flatnonzero(codes == 10)
    starts, ends = np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(codes)]])
    dark = (CLASS[3][codes] == 0) & (codes != 10)
    word_starts = np.flatnonzero(dark & np.concatenate([[True], ~dark[:-1]]))
    word_ends = np.flatnonzero(dark & np.concatenate([~dark[1:], [True]])) + 1
    if not len(word_starts):
        return none
    words_before = np.searchsorted(word_starts, np.concatenate([starts, [len(codes)]]))
    n_words = np.diff(words_before)
    kept = n_words > 0
    starts, ends, n_words = starts[kept], ends[kept], n_words[kept].astype(np.float32)
    length = (ends - starts).astype(np.float32)
    sums = np.concatenate([np.zeros((5, 1), np.float64), np.cumsum(CLASS[:, codes], axis=1, dtype=np.float64)], axis=1)
    letters, capitals, digits, blanks, stops = (sums[:, ends] - sums[:, starts]).astype(np.float32)
    words = span_hashes(codes, word_starts, word_ends)
    line_of = np.repeat(np.arange(len(n_words)), n_words.astype(int))
    order = np.lexsort((words, line_of))
    same = (words[order][1:] == words[order][:-1]) & (line_of[order][1:] == line_of[order][:-1])
    repeated = np.bincount(line_of[order][1:][same], minlength=len(n_words))
    twice = (words[1:] == words[:-1]) & (line_of[1:] == line_of[:-1])
    twice = np.bincount(line_of[1:][twice], minlength=len(n_words))
    marked = np.bincount(line_of[CLASS[0][codes[word_ends - 1]] == 0], minlength=len(n_words))
    _, which, copies = np.unique(span_hashes(codes, starts, ends), return_inverse=True, return_counts=True)
    symbols = length - letters - digits - blanks - stops
    first = codes[starts]
    x = np.stack(
        [
            np.log1p(length) / 6,
            letters / length,
            capitals / np.maximum(letters, 1),
            digits / length,
            stops / length,
            symbols / length,
            np.minimum(symbols / n_words, 4) / 4,
            marked / n_words,
            repeated / n_words,
            twice / n_words,
            np.minimum(length / n_words, 40) / 40,
            (copies[which] > 1).astype(np.float32),
            ((first >= 65) & (first <= 90)).astype(np.float32),
        ],
        axis=1,
    )
    return x.astype(np.float32), length


def with_neighbours(x: np.ndarray) -> np.ndarray:
    """Each line's features, those of the lines before and after it, and a constant."""
    edge = np.zeros((1, x.shape[1]), x.dtype)
    before, after = np.concatenate([edge, x[:-1]]), np.concatenate([x[1:], edge])
    return np.concatenate([x, before, after, np.ones((len(x), 1), x.dtype)], axis=1)


def pieces(chain: np.ndarray) -> list[np.ndarray]:
    """A chain in pieces of at most ``PIECE`` lines, so that the steps of a fit are bounded."""
    return [chain[at : at + PIECE] for at in range(0, len(chain), PIECE)]


@dataclass
class LineField:
    """Scores of a bad line, and of a pair of neighbours: [state before][state after]."""

    weights: np.ndarray
    pair: np.ndarray

    def marginals(self, emissions: np.ndarray) -> np.ndarray:
        """The probability of each line to be bad, by forward and backward odds."""
        (gg, gb), (bg, bb) = np.exp(self.pair).tolist()
        local = np.exp(np.clip(emissions, -30, 30)).tolist()
        ahead, odds = [], 0.0
        for i, e in enumerate(local):
            odds = e * (gb + odds * bb) / (gg + odds * bg) if i else e
            odds = min(max(odds, 1e-30), 1e30)
            ahead.append(odds)
        out, back = [0.0] * len(local), 1.0
        for i in range(len(local) - 1, -1, -1):
            total = ahead[i] * back
            out[i] = total / (1 + total)
            up = local[i] * back
            back = (bg + bb * up) / (gg + gb * up)
        return np.array(out)

    @classmethod
    def fit(cls, docs: list[np.ndarray], states: list[np.ndarray], steps: int = 120, ridge: float = 1e-3) -> LineField:
        """Maximise the conditional likelihood of the states by Adam over all documents at once."""
        sizes = np.array([len(d) for d in docs])
        x, y = np.concatenate(docs).astype(np.float64), np.concatenate(states)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        order = np.argsort(-sizes, kind="stable")
        longest, live = sizes.max(), [int((sizes > t).sum()) for t in range(sizes.max())]
        place = [starts[order[:n]] + t for t, n in enumerate(live)]
        theta = np.zeros(x.shape[1] + 4)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        inner = np.ones(len(x), bool)
        inner[starts] = False
        second = np.flatnonzero(inner)
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[second - 1], y[second]), 1)
        for step in range(1, steps + 1):
            w, pair = theta[:-4], theta[-4:].reshape(2, 2)
            e = np.stack([np.zeros(len(x)), x @ w], axis=1)
            alpha, beta = np.zeros((len(x), 2)), np.zeros((len(x), 2))
            for t, at in enumerate(place):
                if t:
                    alpha[at] = np.logaddexp(alpha[at - 1, :1] + pair[0], alpha[at - 1, 1:] + pair[1])
                alpha[at] += e[at]
            for t in range(longest - 2, -1, -1):
                at = place[t + 1]
                ahead = beta[at] + e[at]
                beta[at - 1] = np.logaddexp(ahead[:, :1] + pair[:, 0], ahead[:, 1:] + pair[:, 1])
            log_z = np.logaddexp(alpha[ends - 1, 0], alpha[ends - 1, 1])
            z = np.repeat(log_z, sizes)
            bad = np.exp(alpha[:, 1] + beta[:, 1] - z)
            ahead = (beta + e)[second]
            both = np.exp(alpha[second - 1][:, :, None] + pair + ahead[:, None, :] - z[second][:, None, None])
            grad = np.concatenate([x.T @ (y - bad), (seen - both.sum(axis=0)).ravel()]) / len(x) - ridge * theta
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            theta += 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        return cls(theta[:-4], theta[-4:].reshape(2, 2))


@dataclass
class QualityModel:
    field: LineField | None
    curve: Logistic | None

    def summary(self, x: np.ndarray, length: np.ndarray) -> list[float]:
        """Length-weighted mean and maximum of the lines' marginals, and the number of lines."""
        if not len(x):
            return [0.0, 0.0, 0.0]
        bad = self.field.marginals(with_neighbours(x) @ self.field.weights)
        return [float(bad @ length / length.sum()), float(bad.max()), float(np.log1p(len(x)))]

    def score(self, texts: pd.Series) -> pd.Series:
        if self.field is None:
            return pd.Series(np.full(len(texts), 0.5))
        x = np.array([self.summary(*line_features(t)) for t in texts]).reshape(-1, 3)
        return pd.Series(self.curve.probability(x))

    def column(self, text_col: str = "text") -> Column:
        """The quality of a text column, 0 to 1."""
        score = self.score
        return text_function(lambda texts: pa.array(score(texts), pa.float64()), T.DoubleType(), text_col)


def fit(docs: DataFrame, labels: DataFrame, held_out: Column, *, per_class: int = 1000, most_lines: int = 400_000, row_lines: int = 20_000, rounds: int = 3) -> QualityModel:
    """A model of ``labels.quality``; ``held_out`` is a condition on doc_id that is not learned from."""
    sample = saved(labelled_sample(labels, docs, "quality", held_out, per_class), "quality-sample")
    # At most ``per_class`` rows of each class go through this window, without their texts.
    long = F.when(F.col("lines") > row_lines, F.col("lines")).otherwise(0)
    so_far = F.sum("lines").over(Window.orderBy(long, F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    lines = sample.select("doc_id", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).alias("lines")).withColumn("so_far", so_far)
    stand_for = {r.label: r.ids for r in sample.groupBy("label").agg(F.sum("weight").alias("ids")).collect()}
    sample = sample.join(F.broadcast(lines.where(F.col("so_far") <= most_lines).select("doc_id")), "doc_id")

    @F.pandas_udf(T.StructType([T.StructField("x", T.BinaryType()), T.StructField("length", T.BinaryType())]))
    def measured(texts: pd.Series) -> pd.DataFrame:
        both = [line_features(t) for t in texts]
        return pd.DataFrame({"x": [x.tobytes() for x, _ in both], "length": [n.tobytes() for _, n in both]})

    got = sample.select("doc_id", "label", measured("text").alias("f")).select("doc_id", "label", "f.x", "f.length").toPandas()
    got = got.sort_values(["doc_id", "label"], kind="stable")
    good = got["label"].to_numpy()
    if not len(got) or good.min() == good.max():
        return QualityModel(None, None)
    lines = [np.frombuffer(b, np.float32).reshape(-1, N_FEATURES) for b in got["x"]]
    lengths = [np.frombuffer(b, np.float32) for b in got["length"]]
    if not any(map(len, lines)):
        return QualityModel(None, None)
    weight = got["label"].map(stand_for) / got.groupby("label")["label"].transform("size")
    docs_x, of_doc = [with_neighbours(x) for x in lines if len(x)], [g for x, g in zip(lines, good) if len(x)]
    states = [np.full(len(x), 1 - g) for x, g in zip(docs_x, of_doc)]
    for k in range(rounds):
        field = LineField.fit([p for x in docs_x for p in pieces(x)], [p for y in states for p in pieces(y)])
        if k + 1 < rounds:
            for i, (x, g) in enumerate(zip(docs_x, of_doc)):
                if not g:
                    bad = field.marginals(x @ field.weights)
                    states[i] = ((bad > 0.5) | (bad == bad.max())).astype(int)
    model = QualityModel(field, None)
    model.curve = Logistic.fit(np.array([model.summary(x, n) for x, n in zip(lines, lengths)]), good, weight.to_numpy())
    return model


def scored(docs: DataFrame, model: QualityModel, held_out: Column, threshold: float = 0.5) -> DataFrame:
    rows = docs.select("doc_id", held_out.alias("held_out"), model.column().alias("score"))
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
