"""Toxicity scores from class-conditional Kneser-Ney models (operator 2).

Method: a model of toxic and one of ordinary texts give the probability of each letter of a
word after the four before it. Both take the counts of their own class at the highest order,
less modified Kneser-Ney discounts, and hand what these free to the same lower orders:
continuation counts (how many different letters a sequence follows) of all documents,
labelled or not. So an expression that is rare in a class gets the shared probability there.
A word's evidence is the difference of its two log-likelihoods. As a few toxic words in a
long text are toxic too, a text's evidence is normalised by length in two ways: the mean of
the ``strongest`` words, and the logarithm of what exceeds ``margin`` over the root of the
number of words. A logistic curve turns these into a score.
A document counts once for each of its words, however often it repeats them.

Letters are mapped to an alphabet of ``SYMBOLS``, so there are at most ``SYMBOLS ** ORDER``
sequences (33.5 million), however large the input is: the table of counts, its way to the
driver, where it is smoothed, and the table of differences that goes to the tasks have a
proven bound, while all labelled rows and all documents are counted. Each task adds up
the counts of its own documents before the shuffle; texts are read in place and never
shuffled (but for the join to labels where these are too many to broadcast). The curve is
fitted on at most ``per_class`` ids of each class, by models that have not seen them (two
folds), and each row weighs as many as it stands for.

Cases: a text that is null, empty or without letters has evidence zero and gets the score
of that; without labels of both classes every score is 0; labels of unknown ids, nulls
and values other than 0 and 1 are ignored; texts are scored whole, repeated rows alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_slices, join_small, known_labels, labelled_sample, text_function
from .logistic import Logistic

SYMBOLS, ORDER = 32, 5
#: Columns of counts: documents of class 0 and 1 in either half, and all documents.
COUNTS = ["c00", "c01", "c10", "c11", "n"]
ALL = len(COUNTS) - 1


@cache
def symbols() -> np.ndarray:
    """The symbol of each code point: 0 where it is no letter, a to z 1 to 26; other letters are dealt over 1 to 31."""
    table = np.zeros(0x110000, np.uint8)
    for c in range(len(table)):
        if (letter := chr(c)).isalpha():
            low = ord(letter.lower()[0])
            table[c] = low - 96 if 97 <= low <= 122 else 1 + low % 31
    return table


@dataclass
class Words:
    """The words of some texts, one after the other, and their letter sequences."""

    doc: np.ndarray  # of each word, the number of its text
    key: np.ndarray  # of each word, a hash of its symbols
    first: np.ndarray  # of each word, the place of its first sequence
    size: np.ndarray  # of each word, how many sequences it has: its letters and its end
    grams: np.ndarray


def words_of(texts: list[str]) -> Words:
    points = np.frombuffer("\0".join(texts).encode("utf-32-le", "replace"), np.uint32)
    s = symbols()[points]
    at = np.flatnonzero(s)
    opens = np.ones(len(at), bool)
    opens[1:] = np.diff(at) > 1
    starts = np.flatnonzero(opens)
    word = np.cumsum(opens) - 1
    length = np.diff(np.append(starts, len(at)))
    text_starts = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    doc = np.searchsorted(text_starts, at[starts], "right") - 1
    letters = s[at].astype(np.uint32)
    # Each word stands after ORDER - 1 blanks and before one, so no sequence spans two words.
    place = np.arange(len(at)) + ORDER * word + ORDER - 1
    spelled = np.zeros(len(at) + ORDER * len(starts) + ORDER, np.uint32)
    spelled[place] = letters
    ends = np.zeros(len(spelled), bool)
    ends[place] = True
    ends[place[starts + length - 1] + 1] = True
    grams = np.zeros(len(spelled), np.uint32)
    for back in range(ORDER):
        grams[ORDER - 1 :] += spelled[ORDER - 1 - back : len(spelled) - back] << np.uint32(5 * back)
    size = length + 1
    with np.errstate(over="ignore"):
        inside = np.arange(len(at)) - np.repeat(starts, length)
        powers = np.cumprod(np.append(np.uint64(1), np.full(length.max(initial=0), 0x9E3779B97F4A7C15, np.uint64)))
        hashed = np.add.reduceat(letters * powers[inside], starts) if len(starts) else np.zeros(0, np.uint64)
    return Words(doc, hashed, np.cumsum(size) - size, size, grams[ends].astype(np.int64))


def summed(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their rows."""
    distinct, of = np.unique(keys, return_inverse=True)
    return distinct, np.stack([np.bincount(of, rows[:, j], len(distinct)) for j in range(rows.shape[1])], axis=1).astype(np.int64)


def counted(texts: list[str], kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequences and their counts; a text's kind is the column of its class and half, ``ALL`` if it has none."""
    w = words_of(texts)
    with np.errstate(over="ignore"):
        own = np.unique(w.key * np.uint64(0xD1342543DE82EF95) + w.doc.astype(np.uint64), return_index=True)[1]
    _, example, which = np.unique(w.key[own], return_index=True, return_inverse=True)
    rows = np.bincount(which * len(COUNTS) + kinds[w.doc[own]], minlength=len(example) * len(COUNTS)).reshape(-1, len(COUNTS))
    rows[:, ALL] = rows.sum(axis=1)
    example = own[example]
    size = w.size[example]
    places = np.repeat(w.first[example] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return summed(w.grams[places], np.repeat(rows, size, axis=0))


def gram_counts(docs: DataFrame, known: DataFrame, text_col: str = "text") -> DataFrame:
    """(gram, c00, c01, c10, c11, n): in how many documents of each class and half, and of all, words have each sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for part in in_slices(batches, 128):
            held.append(counted([t or "" for t in part.column(0).to_pylist()], part.column(1).to_numpy()))
            rows += len(held[-1][0])
            if rows > 200_000:
                held = [summed(*(np.concatenate(x) for x in zip(*held)))]
                rows = len(held[0][0])
        if held:
            keys, sums = summed(*(np.concatenate(x) for x in zip(*held)))
            for at in range(0, len(keys), 65_536):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 65_536]) for x in (keys, *sums.T)], ["gram", *COUNTS])

    kind = F.coalesce(F.col("label") * 2 + half(), F.lit(ALL)).cast("int")
    rows = join_small(docs.select("doc_id", text_col), known, "doc_id", "left").select(text_col, kind.alias("kind"))
    parts = rows.mapInArrow(run, ", ".join(f"{c} long" for c in ["gram", *COUNTS]))
    return parts.groupBy("gram").agg(*(F.sum(c).alias(c) for c in COUNTS))


def discounts(counts: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 0, 1, 2 and 3 or more, from how many counts are 1, 2, 3 and 4."""
    n = np.maximum(np.bincount(np.minimum(counts, 5), minlength=6)[1:5], 1).astype(float)
    y = n[0] / (n[0] + 2 * n[1])
    d = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
    return np.array([0.0, *(float(np.clip(x, 0.1, k + 0.9)) for k, x in enumerate(d))])


def smoothed(grams: np.ndarray, counts: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Interpolated probability of the last symbol of each of the ordered ``grams`` after the others.

    ``below`` is its probability by the next lower order, which gets what discounts free.
    """
    cut = discounts(counts)[np.minimum(counts, 3)]
    starts = np.flatnonzero(np.diff(grams // SYMBOLS, prepend=-1))
    repeats = np.diff(np.append(starts, len(grams)))
    total, freed = (np.repeat(np.add.reduceat(x, starts), repeats) for x in (counts, cut))
    return np.where(total > 0, (counts - cut + freed * below) / np.maximum(total, 1), below)


def shared_backoff(grams: np.ndarray) -> np.ndarray:
    """For each of the ordered sequences the probability that the lower orders give, by continuation counts."""
    levels, order = [(grams, None)], ORDER
    while order > 1:
        order -= 1
        levels.append(np.unique(levels[-1][0] % SYMBOLS**order, return_counts=True))
    below = np.full(len(levels[-1][0]), 1 / SYMBOLS)
    for order in range(1, ORDER):
        lower, counts = levels[ORDER - order]
        p = smoothed(lower, counts, below)
        upper = levels[ORDER - order - 1][0]
        below = p[np.searchsorted(lower, upper % SYMBOLS**order)]
    return below


@dataclass
class Evidence:
    """What letter sequences say for class 1 against class 0: differences of log-likelihoods."""

    grams: np.ndarray
    ratios: np.ndarray
    strongest: int = 3
    margin: float = 2.0
    table: tuple[np.ndarray, np.ndarray] | None = field(default=None, repr=False)

    @classmethod
    def of(cls, grams: np.ndarray, counts: tuple[np.ndarray, np.ndarray]) -> Evidence:
        """``grams`` are the ordered sequences of all documents, ``counts`` those of class 0 and of class 1."""
        if not all(c.any() for c in counts):
            return cls(np.zeros(0, np.int32), np.zeros(0, np.float32))
        below = shared_backoff(grams)
        ordinary, toxic = (smoothed(grams, c, below) for c in counts)
        # What neither class has seen says nothing.
        seen = counts[0] + counts[1] > 0
        return cls(grams[seen].astype(np.int32), (np.log(toxic[seen]) - np.log(ordinary[seen])).astype(np.float32))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": None}

    def by_context(self) -> tuple[np.ndarray, np.ndarray]:
        """The row of each sequence without its last symbol (0 where none is known), and the ratios of a row by last symbol."""
        contexts, row = np.unique(self.grams // SYMBOLS, return_inverse=True)
        row_of = np.zeros(SYMBOLS ** (ORDER - 1), np.int32)
        row_of[contexts] = np.arange(1, len(contexts) + 1)
        ratios = np.zeros((len(contexts) + 1, SYMBOLS), np.float32)
        ratios[row + 1, self.grams % SYMBOLS] = self.ratios
        return row_of, ratios

    def measure(self, texts: list[str]) -> np.ndarray:
        """(texts, 2): mean of the strongest words, and what exceeds the margin by the number of words."""
        if self.table is None:
            self.table = self.by_context()
        row_of, ratios = self.table
        out, w = np.zeros((len(texts), 2)), words_of(texts)
        if not len(w.doc):
            return out
        x = np.add.reduceat(ratios[row_of[w.grams // SYMBOLS], w.grams % SYMBOLS].astype(np.float64), w.first)
        starts = np.flatnonzero(np.diff(w.doc, prepend=-1))
        rows, number = w.doc[starts], np.diff(np.append(starts, len(x)))
        out[rows, 1] = np.log1p(20 * np.add.reduceat(np.maximum(x - self.margin, 0), starts) / np.sqrt(number))
        for row, start, n in zip(rows, starts, number):
            own = x[start : start + n]
            out[row, 0] = (np.partition(own, -self.strongest)[-self.strongest :] if n > self.strongest else own).sum() / self.strongest
        return out

    def column(self, text_col: str = "text") -> Column:
        """The two numbers of a text column as an array."""

        def run(texts: pd.Series) -> pa.Array:
            return pa.array(list(self.measure([t or "" for t in texts])), pa.list_(pa.float64()))

        return text_function(run, T.ArrayType(T.DoubleType()), text_col)


@dataclass
class ToxicityModel:
    evidence: Evidence | None
    curve: Logistic | None

    def column(self, text_col: str = "text") -> Column:
        """The score, 0 to 1, of a text column."""
        if self.evidence is None:
            return F.lit(0.0)

        def run(texts: pd.Series) -> pa.Array:
            return pa.array(self.curve.probability(self.evidence.measure([t or "" for t in texts])), pa.float64())

        return text_function(run, T.DoubleType(), text_col)


def half() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int")


def fit(docs: DataFrame, labels: DataFrame, held_out: Column, *, per_class: int = 3000) -> ToxicityModel:
    """A model of ``labels.toxic``; ``held_out`` is a condition on doc_id that is not learned from."""
    table = gram_counts(docs, known_labels(labels, "toxic", held_out)).toPandas().sort_values("gram")
    grams, c = table["gram"].to_numpy(), table[COUNTS].to_numpy().T
    whole, *halves = (Evidence.of(grams, x) for x in ((c[0] + c[1], c[2] + c[3]), (c[0], c[2]), (c[1], c[3])))
    if not len(whole.grams):
        return ToxicityModel(None, None)
    sample = labelled_sample(labels, docs, "toxic", held_out, per_class)
    # Each half is measured by the model of the other.
    x = F.when(half() == 0, halves[1].column()).otherwise(halves[0].column())
    known = sample.select("doc_id", "label", "weight", x.alias("x")).toPandas().sort_values(["doc_id", "label"])
    return ToxicityModel(whole, Logistic.fit(np.array(known["x"].tolist()).reshape(-1, 2), known["label"].to_numpy(), known["weight"].to_numpy(), penalty=1.0))


def scored(docs: DataFrame, model: ToxicityModel, held_out: Column, threshold: float = 0.3) -> DataFrame:
    rows = docs.select("doc_id", held_out.alias("held_out"), model.column().alias("score"))
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
