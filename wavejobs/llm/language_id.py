"""Language identification by a string kernel (operator 10).

Method: the blended-spectrum presence kernel of two texts is the number of character
n-grams (n = 1 to ``max_n``) that both contain, divided by the root of the product of
their own numbers. Nyström landmarks, chosen from the sample, turn the kernel into
features K(x, landmarks) · K(landmarks, landmarks)^(-1/2); one ridge regression for each
language against the rest is solved on them. Scoring takes batches of documents: the
presence matrix of a batch times the folded matrix (landmark presence · Nyström map ·
ridge weights).

N-grams are hashed to ``2 ** cell_bits`` cells. The model is fitted on at most
``max_sample`` rows with a language, or four of each language if these are more, chosen
by a hash of doc_id, one row of each id and language. The regressions are solved from sums
(features by features, and features of each language) that tasks add up; a language's rows
are in one task, at most ``max_sample`` or four of them. To the driver come the presence rows
of the landmarks, as many as languages but at most ``max_landmarks``, and one vector of
that length for each language. With more languages than landmarks the model stays in two
factors, so nothing has the size of cells times languages. More than ``most_languages``
values of lang are an error before anything is collected.

Cases: a text that is null or has no letter is ``und`` with score 0; long texts count
whole; without any learned language everything is ``und``; repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved, text_function

LETTER = regex.compile(r"\p{L}").search
UNDEFINED = "und"


def cells_of(text: str, max_n: int, cell_bits: int) -> np.ndarray:
    """The cells of the n-grams of a text, with repeats; white space runs are one blank."""
    plain = " " + " ".join(text.lower().split()) + " "
    points = np.frombuffer(plain.encode("utf-32-le", "replace"), np.uint32)
    grams, out = points.astype(np.uint64), []
    shift = np.uint64(64 - cell_bits)
    with np.errstate(over="ignore"):
        for n in range(1, max_n + 1):
            if n > 1:
                grams = grams[:-1] * np.uint64(0x100000001B3) + points[n - 1 :]
            mixed = (grams ^ (grams >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)
            out.append(((mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)) >> shift)
    return np.concatenate(out).astype(np.int64)


def presence(texts, max_n: int, cell_bits: int) -> np.ndarray:
    """(texts, cells) of 0 and 1."""
    rows = np.zeros((len(texts), 1 << cell_bits), np.float32)
    for row, text in zip(rows, texts):
        row[cells_of(text or "", max_n, cell_bits)] = 1
    return rows


@dataclass
class LanguageModel:
    languages: list[str]
    factors: list[np.ndarray]  # what a text's presence row is multiplied by: (cells, languages), or (cells, landmarks) and (landmarks, languages)
    bias: np.ndarray
    max_n: int
    cell_bits: int

    def predict(self, texts: pd.Series, batch: int = 32) -> pd.DataFrame:
        names, scores = [UNDEFINED] * len(texts), np.zeros(len(texts))
        texts = list(texts)
        rows = [i for i, t in enumerate(texts) if isinstance(t, str) and LETTER(t)] if self.languages else []
        for at in range(0, len(rows), batch):
            part = rows[at : at + batch]
            x = presence([texts[i] for i in part], self.max_n, self.cell_bits)
            own = np.sqrt(x.sum(axis=1, keepdims=True))
            for factor in self.factors:
                x = x @ factor
            y = x / own + self.bias
            best = y.argmax(axis=1)
            for i, b, value in zip(part, best, y[np.arange(len(part)), best]):
                names[i], scores[i] = self.languages[b], min(1.0, max(0.0, float(value)))
        return pd.DataFrame({"lang": names, "score": scores})

    def column(self, text_col: str = "text") -> Column:
        """struct<lang, score> of a text column."""
        kind = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])
        predict = self.predict

        def run(texts: pd.Series) -> pa.Array:
            found = predict(texts)
            return pa.StructArray.from_arrays([pa.array(found["lang"], pa.string()), pa.array(found["score"], pa.float64())], ["lang", "score"])

        return text_function(run, kind, text_col)


def unpacked(bits: Iterable[bytes]) -> np.ndarray:
    """Presence rows of length 1."""
    x = np.stack([np.unpackbits(np.frombuffer(b, np.uint8)) for b in bits]).astype(np.float32)
    return x / np.sqrt(x.sum(axis=1, keepdims=True))


def sampled(docs: DataFrame, held_out: Column, max_sample: int, most_languages: int, max_n: int, cell_bits: int) -> tuple[DataFrame, list[str]]:
    """A written table (lang, nth, size, bits) of the rows to learn from, ``size`` of each language; and all languages, commonest first."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out)
    known = known.where(F.col("text").rlike(r"\p{L}"))
    order = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000_007))
    ids = saved(known.select("lang", "doc_id").distinct().withColumn("order", order), "language-ids")
    sizes = saved(ids.groupBy("lang").agg(F.count("*").alias("size")), "language-sizes")
    if (number := sizes.count()) > most_languages:
        raise ValueError(f"{number} languages, more than most_languages={most_languages}")
    languages = [r.lang for r in sizes.orderBy(F.desc("size"), "lang").collect()]
    each = max(4, max_sample // max(1, number))

    @F.pandas_udf(T.BinaryType())
    def packed(texts: pd.Series) -> pd.Series:
        return pd.Series([np.packbits(presence([t], max_n, cell_bits)[0] > 0).tobytes() if LETTER(t) else None for t in texts])

    # Thresholds on a hash pick about twice ``each`` ids a language, and some more of small ones; the rest is cut by rank.
    some = ids.join(F.broadcast(sizes), "lang").where(F.col("order") < F.lit(1_000_000_007.0 * (2 * each + 32)) / F.col("size"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("order", "doc_id"))
    chosen = some.withColumn("nth", rank).where(F.col("nth") <= each).select("doc_id", "lang", "nth")
    rows = known.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"])
    rows = rows.groupBy("doc_id", "lang", "nth").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    # Nulls go when the table is read: a condition before would be pushed below, as a second Python step beside the first in each task.
    got = saved(rows.select("lang", "nth", packed("text").alias("bits")), "language-bits").where("bits is not null")
    return got.withColumn("size", F.count("*").over(Window.partitionBy("lang"))), languages


def feature_sums(sample: DataFrame, landmarks: list[bytes], root: np.ndarray, tasks: int = 8) -> pd.DataFrame:
    """(lang, n, sums): the features of each language added up; without lang, features by features, each row weighted by 1 / size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, square, of = unpacked(landmarks), np.zeros((root.shape[1],) * 2), {}
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                lang, size, bits = (c.to_pylist() for c in batch.slice(at, 128).columns)
                x = (unpacked(bits) @ marks.T).astype(np.float64) @ root
                square += x.T @ (x / np.array(size)[:, None])
                for name, row in zip(lang, x):
                    n, total = of.get(name, (0, 0.0))
                    of[name] = n + 1, total + row
        found = [(None, 0, square.tobytes()), *((name, n, total.tobytes()) for name, (n, total) in of.items())]
        for at in range(0, len(found), 1024):
            columns = zip(("lang", "n", "sums"), zip(*found[at : at + 1024]), (pa.string(), pa.int64(), pa.binary()))
            yield pa.RecordBatch.from_pydict({c: pa.array(v, t) for c, v, t in columns})

    return sample.select("lang", "size", "bits").repartition(tasks, "lang").mapInArrow(run, "lang string, n long, sums binary").toPandas()


def fit(
    docs: DataFrame, held_out: Column, *, max_sample: int = 2000, landmarks: int = 200, max_landmarks: int = 1000, most_languages: int = 20_000, max_n: int = 4, cell_bits: int = 15, ridge: float = 1e-2
) -> LanguageModel:
    """Learn from the texts and languages of rows that are not ``held_out`` (a condition on doc_id)."""
    sample, languages = sampled(docs, held_out, max_sample, most_languages, max_n, cell_bits)
    # Landmarks are the first rows of all languages, then their second ones, and so on.
    most = min(max(landmarks, len(languages)), max(landmarks, max_landmarks))
    bits = [bytes(r.bits) for r in sample.orderBy("nth", F.xxhash64("lang"), "lang").limit(most).select("bits").collect()]
    if not bits:
        return LanguageModel([], [np.zeros((1 << cell_bits, 0), np.float32)], np.zeros(0), max_n, cell_bits)
    marks = unpacked(bits)
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    sums = feature_sums(sample, bits, root)
    square = sum(np.frombuffer(b).reshape(root.shape[1], -1) for b in sums.loc[sums["lang"].isna(), "sums"])
    of = sums[sums["lang"].notna()].set_index("lang")
    languages = [lang for lang in languages if lang in of.index]
    n = of.loc[languages, "n"].to_numpy().astype(float)
    total = np.stack([np.frombuffer(b) for b in of.loc[languages, "sums"]])  # (languages, features)
    # Each language weighs the same, however many rows it has; features and targets are centred on their means over rows.
    means, centre, aim = total / n[:, None], total.sum(axis=0) / n.sum(), n / n.sum()
    whole = means.sum(axis=0)
    scatter = square - np.outer(whole, centre) - np.outer(centre, whole) + len(languages) * np.outer(centre, centre)
    towards = (means - centre).T - np.outer(whole - len(languages) * centre, aim)
    w = np.linalg.solve(scatter + ridge * np.trace(scatter) / len(scatter) * np.eye(len(scatter)), towards)
    factors = [marks.T, (root @ w).astype(np.float32)]
    if len(languages) <= len(marks):
        factors = [factors[0] @ factors[1]]
    return LanguageModel(languages, factors, aim - centre @ w, max_n, cell_bits)


def identified(docs: DataFrame, model: LanguageModel, held_out: Column) -> DataFrame:
    rows = docs.select("doc_id", held_out.alias("held_out"), model.column().alias("found"))
    return rows.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))
