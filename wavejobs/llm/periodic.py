"""Periodic runs of words (operator 12).

Method: seed and extend on diagonals. A run with period q and at least ``LEAST`` words, or
two periods, repeats at lag q at least max(q, LEAST - q) words one after another, which is
``SEED`` or more; for q > ``SEED`` * 2 ** t it is more than that. So k-grams of that length k
are indexed for every octave (k, 2k] of lags, and pairs of places in one document with
equal k-grams and such a lag are seeds. A table with the furthest place covered on each
diagonal suppresses seeds that an earlier one has reached; the others are extended to both
sides. A stretch of two periods or more whose period is its smallest is a run.

Two things keep seeds linear in the words. Places of a k-gram without a period up to k / 2
are more than k / 2 apart, so each has few partners in the octave. A k-gram with such a
period lies in a run found in an octave before; there, only pairs with the first place of
a run can start another one (a stretch of which all k-grams lie in one run begins where
that run, or the one that it meets, begins), and pairs within one run never do. k-grams
are compared by hash, and only those that occur twice in a document are looked at in the
next octave; every extension compares the words.

Each document is measured in the task that holds it, whole; texts of a slice are measured
together, without matches between them. No text is shuffled.

Cases: a null, empty or blank text has no words and no run; a text whose words are all
equal is one run; repeated rows are answered alike; a null id takes part in no rewriting;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_BYTES, slices, text_bytes

LEAST, SEED = 12, 6
ODD = np.uint64(0x9E3779B97F4A7C15)
OTHER = np.uint64(0xC2B2AE3D27D4EB4F)


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of two neighbouring parts as one hash."""
    with np.errstate(over="ignore"):
        h = a * ODD + b
        h = (h ^ (h >> np.uint64(29))) * OTHER
        return h ^ (h >> np.uint64(32))


def repeated(grams: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places whose gram occurs twice or more, by gram and place, and where each gram begins among them."""
    if not len(places):
        return places, np.zeros(0, np.int64)
    order = np.argsort(grams, kind="stable")
    h = grams[order]
    same = h[1:] == h[:-1]
    held = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    new = np.concatenate([[True], ~same])[held]
    return places[order][held], np.flatnonzero(new)


def matched_right(ids: np.ndarray, at: int, lag: int) -> int:
    """The first place from ``at`` on whose word differs from that ``lag`` later (or has none there)."""
    end, step = len(ids) - lag, 64
    while at < end:
        stop = min(at + step, end)
        unlike = ids[at:stop] != ids[at + lag : stop + lag]
        if unlike.any():
            return at + int(unlike.argmax())
        at, step = stop, step * 2
    return end


def matched_left(ids: np.ndarray, at: int, lag: int) -> int:
    """The smallest place such that all words from it to ``at`` equal those ``lag`` later."""
    step = 64
    while at > 0:
        start = max(0, at - step)
        unlike = ids[start:at] != ids[start + lag : at + lag]
        if unlike.any():
            return at - int(unlike[::-1].argmax())
        at, step = start, step * 2
    return 0


def prime_factors(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return [*out, n] if n > 1 else out


def smallest_period(ids: np.ndarray, start: int, period: int) -> bool:
    """Whether a stretch of two periods or more that begins at ``start`` has no smaller period."""
    for p in prime_factors(period):
        d = period // p
        if (ids[start : start + period] == ids[start + d : start + d + period]).all():
            return False
    return True


def plain_seeds(places: np.ndarray, begins: np.ndarray, low: int, high: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(place, lag) of the pairs within each gram's places with a lag in (low, high]."""
    group = np.zeros(len(places), np.int64)
    group[begins] = 1
    group = np.cumsum(group)
    out, shift = [], 1
    while shift < len(places):
        lag = places[shift:] - places[:-shift]
        near = (group[shift:] == group[:-shift]) & (lag <= high)
        if not near.any():
            break
        near &= lag > low
        out.append((places[:-shift][near], lag[near]))
        shift += 1
    return out


def first_seeds(places: np.ndarray, begins: np.ndarray, first: np.ndarray, last: np.ndarray, low: int, high: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(place, lag) as in ``plain_seeds``, of pairs one of which is the first place of its run, in two runs.

    ``first`` and ``last`` are the first and last place of a k-gram in the run that holds each place.
    """
    out, ends = [], np.append(begins[1:], len(places))
    for i in np.flatnonzero(places == first):
        g = np.searchsorted(begins, i, "right") - 1
        own = places[begins[g] : ends[g]]
        p = int(places[i])
        later = own[np.searchsorted(own, max(p + low, int(last[i])), "right") : np.searchsorted(own, p + high, "right")]
        earlier = own[np.searchsorted(own, p - high, "left") : np.searchsorted(own, p - low, "left")]
        out += [(np.full(len(later), p), later - p), (earlier, p - earlier)]
    return out


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of ``ids``, by start and period.

    Documents may stand one after another, as long as no two of them share an id.
    """
    n, found = len(ids), []
    if n < LEAST:
        return found
    h = ids.astype(np.uint64)
    two = joined(h[:-1], h[1:])
    grams = joined(joined(two[:-4], two[2:-2]), two[4:])  # of SEED words
    places, k, low = np.arange(len(grams)), SEED, 0
    while len(places):
        places, begins = repeated(grams[places], places)
        # The run of a short period that holds the k-gram at each place, if any.
        first, last = np.full(n, -1), np.full(n, -1)
        if k > SEED:
            for s, length, q in found:
                if 2 * q <= k <= length:
                    first[s : s + length - k + 1], last[s : s + length - k + 1] = s, s + length - k
        group = np.zeros(len(places), np.int64)
        group[begins] = 1
        group = np.cumsum(group)
        held = first[places] >= 0
        seeds = []
        for part, make in ((~held, plain_seeds), (held, first_seeds)):
            g = group[part]
            starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else g
            more = () if make is plain_seeds else (first[places[part]], last[places[part]])
            seeds += make(places[part], starts, *more, low, 2 * k)
        if seeds:
            at, lag = (np.concatenate(x) for x in zip(*seeds))
            order = np.lexsort((at, lag))
            at, lag = at[order], lag[order]
            # A seed next to one on the same diagonal is covered by it.
            fresh = np.concatenate([[True], (at[1:] - at[:-1] > 1) | (lag[1:] != lag[:-1])]) if len(at) else np.zeros(0, bool)
            covered: dict[int, int] = {}
            for i, d in zip(at[fresh].tolist(), lag[fresh].tolist()):
                if i < covered.get(d, -1):
                    continue
                stop = matched_right(ids, i, d)
                if stop <= i:  # another gram with the same hash
                    continue
                start = matched_left(ids, i, d)
                covered[d] = stop
                length = stop - start + d
                if length >= max(LEAST, 2 * d) and smallest_period(ids, start, d):
                    found.append((start, length, d))
        places = np.sort(places)
        places = places[places + 2 * k <= n]
        low, wide = 2 * k, np.zeros(max(0, len(grams) - k), np.uint64)
        wide[places] = joined(grams[places], grams[places + k])
        grams, k = wide, 2 * k
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """False for words that a run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) == 0


def rewritten(words: list[bytes], h: int) -> list[bytes]:
    """The words with a periodic tail, whose start and period ``h`` gives."""
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def measured(texts: list[str | None], hashes: list[int | None]) -> list[tuple]:
    """The report of each text; where a hash is given and 10 divides it, of the text it rewrites."""
    docs, ids, base = [], [], 0
    for text, h in zip(texts, hashes):
        words = (text or "").encode("utf-8", "replace").split()  # on ASCII white space
        if words and h is not None and h % 10 == 0:
            words = rewritten(words, h)
        known = dict.fromkeys(words)
        for i, w in enumerate(known):
            known[w] = base + i
        base += len(known)
        docs.append(words)
        ids.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
    ends = np.cumsum([len(x) for x in ids])
    of_doc: list[list] = [[] for _ in docs]
    if len(ends):
        found = runs_of(np.concatenate(ids))
        starts = ends - [len(x) for x in ids]
        for d, (s, length, q) in zip(np.searchsorted(ends, [r[0] for r in found], "right").tolist(), found):
            of_doc[d].append((s - int(starts[d]), length, q))
    return [report(words, runs) for words, runs in zip(docs, of_doc)]


def report(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    start, length, period = best or (None, None, None)
    listed = sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
    if runs:
        words = [words[i] for i in np.flatnonzero(kept_words(len(words), runs)).tolist()]
    return len(runs), start, length, period, 1000 * length // period if best else None, listed, sha256(b" ".join(words)).hexdigest()


KIND = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("n_runs", "start", "length", "period", "exponent_milli")]
    + [T.StructField(c, T.StringType()) for c in ("runs_sha256", "collapsed_sha256")]
)
ARROW = pa.struct([pa.field(f.name, pa.int64() if f.dataType == T.LongType() else pa.string()) for f in KIND.fields])


def run_column(text: Column, rewrite_hash: Column | None = None, *, rows: int = 128) -> Column:
    """struct of the runs of a text column; tasks measure up to ``rows`` texts, or ``SLICE_BYTES`` of text, together."""

    @F.arrow_udf(KIND)
    def run(texts: pa.Array, hashes: pa.Array) -> pa.Array:
        out = []
        for s in slices(text_bytes(texts), rows, SLICE_BYTES):
            out += measured(texts[s].to_pylist(), hashes[s].to_pylist())
        return pa.array([dict(zip(KIND.names, r)) for r in out], ARROW)

    return run(text, F.lit(None).cast("long") if rewrite_hash is None else rewrite_hash)


def scan(docs: DataFrame, rewrite_hash: Column | None = None) -> DataFrame:
    """One row per document: its runs, the longest one, and the text without repeated periods, as digests."""
    rows = docs.select("doc_id", run_column(F.col("text"), rewrite_hash).alias("r"))
    return rows.select("doc_id", "r.*")
