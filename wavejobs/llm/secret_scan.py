"""Secret scan by the cost of guessing (operator 13).

Method: dynamic programming over the values that stand in a credential's context (after a
key such as ``password``, ``api key`` or ``bearer`` and a sign, ``is`` or blanks). A value
is cut into words, dates, repeats, keyboard walks or sequences, and brute-force spans; each
costs the binary logarithm of its guesses, each further span ``JOIN``, and the cheapest cut
is the value's cost. Values of ``least_chars`` characters that cost ``least_bits`` or more
are secrets of kind ``guess``, unless they overlap a base span: those found by the three
base patterns (``assign``, ``access``, ``hex``), which stay.

A word costs the logarithm of its rank by frequency in all documents. Letters next to one
another in the texts, outside values after a sign, are counted over the whole corpus; ranks
come from counts in quarter octaves. Only the words that are parts of a value are joined to
it, so no dictionary goes to the driver or to all tasks. Each different value is judged once.

Cases: a null text counts as empty; repeated rows are answered alike; places are code
points; long texts and values are taken whole, where they are read; without any value or
word nothing is added; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import accumulate
from math import comb, inf, log2

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_BYTES, in_slices, join_small, saved, slices, text_bytes

# The base patterns and the lengths that a match needs.
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX_DIGITS = b"0123456789abcdef"
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 6, 20, 24
KINDS = ("assign", "access", "hex", "guess")

#: Keys that credentials stand after, found in lower-cased text; and what makes a plain ``key`` one.
KEYS_OF_VALUES = (b"password", b"passwd", b"passphrase", b"passcode", b"pwd", b"secret", b"token", b"authorization", b"bearer", b"credential")
KIND_OF_KEY = re.compile(rb"(?:api|access|private|auth|signing|encryption)[\x20_-]?\Z")
CONTEXT = re.compile(
    rb"[A-Za-z]{1,20}(?:[\x20_-]?key)?[\"')\]]?(?:\x20*(?P<sign>[:=]+>?)\x20*(?:bearer\x20+|basic\x20+)?|\x20+(?:(?:is|was)\x20+)?)[\"'(\[]?(?P<value>[^\x00-\x20\x7F\"'`<>,;]+)",
    re.I,
)
AFTER = b".:!?)]}"  # marks that end a sentence or bracket, not a value
LETTERS = re.compile(rb"[a-z]{3,20}")
WORD = (3, 20)

# The keys of a keyboard by rows, each slanted by half a key, plain and shifted.
KEY_ROWS = (("`1234567890-=", "~!@#$%^&*()_+", 0), ("qwertyuiop[]\\", "QWERTYUIOP{}|", 1), ("asdfghjkl;'", 'ASDFGHJKL:"', 1), ("zxcvbnm,./", "ZXCVBNM<>?", 1))
# Signs that stand for letters.
LEET = str.maketrans("4@301!$5+7", "aaeoiisstt")
KEYS = {c: (row, at + first) for row, (plain, shifted, first) in enumerate(KEY_ROWS) for names in (plain, shifted) for at, c in enumerate(names)}
NEXT = {(0, 1), (0, -1), (-1, 0), (-1, 1), (1, -1), (1, 0)}
JOIN, WALK_START, WALK_TURN, SEQUENCE_START, YEAR_BITS, DAY_BITS, SEPARATED = 1.0, log2(47), log2(4.6), log2(62), log2(200), log2(366 * 200), 2.0
YEAR = re.compile(r"(?:19|20)\d\d", re.ASCII)
DATES = (
    (re.compile(r"(?P<y>(?:19|20)\d\d)(?P<m>\d\d)(?P<d>\d\d)", re.ASCII), 0.0),
    (re.compile(r"(?P<d>\d\d)(?P<m>\d\d)(?P<y>(?:19|20)\d\d)", re.ASCII), 0.0),
    (re.compile(r"(?P<d>\d\d)(?P<m>\d\d)(?P<y>\d\d)", re.ASCII), 0.0),
    (re.compile(r"(?P<y>\d{4})(?P<s>[-/._])(?P<m>\d\d?)(?P=s)(?P<d>\d\d?)", re.ASCII), SEPARATED),
    (re.compile(r"(?P<d>\d\d?)(?P<s>[-/._])(?P<m>\d\d?)(?P=s)(?P<y>\d{4}|\d\d)", re.ASCII), SEPARATED),
)


@cache
def char_bits(c: str) -> float:
    """Brute force: the size of the character's class."""
    return log2(10 if "0" <= c <= "9" else 26 if "a" <= c <= "z" or "A" <= c <= "Z" else 33 if c < "\x80" else 1000)


def case_bits(word: str) -> float:
    """The ways to write as many capitals; all small is free, one at the front or all cost one bit."""
    big = sum(map(str.isupper, word))
    if not big:
        return 0.0
    if big == len(word) or (big == 1 and word[0].isupper()):
        return 1.0
    return log2(sum(comb(len(word), k) for k in range(1, min(big, len(word) - big) + 1)) + 1)


def spelled(value: str) -> str:
    """Small letters, also for signs that stand for them; as long as ``value``."""
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in value).translate(LEET)


def word_spans(value: str, words: dict[str, float]) -> Iterator[tuple[int, int, float]]:
    """Known words, also with signs for letters, each of which costs one bit."""
    plain = spelled(value) if words else ""
    for i in range(len(plain)):
        for j in range(i + WORD[0], min(i + WORD[1], len(plain)) + 1):
            if not "a" <= plain[j - 1] <= "z":
                break
            if (bits := words.get(plain[i:j])) is not None:
                signs = sum(not c.isalpha() for c in value[i:j])
                yield i, j, bits + case_bits(value[i:j]) + signs


def date_spans(value: str) -> Iterator[tuple[int, int, float]]:
    for i, c in enumerate(value):
        if not "0" <= c <= "9":
            continue
        if YEAR.match(value, i):
            yield i, i + 4, YEAR_BITS
        for pattern, extra in DATES:
            m = pattern.match(value, i)
            if m:
                day, month = sorted((int(m["d"]), int(m["m"])), reverse=True)
                if 1 <= month <= 12 and 1 <= day <= 31:
                    yield i, m.end(), DAY_BITS + extra


def repeat_spans(value: str, longest_unit: int = 8) -> Iterator[tuple[int, int, float]]:
    """Longest repeats of a unit of up to ``longest_unit`` characters, of four characters at least."""
    for unit in range(1, min(longest_unit, len(value) // 2) + 1):
        start = 0
        for j in range(unit, len(value) + 1):
            if j == len(value) or value[j] != value[j - unit]:
                times = (j - start) // unit
                if times >= 2 and times * unit >= 4:
                    yield start, start + times * unit, sum(map(char_bits, value[start : start + unit])) + log2(times)
                start = j - unit + 1


def walk_spans(value: str) -> Iterator[tuple[int, int, float]]:
    """Longest walks over neighbouring keys and longest runs of the code, of three characters at least."""

    def stretches(steps: list, one_way: bool) -> Iterator[tuple[int, int, int]]:
        start, turns = 0, 0
        for k in range(len(steps) + 1):
            step = steps[k] if k < len(steps) else None
            if step is None or (one_way and k > start and step != steps[k - 1]):
                if k - start >= 2:
                    yield start, k + 1, turns
                start, turns = (k if step is not None else k + 1), 0
            elif k > start and step != steps[k - 1]:
                turns += 1

    places = [KEYS.get(c) for c in value]
    moves = [(b[0] - a[0], b[1] - a[1]) if a and b else None for a, b in zip(places, places[1:])]
    for start, end, turns in stretches([m if m in NEXT else None for m in moves], False):
        yield start, end, WALK_START + log2(end - start) + (turns + 1) * WALK_TURN
    gaps = [ord(b) - ord(a) for a, b in zip(value, value[1:])]
    alike = [g if g in (1, -1) and a.isalnum() and b.isalnum() else None for g, a, b in zip(gaps, value, value[1:])]
    for start, end, _ in stretches(alike, True):
        yield start, end, SEQUENCE_START + log2(end - start) + 1


def guess_bits(value: str, words: dict[str, float]) -> float:
    """The cost of the cheapest cut of ``value``; ``words`` has the cost of each known word."""
    ending: dict[int, list[tuple[int, float]]] = {}
    for spans in (word_spans(value, words), date_spans(value), repeat_spans(value), walk_spans(value)):
        for i, j, bits in spans:
            ending.setdefault(j, []).append((i, bits))
    best, brute = [0.0], inf  # up to each place, and with a brute-force span that ends there
    for j in range(1, len(value) + 1):
        brute = min(brute, best[j - 1] + (JOIN if j > 1 else 0.0)) + char_bits(value[j - 1])
        others = (best[i] + bits + (JOIN if i else 0.0) for i, bits in ending.get(j, ()))
        best.append(min(brute, *others) if j in ending else brute)
    return best[-1]


def word_parts(value: str) -> Iterator[str]:
    """Every run of letters of ``value`` that may be a word."""
    plain = spelled(value)
    for i in range(len(plain)):
        for j in range(i + 1, min(i + WORD[1], len(plain)) + 1):
            if not "a" <= plain[j - 1] <= "z":
                break
            if j - i >= WORD[0]:
                yield plain[i:j]


class Places:
    """Code points of places in UTF-8 bytes, asked for in rising order."""

    def __init__(self, raw: bytes, ascii_only: bool):
        self.raw, self.same, self.at, self.points = raw, ascii_only, 0, 0

    def __call__(self, place: int) -> int:
        if self.same:
            return place
        if place < self.at:
            self.at = self.points = 0
        self.points += len(self.raw[self.at : place].decode("utf-8", "replace"))
        self.at = place
        return self.points


def key_places(raw: bytes) -> list[int]:
    """Where the keys of credentials begin, in bytes."""
    low, places = raw.lower(), set()
    for name in (*KEYS_OF_VALUES, b"key"):
        at = low.find(name)
        while at >= 0:
            kind = KIND_OF_KEY.search(low, max(0, at - 12), at) if name == b"key" else None
            if kind or name != b"key":
                places.add(kind.start() if kind else at)
            at = low.find(name, at + 1)
    return sorted(places)


IS_HEX = bytes(c in HEX_DIGITS for c in range(256))


def hex_spans(raw: bytes) -> Iterator[tuple[int, int]]:
    """Longest runs of ``HEX_CHARS`` small hexadecimal digits or more."""
    marks, least = raw.translate(IS_HEX), b"\1" * HEX_CHARS
    at = marks.find(least)
    while at >= 0:
        end = marks.find(b"\0", at)
        end = len(raw) if end < 0 else end
        yield at, end
        at = marks.find(least, end)


def base_spans(raw: bytes, keys: list[int]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in bytes, by start and kind."""
    found, at = [], 0
    for key in keys:
        if key >= at and (m := ASSIGN.match(raw, key)):
            at = m.end()
            if m.end(2) - m.start(2) >= ASSIGN_CHARS:
                found.append((key, 0, at))
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(raw) if m.end() - m.start() >= ACCESS_CHARS]
    found += [(start, 2, end) for start, end in hex_spans(raw)]
    return sorted(found)


def context_values(raw: bytes, keys: list[int]) -> list[tuple[int, int, bool]]:
    """(start, end, after a sign) of each value in a credential's context, in bytes.

    What stands in a value after a sign is no key, a value after blanks may be the next one's key.
    """
    found: dict[tuple[int, int], bool] = {}
    at = 0
    for key in keys:
        if key >= at and (m := CONTEXT.match(raw, key)):
            start, signed = m.start("value"), m["sign"] is not None
            end = start + len(m["value"].rstrip(AFTER))
            at = end if signed else at
            if end > start:
                found[start, end] = found.get((start, end), False) or signed
    return sorted((start, end, signed) for (start, end), signed in found.items())


SPAN = "array<struct<start:long,kind:int,end:long>>"
SCANNED = f"base {SPAN}, held array<struct<start:long,end:long,free:boolean,value:string>>"
ARROW_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
ARROW_VALUE = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("free", pa.bool_()), ("value", pa.string())])
ARROW = pa.struct([("base", pa.list_(ARROW_SPAN)), ("held", pa.list_(ARROW_VALUE))])


def scanned(text: str | None) -> dict:
    """Base spans and context values of a text, in code points; ``free`` values overlap no base span."""
    raw = (text or "").encode("utf-8", "replace")
    keys = key_places(raw)
    base, held = base_spans(raw, keys), context_values(raw, keys)
    if not base and not held:
        return {"base": [], "held": []}
    ends = sorted({p for s, _, e in base for p in (s, e)} | {p for s, e, _ in held for p in (s, e)})
    point = dict(zip(ends, map(Places(raw, len(raw) == len(text)), ends)))
    starts, reach = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))

    def free(start: int, end: int) -> bool:
        before = bisect_left(starts, end)
        return not before or reach[before - 1] <= start

    return {
        "base": [{"start": point[s], "kind": k, "end": point[e]} for s, k, e in base],
        "held": [{"start": point[s], "end": point[e], "free": free(s, e), "value": raw[s:e].decode("utf-8", "replace")} for s, e, _ in held],
    }


def scan_column(text_col: str = "text", rows: int = 128) -> Column:
    @F.arrow_udf(SCANNED)
    def scan(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.array([scanned(t) for t in texts[s].to_pylist()], ARROW) for s in slices(text_bytes(texts), rows, SLICE_BYTES)])

    return scan(F.col(text_col))


def word_counts(docs: DataFrame, text_col: str = "text", most: int = 200_000) -> DataFrame:
    """(word, n) over all texts, outside base spans and values after a sign; a task holds up to ``most`` words and then passes them on."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def passed() -> pa.RecordBatch:
            out = pa.record_batch({"word": pa.array([w.decode() for w in seen], pa.string()), "n": pa.array(list(seen.values()), pa.int64())})
            seen.clear()
            return out

        for batch in in_slices(batches):
            for text in batch.column(0).to_pylist():
                raw, at = (text or "").encode("utf-8", "replace"), 0
                low = raw.lower()
                keys = key_places(raw)
                hidden = [(s, e) for s, _, e in base_spans(raw, keys)] + [(s, e) for s, e, signed in context_values(raw, keys) if signed]
                for s, e in sorted(hidden):
                    seen.update(LETTERS.findall(low, at, max(at, s)))
                    at = max(at, e)
                seen.update(LETTERS.findall(low, at))
            if len(seen) >= most:
                yield passed()
        yield passed()

    return docs.select(text_col).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def word_bits(counts: DataFrame) -> DataFrame:
    """(word, bits): the logarithm of how many words are as frequent or more, by quarter octaves of the count."""
    counts = counts.withColumn("octave", F.floor(4 * F.log2("n")))
    sizes = counts.groupBy("octave").agg(F.count("*").alias("here"))  # 256 rows at most
    ranks = sizes.select("octave", F.sum("here").over(Window.orderBy(F.desc("octave"))).alias("rank"))
    return counts.join(F.broadcast(ranks), "octave").select("word", F.log2("rank").alias("bits"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def parts_of(values: pd.Series) -> pd.Series:
    return values.map(lambda v: sorted(set(word_parts(v))))


@F.pandas_udf(T.DoubleType())
def bits_of(values: pd.Series, words: pd.Series) -> pd.Series:
    return values.combine(words, lambda v, known: guess_bits(v, {w["word"]: w["bits"] for w in ([] if known is None else known)}))


def value_bits(values: DataFrame, bits: DataFrame) -> DataFrame:
    """(value, cost) of each of the different ``values(value)``, by the words that they hold."""
    parts = values.select("value", F.explode(parts_of("value")).alias("word"))
    known = bits.join(parts.select("word").distinct(), "word", "left_semi")
    known = join_small(parts, known, "word", most=500_000)
    known = known.groupBy("value").agg(F.collect_list(F.struct("word", "bits")).alias("words"))
    return values.join(known, "value", "left").select("value", bits_of("value", "words").alias("cost"))


def as_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def scan(docs: DataFrame, *, least_bits: float = 40.0, least_chars: int = 8) -> DataFrame:
    """One row per document: base spans by kind, all spans, and the cost of its dearest value."""
    rows = docs.select("doc_id", scan_column().alias("s")).select("doc_id", "s.*")
    rows = saved(rows.withColumn("row", F.monotonically_increasing_id()), "secret-rows")
    held = rows.select("row", F.explode("held").alias("h")).select("row", "h.*")
    values = saved(held.select("value").distinct(), "secret-values")
    costs = value_bits(values, word_bits(saved(word_counts(docs), "secret-words")))
    held = join_small(held, costs, "value", most=500_000)
    secret = F.col("free") & (F.col("cost") >= least_bits) & (F.length("value") >= least_chars)
    span = F.struct("start", F.lit(KINDS.index("guess")).alias("kind"), "end")
    added = held.groupBy("row").agg(F.collect_set(F.when(secret, span)).alias("added"), F.max("cost").alias("max_bits"))
    out = rows.drop("held").join(added, "row", "left").withColumn("added", F.coalesce("added", F.array().cast(SPAN)))
    counts = [F.expr(f"size(filter(base, s -> s.kind = {k}))").cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]
    return out.select(
        "doc_id",
        *counts,
        F.sha2(as_text(F.col("base")), 256).alias("base_sha256"),
        as_text(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_guess"),
        F.coalesce("max_bits", F.lit(0.0)).alias("max_bits"),
    )
