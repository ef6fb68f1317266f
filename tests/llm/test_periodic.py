import random
import re
import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavejobs.llm import periodic
from wavejobs.llm.common import slices

from .data import SF, awkward, empty


def brute_runs(w):
    """Every maximal stretch of each period by comparing words, kept where no smaller period holds."""
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            part = w[s : i + q]
            if len(part) >= max(12, 2 * q) and not any(part[:-p] == part[p:] for p in range(1, q)):
                out.append((s, len(part), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute(doc_id, text, rewrite=True):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if rewrite and doc_id is not None and w:
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha256(listed.encode()).hexdigest(), sha256(kept.encode()).hexdigest())


def check(df):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    key = lambda t: (t[0] is None, *map(str, t))
    got = periodic.scan(df, F.crc32(F.col("doc_id").cast("string"))).collect()
    assert sorted(map(tuple, got), key=key) == sorted((brute(*r) for r in rows), key=key)


def test_scan_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check(docs.where(F.length("text") < 6000))
    check(awkward(spark).where("doc_id is null or doc_id <> 7"))
    check(empty(spark))
    rewritten = [(i, " ".join(f"w{k % 90}" for k in range(i % 300))) for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0]
    check(spark.createDataFrame(rewritten, "doc_id long, text string"))


def test_a_long_text_of_one_word(spark):
    r = periodic.scan(awkward(spark).where("doc_id = 7")).first()
    assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (1, 0, 30_000, 1, 30_000_000)
    assert r.collapsed_sha256 == sha256(b"word").hexdigest()


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("words", [[0] * 11, [0] * 12, fibonacci(300), [0, 1] * 30 + [1, 0] * 30, ([0] * 40 + [1]) * 3 + [0] * 40 + [2] + [0] * 43 + [1], [0, 0, 1] * 20 + [0, 1, 0] * 20])
def test_runs_within_runs(words):
    assert periodic.runs_of(np.array(words, np.int64)) == brute_runs(words)


def test_random_words_with_planted_repeats():
    rng = random.Random(11)
    for _ in range(600):
        letters, n = rng.choice([1, 2, 2, 3, 5]), rng.randrange(140)
        w = [rng.randrange(letters) for _ in range(n)]
        for _ in range(rng.randrange(4)):
            if n > 4:
                s, p = rng.randrange(n), rng.randrange(1, max(2, n // 3))
                for i in range(s + p, min(n, s + p * rng.randrange(2, 6))):
                    w[i] = w[i - p]
        assert periodic.runs_of(np.array(w, np.int64)) == brute_runs(w)


def test_documents_of_a_slice_stay_apart():
    texts = ["a b c d e f " * 3, "a b c d e f " * 3, None, "", "x"]
    alone = [periodic.measured([t], [None])[0] for t in texts]
    assert periodic.measured(texts, [None] * 5) == alone and [r[0] for r in alone] == [1, 1, 0, 0, 0]
    cut = lambda sizes: [(s.start, s.stop) for s in slices(sizes, 2, 10)]
    assert cut([5, 5, 90, 1, 1]) == [(0, 2), (2, 3), (3, 5)] and cut([]) == [(0, 0)] and cut([99]) == [(0, 1)] and cut([1, 1, 1]) == [(0, 2), (2, 3)]
