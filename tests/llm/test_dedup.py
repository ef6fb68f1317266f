import hashlib
import re
from collections import defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from wavejobs.llm import exact_dedup, simhash
from wavejobs.llm.common import join_groups
from wavejobs.llm.components import components
from wavejobs.sources.shared import saved

from .data import SF, awkward, empty, lower_ascii


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower_ascii(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """{row index: smallest id reachable} by comparing every pair."""
    prints = [brute_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[find(i)].append(d)
    return prints, [min((d for d in ids[find(i)] if d is not None), default=None) for i in range(len(rows))]


def check_simhash(df, **options):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    prints, ids = brute_components(rows)
    out = simhash.near_duplicates(df, **options).select("doc_id", simhash.as_hex("fp").alias("h"), "representative.id").collect()
    key = lambda t: (t[0] is None, t)
    assert sorted(map(tuple, out), key=key) == sorted([(d, f"{p:016x}", c) for (d, _), p, c in zip(rows, prints, ids)], key=key)


def test_simhash_equals_brute_force(spark):
    check_simhash(spark.read.parquet(f"{SF}/documents.parquet"))
    check_simhash(awkward(spark))
    check_simhash(empty(spark))


def test_simhash_splits_long_lists(spark):
    base = " ".join(f"w{i}" for i in range(200))
    rows = [(i, base + f" tail{i} more{i % 7}") for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check_simhash(df, list_rows=16)
    assert simhash.one_of_each(df, list_rows=16).count() == len(set(brute_components(rows)[1]))


def test_index_finds_all_pairs_of_four_bits(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = []
    for b in base:
        for n in (3, 4, 5):
            flips = rng.choice(64, n, replace=False)
            near.append(int(b) ^ sum(1 << int(f) for f in flips))
    values = np.unique(np.array([*map(int, base), *near], np.uint64))
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    found = components(simhash.links(df, list_rows=8)).collect()
    got = {r.node: r.root for r in found}
    root = {int(v): int(v) for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (int(a) ^ int(b)).bit_count() <= 4:
                root[find(int(a))] = find(int(b))
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    groups, mine = defaultdict(set), defaultdict(set)
    for v in values:
        groups[find(int(v))].add(signed(int(v)))
        mine[got.get(signed(int(v)), signed(int(v)))].add(signed(int(v)))
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 30)] + [(5, 5), (None, 3), (29, 100)]
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node for r in got} == set(range(8, 30)) | set(range(100, 141)) and {r.root for r in got} == {7}


def test_groups_beyond_the_hot_ones_are_not_broadcast(spark):
    """Groups counted over exploded postings seem small from the files below them, but are many times as large."""
    prints = saved(spark.range(2000).select(F.xxhash64("id").alias("fp")), "test-prints")
    postings = prints.select("fp", F.explode(F.transform(F.sequence(F.lit(0), F.lit(34)), lambda k: F.pmod(F.col("fp"), 5 + k))).alias("key"))
    sizes = postings.groupBy("key").agg(F.count("*").alias("n"))
    met = join_groups(postings, sizes, ["key"], "n", 70_000)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and plan.count("SortMergeJoin") == 1
    assert met.count() == 70_000


def brute_exact(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = defaultdict(list)
    for d, t in rows:
        groups[norm(t)].append((-len(t or ""), d is None, d))
    best = {k: min(v, key=lambda x: (x[0], x[1], x[2] or 0)) for k, v in groups.items()}
    out, stays = [], set()
    for d, t in rows:
        k, b = norm(t), best[norm(t)]
        # One row of each group stays, whichever of rows with one id and length it is.
        kept = b[2] == d and b[0] == -len(t or "") and k not in stays
        stays.update([k] * kept)
        out.append((d, b[2], len(groups[k]), kept, hashlib.sha256(k.encode()).hexdigest()))
    return out


def check_exact(df):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    key = lambda t: (t[0] is None, t[0] or 0, t[4], t[3])
    want = sorted(brute_exact(rows), key=key)
    assert sorted(map(tuple, exact_dedup.report(df, bucket_keys=16).collect()), key=key) == want
    kept = {(d, s) for d, _, _, k, s in want if k}
    out = exact_dedup.unique(df, bucket_keys=16)
    assert out.columns == df.columns and out.count() == len(kept)


def test_exact_equals_brute_force(spark):
    check_exact(spark.read.parquet(f"{SF}/documents.parquet"))
    check_exact(awkward(spark))
    check_exact(empty(spark))
    check_exact(spark.createDataFrame([(1, "a b"), (1, "ab "), (1, "a b"), (2, "ab"), (None, "q "), (None, "q ")], "doc_id long, text string"))


def test_a_third_of_all_rows_under_one_id_and_text(spark):
    rows = spark.range(0, 3000, 1, 6).selectExpr(
        "case when id % 3 = 0 then 7 when id % 3 = 1 then id else null end as doc_id",
        "case when id % 3 = 0 then 'the  same text' when id % 3 = 1 then 'text ' || id % 50 else 'no id' end as text", "id as other", "'x' as sha_key", "'y' as nth",
    )
    out = exact_dedup.unique(rows, hot_rows=100).collect()
    assert sorted(map(str, (r.text for r in out))) == sorted({"the  same text", "no id", *(f"text {k}" for k in range(50))})
    whole = {(r.doc_id, r.text, r.other, r.sha_key, r.nth) for r in rows.collect()}
    assert exact_dedup.unique(rows).columns == rows.columns and all(tuple(r) in whole for r in out)
    assert {r.doc_id for r in out if r.text.startswith("text")} == {min(i for i in range(1, 3000, 3) if i % 50 == k) for k in range(50)}
    few = exact_dedup.unique(rows.where("other < 300")).collect()
    assert len(few) == 52


def test_bytes_decide_under_one_digest(spark):
    """With a digest of four values most groups hold several texts, which must stay apart."""
    weak = lambda normal: F.encode((F.crc32(normal) % 4).cast("string"), "utf-8")
    rows = [(i, w * (1 + i % 2)) for i, w in enumerate(["ab", "cd", "ef", "a b", "gh", "ij", "ab", "c d ", "kl", "mn", "ab"] * 4)]
    df = spark.createDataFrame([*rows, (None, "ab"), (3, None), (4, " "), (7, "cdcd"), (7, "cdcd")], "doc_id long, text string").withColumn("nth", F.lit("x"))
    for docs in (df, awkward(spark), spark.read.parquet(f"{SF}/documents.parquet"), empty(spark)):
        want = brute_exact([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
        got = exact_dedup.report(docs, digest=weak, bucket_keys=16).collect()
        key = lambda t: (t[0] is None, t[0] or 0, t[1] is None, t[1] or 0, *t[2:4])
        assert sorted((tuple(r)[:4] for r in got), key=key) == sorted((w[:4] for w in want), key=key)
        out = exact_dedup.unique(docs, digest=weak, bucket_keys=16)
        plain = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
        kept = sorted((str(r.doc_id), hashlib.sha256(plain(r.text).encode()).hexdigest()) for r in out.collect())
        assert out.columns == docs.columns and kept == sorted((str(w[0]), w[4]) for w in want if w[3])


def test_screen_of_texts_loses_none(spark):
    texts = spark.range(20_000).select(F.col("id"), F.xxhash64("id").alias("key"))
    groups = texts.where("id % 10 = 0").select("key")
    for bits, most in ((26, 2100), (14, 6000), (6, 20_000)):
        got = {r.id for r in exact_dedup.screened_texts(texts, groups, bits).collect()}
        assert got >= set(range(0, 20_000, 10)) and len(got) <= most
    assert exact_dedup.screened_texts(texts, groups.limit(0)).count() == 0


def test_fuse_filter_has_no_false_negatives():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 10, 1000, 70_000):
        keys = rng.integers(0, 2**64, n, dtype=np.uint64, endpoint=False)
        f = exact_dedup.BinaryFuseFilter.build(keys)
        assert f.may_hold(keys).all()
        others = rng.integers(0, 2**64, 20_000, dtype=np.uint64, endpoint=False)
        assert f.may_hold(others).mean() < 0.02
    assert len(f.cells) < 1.3 * n
