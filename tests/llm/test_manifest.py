import hashlib
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from wavejobs.llm import merkle

from .data import SF, awkward, empty, lower_ascii


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def mark(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    """(top, for each node the siblings left and right of it on every level)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        for path, k in zip(paths, at):
            run = runs[k // 16]
            path.append(("".join(run[: k % 16]), "".join(run[k % 16 + 1 :])))
        nodes, at = [H(*r) for r in runs], [k // 16 for k in at]
    return nodes[0], paths


def brute(rows):
    groups = defaultdict(list)
    for d, text, lang, source, n in rows:
        leaf = lambda t: H(*map(mark, (d, source, lang, n, t)))  # noqa: B023, E731
        tampered = d is not None and zlib.crc32(str(d).encode()) % 5 == 0
        groups[source].append((d is not None, d or 0, leaf(text), d, leaf(lower_ascii(text)) if tampered and text is not None else leaf(text)))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([g[2] for g in sorted(groups[s])]) for s in order}
    root, upper = tree([trees[s][0] for s in order]) if order else (None, [])
    out = []
    for s, above in zip(order, upper):
        subroot, paths = trees[s]
        for (_, _, leaf, d, other), path in zip(sorted(groups[s]), paths):
            path = [*path, *above]
            fold = other
            for left, right in path:
                fold = H(left, fold, right)
            out.append((d, leaf, subroot, root, H(*(x for p in path for x in p)), fold, fold == root))
    return out


def check(df, **options):
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    key = lambda t: (t[0] is None, *map(str, t))
    out = merkle.manifest(df, **options)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, out.collect()), key=key) == sorted(brute(rows), key=key)


def test_manifest_equals_brute_force(spark):
    check(spark.read.parquet(f"{SF}/documents.parquet"))
    check(awkward(spark))
    check(empty(spark))


@pytest.mark.parametrize("levels", [1, 2])
def test_one_source_with_most_rows_and_many_of_one_row(spark, levels):
    rows = spark.range(0, 700, 1, 5).select(
        F.when(F.col("id") % 50 == 0, None).otherwise(F.expr("id div 2")).alias("doc_id"), F.concat(F.lit("Some Text "), F.col("id") % 7).alias("text"), F.lit("en").alias("lang"),
        F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 30 == 0, None).otherwise(F.concat(F.lit("s"), "id")).alias("source"), F.lit(3).alias("n_chars"),
    )
    check(rows, levels=levels)


def test_manifest_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = sorted(con.execute(merkle.oracle()).fetchall())
    assert want == sorted(brute([(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]))
