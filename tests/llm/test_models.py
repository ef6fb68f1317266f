"""Learned operators: held-out accuracy, and defined results for awkward rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavejobs.llm import language_id, license_scan, nearest, quality, queries, toxicity, url_filter
from wavejobs.llm.common import fold

from .data import awkward, empty

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return [spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels")]


def accuracy(scored, labels, label):
    rows = scored.where("held_out").join(labels, "doc_id").select("predicted", label).collect()
    return sum(r[0] == r[1] for r in rows) / len(rows)


def test_toxicity(spark, tables):
    docs, labels = tables
    held = fold("doc_id", 4) == 2
    model = toxicity.fit(docs, labels, held)
    out = toxicity.scored(docs, model, held)
    assert out.count() == docs.count() and accuracy(out, labels, "toxic") > 0.9
    odd = toxicity.scored(awkward(spark), model, held).collect()
    assert len(odd) == 12 and all(0 <= r.score <= 1 for r in odd)
    none = toxicity.fit(docs, labels.limit(0), held)
    assert {r.score for r in toxicity.scored(awkward(spark), none, held).collect()} == {0.0}
    assert toxicity.scored(empty(spark), model, held).count() == 0


def test_quality(spark, tables):
    docs, labels = tables
    held = fold("doc_id", 3) == 1
    model = quality.fit(docs, labels, held)
    out = quality.scored(docs, model, held)
    assert out.count() == docs.count() and accuracy(out, labels, "quality") > 0.95
    odd = quality.scored(awkward(spark), model, held).collect()
    assert len(odd) == 12 and all(0 <= r.score <= 1 for r in odd)
    assert quality.scored(empty(spark), model, held).count() == 0
    few = quality.fit(docs, labels, held, most_lines=2000)
    assert accuracy(quality.scored(docs, few, held), labels, "quality") > 0.9
    blank = quality.fit(docs.withColumn("text", F.lit(" \n ")), labels, held)
    assert {r.score for r in quality.scored(awkward(spark), blank, held).collect()} == {0.5}
    none = quality.fit(docs, labels.limit(0), held)
    assert {r.score for r in quality.scored(awkward(spark), none, held).collect()} == {0.5}


def test_one_very_long_text_moves_no_other_quality(spark, tables):
    docs, labels = tables
    docs, held = docs.select("doc_id", "text"), fold("doc_id", 3) == 1
    before = {r.doc_id: r.score for r in quality.scored(docs, quality.fit(docs, labels, held), held).collect()}
    learned = labels.where("quality is not null").where(~held).orderBy(F.xxhash64("doc_id")).first().doc_id
    long = docs.withColumn("text", F.when(F.col("doc_id") == learned, F.expr("repeat('x y\n', 400001)")).otherwise(F.col("text")))
    after = {r.doc_id: r.score for r in quality.scored(long, quality.fit(long, labels, held), held).collect()}
    assert max(abs(after[d] - before[d]) for d in before if d != learned) < 0.01
    assert max(map(len, quality.pieces(list(range(1201))))) == quality.PIECE and sum(quality.pieces(list(range(1201))), []) == list(range(1201))


def by_hand(text):
    """The features of each line, one after the other."""
    lines = [x for x in text.encode().split(b"\n") if x.split()]
    out = []
    for line in lines:
        words, n = line.split(), len(line)
        letters = sum(c >= 128 or chr(c).isalpha() for c in line)
        capitals, digits = sum(65 <= c <= 90 for c in line), sum(48 <= c <= 57 for c in line)
        blanks, stops = sum(c in b"\t\x0b\x0c\r " for c in line), sum(c in b",." for c in line)
        symbols = n - letters - digits - blanks - stops
        plain = sum(c >= 128 or chr(c).isalpha() for c in (w[-1] for w in words))
        out.append([
            np.log1p(n) / 6, letters / n, capitals / max(letters, 1), digits / n, stops / n, symbols / n, min(symbols / len(words), 4) / 4,
            (len(words) - plain) / len(words), (len(words) - len(set(words))) / len(words), sum(a == b for a, b in zip(words, words[1:])) / len(words),
            min(n / len(words), 40) / 40, float(lines.count(line) > 1), float(65 <= line[0] <= 90),
        ])
    return np.array(out)


def log_likelihood(field, chains, states, ridge=1e-3):
    """What the fit maximises, by enumeration of all labellings of each chain."""
    import itertools

    total = 0.0
    for x, y in zip(chains, states):
        e = x @ field.weights
        value = lambda s: sum(v * e[i] for i, v in enumerate(s)) + sum(field.pair[a, b] for a, b in zip(s, s[1:]))  # noqa: B023, E731
        total += value(y.tolist()) - np.log(sum(np.exp(value(s)) for s in itertools.product((0, 1), repeat=len(x))))
    return total / sum(map(len, chains)) - ridge / 2 * ((field.weights**2).sum() + (field.pair**2).sum())


def test_quality_parts_equal_plain_versions():
    text = "A good line, it is.\n\n bad bad bad ### 12\nbad bad bad ### 12\nÉté 99 zz!\n   \nA good line, it is.\n"
    x, length = quality.line_features(text)
    assert np.allclose(x[[0, 3, 4]], by_hand(text)[[0, 3, 4]], atol=1e-6) and len(x) == 5 and length.tolist() == [19, 19, 18, 12, 19]
    assert np.allclose(x, by_hand(text), atol=1e-6)
    rng = np.random.default_rng(8)
    chains = [np.column_stack([rng.normal(size=(n, 2)), np.ones(n)]) for n in (1, 4, 6, 3, 5)]
    states = [(c[:, 0] + rng.normal(size=len(c)) > 0).astype(int) for c in chains]
    field = quality.LineField.fit(chains, states, steps=600)
    best = log_likelihood(field, chains, states)
    for _ in range(40):
        other = quality.LineField(field.weights + rng.normal(size=3) * 0.2, field.pair + rng.normal(size=(2, 2)) * 0.2)
        assert log_likelihood(other, chains, states) < best + 1e-5


def test_quality_score_equals_enumeration():
    import itertools

    rng = np.random.default_rng(9)
    field = quality.LineField(rng.normal(size=3 * quality.N_FEATURES + 1), rng.normal(size=(2, 2)))
    model = quality.QualityModel(field, quality.Logistic(np.array([0.1, 0.2, 1.0]), np.array([0.5, 0.6, 0.7]), np.array([-1.0, 0.4, 0.2, 0.3])))
    text = "One line.\nTwo two ##\nthree 3 3 3\nFour, four"
    x = by_hand(text)
    rows = np.concatenate([x, np.vstack([x[:1] * 0, x[:-1]]), np.vstack([x[1:], x[:1] * 0]), np.ones((len(x), 1))], axis=1)
    e = rows @ field.weights
    weight = {s: np.exp(sum(v * e[i] for i, v in enumerate(s)) + sum(field.pair[a, b] for a, b in zip(s, s[1:]))) for s in itertools.product((0, 1), repeat=len(x))}
    bad = np.array([sum(w for s, w in weight.items() if s[i]) for i in range(len(x))]) / sum(weight.values())
    sizes = np.array([len(line) for line in text.split("\n")])
    z = (np.array([bad @ sizes / sizes.sum(), bad.max(), np.log1p(len(x))]) - model.curve.mean) / model.curve.scale
    want = 1 / (1 + np.exp(-(z @ model.curve.weights[:3] + model.curve.weights[3])))
    assert abs(model.score([text])[0] - want) < 1e-6


def test_marginals_equal_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(2)
    field = quality.LineField(np.zeros(1), rng.normal(size=(2, 2)))
    e = rng.normal(size=6)
    weight = {s: np.exp(sum(e[i] * v for i, v in enumerate(s)) + sum(field.pair[a, b] for a, b in zip(s, s[1:]))) for s in itertools.product((0, 1), repeat=6)}
    want = [sum(w for s, w in weight.items() if s[i]) / sum(weight.values()) for i in range(6)]
    assert np.allclose(field.marginals(e), want)


def test_language(spark, tables):
    docs, _ = tables
    held = fold("doc_id", 4) == 2
    model = language_id.fit(docs, held)
    rows = language_id.identified(docs, model, held).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    odd = {r.doc_id: r for r in language_id.identified(awkward(spark), model, held).collect()}
    assert odd[3].lang_pred == odd[4].lang_pred == odd[8].lang_pred == "und" and odd[1].lang_pred != "und"
    assert language_id.identified(empty(spark), model, held).count() == 0 and language_id.fit(empty(spark), held).languages == []
    none = language_id.fit(docs.withColumn("lang", F.lit(None).cast("string")), held)
    assert {r.lang_pred for r in language_id.identified(awkward(spark), none, held).collect()} == {"und"}


def test_licenses(spark):
    rows = [(1, "Under the MIT License, or the mit license."), (2, None), (3, "GNU General Public; license"), (4, "cc-by cc by"), (4, "cc-by cc by"), (5, "Licensed under CC BY-NC 4.0.")]
    got = sorted(map(tuple, license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).drop("score").collect()))
    assert got == [
        (1, 8, 2, 2, 6, "mit", "mit"),
        (2, 0, 0, None, None, "", ""),
        (3, 4, 1, 0, 0, "gpl", "gpl"),
        (4, 4, 2, 0, 2, "cc-by", "cc-by"),
        (4, 4, 2, 0, 2, "cc-by", "cc-by"),
        (5, 7, 1, 2, 2, "cc-by", "cc-by,cc-by-nc-4.0"),
    ]
    assert license_scan.scan(awkward(spark)).count() == 12 and license_scan.scan(empty(spark)).count() == 0


def test_license_notice_with_a_missing_word(spark):
    text = next(n for n in license_scan.NOTICES if n.startswith("permission is hereby")).replace(" any person ", " ")
    out = license_scan.scan(spark.createDataFrame([(1, "x " * 50 + text)], "doc_id long, text string")).first()
    assert out.labels == "mit" and 0.8 <= out.score < 1 and out.base_labels == ""


def mutated_notices(n=150, seed=3):
    """Notices with words left out, put in, swapped and cut apart, among other words."""
    rng = np.random.default_rng(seed)
    notices = list(license_scan.NOTICES)
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.integers(1, 4)):
            w = notices[rng.integers(len(notices))].split()
            for _ in range(rng.integers(0, 6)):
                k = int(rng.integers(len(w)))
                change = rng.integers(5)
                if change == 0:
                    del w[k]
                elif change == 1:
                    w.insert(k, "other")
                elif change == 2 and k:
                    w[k - 1], w[k] = w[k], w[k - 1]
                elif change == 3:
                    w[k:k] = ["far"] * int(rng.integers(1, 30))
                else:
                    w = w[k:] + w[:k]
                w = w or ["none"]
            words += ["x"] * int(rng.integers(0, 5)) + w
        rows.append((i, " ".join(words)))
    return rows


def test_licenses_equal_sql_from_the_definition(spark):
    import duckdb
    import pandas as pd

    rows = [*mutated_notices(), (1000, None), (1001, ""), (1002, "all rights reserved " * 300), (1003, "license apache license apache license mit license")]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    want = con.execute(license_scan.oracle()).fetchall()
    near = lambda t: (*t[:-1], round(t[-1], 9))
    assert sorted(map(near, map(tuple, got))) == sorted(map(near, want))
    assert 30 < sum(r.labels != "" for r in got) < 150


def test_license_spans_keep_order_and_extent(spark):
    bsd = next(n for n in license_scan.NOTICES if n.startswith("redistribution")).split()
    half = len(bsd) // 2
    pairs = [f"{a} {b}" for a, b in zip(bsd, bsd[1:])]
    rng = np.random.default_rng(1)
    texts = [
        " ".join(reversed(pairs)),
        " ".join(rng.permutation(pairs)),
        " ".join(bsd[:half]) + " x" * 1000 + " " + " ".join(bsd[half:]),
        " ".join(bsd),
        " ".join(bsd) + " y" * 500 + " " + " ".join(bsd),
        " ".join(bsd[:9]) + " one or two " + " ".join(bsd[9:]),
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r for r in license_scan.scan(df).collect()}
    assert [out[i].labels for i in range(6)] == ["", "", "", "bsd", "bsd", "bsd"] and out[3].score == 1 and 0.8 <= out[5].score < 1
    places = license_scan.spans(df).where("id = 4").orderBy("start").collect()
    assert [(p.start, p.matched) for p in places] == [(0, 1.0), (len(bsd) + 500, 1.0)]


def test_urls(spark):
    rows = [(1, "http://a.ORG/x"), (2, "https://example.org/es/1"), (3, "nothing"), (4, None), (5, "http://sub.com/de/?q#f"), (6, "http://orgs/x"), (6, "http://orgs/x")]
    got = sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect())
    assert [g[:4] for g in got] == [(1, "a.org", "/x", "org/"), (2, "example.org", "/es/1", "example.org/es/"), (3, "", "", ""), (4, "", "", ""), (5, "sub.com", "/de/", "com/de/"), (6, "orgs", "/x", ""), (6, "orgs", "/x", "")]
    assert [g[4] for g in got[:2]] == ["allow", "block"] and got[4][4] == "block" and got[5] == got[6]
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
    assert {r.verdict for r in url_filter.judge(spark.createDataFrame([(1, "x://q.net/")], "page_id long, url string")).collect()} == {"allow"}


def test_urls_with_awkward_rows(spark):
    rows = [(1, "http://a.org/" + "x" * 100_000), (2, "http://é.net/ö?q=%20#ü"), (3, ""), (4, "://"), (5, None), (5, None), (None, "http://b.com/de/"), (6, "HTTP://EXAMPLE.org/en/12?x")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    for name in ("host", "path", "rule", "plain", "grams", "ratios", "gram", "verdict", "score"):
        df = df.withColumn(name, F.lit("x"))
    got = {r.page_id: r for r in url_filter.judge(df).collect()}
    assert url_filter.judge(df).count() == 8 and got[6].rule == "example.org/en/1" and got[6].verdict == "block"
    assert (got[2].host, got[2].path) == ("é.net", "/ö") and (got[4].host, got[4].path) == ("", "") and got[1].verdict == "allow"


def brute_url_scores(rows):
    """Scores by Witten-Bell over dictionaries: contexts of two, one and no characters."""
    import math
    import re
    from collections import Counter, defaultdict

    text = lambda u: "~~" + re.sub(r"[^a-z0-9./_:?=&-]", "~", re.sub("[A-Z]", lambda m: m[0].lower(), u or "")) + "~"
    n, after = defaultdict(Counter), {v: defaultdict(Counter) for v in ("allow", "block")}
    for u, v in rows:
        t = text(u)
        for i in range(2, len(t)):
            if v:
                after[v][t[i - 2 : i]][t[i]] += 1
    for v, seen in after.items():
        for ctx, c in list(seen.items()):
            for ch, k in c.items():
                n[v, ctx[1]][ch] += k
                n[v, ""][ch] += k

    def p(v, ctx, ch):
        p0 = (n[v, ""][ch] + 1) / (sum(n[v, ""].values()) + 45)
        c1, c2 = n[v, ctx[1]], after[v][ctx]
        p1 = (c1[ch] + len(c1) * p0) / (sum(c1.values()) + len(c1)) if c1 else p0
        return (c2[ch] + len(c2) * p1) / (sum(c2.values()) + len(c2)) if c2 else p1

    score = lambda t: sum(math.log(p("allow", t[i - 2 : i], t[i]) / p("block", t[i - 2 : i], t[i])) for i in range(2, len(t))) / (len(t) - 2)
    return {u: score(text(u)) for u, _ in rows}


def test_url_scores_equal_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url")
    out = url_filter.judge(pages).join(pages, "page_id").collect()
    want = brute_url_scores([(r.url, url_filter.RULES.get(r.rule)) for r in out])
    assert len(out) > 20 and all(abs(r.score - want[r.url]) < 1e-9 for r in out)


def test_license_templates_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(license_scan, "NOTICES", {" ".join(["word"] * 66): "long"})
    with pytest.raises(ValueError):
        license_scan.scan(awkward(spark))


def test_nearest_recall(spark):
    import numpy as np

    rows = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas().sort_values("vec_id")
    ids, v = rows["vec_id"].to_numpy(), np.stack(rows["embedding"]).astype(float)
    got = {}
    for r in queries.op1_nearest(spark, SF).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = (v * v[q]).sum(axis=1)
        s[q] = -np.inf
        best = np.lexsort((ids, -s))[:20]
        mine = sorted(got[ids[q]])
        assert [k for k, _, _ in mine] == list(range(1, 21))
        hits += len(set(ids[best]) & {i for _, i, _ in mine})
    assert hits / (20 * len(got)) > 0.9


def test_nearest_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 2.0, 3.0]), (8, [None, 1.0]), (20, [1.0, 0.0]), (20, [1.0, 0.0]), (40, []), (60, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in nearest.search(df, F.col("id") % 20 == 0).collect())
    assert [g[1:] for g in got if g[0] == 0] == [(1, 2, 2.0), (2, 1, 1.0), (3, 20, 1.0), (4, 60, -1.0)]
    assert [g[2] for g in got if g[0] == 20] == [2, 0, 1, 60] and {g[0] for g in got} == {0, 20, 60}
    assert nearest.search(df.limit(0), F.col("id") % 20 == 0).count() == 0
    clashing = df.selectExpr("*", "'x' as id", "'x' as v", "'x' as block", "'x' as query", "'x' as size", "'x' as top", "'x' as norm")
    assert nearest.search(clashing, F.col("id") % 20 == 0).count() == len(got)


def test_nearest_very_large_and_very_small_vectors(spark):
    rows = [(0, [1e-200, 0.0]), (1, [1e200, 1.0]), (2, [-1e200, 5.0]), (3, [0.0, 1e-300]), (20, [1.7e308, 1.7e308]), (4, [1.7e308, -1.7e308])]
    got = {}
    for r in nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert [i for _, i, _ in sorted(got[0])] == [4, 20, 1, 3, 2] and len(got[20]) == 5 and got[20][0][1] in (1, 3, 0, 2)
    assert sorted(got[20])[-1][1] == 4


def test_counted_bits_equal_sums():
    import numpy as np

    rng = np.random.default_rng(1)
    for m in (1, 2, 3, 7, 64, 65):
        bits = rng.integers(0, 2, (m, 128)).astype(np.uint8)
        sets = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
        for need in (1, 2, m // 2 + 1, m, m + 1):
            got = np.unpackbits(nearest.at_least(nearest.counted(sets), need).view(np.uint8), bitorder="little")
            assert (got.astype(bool) == (bits.sum(axis=0) >= need)).all()


def brute_kneser_ney(docs, known):
    """Differences of log-likelihoods of every seen sequence, by dictionaries and one formula for each order."""
    import math
    from collections import Counter, defaultdict

    import numpy as np
    import regex

    def sequences(text):
        for word in set(regex.findall(r"\p{L}+", (text or "").lower())):
            padded = [0] * 4 + [toxicity.symbols()[ord(c)] for c in word] + [0]
            yield from (tuple(int(x) for x in padded[i : i + 5]) for i in range(len(padded) - 4))

    everywhere, own = set(), {0: Counter(), 1: Counter()}
    for d, text in docs:
        found = list(sequences(text))
        everywhere.update(found)
        if d in known:
            own[known[d]].update(found)

    def cuts(counts):
        n = [max(1, sum(v == k for v in counts.values())) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        return [0] + [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.1), k - 0.1) for k in (1, 2, 3)]

    def model(counts, below):
        d, total, freed = cuts(counts), Counter(), defaultdict(float)
        for g, v in counts.items():
            total[g[:-1]] += v
            freed[g[:-1]] += d[min(v, 3)]
        return lambda g: (counts[g] - d[min(counts[g], 3)] + freed[g[:-1]] * below(g[1:])) / total[g[:-1]] if total[g[:-1]] else below(g[1:])

    p, level, levels = (lambda g: 1 / 32), everywhere, []
    for _ in range(4):
        counts = Counter(g[1:] for g in level)
        levels.append(counts)
        level = set(counts)
    for counts in reversed(levels):
        p = model(counts, p)
    ordinary, toxic = model(own[0], p), model(own[1], p)
    return {int(np.dot(g, 32 ** np.arange(4, -1, -1))): math.log(toxic(g)) - math.log(ordinary(g)) for g in {*own[0], *own[1]}}


def test_toxicity_models_equal_brute_force(spark):
    """Counts of all labelled rows and shared counts of all rows, whatever the sample of the curve holds."""
    plain = [(i, f"calm words here {i % 3 * 'very '}plain day day Élan", 0) for i in range(40)]
    toxic = [(100 + i, "calm zorg plim day", 1) for i in range(2)] + [(200 + i, f"calm awful {'x' * (i + 1)} day", 1) for i in range(20)]
    other = [(300, "zorgon прямо", None), (301, None, None), (302, "12 !", None)]
    docs = spark.createDataFrame(plain + toxic + other, "doc_id long, text string, toxic int").repartition(5)
    model = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), F.lit(False), per_class=4)
    want = brute_kneser_ney([r[:2] for r in plain + toxic + other], {d: c for d, _, c in plain + toxic})
    got = dict(zip(model.evidence.grams.tolist(), model.evidence.ratios.tolist()))
    assert got.keys() == want.keys() and all(abs(got[g] - want[g]) < 1e-4 for g in want)
    table = toxicity.gram_counts(docs, docs.select("doc_id", F.col("toxic").alias("label")).where("label is not null"))
    rows = {r.gram: r for r in table.collect()}
    zor = [toxicity.symbols()[ord(c)] for c in "zor"]
    start = int(sum(int(x) * 32 ** (2 - i) for i, x in enumerate(zor)))
    assert rows[start].n == 3 and rows[start].c10 + rows[start].c11 == 2 and rows[start].c00 + rows[start].c01 == 0


def test_toxicity_measures_equal_a_loop(spark):
    import math

    import numpy as np
    import regex

    rng = np.random.default_rng(3)
    grams = np.arange(32**5, dtype=np.int32)[rng.random(32**5) < 0.3]
    model = toxicity.Evidence(grams, rng.normal(size=len(grams)).astype(np.float32))
    table = dict(zip(grams.tolist(), model.ratios.tolist()))
    texts = ["One word, two words; ÜBER été", "", "12 !!", "a", "x" * 3000, "日本 語 mixed", "again again"]
    for text, got in zip(texts, model.measure(texts)):
        said = []
        for word in regex.findall(r"\p{L}+", text.lower()):
            s = [0] * 4 + [int(toxicity.symbols()[ord(c)]) for c in word] + [0]
            said.append(sum(table.get(sum(x * 32 ** (4 - k) for k, x in enumerate(s[i : i + 5])), 0.0) for i in range(len(s) - 4)))
        n = max(1, len(said))
        assert abs(got[0] - sum(sorted(said)[-3:]) / 3) < 1e-6
        assert abs(got[1] - math.log1p(20 * sum(max(x - 2, 0) for x in said) / n**0.5)) < 1e-6


def test_capped_samples_keep_the_rate_of_classes(spark):
    """A curve fitted on as many rows of each class still scores at the rate of all labelled rows."""
    import numpy as np

    from wavejobs.llm.common import labelled_sample
    from wavejobs.llm.logistic import Logistic

    docs = spark.range(1000).selectExpr("id as doc_id", "'' as text", "cast(id % 10 = 0 as int) as toxic")
    labels = docs.select("doc_id", "toxic").union(spark.range(5000, 5400).selectExpr("id", "1"))
    got = labelled_sample(labels, docs, "toxic", F.lit(False), 50).toPandas()
    assert got.groupby("label")["weight"].agg(["count", "sum"]).values.tolist() == [[50, 900], [50, 100]]
    curve = Logistic.fit(np.zeros((100, 1)), got["label"].to_numpy(), got["weight"].to_numpy())
    assert abs(curve.probability(np.zeros((1, 1)))[0] - 0.1) < 1e-6


def test_sample_has_one_row_of_an_id(spark):
    from wavejobs.llm.common import labelled_sample

    docs = spark.range(500).selectExpr("if(id < 300, 7, id) as doc_id", "concat('text ', id) as text")
    labels = spark.range(500).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    got = labelled_sample(labels, docs, "toxic", F.lit(False), 1000).toPandas()
    assert got["doc_id"].is_unique and set(got["doc_id"]) == {7, *range(300, 500)}
    again = labelled_sample(labels, docs.repartition(7, "text"), "toxic", F.lit(False), 1000).toPandas()
    assert dict(zip(got["doc_id"], got["text"])) == dict(zip(again["doc_id"], again["text"]))


def test_language_learns_every_language(spark):
    rows = spark.range(1100).selectExpr("id as doc_id", "concat('text ', id % 550) as text", "concat('l', id % 550) as lang")
    hot = spark.range(200).selectExpr("9999 as doc_id", "'many copies' as text", "'l0' as lang")
    model = language_id.fit(rows.union(hot), F.lit(False), max_sample=40, cell_bits=8)
    assert len(model.languages) == 550


def test_language_equals_plain_kernel_ridge(spark):
    """All rows are landmarks here, so the model is kernel ridge regression on sets of n-grams."""
    rng = np.random.default_rng(2)
    alphabets = {"x": "abcde fgh", "y": "fghij abk", "z": "klmno éß"}
    rows = [(i, lang, "".join(rng.choice(list(letters), 40 + i))) for i, lang in enumerate("xxxxxxyyyyz" * 3) for letters in [alphabets[lang]]]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3)
    asked = [*(t for _, _, t in rows), "abc", "klé fgh", "Q"]

    def grams(text):
        plain = " " + " ".join(text.lower().split()) + " "
        return {plain[i : i + n] for n in range(1, 4) for i in range(len(plain) - n + 1)}

    sets, queries_ = [grams(t) for _, _, t in rows], [grams(t) for t in asked]
    kernel = lambda a, b: len(a & b) / np.sqrt(len(a) * len(b))
    values, vectors = np.linalg.eigh(np.array([[kernel(a, b) for b in sets] for a in sets]))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    features = np.array([[kernel(a, b) for b in sets] for a in sets]) @ root
    names = ["x", "y", "z"]
    target = np.array([[lang == name for name in names] for _, lang, _ in rows], float)
    weight = np.array([len(rows) / 3 / sum(other == lang for _, other, _ in rows) for _, lang, _ in rows])
    z, aim = features - features.mean(axis=0), target - target.mean(axis=0)
    gram = (z.T * weight) @ z
    w = np.linalg.solve(gram + 0.01 * np.trace(gram) / len(gram) * np.eye(len(gram)), (z.T * weight) @ aim)
    want = (np.array([[kernel(a, b) for b in sets] for a in queries_]) @ root - features.mean(axis=0)) @ w + target.mean(axis=0)
    for options in ({"max_landmarks": 1000}, {"landmarks": 1000}):
        model = language_id.fit(docs, F.lit(False), max_n=3, cell_bits=20, **options)
        got = model.predict(asked)
        assert model.languages == names and list(got["lang"]) == [names[k] for k in want.argmax(axis=1)]
        assert np.allclose(got["score"], np.clip(want.max(axis=1), 0, 1), atol=1e-4)


def test_language_with_fewer_landmarks_than_languages(spark):
    rows = spark.range(240).selectExpr("id as doc_id", "concat(chr(cast(97 + id % 60 % 26 as int)), 'a', chr(cast(97 + id % 60 % 23 as int)), ' of l', id % 60, ' ', id) as text", "concat('l', id % 60) as lang")
    model = language_id.fit(rows, F.lit(False), landmarks=4, max_landmarks=20, cell_bits=12)
    assert len(model.languages) == 60 and [f.shape for f in model.factors] == [(4096, 20), (20, 60)]
    found = language_id.identified(rows, model, F.lit(False)).join(rows.select("doc_id", "lang"), "doc_id").collect()
    # A map of rank 20 cannot tell 60 languages apart as well as one of full rank; chance would find 4.
    assert len(found) == 240 and sum(r.lang == r.lang_pred for r in found) > 40
    folded = language_id.LanguageModel(model.languages, [model.factors[0] @ model.factors[1]], model.bias, model.max_n, model.cell_bits)
    texts = [r.text for r in rows.orderBy("doc_id").limit(50).collect()]
    assert np.allclose(folded.predict(texts)["score"], model.predict(texts)["score"], atol=1e-5)
    full = language_id.fit(rows, F.lit(False), cell_bits=12)
    exact = language_id.identified(rows, full, F.lit(False)).join(rows.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in exact) > 200
    with pytest.raises(ValueError):
        language_id.fit(rows, F.lit(False), most_languages=59)


def test_language_sample_makes_each_text_s_bits_once(spark, monkeypatch):
    """One Python step in a task: a second one beside it would keep twice as many Python workers in an executor."""
    plans, write = {}, language_id.saved

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(language_id, "saved", seen)
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(["one text", "another", "123", "a"])], "doc_id long, text string, lang string")
    sample, languages = language_id.sampled(docs, fold("doc_id", 1) == 2, 100, 10, 3, 10)
    # AQE shows the plan twice, as it is and as it was at first.
    assert plans["language-bits"].split("== Initial Plan ==")[0].count("EvalPython") == 1
    assert languages == ["en"] and sample.count() == 3 and sample.where("bits is null").count() == 0
