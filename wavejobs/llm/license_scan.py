"""License scan by diagonal voting (operator 3).

Method: all rolling word pairs (k-grams with k = 2) of every text are joined by hash with
the pairs of a small table of templates. A hit at word p of a text and word t of a
template votes for the diagonal p - t. The base phrases are places where one diagonal has
all votes. For the longer notices neighbouring diagonals (inserted or missing words) are
merged, and where those together have enough votes, spans are verified: from a hit on, hits
are followed whose words stand later both in the text and in the template, each at most
``shift`` diagonals from the one before, over no more words than the template has and a
slack of a quarter and ``shift``. A span holds if it follows the share of the template's
pairs that is asked for; so neither words in another order nor halves far apart make one.
Each hit is checked on the words themselves.

Everything is built of DataFrame functions; the templates are a fixed table of less than
a thousand rows, so their broadcast has a proven bound. Only hits are shuffled, and their
votes are written, so that texts are read once for them and once to count words.

Cases: a null text counts as empty; no words give zeros, nulls and empty labels; rows that
share id and text are scanned alike; a text may hold any number of places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved

# The phrases whose places are counted, and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Openings of well-known public notices, and the labels they add.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache",
    "licensed under the apache license version 2 0": "apache-2.0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "licensed under the gnu general public license version 3": "gpl-3.0",
    "licensed under the gnu general public license version 2": "gpl-2.0",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "subject to the terms of the mozilla public license": "mpl",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "licensed under a creative commons attribution": "cc-by",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "licensed under cc by 4 0": "cc-by-4.0",
    "released under the mit license": "mit",
    "all rights reserved": "all-rights-reserved",
}

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text, with capitals as they are."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def template_pairs(spark: SparkSession) -> DataFrame:
    """(hash, template, label, base, t, n_pairs, first, second): one row for each pair of words."""
    rows = []
    for base, table in ((True, BASE_PHRASES), (False, NOTICES)):
        for phrase, label in table.items():
            w = phrase.split()
            if len(w) > 65:
                raise ValueError(f"a template may have at most 64 pairs of words: {phrase}")
            rows += [(phrase, label, base, t, len(w) - 1, w[t], w[t + 1]) for t in range(len(w) - 1)]
    df = spark.createDataFrame(rows, "template string, label string, base boolean, t int, n_pairs int, first string, second string")
    return df.withColumn("hash", F.xxhash64("first", "second"))


def hits(docs: DataFrame) -> DataFrame:
    """(id, text_hash, template, label, base, n_pairs, t, p): verified hits of word pairs."""
    w = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("w"))
    pairs = w.select("id", "text_hash", F.posexplode(F.arrays_zip(F.col("w").alias("a"), F.expr("slice(w, 2, size(w))").alias("b"))).alias("p", "x"))
    pairs = pairs.select("id", "text_hash", "p", F.col("x.a").alias("a"), F.col("x.b").alias("b"))
    pairs = pairs.withColumn("hash", F.xxhash64(F.lower("a"), F.lower("b")))
    found = pairs.join(F.broadcast(template_pairs(docs.sparkSession)), "hash")
    same = (F.translate("a", UPPER, LOWER) == F.col("first")) & (F.translate("b", UPPER, LOWER) == F.col("second"))
    return found.where(same).select("id", "text_hash", "template", "label", "base", "n_pairs", "t", F.col("p").cast("long").alias("p"))


def spans(docs: DataFrame, *, shift: int = 3, least: float = 0.8, short: int = 8) -> DataFrame:
    """(id, text_hash, template, label, base, start, matched): verified places.

    ``matched`` is the share of the template's pairs that the span follows in order. Base
    phrases are whole diagonals; notices may spread over neighbouring diagonals and need a
    share of ``least``; those of up to ``short`` pairs, where one word makes another licence,
    need all. Spans of one template that begin within one another are one place, the best.
    """
    key = ["id", "text_hash", "template", "label", "base", "n_pairs"]
    # Votes are counted first, so a diagonal is one row however long it is; rows that repeat vote once.
    votes = (
        hits(docs)
        .withColumn("diagonal", F.col("p") - F.col("t"))
        .groupBy(*key, "diagonal")
        .agg(F.bit_or(F.expr("shiftleft(1L, t)")).alias("seen"))
    )
    votes = saved(votes, "license-votes")
    whole = votes.where(F.col("base") & (F.bit_count("seen") == F.col("n_pairs")))
    whole = whole.select(*key[:5], F.col("diagonal").alias("start"), F.lit(1.0).alias("matched"))
    need = F.when(F.col("n_pairs") <= short, 1.0).otherwise(least) * F.col("n_pairs")
    by = Window.partitionBy(*key).orderBy("diagonal")
    far = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by) > shift, F.lit(True))
    group = F.sum(far.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0))
    merged = votes.where(~F.col("base")).withColumn("g", group)
    merged = merged.withColumn("all", F.bit_count(F.bit_or("seen").over(Window.partitionBy(*key, "g")))).where(F.col("all") >= need)
    at = merged.withColumn("t", F.explode(F.expr("filter(sequence(0, n_pairs - 1), i -> getbit(seen, i) = 1)"))).withColumn("p", F.col("diagonal") + F.col("t"))
    reach = F.col("n_pairs") + F.floor(F.col("n_pairs") / 4) + shift
    longest = 64 + 16 + shift
    hit = F.struct("p", F.col("t").cast("long").alias("t"), F.lit(1).cast("long").alias("n"))
    ahead = F.array_sort(F.collect_list(hit).over(Window.partitionBy(*key, "g").orderBy("p").rangeBetween(0, longest)))
    at = at.withColumns({"own": hit, "reach": reach, "ahead": ahead})
    followed = F.expr(
        f"""aggregate(filter(ahead, x -> x.p <= own.p + reach), own, (s, x) ->
        if(x.p > s.p and x.t > s.t and abs((x.p - x.t) - (s.p - s.t)) <= {shift}, struct(x.p as p, x.t as t, s.n + 1 as n), s)).n"""
    )
    # A span that begins too late in the template cannot follow enough of it.
    at = at.where(F.col("n_pairs") - F.col("t") >= need).withColumn("n", followed).where(F.col("n") >= need)
    place = Window.partitionBy(*key, "g").orderBy("p", "t")
    new = F.coalesce(F.col("p") - F.lag("p").over(place) > F.col("reach"), F.lit(True))
    at = at.withColumn("place", F.sum(new.cast("int")).over(place.rowsBetween(Window.unboundedPreceding, 0)))
    places = at.groupBy(*key, "g", "place").agg(F.min("diagonal").alias("start"), (F.max("n") / F.first("n_pairs")).alias("matched"))
    return whole.unionByName(places.select(*key[:5], "start", "matched"))


def scan(docs: DataFrame, **options) -> DataFrame:
    """One row per document: words, places of base phrases, labels and the best match."""
    found = spans(docs, **options).groupBy("id", "text_hash").agg(
        F.count_if("base").alias("n_base"),
        F.min(F.when(F.col("base"), F.col("start"))).alias("first_word"),
        F.max(F.when(F.col("base"), F.col("start"))).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
        F.max("matched").alias("score"),
    )
    rows = docs.select("doc_id", F.xxhash64("text").alias("hash"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    on = rows["doc_id"].eqNullSafe(found["id"]) & (rows["hash"] == found["text_hash"])
    return rows.join(found, on, "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def oracle(shift: int = 3, least: float = 0.8, short: int = 8) -> str:
    """The same rows in DuckDB: places by comparing words at every position."""
    phrases = ", ".join(f"('{p}', '{label}', {base})" for base, table in (("true", BASE_PHRASES), ("false", NOTICES)) for p, label in table.items())
    return f"""
    with d as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w from documents),
    t as (select phrase, label, base, string_split(phrase, ' ') as tw from (values {phrases}) v(phrase, label, base)),
    tp as (select phrase, label, base, len(tw) - 1 as n, i as t, tw[i + 1] as a, tw[i + 2] as b from t, unnest(range(len(tw) - 1)) u(i)),
    p as (select doc_id, i as p, w[i + 1] as a, w[i + 2] as b from d, unnest(range(len(w) - 1)) u(i)),
    h as (select doc_id, phrase, label, base, n, p, t from p join tp using (a, b)),
    b as (select doc_id, label, base, p - t as start, 1.0::double as matched from h where base group by doc_id, phrase, label, base, n, p - t having count(distinct t) = n),
    k as (select *, case when n <= {short} then n else {least} * n end as need, n + n // 4 + {shift} as reach from h where not base),
    o as (select x.*, (select list({{'p': y.p, 't': y.t, 'n': 1::bigint}} order by y.p, y.t) from k y where y.doc_id = x.doc_id and y.phrase = x.phrase and y.p between x.p and x.p + x.reach) as ahead from k x where n - t >= need),
    q as (select *, list_reduce(ahead, lambda s, y: case when y.p > s.p and y.t > s.t and abs((y.p - y.t) - (s.p - s.t)) <= {shift} then {{'p': y.p, 't': y.t, 'n': s.n + 1}} else s end, {{'p': p, 't': t, 'n': 1::bigint}}).n as got from o),
    s as (select * from b union all select doc_id, label, base, p - t, got::double / n from q where got >= need),
    f as (select doc_id, count(*) filter (base) as n_base, min(start) filter (base) as first_word, max(start) filter (base) as last_word,
        coalesce(array_to_string(list_sort(list_distinct(list(label) filter (base))), ','), '') as base_labels,
        array_to_string(list_sort(list_distinct(list(label))), ',') as labels, max(matched) as score from s group by doc_id)
    select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
        coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0)::double as score
    from d left join f using (doc_id)"""
