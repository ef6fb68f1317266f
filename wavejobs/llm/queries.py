"""The registered queries of the operators, and SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, language_id, license_scan, merkle, nearest, packing, periodic, quality, secret_scan, simhash, toxicity, url_filter
from .common import bounded_batches, fold, table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of whole texts, in a session whose Arrow batches are bounded in bytes."""
    bounded_batches(spark)
    return table(spark, sf_dir, "documents")


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels, held_out = documents(spark, sf_dir), table(spark, sf_dir, "labels"), fold("doc_id", 4) == 2
    return toxicity.scored(docs, toxicity.fit(docs, labels, held_out), held_out)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).drop("score")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", simhash.as_hex("fp").alias("fingerprint"), F.col("representative.id").alias("component_id"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels, held_out = documents(spark, sf_dir), table(spark, sf_dir, "labels"), fold("doc_id", 3) == 1
    return quality.scored(docs, quality.fit(docs, labels, held_out), held_out)


def op9_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.report(documents(spark, sf_dir))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = documents(spark, sf_dir), fold("doc_id", 4) == 2
    return language_id.identified(docs, language_id.fit(docs, held_out), held_out)


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(documents(spark, sf_dir))


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.scan(documents(spark, sf_dir), F.crc32(F.col("doc_id").cast("string")))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_nearest, op2_toxicity, op3_licenses, op4_urls, op5_bpe, op6_simhash, op7_packing, op8_quality, op9_exact, op10_language,
        op11_manifest, op12_periodic, op13_secrets,
    )
}

_NORMAL = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')"

ORACLES: dict[str, str] = {
    "op11_manifest": merkle.oracle(),
    "op3_licenses": license_scan.oracle(),
    "op4_urls": url_filter.oracle(),
    "op9_exact": f"""
    with d as (select doc_id, length(coalesce(text, '')) as n, {_NORMAL} as t from documents),
    r as (select *, first(doc_id) over w as keep_id, row_number() over w as nth, count(*) over (partition by t) as group_size from d
        window w as (partition by t order by n desc, doc_id nulls last rows between unbounded preceding and unbounded following))
    select doc_id, keep_id, group_size::bigint as group_size, nth = 1 as kept, sha256(t) as text_sha256 from r""",
}
