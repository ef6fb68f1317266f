"""Corpus pipeline: toxicity, language, exact and near duplicates, packing.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and
returns a DataFrame that is written as Parquet and read again as the next one's docs.
All but the last return the columns of ``documents``.

Clashing extra columns pass through; null and empty texts are neither toxic nor near to
anything but each other, and go as ``und`` at the language stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wavejobs.llm import exact_dedup, language_id, packing, simhash, toxicity
from wavejobs.llm.common import bounded_batches, fold, saved, table

TOXIC_FROM = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below ``TOXIC_FROM`` stay; learned from labels outside fold 2 of 4."""
    bounded_batches(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold("doc_id", 4) == 2)
    return docs.where(model.column() < TOXIC_FROM)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a learned language is found stay; ``und`` goes."""
    bounded_batches(spark)
    model = language_id.fit(docs, fold("doc_id", 4) == 2)
    return docs.where(model.column()["lang"] != language_id.UNDEFINED)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.unique(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return simhash.one_of_each(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("exact", drop_exact_copies),
    ("near", drop_near_copies),
    ("packing", pack_sequences),
]

#: Learned scores and packing are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
