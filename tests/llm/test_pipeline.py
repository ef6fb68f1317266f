import corpus_pipeline
from wavejobs.llm import exact_dedup

from .data import SF, awkward
from .test_dedup import brute_components, brute_exact
from .test_tokens import WORDS


def test_stages_against_brute_force(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, labels = docs.columns, {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.select("doc_id", "text").collect()
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == columns
        after = {r.doc_id for r in docs.collect()}
        gone = {r.doc_id for r in before} - after
        if name == "toxicity":
            assert sum(labels.get(d) == 0 for d in gone) <= 0.02 * len(before)
            assert sum(labels.get(d) == 1 for d in gone) >= 5
        if name == "language":
            assert not gone
        rows = [(r.doc_id, r.text) for r in before]
        if name == "exact":
            assert after == {d for d, _, _, kept, _ in brute_exact(rows) if kept}
        if name == "near":
            assert after == set(brute_components(rows)[1])
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    tok = Tokenizer.from_file(WORDS)
    want = sum(len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect())
    assert sum(r.length for r in packed) == want


def test_pipeline_takes_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, spark.createDataFrame([], docs.schema), SF)
        assert docs.count() == 0


def test_exact_dedup_takes_one_of_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "ab")], "doc_id long, text string")
    assert [tuple(r) for r in exact_dedup.unique(df).collect()] == [(1, "a b")]


def test_stages_take_awkward_rows_and_drop_what_they_should(spark):
    """Nulls, repeats and clashing columns; the language stage drops texts without letters, the exact one copies."""
    docs = awkward(spark)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.select("doc_id", "text").collect()
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == columns
        ids = [r.doc_id for r in docs.collect()]
        if name == "language":
            assert not {3, 4, 5, 8} & set(ids) and {1, 2, 6, 7, None} <= set(ids)
        if name == "exact":
            assert len(before) == len(ids) + 1 and sorted(ids, key=str) == sorted({r.doc_id for r in before}, key=str)
        if name == "near":
            assert 1 in ids and 2 not in ids
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0
