"""Training-data operators (deduplication, filters, tokenising, packing, search).

Nothing outside this package, ``corpus_pipeline.py`` and the guarded import in
``__spark_entry__.py`` depends on it.
"""
