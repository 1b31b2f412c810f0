"""Training-data operators (deduplication, packing, mixing, rules, search, scoring).

Nothing outside this package and ``corpus_pipeline.py`` imports it.
"""
