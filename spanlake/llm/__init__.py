"""Training-data operators: deduplication, filtering, scoring, packing and token output.

Each ``opN`` module holds one operator with its general interface; ``queries``
holds the registered queries and their SQL twins.  Nothing outside this
subpackage imports it except the guarded import in ``__spark_entry__.py`` and
``corpus_pipeline.py``.
"""
