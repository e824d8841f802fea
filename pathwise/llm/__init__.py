"""Training-data pipeline operators (numbered 1-13) and their queries.

Nothing outside this folder, ``corpus_pipeline.py`` and the guarded import in
``__spark_entry__.py`` depends on it.
"""
