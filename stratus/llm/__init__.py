"""Operators of a training-data pipeline, their queries and their DuckDB SQL.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
