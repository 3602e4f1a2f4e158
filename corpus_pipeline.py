"""Corpus pipeline: language ID, SimHash near-dedup, substring dedup, benchmark decontamination,
SentencePiece encoding.

Every stage takes the documents its predecessor kept, is written as Parquet to the shared
checkpoint folder and read again as the next stage's input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratus.llm import decontaminate, langid, sentencepiece_codec, simhash, substring_dedup
from stratus.llm.common import shared_table

#: a document stays if its language holds this share of its letters at least
MIN_LANGUAGE_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, and those that no language holds ``MIN_LANGUAGE_SCORE`` of, go.

    A null ``lang`` becomes the language found; the other columns stay as they are.
    """
    model = langid.train(docs.where(~langid.held_out()))
    found = langid.predict(docs, model).where(f"lang_pred <> '{langid.UNDETERMINED}' and score >= {MIN_LANGUAGE_SCORE}")
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest doc_id."""
    return simhash.drop_near_copies(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that occur earlier in the corpus are cut out; documents that lose all their text go."""
    return substring_dedup.drop_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with ``piece_ids``, ``n_pieces`` and ``round_trip``."""
    return sentencepiece_codec.encode_texts(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", drop_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("sentencepiece_encoding", encode),
]

#: trained language ID, SimHash and piece encoding have no SQL form: run() is tested against brute force
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = shared_table(stage(spark, docs, sf_dir), name)
    return docs
