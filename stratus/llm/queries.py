"""The operators bound to the supplied tables, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratus.llm import (
    decontaminate,
    html_extract,
    langid,
    lz_fingerprint,
    maxent_lm,
    minhash_join,
    sentencepiece_codec,
    simhash,
    source_audit,
    substring_dedup,
    token_alignment,
    token_counts,
    warc,
)
from stratus.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


@query
def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = maxent_lm.score_texts(docs, docs.where(~maxent_lm.held_out()))
    return scored.select("doc_id", maxent_lm.held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.repeated_spans(table(spark, sf_dir, "documents"))
    return found.selectExpr("doc_id", "unit", "start", "end AS stop", "n_words", "kept_doc_id", "kept_unit", "kept_start", "passage", "passage_words")


ORACLE["op3_substring_dedup"] = r"""
WITH cut AS (
  SELECT doc_id, string_split(regexp_replace(text, '([.!?…؟।][ \t]+|\n[ \t\r\f\v]*|[。！？]+[ \t]*)', '\1' || chr(31), 'g'), chr(31)) AS pieces
  FROM documents WHERE text IS NOT NULL
), pieced AS (
  SELECT doc_id, unnest(pieces) AS piece, unnest(range(len(pieces))) AS place FROM cut
), placed AS (
  SELECT doc_id, place, piece,
         coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
         trim(regexp_replace(lower(piece), '[ \t\r\f\v\n]+', ' ', 'g')) AS norm
  FROM pieced
), counted AS (
  SELECT *, length(norm) - length(regexp_replace(norm, '[\x{0e00}-\x{0eff}\x{1000}-\x{109f}\x{1780}-\x{17ff}\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]', '', 'g')) AS alone,
         trim(regexp_replace(norm, '[ \x{0e00}-\x{0eff}\x{1000}-\x{109f}\x{1780}-\x{17ff}\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]+', ' ', 'g')) AS spaced
  FROM placed WHERE norm <> ''
), units AS (
  SELECT doc_id, norm, start, start + length(regexp_replace(piece, '[ \t\r\f\v\n]+$', '')) AS stop,
         row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS unit,
         (alone + 1) // 2 + CASE WHEN spaced = '' THEN 0 ELSE length(spaced) - length(replace(spaced, ' ', '')) + 1 END AS n_words
  FROM counted
), ranked AS (
  SELECT *, first_value(doc_id) OVER w AS kept_doc_id, first_value(unit) OVER w AS kept_unit, first_value(start) OVER w AS kept_start
  FROM units WINDOW w AS (PARTITION BY norm ORDER BY doc_id, unit)
), later AS (
  SELECT *, kept_unit - unit AS shift, unit - row_number() OVER (PARTITION BY doc_id, kept_doc_id, kept_unit - unit ORDER BY unit) AS run FROM ranked WHERE doc_id <> kept_doc_id OR unit <> kept_unit
), passages AS (
  SELECT *, min(unit) OVER w AS passage, sum(n_words) OVER w AS passage_words FROM later WINDOW w AS (PARTITION BY doc_id, kept_doc_id, shift, run)
)
SELECT doc_id, CAST(unit AS INTEGER) AS unit, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop, CAST(n_words AS INTEGER) AS n_words,
       kept_doc_id, CAST(kept_unit AS INTEGER) AS kept_unit, CAST(kept_start AS INTEGER) AS kept_start, CAST(passage AS INTEGER) AS passage, CAST(passage_words AS BIGINT) AS passage_words
FROM passages WHERE passage_words >= 20
"""


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.held_out())
    model = langid.train(docs.where("not held_out"))
    return langid.predict(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score")


@query
def op5_lz_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprint.compare_neighbours(table(spark, sf_dir, "documents"))


@query
def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op7_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_warc(warc.plan_records(table(spark, sf_dir, "pages")), path)
    read = warc.read_warc(spark, path).where("kind = 'record'")
    return read.select(
        warc.page_number(read.record_id).alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_number(read.refers_to).alias("refers_to")
    )


ORACLE["op7_warc_salvage"] = r"""
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
), kept AS (
  SELECT *, max(page_id) OVER (PARTITION BY html) AS response FROM payloads
)
SELECT page_id, strlen(html) AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> response THEN response END AS refers_to
FROM kept
"""


@query
def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_codec.encode_texts(docs).select("doc_id", "n_pieces", "piece_ids", "round_trip")


@query
def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


@query
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align_tokens(table(spark, sf_dir, "documents"))


@query
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit_sources(table(spark, sf_dir, "documents"))


ORACLE["op12_source_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), words AS (
  SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), counts AS (
  SELECT lang, source, term, count(*)::HUGEINT AS n, count(DISTINCT id) AS n_docs FROM words GROUP BY ALL
), kept AS (
  SELECT lang, term, sum(n)::HUGEINT AS n FROM counts GROUP BY ALL HAVING sum(n_docs) >= 10
), langs AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY ALL
), groups AS (
  SELECT DISTINCT lang, source FROM d
), cells AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, k.n AS lang_n, l.v, l.total
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), shares AS (
  SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v)::HUGEINT AS p,
         1 + (1000000000::HUGEINT * (lang_n + 2)) // (total + 2 * v) AS q
  FROM cells
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), parts AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(p.value, 0) AS value
  FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN pairs p ON p.lang = g.lang AND p.source = g.source AND p.item = h.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


@query
def op13_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_join.minhash_components(table(spark, sf_dir, "documents"))
