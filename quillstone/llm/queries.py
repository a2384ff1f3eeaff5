"""Registered queries of the training-data operators, and SQL with the same rows where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import conversations, decontaminate, exact_dedup, langid, merkle, ngram_join, page_text, personal_data, quality, sentencepieces, toxicity, url_filters, warc
from quillstone.llm.common import dataset_remainder, table
from quillstone.llm.oracles import ASCII_LOWER, CONVERSATIONS, MERKLE


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def _marked(scored: DataFrame, modulus: int, remainder: int, threshold: float) -> DataFrame:
    held = (dataset_remainder("doc_id", modulus) == remainder).alias("held_out")
    return scored.select("doc_id", held, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return _marked(scored, 5, 0, quality.THRESHOLD)


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = langid.identify(table(spark, sf_dir, "documents"))
    return seen.select("doc_id", (dataset_remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "ambiguous")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.summary(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.verdicts(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return _marked(scored, 4, 2, toxicity.THRESHOLD)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(table(spark, sf_dir, "documents"))


def op12_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract(table(spark, sf_dir, "pages"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repairs(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_quality, op3_ngram_jaccard, op4_warc, op5_language, op6_personal_data, op7_exact_dedup, op8_url_filters, op9_toxicity, op10_decontamination, op11_merkle, op12_html, op13_conversations)}

ORACLE_SQL = {
    "op4_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
             d AS (SELECT page_id, octet_length(encode(h)) AS n, sha256(h) AS dg FROM p),
             f AS (SELECT dg, min(page_id) AS first_id FROM d WHERE n >= 100 GROUP BY dg)
        SELECT d.page_id, CAST(d.n AS BIGINT) AS payload_bytes, d.dg AS payload_digest,
               CASE WHEN f.first_id IS NOT NULL AND d.page_id > f.first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN f.first_id IS NOT NULL AND d.page_id > f.first_id THEN f.first_id END AS refers_to
        FROM d LEFT JOIN f ON d.dg = f.dg AND d.n >= 100""",
    "op7_exact_dedup": f"""
        WITH t AS (SELECT doc_id, {ASCII_LOWER} AS x FROM documents),
             g AS (SELECT x, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY x)
        SELECT t.doc_id, g.keep_id, g.group_size, g.keep_id = t.doc_id AS kept, sha256(t.x) AS text_sha256
        FROM t JOIN g ON t.x = g.x""",
    "op11_merkle": MERKLE,
    "op13_conversations": CONVERSATIONS,
}
