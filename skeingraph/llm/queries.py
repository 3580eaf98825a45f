"""Queries over the synthetic tables, one per operator, and their SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut
from . import bpe, fingerprints, language_id, mixing, near_dedup, secret_scan, suffix_dedup, token_counts, topk_search, toxicity

#: The rank file of the queries that encode; a parameter of the operators.
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(DOCUMENTS).parquet(f"{sf_dir}/documents.parquet")


def _fold(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang").withColumn("held_out", F.coalesce(_fold(4) == 2, F.lit(False)))
    profiles = language_id.learn_profiles(docs.where(~F.col("held_out")), order=F.xxhash64("doc_id", "text"))
    return language_id.identify(docs.select("doc_id", "held_out", "text"), profiles)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_documents(spark, sf_dir)).drop("copies")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_documents(spark, sf_dir), RANKS, PATTERN, keep_ids=False)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(_documents(spark, sf_dir))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(_documents(spark, sf_dir))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_documents(spark, sf_dir), shingle=3, percent=85)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_documents(spark, sf_dir))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = token_counts.context_limits(token_counts.length_histogram(_documents(spark, sf_dir), RANKS, PATTERN))
    return token_counts.every_limit(cut(sums))


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def learned_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels outside the held-out fold."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where(_fold(5) != 0)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", F.coalesce(_fold(5) == 0, F.lit(False)).alias("held_out"), "text")
    return toxicity.score(docs, toxicity.train(toxicity.bounded_sample(learned_labels(spark, sf_dir), docs)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_mix_sources": op2_mix_sources,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_fingerprints": op4_fingerprints,
    "op5_secret_scan": op5_secret_scan,
    "op6_near_dedup": op6_near_dedup,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_token_counts": op8_token_counts,
    "op9_topk_search": op9_topk_search,
    "op10_toxicity": op10_toxicity,
}

ORACLE_SQL: dict[str, str] = {
    "op2_mix_sources": """
        WITH sized AS (
          SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS draw FROM documents
        ), classed AS (SELECT *, floor(log2(size + 1) * 8)::INT AS size_class FROM sized
        ), sources AS (
          SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM sized GROUP BY source
        ), weighed AS (
          SELECT source, source_size, [5, 2, 1][((nth - 1) % 3 + 1)::INT]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS ceiling FROM sources
        ), levels AS (
          SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(ceiling) OVER (ORDER BY ceiling / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY ceiling / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed
        ), last_level AS (SELECT max(level) FILTER (ceiling / weight > level) AS last FROM levels
        ), targets AS (
          SELECT source, source_size, CASE WHEN last IS NULL THEN ceiling ELSE least(ceiling, last * weight) END AS target FROM levels, last_level
        ), counted AS (SELECT *, greatest(1, ceil(count(*) OVER (PARTITION BY source, size_class) / 4096.0))::BIGINT AS cells FROM classed
        ), placed AS (
          SELECT *, row_number() OVER (PARTITION BY source ORDER BY size_class, ('0x' || substr(draw, 9, 8))::BIGINT % cells, size, draw, doc_id) AS place FROM counted
        ), rated AS (
          SELECT p.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
            ('0x' || substr(md5('mix:' || coalesce(p.source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS shift
          FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source
        )
        SELECT doc_id, size, source_size, target, (least(floor(place * rate + shift) - floor((place - 1) * rate + shift), 2)::BIGINT * size)::BIGINT AS taken FROM rated
    """,
    "op9_topk_search": """
        WITH rows AS (
          SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)::BIGINT) AS v FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
          SELECT q.n, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: coalesce(z[1] * z[2], 0)))::BIGINT AS score
          FROM rows q JOIN rows c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0
        ), ranked AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
    """,
}
