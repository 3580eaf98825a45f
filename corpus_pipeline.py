"""The corpus pipeline: five stages over ``documents``, each on what the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of ``documents``.  Between stages the rows are written as Parquet to the
shared folder and read again, so a lost executor never costs more than one stage.  What a
stage wrote on its way goes when its result stands, and that when the next one's does.

Null, empty and wordless texts pass every stage (the toxicity score of a text without words
is the bias's) until mixing, where they weigh nothing and are taken like others of their
source at its rate; they encode to no ids.  Null ids pass too.  Rows that repeat in id and
text are copies of which one stays.  A null source is a source of its own.  Empty tables
give no rows, and without labels no text is rejected unless all would be (every score 0.5);
then the stage keeps all.  Other columns of ``documents`` are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeingraph.lineage import delete, released, shared_folder
from skeingraph.llm import bpe, mixing, near_dedup, secret_scan, toxicity
from skeingraph.llm._arrays import small_batches
from skeingraph.llm.queries import DOCUMENTS, PATTERN, RANKS, learned_labels


def _bounded(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes in a session that has no bound, as the job that owns it.

    Stages are read after their function returned, so the bound cannot end with it; at the
    default of 64 MB the batches of two tasks take several hundred MB of an executor.
    """
    for key, value in small_batches(spark).items():
        spark.conf.set(key, value)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    _bounded(spark)
    weights = toxicity.train(toxicity.bounded_sample(learned_labels(spark, sf_dir), docs))
    return toxicity.reject(docs, weights) if len(weights.index) else docs


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    _bounded(spark)
    return near_dedup.keep_one(docs, shingle=5, percent=80)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by their kind."""
    _bounded(spark)
    return secret_scan.redact_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source is sampled to its target; a document taken twice is there twice."""
    _bounded(spark)
    return mixing.emit_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    _bounded(spark)
    return bpe.encode_documents(docs, RANKS, PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("secret_scan", redact),
    ("mixing", mix),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    docs = spark.read.schema(DOCUMENTS).parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/corpus_pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        with released(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before:
            delete(spark, f"{folder}/{before}")
        docs, before = spark.read.schema(DOCUMENTS).parquet(f"{folder}/{name}"), name
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can express neither the model nor the encoding; the tests hold run() against brute force.
ORACLE_SQL = None
