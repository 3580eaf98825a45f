"""The pipeline on a small table: toxic rows go, one of each group stays, secrets are hidden, ids decode."""

import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skeingraph.lineage import shared_folder
from skeingraph.llm import bpe
from skeingraph.llm.queries import DOCUMENTS, PATTERN, RANKS


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    random.seed(8)
    pool = [a + b for a in "ka lo mi ne su".split() for b in "ran del mus tig pol".split()]
    texts = [" ".join(random.choices(pool, k=60)) + (" worthless pathetic idiot" if i % 5 == 0 else "") for i in range(300)]
    texts[201] = texts[202] = texts[203]
    texts[207] += " token=abcdefghijklmnop1234"
    path = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)], DOCUMENTS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, docs, folder).collect()
        docs = spark.createDataFrame(rows, DOCUMENTS)
        kept.append({r["doc_id"]: r["text"] for r in rows})
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    toxic, near, secret, mixed = kept
    assert set(toxic) == {i for i in range(300) if i % 5}
    assert {201, 202, 203} & set(near) == {201} and len(near) == len(toxic) - 2
    assert secret[207].endswith(" [assign]") and {k: v for k, v in secret.items() if k != 207} == {k: v for k, v in near.items() if k != 207}
    assert set(mixed) <= set(secret)


def test_run(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    ranks = bpe.Codec(bpe.read_ranks(RANKS), PATTERN)
    assert rows and all(len(r["ids"]) == r["n_tokens"] and ranks.decode(r["ids"]) for r in rows) and not any(r["doc_id"] % 5 == 0 for r in rows)


def _tables(spark, path, docs, labels):
    spark.createDataFrame(docs, DOCUMENTS).withColumns({"key": F.lit("clash"), "n": F.lit(1)}).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def test_empty_tables(spark, tmp_path):
    _tables(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_odd_rows(spark, tmp_path):
    """Null ids, texts, languages and sources, empty and very long texts, repeated rows, other columns; no labels at all."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(60000))
    docs = [(None, "alpha beta gamma delta epsilon zeta", None, None, None), (1, None, "en", None, 0), (2, "", "en", "s", 0), (3, long, "en", "s", len(long)), (3, long, "en", "s", len(long)), (4, long, "en", None, len(long)), (5, " \n ", None, "s", 3)]
    _tables(spark, tmp_path, docs, [])
    near = corpus_pipeline.drop_near_duplicates(spark, corpus_pipeline.drop_toxic(spark, spark.read.schema(DOCUMENTS).parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)), str(tmp_path))
    assert sorted(str(r["doc_id"]) for r in near.collect()) == ["1", "2", "3", "5", "None"]
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ranks = bpe.Codec(bpe.read_ranks(RANKS), PATTERN)
    known = {(i, t or "") for i, t, *_ in docs}
    assert rows and all((r["doc_id"], ranks.decode(r["ids"]).decode()) in known for r in rows)
    assert corpus_pipeline.ORACLE_SQL is None


def test_what_a_stage_wrote_goes(spark, folder):
    """After a run only the last stage's input is left below the shared folder."""
    base = shared_folder(spark)
    before = {d for d in os.listdir(base.removeprefix("file:"))}
    corpus_pipeline.run(spark, folder).collect()
    new = set(os.listdir(base.removeprefix("file:"))) - before
    assert len(new) == 1 and os.listdir(f"{base.removeprefix('file:')}/{new.pop()}") == ["mixing"]
