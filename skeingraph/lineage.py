"""Lineage cuts for long plans: tables written to a folder that all executors share.

A cut is a Parquet table below ``spark.checkpoint.dir``.  It survives lost executors, is
read column by column, and goes when it is dropped; shuffle files of the plan that wrote it
go as soon as it stands.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Shuffle files of a finished query are removed at once rather than when the driver next collects garbage.
_CLEAN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
_scopes: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, which ``spark.checkpoint.dir`` names.

    A local session without one (tests on one machine) gets a folder of its own; on a
    cluster that would not be shared, so there it is an error.
    """
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp())
        held = context._jsc.sc().getCheckpointDir()
    return held.get()


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Settings for the queries that run inside; what the session had comes back."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again, without its lineage."""
    folder, out = keep(df)
    if _scopes:
        _scopes[-1].append(folder)
    out._cut_folder = folder
    return out


def keep(df: DataFrame) -> tuple[str, DataFrame]:
    """A written copy that no scope drops, and its folder."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    with settings(spark, _CLEAN):
        df.write.parquet(folder)
    return folder, spark.read.schema(df.schema).parquet(folder)


def partitioned(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` checkpointed by hash of ``columns``: joins and sums by them read it without a shuffle, however often."""
    shared_folder(df.sparkSession)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *columns).checkpoint()


def drop(*tables: DataFrame | None) -> None:
    """Removes cuts that nothing reads any more; other frames are left alone."""
    for table in tables:
        folder = getattr(table, "__dict__", {}).get("_cut_folder")
        if folder:
            delete(table.sparkSession, folder)


def replace(old: DataFrame | None, df: DataFrame) -> DataFrame:
    """``df`` cut, and after that ``old``, from which it may come, dropped."""
    new = cut(df)
    drop(old)
    return new


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Drops every cut made inside; what comes of them must have been written by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for folder in _scopes.pop():
            delete(spark, folder)
