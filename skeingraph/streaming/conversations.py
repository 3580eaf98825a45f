"""Streams over messages and events: pairing, session state, dirty refresh.

Every stream reads a folder of files, ends when it has read what is there
(``availableNow``) or runs on with a trigger, and has a batch form of the same result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..lineage import shared_folder
from ..operators.ingest import normal_role

PAIR_SCHEMA = "session_key string, pair long, turn long, user string, assistant string"
_PAIR_STATE = "pairs long, turn long, user string, waits boolean"


def message_stream(spark: SparkSession, folder: str, files_per_trigger: int = 4) -> DataFrame:
    schema = "conv_id long, turn long, role string, text string"
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return rows.select(F.col("conv_id").cast("string").alias("session_key"), "turn", normal_role(F.col("role")).alias("role"), F.col("text").alias("content")).where("role <> ''")


def _pair_up(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Holds a session's open question between batches."""
    n, turn, user, waits = state.get if state.exists else (0, 0, "", False)
    out = []
    for row in pd.concat(list(batches)).sort_values("turn").itertuples(index=False):
        if waits:
            n += 1
            out.append((key[0], n, turn, user, row.content if row.role == "assistant" else ""))
        waits = row.role == "user"
        turn, user = (row.turn, row.content) if waits else (0, "")
    state.update((n, turn, user, waits))
    yield pd.DataFrame(out, columns=["session_key", "pair", "turn", "user", "assistant"])


def stream_turn_pairs(messages: DataFrame) -> DataFrame:
    """Question and answer pairs of each session as they complete; messages arrive in turn order."""
    return messages.groupBy("session_key").applyInPandasWithState(_pair_up, PAIR_SCHEMA, _PAIR_STATE, "append", GroupStateTimeout.NoTimeout)


def stream_sessions(events: DataFrame, gap: str = "90 seconds", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n) of activity sessions that a gap ends; late rows wait for the watermark."""
    rows = events.withWatermark("ts", late)
    windowed = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return windowed.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def stream_distinct(messages: DataFrame, least: int = 40, most: int = 4000, late: str = "10 minutes") -> DataFrame:
    """Texts of acceptable length, each once within the watermark."""
    rows = messages.where(F.char_length("content").between(least, most))
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["content"])


def _folder(stream: DataFrame, folder: str | None) -> str:
    return folder or f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"


def drain(stream: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """What a stream yields from the input that is there, as a table.

    ``folder`` holds the stream's progress and output; given again, a run that failed goes
    on where it stopped, and one that ended takes up what came since.
    """
    spark, folder = stream.sparkSession, _folder(stream, folder)
    writer = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{folder}/state")
    writer.trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def drain_whole(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """What an aggregation yields from the input that is there, windows still open at its end included.

    Append mode would hold those back for a watermark that never comes; here each
    micro-batch writes the whole result and the last one stands.
    """
    spark, folder = stream.sparkSession, _folder(stream, folder)

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/out/{number}")
        rows.sparkSession.range(1).write.mode("overwrite").parquet(f"{folder}/last/{number}")

    writer = stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{folder}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    done = [n for n in _numbers(spark, f"{folder}/last")]
    return spark.read.schema(stream.schema).parquet(f"{folder}/out/{max(done)}") if done else spark.createDataFrame([], stream.schema)


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    """The numbered folders below ``folder``, one for each micro-batch."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [int(x.getPath().getName()) for x in files.listStatus(path)] if files.exists(path) else []


def each_batch(stream: DataFrame, refresh: Callable[[DataFrame, int], None], folder: str | None = None) -> str:
    """Calls ``refresh`` with every micro-batch, and the folder of its progress; a batch that failed comes again with its number."""
    folder = _folder(stream, folder)
    stream.writeStream.foreachBatch(refresh).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return folder


def dirty_refresh(changes: DataFrame, nodes: DataFrame, score: Callable[[DataFrame, DataFrame], DataFrame], folder: str | None = None) -> DataFrame:
    """Rows of ``score(nodes, dirty)`` for the nodes that a stream of changes (node_id) names; a node named again is scored again.

    Each micro-batch writes its own folder, so one that comes again replaces itself.
    """
    spark, folder = changes.sparkSession, _folder(changes, folder)

    def refresh(rows: DataFrame, number: int) -> None:
        score(nodes, rows.select("node_id").distinct()).withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{folder}/out/number={number}")

    each_batch(changes, refresh, folder)
    if not _numbers_of(spark, f"{folder}/out"):
        return score(nodes, spark.createDataFrame([], "node_id string"))
    held = spark.read.parquet(f"{folder}/out").drop("number")
    newest = Window.partitionBy("id").orderBy(F.col("batch").desc())
    return held.withColumn("nth", F.row_number().over(newest)).where("nth = 1").drop("nth", "batch")


def _numbers_of(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


_FLUSH = "session_key string, flush long, n long, texts array<string>"


def _flush_of(turns: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        flushed, held = (state.get[0], list(state.get[1])) if state.exists else (0, [])
        out = []
        for row in pd.concat(list(batches)).sort_values("turn").itertuples(index=False):
            held.append(row.content)
            if len(held) == turns:
                out.append((key[0], flushed, turns, held))
                flushed, held = flushed + 1, []
        state.update((flushed, held))
        yield pd.DataFrame(out, columns=["session_key", "flush", "n", "texts"])

    return run


def stream_flushes(messages: DataFrame, turns: int = 15) -> DataFrame:
    """(session_key, flush, n, texts): the texts of a session each time that so many have come; the rest waits."""
    return messages.groupBy("session_key").applyInPandasWithState(_flush_of(turns), _FLUSH, "flushed long, held array<string>", "append", GroupStateTimeout.NoTimeout)


RECALL = "session_key string, ts long, kind string, query string, ids array<string>"
_CONSUMED = "session_key string, ts long, query string, ids array<string>"


def _consume(records: int, ttl_ms: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times, queries, ids = (list(x) for x in state.get) if state.exists else ([], [], [])
        out, rows = [], pd.concat(list(batches)).sort_values(["ts", "kind"], ascending=[True, False])
        last = int(rows["ts"].max())
        for row in rows.itertuples(index=False):
            if row.kind == "recall":
                times, queries, ids = [*times, row.ts][-records:], [*queries, row.query][-records:], [*ids, list(row.ids)][-records:]
                continue
            fresh = [i for i, at in enumerate(times) if row.ts - at < ttl_ms]
            if fresh:
                out.append((key[0], row.ts, queries[fresh[-1]], list(dict.fromkeys(x for i in fresh for x in ids[i]))))
            times, queries, ids = [], [], []
        state.update((times, queries, ids))
        state.setTimeoutTimestamp(max(last + ttl_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["session_key", "ts", "query", "ids"])

    return run


def stream_recalls(events: DataFrame, records: int = 5, ttl_ms: int = 30 * 60_000) -> DataFrame:
    """What each session recalled, when it ends: the last query and all ids of its last ``records`` recalls that are not older than the time to live.

    State is kept by session and goes when the events' time has left a silent session that far behind.
    """
    timed = events.withColumn("at", F.timestamp_millis("ts")).withWatermark("at", "10 minutes")
    return timed.groupBy("session_key").applyInPandasWithState(_consume(records, ttl_ms), _CONSUMED, "times array<long>, queries array<string>, ids array<array<string>>", "append", GroupStateTimeout.EventTimeTimeout)


def learn_from(stream: DataFrame, learner, order: str = "ts", folder: str | None = None) -> None:
    """Feeds a stream of feedback (query, target, reward) to a learner on the driver, in order; an online update is sequential.

    A batch is taken whole to the driver: the trigger's size bounds it.
    """
    def refresh(rows: DataFrame, number: int) -> None:
        for r in rows.orderBy(order).collect():
            learner.learn(r["query"], r["target"], r["reward"])

    each_batch(stream, refresh, folder)
