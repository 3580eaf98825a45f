"""File sources: message queues, evaluation sets and what models return."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SESSION_QA = "question string, answer string, category string, timestamp string, session struct<messages:array<struct<role:string,content:string>>>"
LONG_DIALOGUE = "sample_id string, qa array<struct<question:string,answer:string,category:string,evidence:array<string>>>"
TRAJECTORY = "id string, states array<struct<content:string>>"
QUEUE = "session_key string, turn long, role string, content string, created_at string"


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON lines file; lines that don't parse go."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def queue_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """A folder of JSON lines files as a stream."""
    return spark.readStream.schema(QUEUE).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def session_cases(rows: DataFrame) -> DataFrame:
    """(id, category, query, expected_answer, conversation) of question rows with a session."""
    return rows.where("question is not null").select(F.md5(F.col("question").cast("binary")).alias("id"), F.coalesce("category", F.lit("unknown")).alias("category"), F.col("question").alias("query"), F.col("answer").alias("expected_answer"), F.col("session.messages").alias("conversation"))


def dialogue_cases(rows: DataFrame) -> DataFrame:
    """One case per question of a long dialogue; its evidence ids are the expected ones."""
    each = rows.select("sample_id", F.posexplode("qa").alias("pos", "q"))
    return each.select(F.concat_ws("-", "sample_id", "pos").alias("id"), "q.category", F.col("q.question").alias("query"), F.col("q.answer").alias("expected_answer"), F.col("q.evidence").alias("expected_ids"))


DIALOGUE_TURNS = "sample_id string, sessions array<struct<nth:int,turns:array<struct<speaker:string,dia_id:string,text:string>>>>, qa array<struct<question:string,answer:string,category:string,evidence:array<string>>>"


def dialogue_graph(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and expected ids of long dialogues.

    A session is an EVENT node with its turns as content; neighbouring sessions have a
    NEXT_SESSION edge; the evidence of a question (turn ids) names the nodes of its sessions.
    """
    each = rows.select("sample_id", F.explode("sessions").alias("s")).select("sample_id", "s.nth", "s.turns")
    node = F.concat_ws("-", F.lit("bench"), "sample_id", F.concat(F.lit("session"), "nth"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat_ws(": ", t["speaker"], t["text"])), "\n")
    nodes = each.select("sample_id", "nth", node.alias("id"), F.lit("EVENT").alias("type"), F.concat(F.lit("session"), "nth").alias("name"), lines.alias("content"), "turns")
    after = F.lead("id").over(Window.partitionBy("sample_id").orderBy("nth"))
    edges = nodes.withColumn("to_id", after).where("to_id is not null").select(F.col("id").alias("from_id"), "to_id", F.lit("NEXT_SESSION").alias("type"))
    asked = rows.select("sample_id", F.posexplode("qa").alias("pos", "q")).select("sample_id", "pos", F.explode("q.evidence").alias("dia_id"))
    spoken = nodes.select("sample_id", "id", F.explode("turns.dia_id").alias("dia_id"))
    expected = asked.join(spoken, ["sample_id", "dia_id"]).select(F.concat_ws("-", "sample_id", "pos").alias("case_id"), "id").distinct()
    return nodes.drop("turns", "sample_id", "nth"), edges, expected


def trajectory_cases(questions: DataFrame, haystack: DataFrame, trajectories: DataFrame, per_state: int = 2000, per_trajectory: int = 8000, most: int = 20) -> DataFrame:
    """(question_id, texts): the trajectories of each question, cut per state and as a whole.

    ``haystack`` (question_id, trajectory_id, pos) names them; at most ``most`` in order
    count, and a question without one goes.
    """
    body = F.array_join(F.transform(F.filter("states", lambda s: s["content"].isNotNull()), lambda s: F.substring(s["content"], 1, per_state)), "\n")
    texts = trajectories.select(F.col("id").alias("trajectory_id"), F.substring(body, 1, per_trajectory).alias("text")).where("text <> ''")
    held = haystack.join(texts, "trajectory_id").groupBy("question_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("pos", "text"))), 1, most).alias("kept"))
    return questions.join(held, "question_id").withColumn("texts", F.transform("kept", lambda x: x["text"])).drop("kept")


def parse_extraction(reply: str | None, most_nodes: int = 5, most_edges: int = 8) -> dict[str, list]:
    """Nodes and edges of a model's reply: fenced, bare, or the first balanced object that has ``nodes``.

    Types count in any case; nodes without a name or of another type go; what is over the
    caps goes; a reply without such an object gives nothing.
    """
    plain = re.sub(r"```[a-z]*", "", reply or "").strip()
    decoder, found = json.JSONDecoder(), None
    for at in (m.start() for m in re.finditer(r"\{", plain)):
        try:
            value, _ = decoder.raw_decode(plain, at)
        except ValueError:
            continue
        if isinstance(value, dict) and isinstance(value.get("nodes"), list):
            found = value
            break
    kinds = {"TASK", "SKILL", "EVENT"}
    nodes = [n | {"type": str(n["type"]).upper()} for n in (found or {}).get("nodes", []) if isinstance(n, dict) and n.get("name") and str(n.get("type", "")).upper() in kinds]
    edges = [e for e in (found or {}).get("edges") or [] if isinstance(e, dict) and e.get("from") and e.get("to") and e.get("type")]
    return {"nodes": nodes[:most_nodes], "edges": edges[:most_edges]}


def repair_transcript(messages: list[dict]) -> list[dict]:
    """Tool calls each followed by one result: missing results are made up, strays and repeats go."""
    results = {}
    for m in messages:
        if m.get("role") == "tool":
            results.setdefault(m.get("call_id"), m)
    out = []
    for m in messages:
        if m.get("role") == "tool":
            continue
        out.append(m)
        out += [results.get(c) or {"role": "tool", "call_id": c, "content": "[no result]"} for c in m.get("calls") or []]
    return out


def repair_sessions(messages: DataFrame) -> DataFrame:
    """:func:`repair_transcript` of each session (session_key, turn, role, call_id, calls, content), in its order."""
    schema = "session_key string, turn long, role string, call_id string, calls array<string>, content string"

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values("turn").to_dict("records")
        for r in rows:
            r["calls"] = list(r["calls"]) if r["calls"] is not None else []
        out = repair_transcript(rows)
        columns = ["role", "call_id", "calls", "content"]
        return pd.DataFrame([(key[0], i, *[m.get(c) for c in columns]) for i, m in enumerate(out)], columns=["session_key", "turn", *columns])

    return messages.groupBy("session_key").applyInPandas(run, schema)
