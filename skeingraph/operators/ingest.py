"""Conversation ingestion: role normalisation, pairing, chunks, heuristic triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

#: Spellings of the two roles that count; any other role is skipped.
USER_ROLES, ASSISTANT_ROLES = ("user", "human"), ("assistant", "ai", "bot")
#: Words that mark an error report; fixed values.
ERROR_WORDS = "error|exception|fail|failed|failure|crash|bug|timeout"


def normal_role(role: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(role, F.lit(""))))
    return F.when(low.isin(*USER_ROLES), "user").when(low.isin(*ASSISTANT_ROLES), "assistant").otherwise("")


def turn_pairs(messages: DataFrame, after: int = 0) -> DataFrame:
    """(session_key, pair, turn, user, assistant), numbered from 1 in each session, those after ``after``.

    A user turn pairs with the assistant turn that follows it; followed by another user
    turn it pairs with nothing (''); a last user turn waits; an assistant turn without a
    question is skipped.
    """
    order = Window.partitionBy("session_key").orderBy("turn", "id")
    rows = messages.withColumn("role", normal_role(F.col("role"))).where("role <> ''")
    rows = rows.withColumns({"next_role": F.lead("role").over(order), "next_content": F.lead("content").over(order)})
    pairs = rows.where("role = 'user' and next_role is not null")
    answer = F.when(F.col("next_role") == "assistant", F.col("next_content")).otherwise("")
    numbered = pairs.withColumn("pair", F.row_number().over(order)).where(F.col("pair") > after)
    return numbered.select("session_key", "pair", "turn", F.col("content").alias("user"), answer.alias("assistant"))


def adjacent_pairs(messages: DataFrame) -> DataFrame:
    """Only user turns that an assistant turn follows at once."""
    order = Window.partitionBy("session_key").orderBy("turn", "id")
    rows = messages.withColumns({"next_role": F.lead("role").over(order), "next_content": F.lead("content").over(order)})
    return rows.where("role = 'user' and next_role = 'assistant'").select("session_key", "turn", F.col("content").alias("user"), F.col("next_content").alias("assistant"))


def next_session_edges(sessions: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """(group, from_name, to_name) between neighbours of each group."""
    after = F.lead(name).over(Window.partitionBy(group).orderBy(order))
    return sessions.withColumn("to_name", after).where("to_name is not null").select(group, F.col(name).alias("from_name"), "to_name")


def message_chunks(messages: DataFrame, size: int = 10) -> DataFrame:
    """(session_key, chunk, n, content): messages of a session in runs of ``size``."""
    order = Window.partitionBy("session_key").orderBy("turn", "id")
    rows = messages.withColumn("nth", F.row_number().over(order)).withColumn("chunk", F.floor((F.col("nth") - 1) / size).cast("int"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("nth", F.concat_ws(": ", "role", "content").alias("line")))), lambda x: x["line"])
    return rows.groupBy("session_key", "chunk").agg(F.count(F.lit(1)).alias("n"), F.array_join(lines, "\n").alias("content"))


def heuristic_triples(pairs: DataFrame, most_nodes: int = 5, most_edges: int = 8) -> DataFrame:
    """(session_key, pair, nodes, edges) found without a model.

    The first ten words of the question name a TASK; a question with an error word adds an
    EVENT; the first three sentences of the answer with 10 to 200 characters are SKILLs.
    The task uses each skill; the event is solved by the first.  Capped at 5 nodes and 8
    edges per pair.
    """
    words = F.filter(F.split(F.trim("user"), r"\s+"), lambda w: w != "")
    task = text.slug(F.array_join(F.slice(words, 1, 10), " "))
    sentences = F.filter(F.split("assistant", "[。；;！!？?.\n]"), lambda s: F.char_length(F.trim(s)).between(10, 200))
    skills = F.transform(F.slice(sentences, 1, 3), lambda s: text.slug(F.trim(s)))
    rows = pairs.withColumns({"task": task, "skills": F.array_distinct(F.filter(skills, lambda s: s != "")), "is_error": F.lower("user").rlike(ERROR_WORDS)})
    rows = rows.where("task <> ''").withColumn("event", F.when(F.col("is_error"), F.concat(F.lit("error-"), F.substring("task", 1, 32))))

    def node(kind: str, name: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), name.alias("name"))

    def edge(kind: str, a: Column, b: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), a.alias("from_name"), b.alias("to_name"))

    nodes = F.concat(F.array(node("TASK", F.col("task"))), F.when(F.col("is_error"), F.array(node("EVENT", F.col("event")))).otherwise(F.array().cast("array<struct<type:string,name:string>>")), F.transform("skills", lambda s: node("SKILL", s)))
    uses = F.transform("skills", lambda s: edge("USED_SKILL", F.col("task"), s))
    solved = F.when(F.col("is_error") & (F.size("skills") > 0), F.array(edge("SOLVED_BY", F.col("event"), F.col("skills")[0]))).otherwise(F.array().cast("array<struct<type:string,from_name:string,to_name:string>>"))
    return rows.select("session_key", "pair", F.slice(nodes, 1, most_nodes).alias("nodes"), F.slice(F.concat(uses, solved), 1, most_edges).alias("edges"))


def extracted_graph(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with stable ids; equal names of a type are one node, edges resolve within their pair."""
    named = triples.select("session_key", "pair", F.explode("nodes").alias("n")).select("session_key", "pair", "n.type", "n.name")
    named = named.withColumn("id", text.node_id(F.col("type"), text.normal_name(F.col("name"))))
    ends = named.select("session_key", "pair", "name", "id")
    edges = triples.select("session_key", "pair", F.explode("edges").alias("e")).select("session_key", "pair", "e.*")
    edges = edges.join(ends.toDF("session_key", "pair", "from_name", "from_id"), ["session_key", "pair", "from_name"]).join(ends.toDF("session_key", "pair", "to_name", "to_id"), ["session_key", "pair", "to_name"])
    nodes = named.groupBy("id", "type").agg(F.min("name").alias("name"))
    return nodes, edges.select("from_id", "to_id", "type").distinct()
