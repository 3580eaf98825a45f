"""Full-text search by BM25, per index or over all, and its merge order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..lineage import cut
from . import store


def bm25(docs: DataFrame, query: str, limit: int, *, id_col: str = "id", text_col: str = "content", by: str | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) of the best documents for a query of a few words; with ``by`` the best of each index, which has its own statistics.

    One pass over the texts counts the query's terms and the length of each; what is left
    is a narrow table.
    """
    index = [F.col(by).alias("index")] if by else [F.lit("all").alias("index")]
    asked = F.array_distinct(text.search_tokens(F.lit(query)))
    rows = docs.select(F.col(id_col).alias("id"), *index, text.search_tokens(F.col(text_col)).alias("terms"))
    times = F.filter(F.transform(asked, lambda t: F.struct(t.alias("term"), F.size(F.filter("terms", lambda x: x == t)).alias("tf"))), lambda x: x["tf"] > 0)
    rows = cut(rows.select("id", "index", F.size("terms").alias("length"), times.alias("times")))
    totals = rows.groupBy("index").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("avg_length"))
    tf = rows.where(F.size("times") > 0).select("id", "index", "length", F.explode("times").alias("t")).select("id", "index", "length", "t.term", "t.tf")
    df = tf.groupBy("index", "term").agg(F.count(F.lit(1)).alias("df"))
    known = df.join(totals, "index").withColumn("idf", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("avg_length")))
    # A row for each term of the query and index.
    scored = tf.join(F.broadcast(known), ["index", "term"]).groupBy("index", "id").agg(F.sum(part).alias("score"))
    if not by:
        return scored.select("id", "score").orderBy(F.round("score", 9).desc(), "id").limit(limit)
    nth = F.row_number().over(Window.partitionBy("index").orderBy(F.round("score", 9).desc(), "id"))
    return scored.withColumn("nth", nth).where(F.col("nth") <= limit).select("index", "id", "score")


def merged(found: DataFrame, limit: int) -> DataFrame:
    """Final order of text hits: validations, then time; the score has done its work in the cut before."""
    return found.orderBy(F.col("validated_count").desc(), F.col("updated_at").desc(), "id").limit(limit)


def search_nodes(nodes: DataFrame, query: str, limit: int, indexed: bool = True) -> DataFrame:
    """Nodes for a query: the best of each type's index, united and merged; without an index, those that contain the query."""
    live = nodes.where(store.active_or_unset())
    if not indexed:
        return store.contains(nodes, query, limit)
    found = bm25(live, query, limit, by="type").select("id").distinct()
    return merged(live.join(found, "id", "left_semi"), limit)
