"""Recall: precise, staged and general retrieval, and their merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from ..lineage import cut
from . import graph, search, store, vectors


def seeds(nodes: DataFrame, embeddings: DataFrame, text: str, query: list[float], limit: int) -> DataFrame:
    """(id, pos): vector hits first, then text hits, each id at its first place."""
    active = nodes.where(store.active()).select("id")
    near = vectors.top_k(embeddings, query, limit).join(active, "id", "left_semi").select("id", F.lit(0).alias("src"), F.col("similarity").alias("s"))
    words = search.bm25(nodes.where(store.active_or_unset()), text, limit).select("id", F.lit(1).alias("src"), F.col("score").alias("s"))
    both = near.unionByName(words)
    place = F.row_number().over(Window.orderBy("src", F.round("s", 9).desc(), "id"))
    return both.withColumn("pos", place).groupBy("id").agg(F.min("pos").alias("pos")).orderBy("pos", "id").limit(limit)


def precise(nodes: DataFrame, edges: DataFrame, embeddings: DataFrame, text: str, query: list[float], *, limit: int = 6, depth: int = 2, rounds: int = 10, cliques: DataFrame | None = None) -> DataFrame:
    """(id, rank) of the best nodes near the seeds by personalised PageRank; ``cliques`` are edges too."""
    start = cut(seeds(nodes, embeddings, text, query, limit).select("id"))
    near = graph.walk(edges, start, depth, cliques=cliques).select("id").unionByName(start).distinct()
    ranks = graph.pagerank(nodes, edges, start, rounds=rounds, cliques=cliques)
    found = ranks.join(near, "id", "left_semi").join(nodes.where(store.active()).select("id"), "id", "left_semi")
    return found.orderBy(F.round("rank", 9).desc(), "id").limit(limit)


def staged(nodes: DataFrame, edges: DataFrame, embeddings: DataFrame, text: str, query: list[float], now_ms: int, *, limit: int = 6, depth: int = 1) -> DataFrame:
    """(id, rank_score): text seeds, their neighbourhood, then similarity and time together."""
    start = search.bm25(nodes.where(store.active_or_unset()), text, limit).select("id")
    near = graph.walk(edges, start, depth).select("id").unionByName(start).distinct()
    known = embeddings.select("id", scores.cosine(F.col("embedding"), vectors.literal(query)).alias("similarity"))
    # A candidate without a vector has similarity 0.
    rows = nodes.join(near, "id", "left_semi").join(known, "id", "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
    return vectors.rank(rows, now_ms).orderBy(F.round("rank_score", 9).desc(), "id").limit(limit).select("id", "rank_score")


#: Tokens that a node and an edge of a result take, by branch; fixed values.
TOKENS = {"precise": (50, 20), "staged": (50, 20), "general": (30, 0), "merged": (40, 15)}


def with_edges(found: DataFrame, edges: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """The edges between the nodes of a result, and one row: nodes, edges and the tokens that they take."""
    held = store.induced_edges(edges, found.select("id")) if kind != "general" else edges.limit(0)
    per_node, per_edge = TOKENS[kind]
    sizes = found.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(held.agg(F.count(F.lit(1)).alias("edges")))  # one row each
    return held, sizes.withColumn("tokens", F.col("nodes") * per_node + F.col("edges") * per_edge)


def merged_edges(precise_edges: DataFrame, general_edges: DataFrame) -> DataFrame:
    """Edges of both results by (from_id, type, to_id), those of the second in place of the first's."""
    key = ["from_id", "to_id", "type"]
    return precise_edges.join(general_edges.select(*key), key, "left_anti").unionByName(general_edges)


def prompt_header(nodes: DataFrame, edge_count: int) -> DataFrame:
    """One row: nodes by type, how many were recalled (``src``), and whether the context is rich (4 nodes or 3 edges)."""
    kinds = [F.count_if(F.col("type") == k).alias(f"{k.lower()}s") for k in ("SKILL", "EVENT", "TASK")]
    out = nodes.agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("src") == "recalled").alias("recalled"), *kinds)
    return out.withColumn("rich", (F.col("nodes") >= 4) | F.lit(edge_count >= 3))


def snippets(nodes: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """(id, title, kind, score, snippet) of the best text hits, at most 20, in search order."""
    found = search.search_nodes(nodes, query, min(limit, 20))
    text = F.concat(F.lit("["), "type", F.lit("] "), "name", F.lit(": "), F.coalesce("description", F.lit("")), F.lit("\n"), F.coalesce("content", F.lit("")))
    return found.select("id", F.col("name").alias("title"), F.col("type").alias("kind"), F.coalesce("pagerank", F.lit(0.0)).alias("score"), text.alias("snippet"))


#: Shares of text and vector scores before there is feedback; fixed values.
COLD_START = (0.4, 0.6)


def hybrid(words: DataFrame, near: DataFrame, limit: int, weights: tuple[float, float] = COLD_START) -> DataFrame:
    """(id, score): text scores over the best of them, and similarities, in fixed shares; a missing one counts 0."""
    top = words.agg(F.max("score").alias("top"))
    text = words.crossJoin(F.broadcast(top)).select("id", (F.col("score") / F.col("top")).alias("w"))  # one row
    both = text.join(near.select("id", F.col("similarity").alias("s")), "id", "full_outer")
    score = weights[0] * F.coalesce("w", F.lit(0.0)) + weights[1] * F.coalesce("s", F.lit(0.0))
    return both.select("id", score.alias("score")).orderBy(F.round("score", 9).desc(), "id").limit(limit)


def similar_cached(cache: DataFrame, query: list[float], least: float = 0.95, newest: int = 20, factor: float = 0.7) -> DataFrame:
    """(key, id, pagerank): the result of the most similar of the newest cached queries, weighed down by ``factor`` times its similarity.

    ``cache`` has key, ts, vector and nodes (array of id and pagerank); below ``least`` there is none.
    """
    recent = cache.orderBy(F.col("ts").desc(), "key").limit(newest)
    near = recent.withColumn("s", scores.cosine(F.col("vector"), vectors.literal(query))).where(F.col("s") >= least)
    best = near.orderBy(F.col("s").desc(), "key").limit(1)
    return best.select("key", "s", F.explode("nodes").alias("n")).select("key", "n.id", (F.col("n.pagerank") * factor * F.col("s")).alias("pagerank"))


def general(nodes: DataFrame, edges: DataFrame, community_vectors: DataFrame, query: list[float], *, near: int = 5, per_community: int = 2, limit: int = 6, rounds: int = 10, cliques: DataFrame | None = None) -> DataFrame:
    """(id, rank): representatives of the nearest communities by personalised PageRank from all of them."""
    close = vectors.top_k(community_vectors, query, near).select(F.col("id").alias("community_id"))
    reps = cut(graph.representatives(nodes, per_community).join(close, "community_id", "left_semi").select("id"))
    return graph.pagerank(nodes, edges, reps, rounds=rounds, cliques=cliques).join(reps, "id", "left_semi").orderBy(F.round("rank", 9).desc(), "id").limit(limit)


def merged(nodes: DataFrame, precise_ids: DataFrame, general_ids: DataFrame, now_ms: int, temporal_weight: float = 0.3, drop_superseded: bool = False) -> DataFrame:
    """Both results without repeats, fresh ones first, then by importance, freshness and recency, then pagerank."""
    both = precise_ids.select("id", F.lit(0).alias("src")).unionByName(general_ids.select("id", F.lit(1).alias("src"))).groupBy("id").agg(F.min("src").alias("src"))
    rows = nodes.join(both, "id")
    if drop_superseded:
        rows = rows.where("state <> 'superseded'")
    weight = F.coalesce("importance_score", F.lit(0.0)) * (1 - F.coalesce("staleness_score", F.lit(0.0)))
    recency = scores.temporal_recency(F.col("updated_at"), F.col("valid_to"), F.col("state"), now_ms)
    rows = rows.withColumns({"stale": F.col("state").isin("superseded", "transitional"), "order_key": weight + temporal_weight * recency})
    order = Window.orderBy("stale", F.round("order_key", 9).desc(), F.col("pagerank").desc(), "id")
    return rows.withColumn("place", F.row_number().over(order))


def context_order(nodes: DataFrame) -> list:
    """Order of the prompt context: active, then skills, tasks and events, then validations and pagerank."""
    kind = F.when(F.col("type") == "SKILL", 0).when(F.col("type") == "TASK", 1).otherwise(2)
    return [F.when(store.active(), 0).otherwise(1), kind, F.col("validated_count").desc(), F.col("pagerank").desc(), F.col("id")]


def assemble(nodes: DataFrame, budget_chars: int) -> DataFrame:
    """(community_id, xml): the context that fits the budget, escaped, grouped by community."""
    from ..functions.text import xml_escape
    from .evaluate import within_budget

    body = F.concat(F.lit("<node type=\""), "type", F.lit("\" name=\""), xml_escape(F.col("name")), F.lit("\">"), xml_escape(F.col("content")), F.lit("</node>"))
    rows = nodes.withColumns({"xml": body, "one": F.lit(1)}).withColumn("size", F.char_length("xml"))
    kept = within_budget(rows, "one", context_order(rows), "size", budget_chars)
    lines = F.transform(F.sort_array(F.collect_list(F.struct("used", "xml"))), lambda x: x["xml"])
    return kept.groupBy(F.coalesce("community_id", F.lit("none")).alias("community_id")).agg(F.array_join(lines, "\n").alias("xml"))
