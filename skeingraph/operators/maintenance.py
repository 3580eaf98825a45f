"""Full and incremental maintenance: graph state in, graph state out, phases in a fixed order."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from . import graph, scoring, store, vectors


@dataclass(frozen=True)
class GraphState:
    """A graph; ``plain`` and ``cliques`` (clique, id, place, n) may state its edges once more.

    A clique stands for an edge from each node to each of a later place, of one type that is
    not RELATES_TO.  Phases that count edges read these two, and ``edges`` stay a plan.
    """

    nodes: DataFrame
    edges: DataFrame
    mentions: DataFrame | None = None
    judged: DataFrame | None = None
    embeddings: DataFrame | None = None
    plain: DataFrame | None = None
    cliques: DataFrame | None = None

    @property
    def counted(self) -> DataFrame:
        """The edges that ``cliques`` do not stand for."""
        return self.edges if self.cliques is None else self.plain


@dataclass(frozen=True)
class Phases:
    """Which phases run; presets differ in these switches alone."""

    cooccurrence: bool = True
    dedup: bool = True
    pagerank: bool = True
    communities: bool = True
    hierarchy: bool = True
    staleness: bool = True
    importance: bool = True
    conflicts: bool = True
    edge_weights: bool = True
    reverse_memory: bool = True
    duplicate_threshold: float = 0.9
    pagerank_rounds: int = 20
    label_rounds: int = 50


def _replaced(nodes: DataFrame, new: DataFrame, column: str, value: str) -> DataFrame:
    """``nodes`` with ``column`` set where ``new`` (id, value) has a row."""
    joined = nodes.join(new.select("id", F.col(value).alias("__new")), "id", "left")
    return joined.withColumn(column, F.coalesce("__new", column)).drop("__new").select(*nodes.columns)


def relate_mentions(state: GraphState, now_ms: int, least: int = 2) -> GraphState:
    if state.mentions is None:
        return state
    pairs = store.cooccurrence(state.mentions, least)
    new = pairs.select(F.col("a").alias("from_id"), F.col("b").alias("to_id"), F.lit("RELATES_TO").alias("type"), F.col("weight").cast("double").alias("weight"))
    plain = None if state.cliques is None else store.upsert_edges(state.plain, new, state.nodes)
    return replace(state, edges=store.upsert_edges(state.edges, new, state.nodes), plain=plain)


def merge_duplicates(state: GraphState, now_ms: int, threshold: float = 0.9) -> GraphState:
    """Pairs of one type at or over the threshold, consumed greedily, then merged."""
    if state.embeddings is None:
        return state
    live = state.embeddings.join(state.nodes.where(store.active()).select("id", "type"), "id")
    chosen = vectors.greedy_merges(vectors.duplicate_pairs(live, threshold), state.nodes)
    if not chosen:
        return state
    mapping = store.merge_targets(state.nodes.sparkSession.createDataFrame(chosen, "merge_id string, keep_id string"))
    nodes = store.merge_nodes(state.nodes, mapping, now_ms).select(*state.nodes.columns)
    # Redirected edges of a clique are no clique, so from here on every edge is there by itself.
    return replace(state, nodes=nodes, edges=store.merge_redirect(state.edges, mapping), plain=None, cliques=None)


def rank_nodes(state: GraphState, now_ms: int, rounds: int = 20) -> GraphState:
    ranks = graph.global_rank(state.nodes, state.counted, rounds=rounds, cliques=state.cliques)
    return replace(state, nodes=_replaced(state.nodes, ranks, "pagerank", "rank"))


def label_communities(state: GraphState, now_ms: int, rounds: int = 50) -> GraphState:
    """Communities of active nodes; inactive ones keep none."""
    labels = graph.label_propagation(state.nodes, state.counted, rounds, cliques=state.cliques)
    live = labels.join(state.nodes.where(store.active()).select("id"), "id", "left_semi")
    named = live.join(graph.communities(live).select("label", "community"), "label")
    return replace(state, nodes=_replaced(state.nodes, named, "community_id", "community"))


def cluster_communities(state: GraphState, now_ms: int) -> GraphState:
    """Topic and domain of each node's community, for graphs that have the two columns."""
    if not {"topic_id", "domain_id"} <= set(state.nodes.columns):
        return state
    members = state.nodes.where(F.col("community_id").isNotNull()).select("id", F.col("community_id").alias("label"))
    topics = graph.hierarchy_level(graph.community_links(state.counted, members, state.cliques), members)
    above = cut(members.join(topics, "label").select("id", F.col("cluster").alias("label")))
    domains = graph.hierarchy_level(graph.community_links(state.counted, above, state.cliques), above)
    levels = topics.toDF("community_id", "topic_id").join(domains.toDF("topic_id", "domain_id"), "topic_id")
    return replace(state, nodes=graph.write_levels(state.nodes, levels).select(*state.nodes.columns))


def score_staleness(state: GraphState, now_ms: int) -> GraphState:
    return replace(state, nodes=_replaced(state.nodes, scoring.staleness(state.nodes, state.counted, now_ms, state.cliques), "staleness_score", "staleness"))


def score_importance(state: GraphState, now_ms: int) -> GraphState:
    return replace(state, nodes=_replaced(state.nodes, scoring.importance(state.nodes, now_ms), "importance_score", "importance"))


def resolve_conflicts(state: GraphState, now_ms: int) -> GraphState:
    """All conflicts: losers are superseded and fade, pairs without a loser merge."""
    decided = cut(scoring.resolved(state.nodes))
    nodes = scoring.apply_conflicts(state.nodes, decided, now_ms).select(*state.nodes.columns)
    nodes, edges = scoring.merge_conflicts(nodes, scoring.fade_losers(state.edges, decided), decided)
    return replace(state, nodes=nodes, edges=edges, plain=None, cliques=None)


def reweigh_edges(state: GraphState, now_ms: int) -> GraphState:
    return state if state.judged is None else replace(state, edges=scoring.reweigh(state.edges, state.judged).select(*state.edges.columns), plain=None, cliques=None)


def remember_unused(state: GraphState, now_ms: int) -> GraphState:
    if state.judged is None:
        return state
    changes = cut(scoring.reverse_memory(state.nodes, state.judged))
    return replace(state, nodes=_replaced(_replaced(state.nodes, changes, "staleness_score", "staleness"), changes, "state", "state"))


def _settled(before: GraphState, after: GraphState, last: bool = False) -> GraphState:
    """``after`` with what its phase changed written, so far as a later phase reads it."""
    out = after if after.nodes is before.nodes else replace(after, nodes=cut(after.nodes))
    if out.cliques is not None:
        return out if out.plain is before.plain else replace(out, plain=cut(out.plain))
    return out if last or out.edges is before.edges else replace(out, edges=cut(out.edges))


def run(state: GraphState, now_ms: int, phases: Phases | None = None) -> tuple[GraphState, DataFrame]:
    """The state after all phases, and the health report; lineage is cut between phases.

    No phase asks for the edges that conflicts and feedback change, so those stay a plan.
    """
    p = phases or Phases()
    steps: list[tuple[bool, Callable[[GraphState], GraphState]]] = [
        (p.cooccurrence, lambda s: relate_mentions(s, now_ms)),
        (p.dedup, lambda s: merge_duplicates(s, now_ms, p.duplicate_threshold)),
        (p.pagerank, lambda s: rank_nodes(s, now_ms, p.pagerank_rounds)),
        (p.communities, lambda s: label_communities(s, now_ms, p.label_rounds)),
        (p.communities and p.hierarchy, lambda s: cluster_communities(s, now_ms)),
        (p.staleness, lambda s: score_staleness(s, now_ms)),
        (p.importance, lambda s: score_importance(s, now_ms)),
        # From here on edges are changed for the caller alone.
        (p.conflicts, lambda s: resolve_conflicts(s, now_ms)),
        (p.edge_weights, lambda s: reweigh_edges(s, now_ms)),
        (p.reverse_memory, lambda s: remember_unused(s, now_ms)),
    ]
    last = steps[7:]
    for on, step in steps:
        if on:
            state = _settled(state, step(state), any(step is x for _, x in last))
    return state, scoring.health(state.nodes, state.edges)


def run_incremental(state: GraphState, dirty: DataFrame, now_ms: int) -> GraphState:
    """Staleness, importance, conflicts and edge weights for dirty nodes alone."""
    nodes = _replaced(state.nodes, scoring.staleness_incremental(state.nodes, dirty, now_ms), "staleness_score", "staleness")
    nodes = _replaced(nodes, scoring.importance_incremental(nodes, dirty, now_ms), "importance_score", "importance")
    won = scoring.conflict_incremental(nodes, dirty).withColumn("state", F.lit("superseded"))
    nodes = _replaced(nodes, won, "state", "state")
    if "superseded_by" in nodes.columns:
        nodes = _replaced(nodes, won, "superseded_by", "superseded_by")
    return replace(state, nodes=nodes, edges=scoring.bump_dirty(state.edges, dirty).select(*state.edges.columns))


def add_dirty(dirty: DataFrame, ids: DataFrame) -> DataFrame:
    return dirty.unionByName(ids).distinct()


def remove_dirty(dirty: DataFrame, ids: DataFrame) -> DataFrame:
    return dirty.join(ids, "node_id", "left_anti")


def fallback_summary(nodes: DataFrame) -> DataFrame:
    """(community_id, summary, member_count) without a model: types, then five names, at most 100 characters."""
    own = nodes.where(store.active() & F.col("community_id").isNotNull())
    ranked = F.sort_array(F.collect_list(F.struct(-F.col("validated_count"), "id", "name")))
    names = F.transform(F.slice(ranked, 1, 5), lambda x: x["name"])
    text: Column = F.concat(F.array_join(F.sort_array(F.collect_set("type")), "/"), F.lit("："), F.array_join(names, "、"))
    return own.groupBy("community_id").agg(F.substring(text, 1, 100).alias("summary"), F.count(F.lit(1)).alias("member_count"))


def upsert_summaries(stored: DataFrame, incoming: DataFrame, now_ms: int) -> DataFrame:
    """Summaries (id, summary, member_count, updated_at) after those of ``incoming`` replaced or joined them."""
    kept = stored.join(incoming, "id", "left_anti")
    return kept.unionByName(incoming.select("id", "summary", "member_count").withColumn("updated_at", F.lit(now_ms).cast("long")))


def prune_summaries(summaries: DataFrame, nodes: DataFrame) -> DataFrame:
    """Summaries of communities that still have an active member."""
    return summaries.join(nodes.where(store.active()).select(F.col("community_id").alias("id")), "id", "left_semi")


def unsummarised(nodes: DataFrame, summaries: DataFrame) -> DataFrame:
    known = summaries.where("summary <> ''").select(F.col("id").alias("community_id"))
    return nodes.where("community_id is not null").select("community_id").distinct().join(known, "community_id", "left_anti")


def record_feedback(nodes: DataFrame, judged: DataFrame, feedback: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """Judged rows with the new ones, and nodes with one validation more for each use."""
    new = scoring.judged_rows(feedback)
    merged = judged.join(new, ["feedback_id", "node_id"], "left_anti").unionByName(new)
    gain = new.where("verdict = 'used'").groupBy(F.col("node_id").alias("id")).agg(F.count(F.lit(1)).alias("__gain"))
    grown = nodes.join(gain, "id", "left").withColumns({"validated_count": F.col("validated_count") + F.coalesce("__gain", F.lit(0)), "updated_at": F.when(F.col("__gain").isNotNull(), F.lit(now_ms)).otherwise(F.col("updated_at"))})
    return merged, grown.select(*nodes.columns)


def mark_pairs_processed(messages: DataFrame, pairs: DataFrame, now_ms: int) -> DataFrame:
    """Sets the processed time of both messages of each (session_key, user, assistant), the user's first."""
    u = messages.select("session_key", F.col("id").alias("u_id"), F.col("content").alias("user"), F.col("turn").alias("ut"))
    a = messages.select("session_key", F.col("id").alias("a_id"), F.col("content").alias("assistant"), F.col("turn").alias("at"))
    both = pairs.join(u, ["session_key", "user"]).join(a, ["session_key", "assistant"]).where("ut < at")
    done = both.select(F.col("u_id").alias("id")).unionByName(both.select(F.col("a_id").alias("id"))).distinct().withColumn("__done", F.lit(now_ms))
    return messages.join(done, "id", "left").withColumn("rebuild_processed_at", F.coalesce("__done", "rebuild_processed_at")).drop("__done")


#: Settings that a change of takes effect at once; the others need a restart.
LIVE_SETTINGS = frozenset(Phases.__dataclass_fields__)


def merge_settings(base: dict, changes: dict) -> dict:
    """``base`` with ``changes``, nested settings merged; a null leaves what was there."""
    out = dict(base)
    for key, value in changes.items():
        if isinstance(value, dict) and isinstance(out.get(key), dict):
            out[key] = merge_settings(out[key], value)
        elif value is not None:
            out[key] = value
    return out


def changed_settings(before: dict, after: dict, under: str = "") -> list[str]:
    """Dotted names of the settings that differ, in order."""
    out = []
    for key in sorted(set(before) | set(after)):
        a, b = before.get(key), after.get(key)
        out += changed_settings(a, b, f"{under}{key}.") if isinstance(a, dict) and isinstance(b, dict) else [f"{under}{key}"] if a != b else []
    return out


def phases_from(settings: dict) -> Phases:
    """The phases that a configuration switches; unknown names are an error."""
    unknown = set(settings) - LIVE_SETTINGS
    if unknown:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return Phases(**settings)
