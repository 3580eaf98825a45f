"""Maintenance scores: staleness, importance, health, conflicts, edge weights, negative memory, feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from ..lineage import cut
from .store import active, merge_targets


def in_degree(edges: DataFrame, cliques: DataFrame | None = None) -> DataFrame:
    """(id, in_degree); of ``cliques`` (clique, id, place, n) a node has an edge from each of an earlier place."""
    counted = edges.groupBy(F.col("to_id").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))
    if cliques is None:
        return counted
    members = cliques.groupBy("clique", "place", "id").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("clique").orderBy("place").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counted.unionByName(members.select("id", (F.col("n") * before).alias("in_degree"))).groupBy("id").agg(F.sum("in_degree").alias("in_degree"))


def staleness(nodes: DataFrame, edges: DataFrame, now_ms: int, cliques: DataFrame | None = None) -> DataFrame:
    """Active nodes with ``staleness``; degrees are aggregated before the join."""
    rows = nodes.where(active()).join(in_degree(edges, cliques), "id", "left").withColumn("in_degree", F.coalesce("in_degree", F.lit(0)))
    return rows.withColumn("staleness", scores.staleness(F.col("state"), F.col("updated_at"), F.col("in_degree"), F.col("source"), now_ms))


def staleness_incremental(nodes: DataFrame, dirty: DataFrame, now_ms: int) -> DataFrame:
    rows = nodes.where(active()).join(dirty, nodes["id"] == dirty["node_id"], "left_semi")
    return rows.withColumn("staleness", scores.staleness_incremental(F.col("state"), F.col("updated_at"), F.col("source"), now_ms))


def importance(nodes: DataFrame, now_ms: int) -> DataFrame:
    """Active nodes with ``importance``, rounded to 3; the largest pagerank is one broadcast row."""
    rows = nodes.where(active())
    top = rows.agg(F.max("pagerank").alias("max_pagerank"))
    rows = rows.crossJoin(F.broadcast(top))  # one row
    return rows.withColumn("importance", F.round(scores.importance(F.col("updated_at"), F.col("validated_count"), F.col("pagerank"), F.col("max_pagerank"), F.col("source"), now_ms), 3))


def importance_incremental(nodes: DataFrame, dirty: DataFrame, now_ms: int) -> DataFrame:
    rows = nodes.where(active()).join(dirty, nodes["id"] == dirty["node_id"], "left_semi")
    return rows.withColumn("importance", scores.importance_incremental(F.col("updated_at"), F.col("validated_count"), F.col("pagerank"), F.col("source"), now_ms))


#: Edge types that a phase leaves alone; fixed values.
SPARED = ("NEXT_SESSION", "CONTAINS")
#: Edge types that health and merging do not count; fixed values.
UNCOUNTED = ("NEXT_SESSION", "CONTAINS", "MENTIONS")


def business(types: tuple[str, ...] = SPARED):
    return ~F.col("type").isin(*types)


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Active nodes without an edge of any type."""
    ends = edges.select(F.explode(F.array("from_id", "to_id")).alias("id"))
    return nodes.where(active()).join(ends, "id", "left_anti")


def health(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts and averages, structural edges not counted; ``avg_pagerank_top`` divides the ten largest by all active."""
    counts = nodes.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(active()).alias("active"),
        F.count_if(F.col("state") == "superseded").alias("superseded"), F.count_if(F.col("state") == "transitional").alias("transitional"),
        F.count_if(active() & (F.col("staleness_score") >= 0.7)).alias("stale"),
        F.countDistinct(F.when(active(), F.col("community_id"))).alias("communities"),
        F.avg(F.when(active(), F.col("pagerank"))).alias("avg_pagerank"),
    )
    top = nodes.where(active()).orderBy(F.col("pagerank").desc()).limit(10).agg(F.sum("pagerank").alias("top_sum"))
    alone = isolated(nodes, edges).agg(F.count(F.lit(1)).alias("isolated"))
    linked = edges.where(business(UNCOUNTED)).agg(F.count(F.lit(1)).alias("edges"))
    out = counts.crossJoin(top).crossJoin(alone).crossJoin(linked)  # one row each
    return out.withColumn("avg_pagerank_top", F.col("top_sum") / F.col("active")).drop("top_sum")


def anomalies(report: DataFrame) -> DataFrame:
    """One row per rule that a health report breaks."""
    rules = [
        ("isolated", F.col("isolated") > 0.3 * F.col("active")), ("stale", F.col("stale") > 0.3 * F.col("active")),
        ("low_pagerank", (F.col("avg_pagerank_top") < 0.01) & (F.col("active") > 10)), ("transitional", F.col("transitional") > 0),
    ]
    found = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules]))
    return report.select(F.explode(found).alias("anomaly"))


def conflict_candidates(nodes: DataFrame, limit: int | None = None) -> DataFrame:
    """Pairs a < b of active nodes with one name, of which one is transitional or staler than 0.7, in a fixed order.

    Types may differ: such pairs are scanned and :func:`conflict_winner` resolves none.
    Every pair has an open side, so only those nodes are joined with the others of their name.
    """
    keep = ["id", "name", "type", "content", "state", "valid_from", "source", "validated_count", "staleness_score"]
    own = nodes.where(active()).select(*keep, F.coalesce((F.col("state") == "transitional") | (F.col("staleness_score") > 0.7), F.lit(False)).alias("open"))
    one, two = own.where("open").alias("x"), own.alias("y")
    if limit:
        # The first nodes that have a later partner hold the first pairs, so no others are made.
        last = own.groupBy("name").agg(F.max("id").alias("last"), F.max(F.when(F.col("open"), F.col("id"))).alias("last_open"))
        able = own.join(last, "name").where(F.col("id") < F.when(F.col("open"), F.col("last")).otherwise(F.col("last_open")))
        first = able.select("id").distinct().orderBy("id").limit(limit)
        one = F.broadcast(own.join(F.broadcast(first), "id", "left_semi")).alias("x")  # at most ``limit`` ids
        found = one.join(two, F.expr("x.name = y.name and x.id < y.id and (x.open or y.open)"))
        sides = [F.col(f"{p}.{c}").alias(f"{s}_{c}") for s, p in (("a", "x"), ("b", "y")) for c in keep if c != "name"]
        return found.select(F.col("x.name").alias("name"), *sides).orderBy("a_id", "b_id").limit(limit)
    # A pair with two open sides is found from the first.
    found = one.join(two, F.expr("x.name = y.name and x.id <> y.id and (not y.open or x.id < y.id)"))
    first = F.col("x.id") < F.col("y.id")
    sides = [F.when(first, F.col(f"{p}.{c}")).otherwise(F.col(f"{q}.{c}")).alias(f"{s}_{c}") for s, p, q in (("a", "x", "y"), ("b", "y", "x")) for c in keep if c != "name"]
    return found.select(F.col("x.name").alias("name"), *sides)


def _source_rank(column: str):
    return F.when(F.col(column) == "knowledge", 3).when(F.coalesce(column, F.lit("experience")) == "experience", 2).otherwise(1)


def conflict_winner(pairs: DataFrame, temporal: bool = True, source: bool = True, confidence: bool = True) -> DataFrame:
    """Pairs of one type with ``winner_id``, ``loser_id`` and ``reason``.

    The later start of validity wins, then the better source, then 1.5 times the
    validations; else the nodes merge into the one with more fresh validations, ties to
    the first.  Without ``temporal`` priority the first always wins, as ``temporal``.
    """
    def rank(side: str):
        return _source_rank(f"{side}_source")

    a_time, b_time = F.coalesce("a_valid_from", F.lit(0)), F.coalesce("b_valid_from", F.lit(0))
    a_n, b_n = F.coalesce("a_validated_count", F.lit(0)), F.coalesce("b_validated_count", F.lit(0))
    a_fresh, b_fresh = a_n * (1 - F.coalesce("a_staleness_score", F.lit(0.0))), b_n * (1 - F.coalesce("b_staleness_score", F.lit(0.0)))
    by_source, a_sure, b_sure = F.lit(source) & (rank("a") != rank("b")), F.lit(confidence) & (a_n > 1.5 * b_n), F.lit(confidence) & (b_n > 1.5 * a_n)
    reason = F.when(a_time != b_time, "temporal").when(by_source, "source").when(a_sure | b_sure, "confidence").otherwise("merge")
    wins = F.when(a_time != b_time, a_time > b_time).when(by_source, rank("a") > rank("b")).when(a_sure, True).when(b_sure, False).otherwise(a_fresh >= b_fresh)
    if not temporal:
        reason, wins = F.lit("temporal"), F.lit(True)
    named = pairs.where("a_type = b_type").withColumn("reason", reason)
    return named.withColumn("winner_id", F.when(wins, F.col("a_id")).otherwise(F.col("b_id"))).withColumn("loser_id", F.when(wins, F.col("b_id")).otherwise(F.col("a_id")))


#: Open nodes of a name and type that meet the others in one piece.
TILE = 1024


def decided_pairs(nodes: DataFrame) -> DataFrame:
    """(a_id, b_id, reason, winner_id, loser_id) as of :func:`conflict_winner` over all :func:`conflict_candidates`, with what a decision says of both.

    What decides and what is said is worked out a node, not a pair.  The open nodes of a name
    are dealt to tiles that each meet all nodes of the name, so a task holds a tile at most.
    """
    n, stale = F.coalesce("validated_count", F.lit(0)), F.coalesce("staleness_score", F.lit(0.0))
    facts = {"since": F.coalesce("valid_from", F.lit(0)), "rank": _source_rank("source"), "n": n, "fresh": n * (1 - stale), "stale": F.format_string("%.2f", stale), "sure": F.format_string("%d", n), "from": F.coalesce("source", F.lit("experience"))}
    is_open = F.coalesce((F.col("state") == "transitional") | (F.col("staleness_score") > 0.7), F.lit(False)).alias("open")
    own = nodes.where(active() & F.col("name").isNotNull() & F.col("type").isNotNull()).select("name", "type", "id", is_open, *[c.alias(k) for k, c in facts.items()])
    sizes = own.where("open").groupBy("name", "type").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    dealt = own.join(sizes, ["name", "type"])
    tile = F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")
    x = dealt.where("open").select("name", "type", tile.alias("tile"), *[F.col(c).alias(f"x_{c}") for c in ("id", *facts)])
    y = dealt.select("name", "type", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), *[F.col(c).alias(f"y_{c}") for c in ("id", "open", *facts)])
    # A pair with two open sides is found from the first.
    met = y.join(x.hint("merge"), ["name", "type", "tile"]).where("x_id <> y_id and (not y_open or x_id < y_id)")
    rule = "CASE WHEN x_since <> y_since THEN {0} WHEN x_rank <> y_rank THEN {1} WHEN x_n > 1.5D * y_n THEN {2} WHEN y_n > 1.5D * x_n THEN {3} ELSE {4} END"
    wins = F.expr(rule.format("x_since > y_since", "x_rank > y_rank", "true", "false", "x_fresh > y_fresh OR x_fresh = y_fresh AND x_id < y_id"))
    reason = F.expr(rule.format("'temporal'", "'source'", "'confidence'", "'confidence'", "'merge'"))
    first = F.col("x_id") < F.col("y_id")
    said = [F.when(first, F.col(f"{p}_{c}")).otherwise(F.col(f"{q}_{c}")).alias(f"{s}_{c}") for s, p, q in (("a", "x", "y"), ("b", "y", "x")) for c in ("stale", "sure", "from")]
    ends = [F.least("x_id", "y_id").alias("a_id"), F.greatest("x_id", "y_id").alias("b_id")]
    return met.select(*ends, reason.alias("reason"), F.when(wins, F.col("x_id")).otherwise(F.col("y_id")).alias("winner_id"), F.when(wins, F.col("y_id")).otherwise(F.col("x_id")).alias("loser_id"), *said)


def merging(nodes: DataFrame) -> DataFrame:
    """(merge_id, keep_id): the losers of all pairs that merge, each with its winner of smallest id.

    As of :func:`conflict_winner` over all :func:`conflict_candidates`, but nodes are
    compared by what decides a pair, once for all that agree in it, and no pairs are made.
    """
    n = F.coalesce("validated_count", F.lit(0))
    is_open = F.coalesce((F.col("state") == "transitional") | (F.col("staleness_score") > 0.7), F.lit(False))
    facts = {"since": F.coalesce("valid_from", F.lit(0)), "rank": _source_rank("source"), "n": n, "fresh": n * (1 - F.coalesce("staleness_score", F.lit(0.0))), "open": is_open}
    own = nodes.where(active()).select("id", "name", "type", *[c.alias(k) for k, c in facts.items()])
    like, differ = ["name", "type", "since", "rank"], ["n", "fresh", "open"]
    classes = cut(own.groupBy(*like, *differ).agg(F.min("id").alias("low")))
    above = classes.withColumnsRenamed({c: f"{c}_2" for c in (*differ, "low")})
    met = classes.join(above, like).where("(open or open_2) and fresh_2 >= fresh and n <= 1.5D * n_2 and n_2 <= 1.5D * n")
    # Equally fresh ones lose to a smaller id alone.
    met = met.groupBy(*like, *differ).agg(F.min(F.when(F.col("fresh_2") > F.col("fresh"), F.col("low_2"))).alias("over"), F.min(F.when(F.col("fresh_2") == F.col("fresh"), F.col("low_2"))).alias("same"))
    winner = F.least("over", F.when(F.col("same") < F.col("id"), F.col("same")))
    lost = own.join(met, like + differ).select(F.col("id").alias("merge_id"), winner.alias("keep_id")).where("keep_id is not null")
    return lost.groupBy("merge_id").agg(F.min("keep_id").alias("keep_id"))


def superseded(nodes: DataFrame) -> DataFrame:
    """(loser_id, winner_id): the losers of all pairs that are decided without a merge, each with its winner of smallest id.

    As of :func:`conflict_winner` over all :func:`conflict_candidates`, but what a node loses
    to is read off in order of what decides, once for all that agree in it, and no pairs are made.
    """
    is_open = F.coalesce((F.col("state") == "transitional") | (F.col("staleness_score") > 0.7), F.lit(False))
    facts = {"since": F.coalesce("valid_from", F.lit(0)), "rank": _source_rank("source"), "n": F.coalesce("validated_count", F.lit(0)), "open": is_open}
    own = nodes.where(active() & F.col("name").isNotNull() & F.col("type").isNotNull()).select("id", "name", "type", *[c.alias(k) for k, c in facts.items()])
    lows = [F.min("id").alias("low"), F.min(F.when(F.col("open"), F.col("id"))).alias("low_open")]
    like = ["name", "type", "since", "rank"]
    classes = cut(own.groupBy(*like, "n").agg(*lows))
    # A later start or a better source: what comes before in that order.
    levels = classes.groupBy(*like).agg(F.min("low").alias("low"), F.min("low_open").alias("low_open"))
    before = Window.partitionBy("name", "type").orderBy(F.col("since").desc(), F.col("rank").desc()).rowsBetween(Window.unboundedPreceding, -1)
    above = levels.select(*like, F.min("low").over(before).alias("above"), F.min("low_open").over(before).alias("above_open"))
    # More than 1.5 times the validations: of one number the asking half comes first, so equal ones do not count.
    marks = classes.select(*like, "n", F.col("n").cast("double").alias("at"), F.lit(1).alias("there"), "low", "low_open")
    none = F.lit(None).cast(classes.schema["low"].dataType)
    asks = classes.select(*like, "n", (F.col("n") * F.lit(1.5)).alias("at"), F.lit(0).alias("there"), none.alias("low"), none.alias("low_open"))
    passed = Window.partitionBy(*like).orderBy(F.col("at").desc(), "there").rowsBetween(Window.unboundedPreceding, 0)
    sure = marks.unionByName(asks).select(*like, "n", "there", F.min("low").over(passed).alias("sure"), F.min("low_open").over(passed).alias("sure_open")).where("there = 0").drop("there")
    # Written first, so its size is known and nodes are not shuffled for a small one.
    over = cut(sure.join(above, like).select(*like, "n", F.least("above", "sure").alias("over"), F.least("above_open", "sure_open").alias("over_open")))
    # One side of a pair is open.
    winner = F.when(F.col("open"), F.col("over")).otherwise(F.col("over_open"))
    lost = own.join(over, [*like, "n"]).select(F.col("id").alias("loser_id"), winner.alias("winner_id")).where("winner_id is not null")
    return lost.groupBy("loser_id").agg(F.min("winner_id").alias("winner_id"))


def resolved(nodes: DataFrame) -> DataFrame:
    """(loser_id, winner_id, reason): of all decided pairs what phases read, a loser's winner of smallest id, once without and once with a merge."""
    merges = merging(nodes).select(F.col("merge_id").alias("loser_id"), F.col("keep_id").alias("winner_id"), F.lit("merge").alias("reason"))
    return superseded(nodes).withColumn("reason", F.lit("superseded")).unionByName(merges)


def conflict_decisions(decided: DataFrame, now_ms: int) -> DataFrame:
    """(id, decision, winner_id, loser_id, ts, reason): a row for each pair that was decided without a merge."""
    def value(side: str, column: str, default):
        return F.coalesce(F.col(f"{side}_{column}"), F.lit(default))

    if "a_stale" in decided.columns:
        why = F.concat(*[part for label, c in (("staleness: ", "stale"), ("; validated: ", "sure"), ("; source: ", "from")) for part in (F.lit(f"{label}a="), f"a_{c}", F.lit(", b="), f"b_{c}")])
    else:
        why = F.format_string("staleness: a=%.2f, b=%.2f; validated: a=%d, b=%d; source: a=%s, b=%s", *[value(s, c, d) for c, d in (("staleness_score", 0.0), ("validated_count", 0), ("source", "experience")) for s in ("a", "b")])
    key = F.md5(F.concat_ws("|", "winner_id", "loser_id").cast("binary"))
    return decided.where("reason <> 'merge'").select(F.concat(F.lit("decision-"), key).alias("id"), F.col("reason").alias("decision"), "winner_id", "loser_id", F.lit(now_ms).alias("ts"), why.alias("reason"))


def apply_conflicts(nodes: DataFrame, decided: DataFrame, now_ms: int) -> DataFrame:
    """Losers of decided pairs become superseded and fully stale, by the winner with the smallest id; others stay as they are."""
    lost = decided.where("reason <> 'merge'").groupBy("loser_id").agg(F.min("winner_id").alias("__by"))
    out = nodes.join(lost, nodes["id"] == lost["loser_id"], "left")
    gone = F.col("loser_id").isNotNull()
    new = {"state": F.lit("superseded"), "staleness_score": F.lit(1.0), "valid_to": F.lit(now_ms).cast("long"), "superseded_by": F.col("__by")}
    known = out if "superseded_by" in nodes.columns else out.withColumn("superseded_by", F.lit(None).cast("string"))
    return known.withColumns({c: F.when(gone, v).otherwise(F.col(c)) for c, v in new.items()}).drop("loser_id", "__by")


def fade_losers(edges: DataFrame, decided: DataFrame) -> DataFrame:
    """Outgoing edges of the losers of decided pairs at a tenth, structural ones spared."""
    # Written first, so its size is known and edges are not shuffled for a small one.
    lost = cut(decided.where("reason <> 'merge'").select(F.col("loser_id").alias("from_id")).distinct()).withColumn("__lost", F.lit(True))
    return faded(edges.join(lost, "from_id", "left"), "__lost")


def faded(edges: DataFrame, lost: str) -> DataFrame:
    """``edges`` at a tenth where the column ``lost`` is true, structural ones spared; without that column."""
    return edges.withColumn("weight", F.when(F.col(lost) & business(), F.col("weight") * 0.1).otherwise(F.col("weight"))).drop(lost)


def merge_conflicts(nodes: DataFrame, edges: DataFrame, decided: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after the pairs that merge, of ``decided`` or else of all candidates.

    The winner holds the contents of both in order of id, their validations together, is
    current and not stale; the loser goes.  Its outgoing edges, structural ones left out, are
    the winner's: an edge that the winner had keeps half its weight, a new one has 0.5.  Where
    pairs share nodes, each loser goes to its winner with the smallest id, chains to their end.
    """
    pairs = merging(nodes) if decided is None else decided.where("reason = 'merge'").groupBy(F.col("loser_id").alias("merge_id")).agg(F.min("winner_id").alias("keep_id"))
    mapping = merge_targets(cut(pairs))
    return merged_nodes(nodes, mapping), merged_edges(edges, mapping)


def merged_nodes(nodes: DataFrame, mapping: DataFrame) -> DataFrame:
    """The nodes of :func:`merge_conflicts`, which merges by ``mapping`` (merge_id, keep_id)."""
    grouped = mapping.unionByName(mapping.select(F.col("keep_id").alias("merge_id"), "keep_id").distinct())
    members = nodes.join(grouped, nodes["id"] == grouped["merge_id"])
    texts = F.transform(F.sort_array(F.collect_list(F.when(F.col("content") != "", F.struct("id", "content")))), lambda x: x["content"])
    sums = members.groupBy("keep_id").agg(F.array_join(texts, "\n---\n").alias("__content"), F.sum("validated_count").alias("__n"))
    kept = nodes.join(mapping, nodes["id"] == mapping["merge_id"], "left_anti").join(sums, F.col("id") == F.col("keep_id"), "left")
    won = F.col("keep_id").isNotNull()
    changes = {"content": F.col("__content"), "validated_count": F.col("__n"), "state": F.lit("current"), "staleness_score": F.lit(0.0)}
    return kept.withColumns({c: F.when(won, v).otherwise(F.col(c)) for c, v in changes.items()}).select(*nodes.columns)


def merged_edges(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """The edges of :func:`merge_conflicts`."""
    key = ["from_id", "to_id", "type"]
    copied = edges.where(business()).join(mapping, edges["from_id"] == mapping["merge_id"]).select(F.col("keep_id").alias("from_id"), "to_id", "type").distinct()
    lost = mapping.select("merge_id")
    rest = edges.join(lost, edges["from_id"] == lost["merge_id"], "left_anti").join(lost, edges["to_id"] == lost["merge_id"], "left_anti")
    copied = copied.join(lost, copied["to_id"] == lost["merge_id"], "left_anti").where("from_id <> to_id").withColumn("__copied", F.lit(True))
    both = rest.join(copied, key, "full_outer")
    weight = F.when(F.col("__copied"), F.coalesce("weight", F.lit(1.0)) * 0.5).otherwise(F.col("weight"))
    return both.withColumn("weight", weight).select(*edges.columns)


def conflict_incremental(nodes: DataFrame, dirty: DataFrame) -> DataFrame:
    """(id, superseded_by): nodes of any state and type that a node of their name supersedes, where one of the two is dirty.

    A dirty node supersedes what is not newer than it and is superseded by what is newer;
    of several the newest counts, ties to the larger id.  A name is summed up in one row
    before its nodes see it, so no pairs are made.
    """
    own = nodes.select("id", "name", F.coalesce("updated_at", F.lit(0)).alias("t")).where("name is not null")
    own = own.join(dirty.select(F.col("node_id").alias("id")).distinct().withColumn("dirty", F.lit(True)), "id", "left").withColumn("dirty", F.coalesce("dirty", F.lit(False)))
    mark = F.struct("t", "id")
    tops = own.groupBy("name").agg(F.max(F.when(F.col("dirty"), mark)).alias("top"), F.max(mark).alias("newest")).where("top is not null")
    held = cut(own.join(tops, "name"))
    second = held.where("dirty and id <> top.id").groupBy("name").agg(F.max(mark).alias("next"))
    held = held.join(second, "name", "left")
    other = F.when(F.col("top.id") != F.col("id"), F.col("top")).otherwise(F.col("next"))
    by_dirty = F.when(other["t"] >= F.col("t"), other)
    by_newer = F.when(F.col("dirty") & (F.col("newest.t") > F.col("t")), F.col("newest"))
    by = F.greatest(by_dirty, by_newer)
    return held.where(by.isNotNull()).select("id", by["id"].alias("superseded_by"))


def used_pairs(judged: DataFrame) -> DataFrame:
    """(a, b, usage): in how many feedbacks both were used, a < b."""
    used = judged.where("verdict = 'used'").select("feedback_id", "node_id").distinct()
    pairs = used.withColumnRenamed("node_id", "a").join(used.withColumnRenamed("node_id", "b"), "feedback_id").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("usage"))


def strengthen(edges: DataFrame, judged: DataFrame) -> DataFrame:
    """Edges between nodes used together: weight * 1.1 * (1 + 0.05 * usage), at most 5; structural and other ones as they are."""
    # Written first, so its size is known and edges are not shuffled for a small one.
    pairs = cut(used_pairs(judged))
    keyed = edges.withColumns({"a": F.least("from_id", "to_id"), "b": F.greatest("from_id", "to_id")})
    out = keyed.join(pairs, ["a", "b"], "left")
    grown = F.least(F.lit(5.0), F.col("weight") * 1.1 * (1 + 0.05 * F.col("usage")))
    return out.withColumn("weight", F.when(F.col("usage").isNotNull() & business(), grown).otherwise(F.col("weight"))).drop("a", "b", "usage")


def decay(edges: DataFrame, judged: DataFrame) -> DataFrame:
    """Edges at an unused node with weight over 0.1, structural ones spared: * 0.95, at least 0.1."""
    unused = cut(judged.where("verdict = 'unused'").select(F.col("node_id").alias("id")).distinct()).withColumn("hit", F.lit(True))
    out = edges.join(unused.withColumnRenamed("id", "from_id").withColumnRenamed("hit", "f"), "from_id", "left").join(unused.withColumnRenamed("id", "to_id").withColumnRenamed("hit", "t"), "to_id", "left")
    weaker = F.greatest(F.lit(0.1), F.col("weight") * 0.95)
    touched = (F.col("f").isNotNull() | F.col("t").isNotNull()) & (F.col("weight") > 0.1) & business()
    return out.withColumn("weight", F.when(touched, weaker).otherwise(F.col("weight"))).drop("f", "t")


def reweigh(edges: DataFrame, judged: DataFrame, warm_up: int = 40) -> DataFrame:
    """Strengthen, then decay what results, once enough feedback is there."""
    ready = feedback_count(judged).first()["feedbacks"] >= warm_up
    return decay(strengthen(edges, judged), judged) if ready else edges


def bump_dirty(edges: DataFrame, dirty: DataFrame, kinds: tuple[str, ...] = ("RELATES_TO", "CAUSED_BY", "LEADS_TO")) -> DataFrame:
    """Weights * 1.1 within 0.1 and 5 for edges of some types at dirty nodes."""
    hit = dirty.distinct().withColumn("hit", F.lit(True))
    out = edges.join(hit.toDF("from_id", "f"), "from_id", "left").join(hit.toDF("to_id", "t"), "to_id", "left")
    touched = (F.col("f").isNotNull() | F.col("t").isNotNull()) & F.col("type").isin(*kinds)
    return out.withColumn("weight", F.when(touched, scores.clamp(F.col("weight") * 1.1, 0.1, 5.0)).otherwise(F.col("weight"))).drop("f", "t")


def feedback_count(judged: DataFrame) -> DataFrame:
    return judged.agg(F.countDistinct("feedback_id").alias("feedbacks"))


def feedback_stats(judged: DataFrame) -> DataFrame:
    return judged.groupBy("node_id").agg(F.count_if(F.col("verdict") == "used").alias("used"), F.count_if(F.col("verdict") == "unused").alias("unused"), F.max(F.when(F.col("verdict") == "used", F.col("ts"))).alias("last_used"))


def reverse_memory(nodes: DataFrame, judged: DataFrame, least: int = 10, low: float = 0.2, limit: int = 200) -> DataFrame:
    """Nodes whose staleness or state changes by negative memory.

    Unused ``least`` times and of low importance: staleness + 0.1, transitional beyond 0.9
    (at most ``limit`` nodes, most unused first).  Transitional with a later use: current
    again, staleness 0.
    """
    own = nodes.where(active()).join(feedback_stats(judged).withColumnRenamed("node_id", "id"), "id")
    bad = own.where((F.col("unused") >= least) & (F.coalesce("importance_score", F.lit(0.0)) < low)).orderBy(F.col("unused").desc(), "id").limit(limit)
    worse = F.least(F.lit(1.0), F.coalesce("staleness_score", F.lit(0.0)) + 0.1)
    decayed = bad.select("id", F.lit("decay").alias("change"), F.round(worse, 6).alias("staleness"), F.when(worse > 0.9, "transitional").otherwise(F.col("state")).alias("state"))
    back = own.where((F.col("state") == "transitional") & (F.col("last_used") > F.coalesce("updated_at", F.lit(0))))
    return decayed.unionByName(back.select("id", F.lit("recover").alias("change"), F.lit(0.0).alias("staleness"), F.lit("current").alias("state")))


def judge(recalled: DataFrame) -> DataFrame:
    """``verdict`` of each recalled node: used if the reply holds its id, or its name of three characters or more."""
    reply = F.lower("reply")
    named = (F.char_length("name") >= 3) & reply.contains(F.lower("name"))
    return recalled.withColumn("verdict", F.when(F.coalesce(reply.contains(F.lower("node_id")) | named, F.lit(False)), "used").otherwise("unused"))


def judged_rows(feedback: DataFrame) -> DataFrame:
    """One row per (feedback, node) from the used and unused lists; used wins."""
    used = feedback.select(F.col("id").alias("feedback_id"), F.explode(F.array_distinct("used_ids")).alias("node_id"), F.lit("used").alias("verdict"), "ts")
    unused = feedback.select(F.col("id").alias("feedback_id"), F.explode(F.array_except("recalled_ids", "used_ids")).alias("node_id"), F.lit("unused").alias("verdict"), "ts")
    return used.unionByName(unused)


def near_history_gain(history: DataFrame, limit: int = 5) -> DataFrame:
    """Mean of reward * similarity over each query's most similar past queries."""
    best = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "past_id")
    top = history.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= limit)
    return top.groupBy("query_id").agg(F.avg(F.col("reward") * F.col("similarity")).alias("gain"))
