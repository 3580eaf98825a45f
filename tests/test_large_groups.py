"""Queries that need no pair of conflicting parts make none; what they return is as with all pairs."""

from pyspark.sql import functions as F

from skeingraph import plans
from skeingraph.functions import scores, text
from skeingraph.operators import arrays, graph, maintenance, scoring, store, vectors
from skeingraph.plans import graphs, upkeep
from skeingraph.sources import tables as t

SF = "/root/testdata/sf0.001"


def _odd_parts(spark, tmp_path):
    """The tables with parts that repeat, lack a type or size, and conflict by no other edge."""
    for name in ("customer", "orders", "lineitem", "events", "embeddings"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{SF}/{name}.parquet")
    part = t.read(spark, SF, "part")
    last = part.agg(F.max("p_partkey")).first()[0]
    more = part.limit(12).withColumn("p_partkey", F.col("p_partkey") + last + 1).withColumn("p_type", F.lit("lone")).withColumn("p_size", F.lit(7).cast(part.schema["p_size"].dataType))
    lacking = [more.limit(3).withColumn(c, F.lit(None).cast(part.schema[c].dataType)) for c in ("p_type", "p_size")]
    part.unionByName(more).unionByName(more.limit(5)).unionByName(lacking[0]).unionByName(lacking[1]).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    return str(tmp_path)


def test_counts_and_components_are_those_of_all_pairs(spark, tmp_path):
    sf = _odd_parts(spark, tmp_path)
    edges = t.unwritten_edges(spark, sf)
    want = {r["type"]: r["n"] for r in edges.groupBy("type").agg(F.count(F.lit(1)).alias("n")).collect()}
    want["total"] = sum(want.values())
    assert {r["type"]: r["n"] for r in plans.QUERIES["edge_type_counts"](spark, sf).collect()} == want
    whole = sorted(map(tuple, graph.weak_components(t.nodes(spark, sf), edges).collect()))
    assert sorted(map(tuple, plans.QUERIES["weak_components"](spark, sf).collect())) == whole
    rivals = t.links(spark, sf).where("type = 'CONFLICTS_WITH'").count()
    assert rivals < want["CONFLICTS_WITH"] and rivals < t.read(spark, sf, "part").count()


def test_no_edge_is_written_for_queries_that_return_none(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("all edges were written")

    monkeypatch.setattr(t, "edges", refuse)
    assert [tuple(r) for r in plans.QUERIES["cleared_graph"](spark, SF).collect()] == [(0, 0)]
    assert plans.QUERIES["maintenance_incremental"](spark, SF).count() == t.nodes(spark, SF).count()


def test_cliques_stand_for_their_pairs(spark, tmp_path):
    sf = _odd_parts(spark, tmp_path)
    # A part that is in two groups, and two groups that share a part.
    part = t.read(spark, sf, "part")
    other = part.where("p_size = 7 and p_type = 'lone'").limit(2).withColumn("p_type", F.lit("other"))
    (tmp_path / "more").mkdir()
    for name in ("customer", "orders", "lineitem", "events", "embeddings"):
        (tmp_path / "more" / f"{name}.parquet").symlink_to(f"{SF}/{name}.parquet")
    part.unionByName(other).coalesce(1).write.parquet(str(tmp_path / "more" / "part.parquet"))
    sf = str(tmp_path / "more")
    nodes, edges, plain, cliques = t.nodes(spark, sf), t.unwritten_edges(spark, sf), t.plain_edges(spark, sf), t.cliques(spark, sf)
    assert plain.where("type = 'CONFLICTS_WITH'").isEmpty() and cliques.groupBy("id").count().where("count > 1").count() == 2

    def rows(df):
        return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.distinct().collect())

    seeds = nodes.where("id in ('T3', 'S11')").select("id")
    assert rows(graph.pagerank(nodes, plain, seeds, rounds=3, cliques=cliques)) == rows(graph.pagerank(nodes, edges, seeds, rounds=3))
    assert rows(graph.walk(plain, seeds, 2, cliques=cliques)) == rows(graph.walk(edges, seeds, 2))
    labels = graph.label_propagation(nodes, plain, 4, cliques=cliques)
    assert rows(labels) == rows(graph.label_propagation(nodes, edges, 4, stop_early=False))
    once = labels.distinct()
    assert rows(graph.community_links(plain, once, cliques)) == rows(graph.community_links(edges, once))


def test_rounds_over_arrays_are_those_that_shuffle(spark, tmp_path, monkeypatch):
    """Edges to what is no node, loops, parallel edges and nodes without any included; nothing is shuffled in a round."""
    sf = _dense_parts(spark, tmp_path)
    extra = spark.createDataFrame([("S1", "nowhere", "X", 1.0), ("S2", "S2", "X", 1.0), ("S3", "S4", "X", 1.0), ("S4", "S3", "X", 1.0)], "from_id string, to_id string, type string, weight double")
    nodes, plain, cliques = t.nodes(spark, sf).select("id").unionByName(spark.createDataFrame([("alone",)], "id string")), t.plain_edges(spark, sf).unionByName(extra), t.cliques(spark, sf)
    seeds = nodes.where("id in ('T3', 'S2')")

    def found():
        labels = [sorted(map(tuple, graph.label_propagation(nodes, plain, k, cliques=cliques).collect())) for k in (1, 5)]
        whole = graph.pagerank(nodes, plain, rounds=3, cliques=cliques), graph.pagerank(nodes, plain, seeds, rounds=2)
        return labels, [sorted((r["id"], f"{r['rank']:.9f}") for r in df.collect()) for df in whole]

    monkeypatch.setattr(arrays, "STEPS", 100)
    with monkeypatch.context() as m:
        m.setattr(graph, "partitioned", None)
        got = found()
    monkeypatch.setattr(arrays, "MOST", 0)
    assert got == found()


def test_labels_that_take_turns_end_the_rounds(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    edges = spark.createDataFrame([("a", "b")], "from_id string, to_id string")
    for rounds in (4, 5, 300, 301):
        want = {"a": "ab"[rounds % 2], "b": "ba"[rounds % 2]}
        assert {r["id"]: r["label"] for r in graph.label_propagation(nodes, edges, rounds).collect()} == want


def test_queries_of_every_edge_write_no_copy_of_them(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("all edges were written")

    monkeypatch.setattr(t, "edges", refuse)
    n = t.unwritten_edges(spark, SF).count()
    for name in ("edge_ids", "edge_projection", "edge_decay", "edge_strengthen", "conflict_faded"):
        assert plans.QUERIES[name](spark, SF).count() == n
    assert not plans.QUERIES["conflict_merged_nodes"](spark, SF).isEmpty() and not plans.QUERIES["conflict_merged_edges"](spark, SF).isEmpty()


def test_edge_ids_hash_a_part_once_and_are_those_of_the_whole_text(spark, tmp_path, monkeypatch):
    sf = _odd_parts(spark, tmp_path)
    edges = t.unwritten_edges(spark, sf)
    want = sorted(map(tuple, edges.select("from_id", "to_id", "type", text.edge_id(F.col("from_id"), F.col("to_id"), F.col("type"))).collect()))
    monkeypatch.setattr(t, "unwritten_edges", None)
    assert sorted(map(tuple, plans.QUERIES["edge_ids"](spark, sf).collect())) == want


def _named(spark):
    """Nodes that conflict in many ways, some by nulls."""
    k = F.col("id")
    nulls = F.lit(None)
    return spark.range(400).select(
        F.format_string("n%03d", k).alias("id"), F.when(k % 41 != 0, F.concat(F.lit("name"), k % 3)).alias("name"), F.when(k % 5 == 0, "TASK").otherwise("SKILL").alias("type"), F.lit("x").alias("content"),
        F.when(k % 13 != 0, "active").alias("status"), F.when(k % 7 == 0, "transitional").when(k % 11 != 0, "current").alias("state"), F.when(k % 4 == 0, nulls).otherwise((k % 2) * 100).cast("long").alias("valid_from"),
        F.when(k % 3 == 0, "knowledge").when(k % 6 != 1, "experience").alias("source"), F.when(k % 17 != 0, k % 6).cast("long").alias("validated_count"), F.when(k % 19 != 0, k % 10 / 10).alias("staleness_score"),
    )


def test_merging_makes_no_pairs_and_finds_those_of_all_pairs(spark, monkeypatch):
    nodes = _named(spark)
    decided = scoring.conflict_winner(scoring.conflict_candidates(nodes))
    want = decided.where("reason = 'merge'").groupBy("loser_id").agg(F.min("winner_id")).collect()
    assert len(want) > 20 and sorted(map(tuple, scoring.merging(nodes).collect())) == sorted(map(tuple, want))
    monkeypatch.setattr(scoring, "conflict_candidates", None)
    plans.QUERIES["conflict_merged_nodes"](spark, SF)


def test_first_candidates_are_those_of_all_pairs(spark):
    nodes = _named(spark)
    every = sorted((r["a_id"], r["b_id"]) for r in scoring.conflict_candidates(nodes).select("a_id", "b_id").collect())
    for limit in (1, 7, 500, 10**6):
        found = scoring.conflict_candidates(nodes, limit)
        assert [(r["a_id"], r["b_id"]) for r in found.select("a_id", "b_id").collect()] == every[:limit]


def test_nearest_is_that_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TILE", 16)
    rows = [(i, None if i % 29 == 0 else [] if i % 31 == 0 else [1.0, None, 2.0, 0.0] if i % 23 == 0 else [0.0] * 4 if i % 37 == 0 else [float("nan"), 1.0, 1.0, 1.0] if i == 50 else [1.0, 2.0][: i % 19] if i % 19 == 2 else [float(i % 3), float(i * 7 % 5 - 2), i * 11 % 13 / 3, 1.0]) for i in range(200)]
    every = spark.createDataFrame(rows, "id long, v array<double>")
    asked, past = every.where("id % 5 = 0").toDF("query_id", "q"), every.where("id % 5 <> 0").toDF("past_id", "p").withColumn("reward", F.col("past_id") % 7 / 7)
    whole = scoring.near_history_gain(past.crossJoin(asked).withColumn("similarity", scores.cosine(F.col("q"), F.col("p"))))
    tiled = scoring.near_history_gain(vectors.nearest(asked, past, 5).join(past.select("past_id", "reward"), "past_id"))
    assert sorted((r[0], f"{r[1]:.12f}") for r in tiled.collect()) == sorted((r[0], f"{r[1]:.12f}") for r in whole.collect())


def _dense_parts(spark, tmp_path):
    """The tables with parts of few types and sizes, so merged and kept parts meet in many groups; some parts repeat or are in two groups."""
    for name in ("customer", "orders", "lineitem", "events", "embeddings"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{SF}/{name}.parquet")
    part, key = t.read(spark, SF, "part"), F.col("p_partkey")
    size = part.schema["p_size"].dataType
    dense = part.withColumns({"p_size": (F.floor(key / 3) % 4).cast(size), "p_type": F.concat(F.lit("t"), key % 2)})
    twice = dense.where(key % 10 == 4).unionByName(dense.where(key % 20 == 0).withColumn("p_size", F.lit(3).cast(size)))
    dense.unionByName(twice).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    return str(tmp_path)


def test_merge_redirect_groups_only_edges_that_meet(spark, tmp_path, monkeypatch):
    sf = _dense_parts(spark, tmp_path)
    n = F.substring("id", 2, 9).cast("int")
    pairs = t.skills(spark, sf).where(n % 10 == 1).select(F.col("id").alias("merge_id"), F.concat(F.lit("S"), n - 1).alias("keep_id"))
    told = F.when(F.col("weight") > 1, "often").when(F.col("type") == "PATCHES", F.concat(F.lit("patch "), "to_id"))
    whole = store.merge_redirect(t.structural(t.unwritten_edges(spark, sf)).withColumn("instruction", told), pairs).withColumn("weight", F.round("weight", 6))
    want = sorted(map(str, whole.collect()))

    def refuse(*_):
        raise AssertionError("all edges were written")

    monkeypatch.setattr(t, "edges", refuse)
    assert sorted(map(str, plans.QUERIES["merge_redirect"](spark, sf).collect())) == want
    alone = t.rival_edges(spark, sf, pairs).where("alone")
    ends = t.rival_edges(spark, sf, pairs).select(F.coalesce("keep_from", "from_id").alias("a"), F.coalesce("keep_to", "to_id").alias("b")).groupBy("a", "b").count()
    met = alone.select(F.coalesce("keep_from", "from_id").alias("a"), F.coalesce("keep_to", "to_id").alias("b")).join(ends, ["a", "b"])
    assert ends.where("count > 1").count() > 50 and met.where("count > 1").isEmpty() and met.count() > ends.count() / 2


def test_hierarchy_makes_no_pairs_and_is_that_of_all_edges(spark, tmp_path, monkeypatch):
    sf = _dense_parts(spark, tmp_path)
    every = t.unwritten_edges(spark, sf)
    monkeypatch.setattr(graphs, "_ROUNDS", 2)
    labels = graph.label_propagation(t.nodes(spark, sf), every, 2)
    topics = graph.hierarchy_level(graph.community_links(every, labels), labels)
    above = labels.join(topics, "label").select("id", F.col("cluster").alias("label"))
    domains = graph.hierarchy_level(graph.community_links(every, above), above).toDF("topic", "domain")
    want = sorted(map(tuple, topics.withColumnRenamed("cluster", "topic").join(domains, "topic").select("label", "topic", "domain").collect()))

    def refuse(*_):
        raise AssertionError("all edges were written")

    monkeypatch.setattr(t, "edges", refuse)
    assert sorted(map(tuple, plans.QUERIES["hierarchy"](spark, sf).collect())) == want


def test_maintenance_counts_groups_and_its_nodes_are_those_of_all_pairs(spark, tmp_path, monkeypatch):
    sf = _odd_parts(spark, tmp_path)
    every = t.unwritten_edges(spark, sf)
    got, want = (sorted(map(tuple, scoring.in_degree(*e).where("in_degree > 0").collect())) for e in ((t.plain_edges(spark, sf), t.cliques(spark, sf)), (every,)))
    assert got == want

    def refuse(*_):
        raise AssertionError("all edges were written")

    monkeypatch.setattr(t, "edges", refuse)
    run, short = maintenance.run, maintenance.Phases(pagerank_rounds=2, label_rounds=2)
    monkeypatch.setattr(maintenance, "run", lambda state, now_ms: run(state, now_ms, short))
    counted = plans.QUERIES["maintenance_full"](spark, sf)
    whole = maintenance.run(upkeep._whole(spark, sf, t.unwritten_edges), t.PART_NOW)[0].nodes
    rounded = [F.round(c, 5).alias(c) for c in ("pagerank", "staleness_score", "importance_score")]
    assert sorted(map(str, counted.collect())) == sorted(map(str, whole.select("id", "community_id", "state", *rounded).collect()))
    # Merged nodes make edges that no group stands for.
    near = spark.createDataFrame([("S1", [1.0, 0.0]), ("S2", [1.0, 0.01])], "id string, embedding array<double>")
    state = maintenance.GraphState(t.nodes(spark, sf), every, embeddings=near, plain=t.plain_edges(spark, sf), cliques=t.cliques(spark, sf))
    merged = maintenance.merge_duplicates(state, 7)
    assert merged.cliques is None and merged.edges.count() > every.distinct().count()


def test_decided_pairs_are_those_of_all_candidates(spark, monkeypatch):
    monkeypatch.setattr(scoring, "TILE", 8)
    nodes = _named(spark).withColumn("source", F.when(F.substring("id", 2, 3).cast("int") % 4 == 1, "knowledge").otherwise(F.col("source")))
    whole, tiled = scoring.conflict_winner(scoring.conflict_candidates(nodes)), scoring.decided_pairs(nodes)
    asked = ["a_id", "b_id", "reason", "winner_id", "loser_id"]
    want = sorted(map(tuple, whole.select(*asked).collect()))
    assert len(want) > 1000 and {r[2] for r in want} == {"temporal", "source", "confidence", "merge"}
    assert sorted(map(tuple, tiled.select(*asked).collect())) == want
    assert sorted(map(tuple, scoring.conflict_decisions(tiled, 5).collect())) == sorted(map(tuple, scoring.conflict_decisions(whole, 5).collect()))

    def refuse(*_):
        raise AssertionError("all nodes were written")

    monkeypatch.setattr(t, "nodes", refuse)
    for name in ("conflict_winners", "conflict_decisions"):
        assert not plans.QUERIES[name](spark, SF).isEmpty()


def test_conflicts_are_resolved_for_all_pairs_and_none_is_made(spark, monkeypatch):
    """Far more than a hundred pairs, which is where faded edges and maintenance stopped before."""
    nodes = _named(spark).withColumn("source", F.when(F.substring("id", 2, 3).cast("int") % 4 == 1, "knowledge").otherwise(F.col("source")))
    decided = scoring.conflict_winner(scoring.conflict_candidates(nodes))
    want = {kind: sorted(map(tuple, decided.where(f"reason {'=' if kind else '<>'} 'merge'").groupBy("loser_id").agg(F.min("winner_id")).collect())) for kind in (True, False)}
    assert len(want[True]) > 20 and len(want[False]) > 100
    got = scoring.resolved(nodes)
    for kind in want:
        assert sorted(map(tuple, got.where(f"reason {'=' if kind else '<>'} 'merge'").select("loser_id", "winner_id").collect())) == want[kind]
    whole = nodes.withColumns({"valid_to": F.lit(None).cast("long"), "superseded_by": F.lit(None).cast("string")})
    ids = [r["id"] for r in nodes.orderBy("id").select("id").collect()]
    edges = spark.createDataFrame([(a, b, "CAUSED_BY", 1.0) for a, b in zip(ids, ids[1:] + ids[:1], strict=True)], "from_id string, to_id string, type string, weight double")
    applied = scoring.apply_conflicts(whole, decided, 77).select(*whole.columns)
    every = [sorted(map(str, df.collect())) for df in scoring.merge_conflicts(applied, scoring.fade_losers(edges, decided), decided)]
    monkeypatch.setattr(scoring, "conflict_candidates", None)
    state = maintenance.resolve_conflicts(maintenance.GraphState(whole, edges), 77)
    assert [sorted(map(str, df.collect())) for df in (state.nodes, state.edges)] == every


def test_faded_edges_are_those_of_the_losers_of_all_pairs(spark, tmp_path):
    sf = _odd_parts(spark, tmp_path)
    decided = scoring.conflict_winner(scoring.conflict_candidates(t.nodes(spark, sf)))
    assert decided.where("reason <> 'merge'").count() > 100
    whole = scoring.fade_losers(t.structural(t.unwritten_edges(spark, sf)), decided).withColumn("weight", F.round("weight", 6))
    want = sorted(map(tuple, whole.select("from_id", "to_id", "type", "weight").collect()))
    assert sorted(map(tuple, plans.QUERIES["conflict_faded"](spark, sf).collect())) == want


def test_merged_edges_look_up_no_pair_and_are_those_of_all_edges(spark, tmp_path, monkeypatch):
    sf = _dense_parts(spark, tmp_path)
    n = F.substring("id", 2, 9).cast("int")
    # Many merges, also into later parts and of parts that repeat or are in two groups.
    mapping = t.skills(spark, sf).select("id").distinct().where(n % 5 < 2).select(F.col("id").alias("merge_id"), F.concat(F.lit("S"), n - n % 5 + 2 + n % 2).alias("keep_id"))
    monkeypatch.setattr(store, "merge_targets", lambda pairs: mapping)
    whole = scoring.merged_edges(t.structural(t.unwritten_edges(spark, sf)), mapping).withColumn("weight", F.round("weight", 6))
    want = sorted(map(tuple, whole.select("from_id", "to_id", "type", "weight").collect()))
    assert {r[3] for r in want if r[2] == "CONFLICTS_WITH"} == {0.5, 1.0}
    monkeypatch.setattr(t, "unwritten_edges", None)
    assert sorted(map(tuple, plans.QUERIES["conflict_merged_edges"](spark, sf).collect())) == want
    pairs, rest = t.merged_rivals(spark, sf, mapping)
    assert pairs.where("left").count() > 100 and pairs.where("copied and not left").count() > 100 and not rest.isEmpty()
