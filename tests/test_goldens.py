"""Hand-computed cases of the scores, metrics, merges and state holders."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeingraph.functions import matrix, scores, text
from skeingraph.operators import evaluate, graph, ingest, scoring, store, vectors
from skeingraph.streaming.driver_state import Breaker, RecallRecords, TimedCache

DAY = 86_400_000
NOW = 1_706_745_600_000


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("state", "age", "degree", "source", "expected"),
    [("superseded", 0, 5, "experience", 1.0), ("current", 400, 5, "experience", 0.8), ("current", None, 0, "experience", 0.2), ("current", 0, 5, "knowledge", 0.0), ("current", 67.5, 1, "experience", 0.2)],
)
def test_staleness(spark, state, age, degree, source, expected):
    updated = F.lit(None).cast("bigint") if age is None else F.lit(int(NOW - age * DAY))
    assert value(spark, scores.staleness(F.lit(state), updated, F.lit(degree), F.lit(source), NOW)) == pytest.approx(expected)


def test_recency_and_rank(spark):
    def recency(age, valid_to=None, state="current"):
        return value(spark, scores.temporal_recency(F.lit(NOW - age * DAY), F.lit(valid_to).cast("bigint"), F.lit(state), NOW))

    assert recency(0) == 1.0 and recency(0, NOW - 1) == 0.0 and recency(0, None, "superseded") == 0.0 and recency(0, None, "transitional") == 0.0
    assert recency(300) == pytest.approx(math.exp(-10))
    high = value(spark, scores.combined(F.lit(0.9), F.lit(0.1), F.lit(0.0), F.lit(0.0), 0.0))
    assert high > value(spark, scores.combined(F.lit(0.1), F.lit(0.9), F.lit(0.0), F.lit(0.0), 0.0))


def test_cosine(spark):
    def cos(a, b):
        return value(spark, scores.cosine(F.array(*map(F.lit, a)), F.array(*map(F.lit, b))))

    assert cos([1.0, 2.0], [1.0, 2.0]) == pytest.approx(1) and cos([1.0, 0.0], [0.0, 1.0]) == 0 and cos([1.0], [1.0, 0.0]) == 0 and cos([0.0], [1.0]) == 0


def test_chunk_similarity(spark):
    rows = spark.createDataFrame([("a", [[0.0, 1.0, 0.0], [1.0, 1.0, 0.0]], None), ("b", None, None)], "id string, chunk_embeddings array<array<double>>, embedding array<double>")
    got = vectors.chunk_similarity(rows, [1.0, 0.0, 0.0]).collect()
    assert [(r["id"], round(r["similarity"], 4)) for r in got] == [("a", 0.7071)]


@pytest.mark.parametrize(("a", "b", "f1"), [("Alice works at ACME", "Bob studies at MIT", 0.25), ("cat cat cat", "cat dog", 2 / 3), ("Alice!", "alice", 1.0), ("我 你", "我 他", 0.5), ("", "x", 0.0)])
def test_token_f1(spark, a, b, f1):
    assert value(spark, text.token_f1(F.lit(a), F.lit(b))) == pytest.approx(f1)


def test_chunks(spark):
    long = "".join(chr(97 + i % 26) for i in range(1000))
    parts = value(spark, text.chunks(F.lit(long)))
    assert all(len(p) <= 400 for p in parts) and all(b.startswith(a[-40:]) for a, b in zip(parts, parts[1:], strict=False)) and parts[-1].endswith(long[-1])
    assert value(spark, text.chunks(F.lit(""))) == []


def test_stable_id(spark):
    def fnv(s):
        h = 2166136261
        for c in s:
            h = (h ^ ord(c)) * 16777619 & 0xFFFFFFFF
        return h

    assert value(spark, text.node_id(F.lit("TASK"), F.lit("make tea"))) == f"gn-{fnv('TASK|make tea'):x}"


def test_percentiles_histogram_mrr(spark):
    ten = spark.createDataFrame([("p", float(i)) for i in range(1, 11)], "phase string, ms double")
    row = evaluate.percentiles(ten, "phase", "ms").first()
    assert (row["p50"], row["p90"], row["p99"]) == (5, 9, 10)
    three = spark.createDataFrame([(3.0,), (8.0,), (25.0,)], "ms double")
    assert [r["n"] for r in evaluate.histogram(three, "ms", [5.0, 10.0, 20.0]).orderBy("bucket").collect()] == [1, 1, 0, 1]
    ranks = spark.createDataFrame([("d", 1), ("d", 2), ("d", None), ("d", 3)], "dataset string, first_rank int")
    row = evaluate.report(ranks, ["dataset"]).first()
    assert row["mrr"] == pytest.approx(11 / 24) and row["p1"] == 0.25


def test_usage(spark):
    calls = spark.createDataFrame([("ollama", "extract", 100, 50), ("ollama", "extract", 200, 100)], "provider string, purpose string, prompt_tokens long, completion_tokens long")
    assert {(r["level"], r["calls"], r["total"]) for r in evaluate.usage(calls).collect()} == {("provider", 2, 450), ("purpose", 2, 450), ("total", 2, 450)}


def test_pairing(spark):
    def pairs(*turns, after=0):
        rows = spark.createDataFrame([(str(i), "s", i, r, f"{r}{i}") for i, r in enumerate(turns)], "id string, session_key string, turn long, role string, content string")
        return [(r["user"], r["assistant"]) for r in ingest.turn_pairs(rows, after).orderBy("pair").collect()]

    assert len(pairs("user", "assistant", "user", "assistant")) == 2 and pairs("assistant") == []
    assert pairs("Human", "user", "AI", "user") == [("Human0", ""), ("user1", "AI2")]
    assert len(pairs("user", "assistant", "user", "assistant", after=1)) == 1


_SIDES = [("type", "string"), ("valid_from", "long"), ("source", "string"), ("validated_count", "long"), ("staleness_score", "double")]


def _pair(spark, a, b, kinds=("TASK", "TASK")):
    columns = "a_id string, b_id string, " + ", ".join(f"{s}_{c} {t}" for s in "ab" for c, t in _SIDES)
    return spark.createDataFrame([("a", "b", kinds[0], *a, kinds[1], *b)], columns)


def test_conflicts(spark):
    def winner(a, b, **kw):
        got = scoring.conflict_winner(_pair(spark, a, b), **kw).first()
        return got["winner_id"], got["reason"]

    assert winner((1000, "experience", 1, 0.0), (2000, "experience", 1, 0.0)) == ("b", "temporal")
    assert winner((1, "experience", 1, 0.0), (1, "knowledge", 1, 0.0)) == ("b", "source")
    assert winner((1, "experience", 10, 0.0), (1, "experience", 20, 0.0)) == ("b", "confidence")
    assert winner((1, "experience", 10, 0.5), (1, "experience", 12, 0.1)) == ("b", "merge")
    assert winner((1, None, 10, 0.0), (None, "experience", 10, 0.0)) == ("a", "temporal")
    assert winner((1, "experience", 1, 0.0), (2, "experience", 1, 0.0), temporal=False) == ("a", "temporal")
    assert winner((1, "experience", 10, 0.0), (1, "knowledge", 20, 0.0), source=False) == ("b", "confidence")
    assert scoring.conflict_winner(_pair(spark, (1, "x", 1, 0.0), (2, "x", 1, 0.0), ("TASK", "SKILL"))).count() == 0


def test_conflict_candidates_follow_the_open_sides(spark):
    rows = [("a", "n", "current", 0.0), ("b", "n", "transitional", 0.0), ("c", "n", "current", 0.0), ("d", "m", "current", 0.7), ("e", "m", "current", 0.8), ("f", "k", "current", 0.0), ("g", "k", "current", 0.0)]
    nodes = spark.createDataFrame([(i, n, "TASK", "", s, 0, "experience", 1, x, "active") for i, n, s, x in rows], "id string, name string, type string, content string, state string, valid_from long, source string, validated_count long, staleness_score double, status string")
    assert [(r["a_id"], r["b_id"]) for r in scoring.conflict_candidates(nodes, 100).collect()] == [("a", "b"), ("b", "c"), ("d", "e")]


def test_conflict_effects(spark):
    nodes = spark.createDataFrame([("a", "one", 10, "transitional", 0.5, 5), ("b", "two", 12, "current", 0.1, None), ("c", "other", 1, "current", 0.0, 9)], "id string, content string, validated_count long, state string, staleness_score double, valid_to long")
    edges = spark.createDataFrame([("a", "x", "R", 1.0), ("b", "x", "R", 2.0), ("a", "y", "R", 4.0), ("a", "z", "CONTAINS", 4.0), ("q", "a", "R", 1.0)], "from_id string, to_id string, type string, weight double")
    merge = spark.createDataFrame([("b", "a", "merge")], "winner_id string, loser_id string, reason string")
    kept, left = scoring.merge_conflicts(nodes, edges, merge)
    got = {r["id"]: (r["content"], r["validated_count"], r["state"], r["staleness_score"]) for r in kept.collect()}
    assert got == {"b": ("one\n---\ntwo", 22, "current", 0.0), "c": ("other", 1, "current", 0.0)}
    assert {(r["from_id"], r["to_id"], r["weight"]) for r in left.collect()} == {("b", "x", 1.0), ("b", "y", 0.5)}
    lost = spark.createDataFrame([("b", "a", "source")], "winner_id string, loser_id string, reason string")
    after = {r["id"]: (r["state"], r["valid_to"], r["superseded_by"], r["staleness_score"]) for r in scoring.apply_conflicts(nodes, lost, 77).collect()}
    assert after == {"a": ("superseded", 77, "b", 1.0), "b": ("current", None, None, 0.1), "c": ("current", 9, None, 0.0)}
    faded = {(r["from_id"], r["to_id"]): round(r["weight"], 6) for r in scoring.fade_losers(edges, lost).collect()}
    assert faded == {("a", "x"): 0.1, ("b", "x"): 2.0, ("a", "y"): 0.4, ("a", "z"): 4.0, ("q", "a"): 1.0}


def test_judge(spark):
    rows = spark.createDataFrame([("n1", "tea", "I used N1 here"), ("x", "Green Tea", "green tea it is"), ("y", "ab", "ab ab")], "node_id string, name string, reply string")
    assert [r["verdict"] for r in scoring.judge(rows).collect()] == ["used", "used", "unused"]


def test_merge(spark):
    edges = spark.createDataFrame([("b", "x", "R", 1.0), ("a", "x", "R", 2.0), ("a", "b", "R", 1.0)], "from_id string, to_id string, type string, weight double")
    pairs = spark.createDataFrame([("b", "a")], "merge_id string, keep_id string")
    got = {(r["from_id"], r["to_id"], r["weight"]) for r in store.merge_redirect(edges, pairs).collect()}
    assert got == {("a", "x", 3.0), ("b", "x", 0.1), ("a", "b", 0.1)}
    told = spark.createDataFrame([("b", "x", "R", 1.0, "one"), ("a", "x", "R", 2.0, "two"), ("b", "c", "MENTIONS", 3.0, None)], "from_id string, to_id string, type string, weight double, instruction string")
    got = {(r["from_id"], r["to_id"], r["weight"], r["instruction"]) for r in store.merge_redirect(told, pairs).collect()}
    assert got == {("a", "x", 3.0, "two | one"), ("b", "x", 0.1, "one"), ("a", "c", 3.0, None), ("b", "c", 3.0, None)}
    with pytest.raises(ValueError):
        store.merge_targets(spark.createDataFrame([("c", "b"), ("b", "c")], "merge_id string, keep_id string"))
    chain = spark.createDataFrame([("c", "b"), ("b", "a")], "merge_id string, keep_id string")
    assert {(r[0], r[1]) for r in store.merge_targets(chain).collect()} == {("c", "a"), ("b", "a")}


def test_tolerant_times(spark):
    rows = spark.createDataFrame([("1000",), ("1970-01-01T00:00:02Z",), ("soon",)], "t string")
    assert [r[0] for r in rows.select(store.tolerant_millis(F.col("t"))).collect()] == [1000, 2000, None]


def test_graph_loops(spark):
    nodes = spark.createDataFrame([(c,) for c in "abcdz"], "id string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "from_id string, to_id string")
    assert {(r["id"], r["distance"]) for r in graph.walk(edges, nodes.where("id in ('a', 'z')"), 2).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    near, rank = {"a": "b", "b": "ac", "c": "bd", "d": "c", "z": ""}, dict.fromkeys("abcdz", 0.15)
    for _ in range(7):
        rank = {v: 0.15 + 0.85 * sum(rank[u] / len(near[u]) for u in near[v]) for v in near}
    got = {r["id"]: r["rank"] for r in graph.pagerank(nodes, edges, rounds=7).collect()}
    assert got == pytest.approx(rank)
    labels = {r["id"]: r["label"] for r in graph.label_propagation(nodes, edges, 6).collect()}
    assert labels["z"] == "z" and set(labels) == set("abcdz")
    links = spark.createDataFrame([("a", "b", 3), ("c", "d", 2), ("b", "c", 1)], "a string, b string, weight long")
    four = spark.createDataFrame([(c, c) for c in "abcd"], "id string, label string")
    assert {(r["label"], r["cluster"]) for r in graph.hierarchy_level(links, four).collect()} == {("a", "h-1"), ("b", "h-1"), ("c", "h-2"), ("d", "h-2")}


def test_matrix():
    cold = matrix.Association(2)
    assert list(cold.transform([1.0, 2.0])) == [1.0, 2.0]
    learner = matrix.Association(2, least_gain=0.0)
    q = np.array([1.0, 0.0])
    assert learner.learn(q, q, 1.0) and not learner.learn(q, q, -1.0)
    assert not matrix.Association(2, least_gain=0.5).learn(q, q, 0.3)
    learner.feedback, learner.row_scale = 50, np.array([1.0, 2.0])
    again = matrix.Association.load(learner.dump())
    probe = np.array([0.3, -0.7])
    assert (again.transform(probe) == learner.transform(probe)).all() and again.learn(probe, q, 2.0) and learner.learn(probe, q, 2.0)
    assert (again.m == learner.m).all() and (again.mean == learner.mean).all()
    zero = matrix.Association(2)
    zero.m = np.zeros((2, 2))
    assert (matrix.Association.load(zero.dump()).m == np.eye(2)).all()


def test_driver_state():
    cache = TimedCache(size=2, ttl_ms=10)
    for i in range(3):
        cache.put(i, i, 0)
    assert cache.get(0, 1) is None and cache.get(2, 1) == 2 and cache.get(2, 10) is None
    breaker = Breaker(failures=1, pause_ms=10)
    with pytest.raises(ZeroDivisionError):
        breaker.call(lambda: 1 / 0, 0)
    with pytest.raises(RuntimeError):
        breaker.call(lambda: 1, 5)
    assert breaker.call(lambda: 1, 11) == 1
    records = RecallRecords()
    records.add("s", "q1", ["a", "b"], 0)
    records.add("s", "q2", ["b", "c"], 1)
    assert records.silent(90_001) == ["s"] and records.consume("s", 2) == ("q2", ["a", "b", "c"]) and records.consume("s", 2) is None
