"""Streams that resume, keyed state, services, evaluation within cases, whole-graph loops against brute force."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeingraph.functions import matrix, text
from skeingraph.operators import cases, components, evaluate, graph, maintenance, recall, search, services, store
from skeingraph.sources import files
from skeingraph.streaming import conversations as streams
from skeingraph.streaming.driver_state import Memo


def _write(spark, folder, name, rows):
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{folder}/in/{name}")


def test_a_stream_goes_on_where_it_failed(spark, tmp_path):
    """The second file's batch fails once; the run after it takes that batch again and nothing twice."""
    _write(spark, tmp_path, "a", [(1, 0, "user", "q0")])
    read = lambda: streams.message_stream(spark, f"{tmp_path}/in/*", 1)
    folder, seen, broken = f"{tmp_path}/run", [], [True]

    def refresh(rows, number):
        got = [r["content"] for r in rows.collect()]
        if "a1" in got and broken.pop() if broken else False:
            raise RuntimeError("lost")
        seen.append((number, got))

    streams.each_batch(read(), refresh, folder)
    _write(spark, tmp_path, "b", [(1, 1, "assistant", "a1")])
    with pytest.raises(Exception, match="lost"):
        streams.each_batch(read(), refresh, folder)
    streams.each_batch(read(), refresh, folder)
    assert [x for _, x in seen] == [["q0"], ["a1"]] and len({n for n, _ in seen}) == 2


def test_pairs_resume_with_their_state(spark, tmp_path):
    _write(spark, tmp_path, "a", [(1, 0, "user", "q0"), (1, 1, "assistant", "a0"), (1, 2, "user", "q1")])
    run = lambda: streams.drain(streams.stream_turn_pairs(streams.message_stream(spark, f"{tmp_path}/in/*")), folder=f"{tmp_path}/run")
    assert [(r["pair"], r["user"], r["assistant"]) for r in run().collect()] == [(1, "q0", "a0")]
    _write(spark, tmp_path, "b", [(1, 3, "assistant", "a1")])
    assert sorted((r["pair"], r["user"], r["assistant"]) for r in run().collect()) == [(1, "q0", "a0"), (2, "q1", "a1")]


def test_recalls_by_session(spark, tmp_path):
    rows = [("s", 10 * i, "recall", f"q{i}", [f"n{i}", "n0"]) for i in range(7)] + [("s", 100, "end", None, []), ("s", 110, "end", None, []), ("t", 0, "recall", "old", ["x"]), ("t", 5000, "recall", "new", ["y"]), ("t", 5001, "end", None, [])]
    spark.createDataFrame(rows, streams.RECALL).coalesce(1).write.parquet(f"{tmp_path}/in")
    events = spark.readStream.schema(streams.RECALL).parquet(f"{tmp_path}/in")
    got = {r["session_key"]: (r["ts"], r["query"], r["ids"]) for r in streams.drain(streams.stream_recalls(events, 5, 1000)).collect()}
    assert got == {"s": (100, "q6", ["n2", "n0", "n3", "n4", "n5", "n6"]), "t": (5001, "new", ["y"])}


def test_queue_stream(spark, tmp_path):
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "a.jsonl").write_text("\n".join([json.dumps({"session_key": "s", "turn": 1, "role": "user", "content": "x"}), "{bad"]))
    got = streams.drain(files.queue_stream(spark, f"{tmp_path}/q"), folder=f"{tmp_path}/run").where("session_key is not null").collect()
    assert [(r["session_key"], r["content"]) for r in got] == [("s", "x")]


def test_online_learning(spark, tmp_path):
    rows = [(k, [1.0, float(k % 2)], [0.5, 1.0], 1.0 - k / 10) for k in range(6)]
    spark.createDataFrame(rows, "ts long, query array<double>, target array<double>, reward double").repartition(3).write.parquet(f"{tmp_path}/in")
    one, two = matrix.Association(2), matrix.Association(2)
    streams.learn_from(spark.readStream.schema("ts long, query array<double>, target array<double>, reward double").parquet(f"{tmp_path}/in"), one)
    for _, q, target, reward in rows:
        two.learn(np.array(q), np.array(target), reward)
    assert np.allclose(one.m, two.m) and one.feedback == 6


def test_services(spark):
    rows = spark.createDataFrame([("n1", "Green Tea", "all about green tea", 1), ("n2", "Coffee", "nothing", 2), ("n3", "Tea", "tea", 11)], "node_id string, name string, reply string, place int")

    def yes(prompts):
        return ["unused" for _ in prompts]

    def broken(prompts):
        raise OSError("down")

    services.register_judge("model", services.model_judge(yes))
    services.register_judge("down", services.model_judge(broken))
    said = {n: {r["node_id"]: r["verdict"] for r in services.judge(rows, n).collect()} for n in ("heuristic", "model", "down", "unknown")}
    assert said["heuristic"] == said["down"] == said["unknown"] == {"n1": "used", "n2": "unused", "n3": "used"}
    assert said["model"] == {"n1": "unused", "n2": "unused", "n3": "used"}
    members = spark.createDataFrame([("c", 2, "b", "SKILL", None), ("c", 1, "a", "TASK", "x")], "community_id string, place int, name string, type string, description string")
    assert [r["prompt"] for r in services.summary_prompts(members).collect()] == ["[TASK] a: x\n[SKILL] b: "]
    memo = Memo(lambda x: x * 2)
    assert [memo(2), memo(2), memo(3)] == [4, 4, 6] and memo.calls == 2


def test_sample_cases(spark):
    known = cases.sample_cases(spark)
    results = cases.case_results(known, cases.rank_in_cases(known)).collect()
    assert len(results) == 10 and all(r["hit1"] and r["rr"] == 1.0 and r["f1"] > 0.3 for r in results)
    none = cases.case_results(known, cases.rank_in_cases(known).limit(0)).collect()
    assert all(not r["hit1"] and r["rr"] == 0.0 and r["recalled"] == 0 and r["f1"] == 0.0 for r in none)


def test_metrics_text(spark):
    rows = spark.createDataFrame([("nodes", "TASK", 3.0), ("nodes", "SKILL", 2.0), ("edges", "", 7.5)], "name string, label string, value double")
    assert evaluate.metrics_text(rows, "g") == '# TYPE g_edges gauge\ng_edges 7.5\n# TYPE g_nodes gauge\ng_nodes{kind="SKILL"} 2\ng_nodes{kind="TASK"} 3\n'


def test_settings():
    base = {"phases": {"dedup": True, "pagerank": True}, "limit": 5}
    new = maintenance.merge_settings(base, {"phases": {"dedup": False}, "limit": None, "name": "x"})
    assert new == {"phases": {"dedup": False, "pagerank": True}, "limit": 5, "name": "x"} and maintenance.changed_settings(base, new) == ["name", "phases.dedup"]
    assert maintenance.phases_from(new["phases"]).dedup is False
    with pytest.raises(ValueError):
        maintenance.phases_from({"dedupe": True})
    assert [store.clamped("depth", v) for v in (None, 0, 3, 99)] == [5, 1, 3, 5]


def test_similar_cache(spark):
    rows = spark.createDataFrame([("k", 5, [1.0, 0.0], [("n", 1.0)])], "key string, ts long, vector array<double>, nodes array<struct<id:string,pagerank:double>>")
    got = recall.similar_cached(rows, [0.6, 0.8], least=0.5).first()
    assert got["id"] == "n" and got["pagerank"] == pytest.approx(0.42) and recall.similar_cached(rows, [0.6, 0.8]).count() == 0


def test_search_splits_cjk(spark):
    rows = spark.createDataFrame([("a", "图数据库 engine v2"), ("b", "数据 engine"), ("c", "库")], "id string, content string")
    got = {r["id"]: r["t"] for r in rows.select("id", text.search_tokens(F.col("content")).alias("t")).collect()}
    assert got == {"a": ["图数", "数据", "据库", "engine", "v2"], "b": ["数据", "engine"], "c": ["库"]}
    assert {r["id"] for r in search.bm25(rows, "数据", 5).collect()} == {"a", "b"}


def test_components_and_forest(spark):
    draw = random.Random(4)
    ids = [f"n{i:02d}" for i in range(40)]
    links = {tuple(sorted(draw.sample(ids, 2))): draw.randrange(1, 6) for _ in range(70)}
    table = spark.createDataFrame([(a, b, w) for (a, b), w in links.items()], "a string, b string, weight long")
    root = {i: i for i in ids}
    taken = set()
    for (a, b), w in sorted(links.items(), key=lambda x: (-x[1], x[0])):
        if root[a] != root[b]:
            taken.add((a, b, w))
            low, high = sorted((root[a], root[b]))
            root = {k: low if v == high else v for k, v in root.items()}
    assert {(r["a"], r["b"], r["weight"]) for r in graph.spanning_forest(table).collect()} == taken
    found = {r["node"]: r["component"] for r in components.components(table.select("a", "b")).collect()}
    assert found == {i: root[i] for i in found} and set(found) == {x for p in links for x in p}


def _near(pairs):
    out = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
        out.setdefault(b, []).append(a)
    return out


def test_recalls_equal_brute_force(spark):
    """Precise and general recall on a small graph, against ranks and walks counted in plain loops."""
    draw = random.Random(6)
    ids = [f"n{i:02d}" for i in range(30)]
    pairs = sorted({tuple(sorted(draw.sample(ids, 2))) for _ in range(50)})
    near = _near(pairs)
    facts = [(i, "SKILL", f"name {i}", "", f"word{k % 4} text {i}", "active" if k % 7 else "merged", "current", k / 30, k, f"c-{k % 3}") for k, i in enumerate(ids)]
    nodes = spark.createDataFrame(facts, "id string, type string, name string, description string, content string, status string, state string, pagerank double, validated_count long, community_id string")
    edges = spark.createDataFrame([(a, b, "R", 1.0) for a, b in pairs], "from_id string, to_id string, type string, weight double")
    vectors = {i: [draw.uniform(-1, 1) for _ in range(4)] for i in ids}
    table = spark.createDataFrame(list(vectors.items()), "id string, embedding array<double>")
    query = [0.5, -0.2, 0.1, 0.9]
    live = {f[0] for f in facts if f[5] == "active"}

    def close(v):
        return sum(a * b for a, b in zip(v, query, strict=True)) / (sum(a * a for a in v) ** 0.5 * sum(a * a for a in query) ** 0.5)

    def ranks(seeds, rounds):
        now = {i: 0.15 * (i in seeds) for i in ids}
        for _ in range(rounds):
            now = {i: 0.15 * (i in seeds) + 0.85 * sum(now[j] / len(near[j]) for j in near.get(i, [])) for i in ids}
        return now

    start = [r["id"] for r in recall.seeds(nodes, table, "word1", query, 4).collect()]
    by_vector = [i for i in sorted(ids, key=lambda i: (-close(vectors[i]), i))[:4] if i in live]
    assert start[: len(by_vector)] == by_vector
    reach = set(start)
    for _ in range(2):
        reach |= {j for i in reach for j in near.get(i, [])}
    rank = ranks(set(start), 10)
    want = sorted((i for i in reach if i in live), key=lambda i: (-round(rank[i], 9), i))[:5]
    got = recall.precise(nodes, edges, table, "word1", query, limit=4 + 1, rounds=10).collect()
    start5 = [r["id"] for r in recall.seeds(nodes, table, "word1", query, 5).collect()]
    reach = set(start5)
    for _ in range(2):
        reach |= {j for i in reach for j in near.get(i, [])}
    rank = ranks(set(start5), 10)
    want = sorted((i for i in reach if i in live), key=lambda i: (-round(rank[i], 9), i))[:5]
    assert [r["id"] for r in got] == want and [r["rank"] for r in got] == pytest.approx([rank[i] for i in want])
    groups = spark.createDataFrame([(f"c-{k}", v) for k, v in enumerate(([1.0, 0.0, 0.0, 1.0], [0.0, 1.0, 0.0, 0.0], [0.4, 0.0, 0.0, 1.0]))], "id string, embedding array<double>")
    reps = {c: sorted((f[0] for f in facts if f[9] == c and f[0] in live), key=lambda i: (-facts[ids.index(i)][7], -facts[ids.index(i)][8], i))[:2] for c in ("c-0", "c-2")}
    chosen = {i for r in reps.values() for i in r}
    rank = ranks(chosen, 10)
    got = recall.general(nodes, edges, groups, query, near=2).collect()
    assert [r["id"] for r in got] == sorted(chosen, key=lambda i: (-round(rank[i], 9), i))


def test_walk_limit_and_levels(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("c", "d")], "from_id string, to_id string")
    seeds = spark.createDataFrame([("a",)], "id string")
    assert [r["id"] for r in graph.walk(edges, seeds, 2, 3).collect()] == ["a", "b", "c"]
    nodes = spark.createDataFrame([("a", "active", "c-1", "t-1", "d-1"), ("b", "merged", "c-1", "t-1", "d-1"), ("c", "active", "c-2", "t-1", "d-1")], "id string, status string, community_id string, topic_id string, domain_id string")
    assert {r["id"] for r in graph.drill_down(nodes, topic="t-1").collect()} == {"a", "c"} and graph.drill_down(nodes).count() == 0
