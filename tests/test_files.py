"""File sources, reply parsing, transcripts, tuning and greedy merges."""

import json

from skeingraph.operators import tuning, vectors
from skeingraph.sources import files


def test_bad_lines_go(spark, tmp_path):
    rows = [{"question": "q1", "answer": "a", "session": {"messages": [{"role": "user", "content": "hi"}]}}, {"answer": "no question"}]
    (tmp_path / "set.jsonl").write_text("\n".join([*map(json.dumps, rows), "{broken"]))
    cases = files.session_cases(files.json_lines(spark, str(tmp_path / "set.jsonl"), files.SESSION_QA)).collect()
    assert [(r["query"], r["category"], r["conversation"][0]["content"]) for r in cases] == [("q1", "unknown", "hi")]


def test_dialogue_cases(spark, tmp_path):
    (tmp_path / "set.json").write_text(json.dumps([{"sample_id": "s", "qa": [{"question": "q", "answer": "a", "category": "1", "evidence": ["D1:2"]}]}]))
    row = files.dialogue_cases(files.json_array(spark, str(tmp_path / "set.json"), files.LONG_DIALOGUE)).first()
    assert (row["id"], row["expected_ids"]) == ("s-0", ["D1:2"])


def test_trajectories(spark):
    questions = spark.createDataFrame([("q1",), ("q2",)], "question_id string")
    haystack = spark.createDataFrame([("q1", "t1", 0), ("q1", "t2", 1)], "question_id string, trajectory_id string, pos int")
    paths = spark.createDataFrame([("t1", [("a" * 30,), ("b",)]), ("t2", [(None,)])], files.TRAJECTORY)
    rows = files.trajectory_cases(questions, haystack, paths, per_state=10).collect()
    assert [(r["question_id"], r["texts"]) for r in rows] == [("q1", ["a" * 10 + "\nb"])]


def test_reply_parsing():
    good = {"nodes": [{"type": "task", "name": "n"}, {"type": "OTHER", "name": "x"}, {"type": "SKILL"}], "edges": [{"from": "a", "to": "b", "type": "T"}, {}]}
    for reply in (json.dumps(good), f"```json\n{json.dumps(good)}\n```", 'text {"a": {} } ' + json.dumps(good) + " tail"):
        got = files.parse_extraction(reply)
        assert got == {"nodes": [{"type": "TASK", "name": "n"}], "edges": [good["edges"][0]]}
    many = {"nodes": [{"type": "TASK", "name": str(i)} for i in range(9)]}
    assert len(files.parse_extraction(json.dumps(many))["nodes"]) == 5 and files.parse_extraction(None) == {"nodes": [], "edges": []}


def test_transcripts():
    call = {"role": "assistant", "calls": ["1", "2"]}
    one = {"role": "tool", "call_id": "1", "content": "x"}
    assert files.repair_transcript([one, call, one, {"role": "tool", "call_id": "9"}]) == [call, one, {"role": "tool", "call_id": "2", "content": "[no result]"}]


def test_tuning():
    start = {k: low for k, (low, _, _) in tuning.BOUNDS.items()}
    best, seen = tuning.tune(start, lambda p: tuning.Round(p, p["recall_limit"] / 20, 0.1, 0.25, 0.0), rounds=8)
    assert best.parameters["recall_limit"] == 15 and len(seen) == 9
    assert tuning.diagnose(tuning.Round({}, 0.1, 0.5, 0.1, 0.9)) == ["ranking", "coverage", "latency", "answers"]


def test_greedy_merges(spark):
    pairs = spark.createDataFrame([("a", "b", 0.99), ("b", "c", 0.98), ("c", "d", 0.97)], "a string, b string, similarity double")
    nodes = spark.createDataFrame([("a", 5, 0), ("b", 1, 0), ("c", 1, 1), ("d", 1, 2)], "id string, validated_count long, updated_at long")
    assert vectors.greedy_merges(pairs, nodes) == [("b", "a"), ("c", "d")]


def test_dialogue_graph(spark):
    turns = [(1, [("A", "D1:1", "hi"), ("B", "D1:2", "yes")]), (2, [("A", "D2:1", "later")])]
    rows = spark.createDataFrame([("s", turns, [("q", "a", "1", ["D1:2", "D2:1"])])], files.DIALOGUE_TURNS)
    nodes, edges, expected = files.dialogue_graph(rows)
    assert {(r["id"], r["content"]) for r in nodes.collect()} == {("bench-s-session1", "A: hi\nB: yes"), ("bench-s-session2", "A: later")}
    assert [tuple(r) for r in edges.collect()] == [("bench-s-session1", "bench-s-session2", "NEXT_SESSION")]
    assert {tuple(r) for r in expected.collect()} == {("s-0", "bench-s-session1"), ("s-0", "bench-s-session2")}


def test_repaired_sessions(spark):
    rows = [("s", 0, "assistant", None, ["1", "2"], "call"), ("s", 1, "tool", "1", None, "x"), ("t", 0, "tool", "9", None, "stray"), ("t", 1, "user", None, None, "hi")]
    got = files.repair_sessions(spark.createDataFrame(rows, "session_key string, turn long, role string, call_id string, calls array<string>, content string")).collect()
    assert sorted((r["session_key"], r["turn"], r["role"], r["content"]) for r in got) == [("s", 0, "assistant", "call"), ("s", 1, "tool", "x"), ("s", 2, "tool", "[no result]"), ("t", 0, "user", "hi")]
