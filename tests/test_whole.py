"""Queries over their whole input, against brute force."""

import datetime

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from skeingraph import plans
from skeingraph.operators import graph, maintenance
from skeingraph.sources import tables as t


def test_sessions_equal_the_batch_form(spark, tmp_path):
    """Sessions that are open when the input ends are there too."""
    start, gap = datetime.datetime(2024, 1, 1), datetime.timedelta(hours=6)
    rows = [(k % 7, start + datetime.timedelta(minutes=(k * k * 37) % 9000)) for k in range(400)]
    rows += [(k, start + datetime.timedelta(minutes=9000 + k)) for k in range(7)]
    spark.createDataFrame(rows, "user_id long, ts timestamp_ntz").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    want = []
    for user in range(7):
        own = sorted(ts for u, ts in rows if u == user)
        first, n = own[0], 0
        for ts, after in zip(own, [*own[1:], None], strict=True):
            n += 1
            if after is None or after > ts + gap:
                want.append((user, first, ts + gap, n))
                first, n = after, 0
    utc = [F.timestamp_micros(c).cast("timestamp_ntz").alias(c) for c in ("start_us", "end_us")]
    got = plans.QUERIES["stream_sessions"](spark, str(tmp_path)).select("user_id", *utc, "n").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def loop_labels(ids, pairs, rounds):
    label = {i: i for i in ids}
    near = {i: [b for a, b in pairs if a == i] + [a for a, b in pairs if b == i] for i in ids}
    for _ in range(rounds):
        new = dict(label)
        for i in ids:
            seen = Counter(label[j] for j in near[i])
            if seen:
                new[i] = min(seen, key=lambda x: (-seen[x], x != label[i], x))
        label = new
    return label


def loop_level(pairs, label):
    names, weight = sorted(set(label.values())), Counter()
    for a, b in pairs:
        if label[a] != label[b]:
            weight[tuple(sorted((label[a], label[b])))] += 1
    root, groups = {n: n for n in names}, len(names)
    for a, b in sorted(weight, key=lambda p: (-weight[p], p)):
        if groups > max(1, math.isqrt(len(names))) and root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root, groups = {n: low if r == high else r for n, r in root.items()}, groups - 1
    order = list(dict.fromkeys(root[n] for n in names))
    return {n: f"h-{order.index(root[n]) + 1}" for n in names}


def test_hierarchy_takes_every_edge_type(spark, monkeypatch):
    draw = random.Random(3)
    ids = [f"{k}{i}" for k in "TSE" for i in range(8)]
    kinds = {("T", "S"): "USED_SKILL", ("T", "E"): "LEADS_TO", ("E", "E"): "CAUSED_BY", ("E", "S"): "SOLVED_BY", ("S", "S"): "PATCHES"}
    pairs = sorted({(a, b) for a in ids for b in ids if (a[0], b[0]) in kinds and (a[0] != b[0] or a < b) and draw.random() < 0.07})
    edges = spark.createDataFrame([(a, b, kinds[a[0], b[0]], 1.0) for a, b in pairs], "from_id string, to_id string, type string, weight double")
    monkeypatch.setattr(t, "nodes", lambda spark, sf: spark.createDataFrame([(i,) for i in ids], "id string"))
    monkeypatch.setattr(t, "edges", lambda spark, sf: edges)

    def spread(nodes, edges, rounds=50, stop_early=True):
        """The same rounds on the driver; the operator has its own test."""
        given = [(r["from_id"], r["to_id"]) for r in edges.collect()]
        label = loop_labels([r["id"] for r in nodes.collect()], given, rounds)
        return spark.createDataFrame(list(label.items()), "id string, label string")

    monkeypatch.setattr(graph, "label_propagation", spread)
    label = loop_labels(ids, pairs, 50)
    topic = loop_level(pairs, label)
    domain = loop_level(pairs, {i: topic[x] for i, x in label.items()})
    got = plans.QUERIES["hierarchy"](spark, "").collect()
    assert {r["label"]: (r["topic"], r["domain"]) for r in got} == {n: (topic[n], domain[topic[n]]) for n in topic}


def test_maintenance_is_given_the_whole_graph(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(maintenance, "run", lambda state, now_ms, phases=None: seen.append((state, phases)) or (state, None))
    sf = "/root/testdata/sf0.001"
    plans.QUERIES["maintenance_full"](spark, sf)
    (state, phases), = seen
    assert phases in (None, maintenance.Phases())
    assert {r[0] for r in state.nodes.select("type").distinct().collect()} == {"TASK", "SKILL", "EVENT"}
    assert state.edges.count() == t.edges(spark, sf).count() and state.mentions.count() == t.mentions(spark, sf).count()
    assert state.embeddings.columns == ["id", "embedding"] and state.embeddings.count() == t.read(spark, sf, "embeddings").count()
