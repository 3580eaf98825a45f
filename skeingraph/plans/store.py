"""Queries of scans, lookups, upserts and merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..lineage import cut
from ..operators import store
from ..sources import tables as t
from .registry import query

_NODE = ["id", "type", "name", "status", "validated_count"]
_NODES_SQL = ", ".join(_NODE)


@query("node_lookup", f"SELECT {_NODES_SQL} FROM nodes WHERE id IN ('T1', 'S7', 'E42', 'T11')")
def node_lookup(spark, sf):
    return store.by_id(t.nodes(spark, sf), ["T1", "S7", "E42", "T11"]).select(*_NODE)


@query("nodes_by_type", f"SELECT {_NODES_SQL} FROM skills WHERE status = 'active' OR status IS NULL ORDER BY validated_count DESC, id LIMIT 50")
def nodes_by_type(spark, sf):
    return store.by_type(t.nodes(spark, sf), "SKILL", 50).select(*_NODE)


@query("top_nodes", "SELECT id, type, pagerank, validated_count FROM nodes WHERE status = 'active' OR status IS NULL ORDER BY pagerank DESC, validated_count DESC, id LIMIT 20")
def top_nodes(spark, sf):
    return store.top_nodes(t.nodes(spark, sf), 20).select("id", "type", "pagerank", "validated_count")


@query("graph_counts", "SELECT (SELECT count(*) FROM nodes WHERE status = 'active' OR status IS NULL) AS nodes_active, (SELECT count(*) FROM edges WHERE from_id IN (SELECT id FROM nodes) AND to_id IN (SELECT id FROM nodes)) AS edges")
def graph_counts(spark, sf):
    nodes = t.nodes(spark, sf)
    count = nodes.where(store.active_or_unset()).agg(F.count(F.lit(1)).alias("nodes_active"))
    return count.crossJoin(store.edge_count(t.edges(spark, sf), nodes))  # one row each


@query("induced_edges", "SELECT from_id, to_id, type, weight FROM edges WHERE from_id IN (SELECT id FROM nodes WHERE validated_count >= 18) AND to_id IN (SELECT id FROM nodes WHERE validated_count >= 18)")
def induced_edges(spark, sf):
    ids = t.nodes(spark, sf).where("validated_count >= 18").select("id")
    return store.induced_edges(t.edges(spark, sf), ids).select("from_id", "to_id", "type", "weight")


@query("incident_edges", "SELECT from_id, to_id, type, weight FROM edges WHERE from_id IN ('T5', 'S9') OR to_id IN ('T5', 'S9')")
def incident_edges(spark, sf):
    return store.incident_edges(t.edges(spark, sf), ["T5", "S9"]).select("from_id", "to_id", "type", "weight")


@query("session_last_n", "SELECT * FROM (SELECT id, turn, role, content FROM messages WHERE session_key = '3' ORDER BY turn DESC, id DESC LIMIT 4) ORDER BY turn, id")
def session_last_n(spark, sf):
    return store.last_messages(t.messages(spark, sf), "3", 4).select("id", "turn", "role", "content")


@query("session_page", "SELECT id, turn, role FROM messages WHERE session_key = '5' AND (turn > 1 OR (turn = 1 AND id > 'm5-1')) ORDER BY turn, id LIMIT 3")
def session_page(spark, sf):
    return store.message_page(t.messages(spark, sf), "5", 1, "m5-1", 3).select("id", "turn", "role")


@query("session_keys", "SELECT DISTINCT session_key FROM messages WHERE session_key IS NOT NULL")
def session_keys(spark, sf):
    return store.session_keys(t.messages(spark, sf))


@query("recent_distinct_messages", "SELECT id, turn, role, content FROM (SELECT *, row_number() OVER (PARTITION BY role, substr(content, 1, 100) ORDER BY turn, id) AS nth FROM (SELECT * FROM messages WHERE session_key = '4' ORDER BY turn DESC, id DESC LIMIT 10)) WHERE nth = 1 ORDER BY turn, id LIMIT 5")
def recent_distinct_messages(spark, sf):
    return store.recent_distinct(t.messages(spark, sf), "4", 5).select("id", "turn", "role", "content")


@query("schema_counts", "SELECT 'node' AS kind, type, count(*) AS n FROM nodes GROUP BY type UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY type")
def schema_counts(spark, sf):
    return store.type_counts(t.nodes(spark, sf), "node").unionByName(store.type_counts(t.edges(spark, sf), "edge")).select("kind", "type", "n")


@query("edge_type_counts", "SELECT coalesce(type, 'total') AS type, count(*) AS n FROM edges GROUP BY ROLLUP (type)")
def edge_type_counts(spark, sf):
    return t.edge_counts(spark, sf).rollup("type").agg(F.sum("n").alias("n")).select(F.coalesce("type", F.lit("total")).alias("type"), "n")


@query("relates_from_mentions", "SELECT a.node_id AS a, b.node_id AS b, count(DISTINCT a.msg_id) AS weight FROM mentions a JOIN mentions b ON a.msg_id = b.msg_id AND a.node_id < b.node_id GROUP BY 1, 2 HAVING count(DISTINCT a.msg_id) >= 2")
def relates_from_mentions(spark, sf):
    return store.cooccurrence(t.mentions(spark, sf), 2)


@query("contains_search", "SELECT id, name, validated_count FROM nodes WHERE (contains(name, '17') OR contains(description, '17') OR contains(content, '17')) AND (status = 'active' OR status IS NULL) ORDER BY validated_count DESC, updated_at DESC NULLS LAST, id LIMIT 30")
def contains_search(spark, sf):
    return store.contains(t.nodes(spark, sf), "17", 30).select("id", "name", "validated_count")


def _stored(nodes):
    return nodes.where("cast(substring(id, 2, 9) as int) % 3 <> 0").select("id", "type", "name", "description", "status", "state", "source", "validated_count", "pagerank", F.col("updated_at").alias("created_at"), "updated_at", F.lit(None).cast("bigint").alias("valid_from"), F.lit(None).cast("bigint").alias("valid_to"), "community_id")


def _incoming(nodes):
    given = F.when(F.col("validated_count") % 2 == 0, F.concat("description", F.lit(" v2")))
    return nodes.where("cast(substring(id, 2, 9) as int) % 2 = 0").select("id", "type", "name", given.alias("description"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("state"), F.lit(None).cast("string").alias("source"), (F.col("validated_count") + 1).alias("validated_count"), F.lit(0.0).alias("pagerank"), F.lit(None).cast("bigint").alias("created_at"), F.lit(None).cast("bigint").alias("valid_from"), F.lit(7).cast("bigint").alias("valid_to"))


_UPSERT = {
    "stored": "SELECT *, updated_at AS created_at FROM skills WHERE substr(id, 2)::INT % 3 <> 0",
    "incoming": "SELECT id, type, name, CASE WHEN validated_count % 2 = 0 THEN description || ' v2' END AS description, validated_count + 1 AS validated_count FROM skills WHERE substr(id, 2)::INT % 2 = 0",
}


@query("upsert_nodes", """SELECT coalesce(s.id, i.id) AS id, coalesce(i.type, s.type) AS type, coalesce(i.name, s.name) AS name, coalesce(i.description, s.description) AS description, coalesce(s.status, 'active') AS status,
    coalesce(s.state, 'current') AS state, coalesce(s.source, 'experience') AS source, coalesce(s.validated_count, i.validated_count) AS validated_count, coalesce(s.pagerank, 0.0::DOUBLE) AS pagerank,
    coalesce(s.created_at, 1007164800000) AS created_at, CASE WHEN i.id IS NOT NULL THEN 1007164800000 ELSE s.updated_at END AS updated_at, coalesce(s.created_at, 1007164800000) AS valid_from, CASE WHEN i.id IS NOT NULL THEN 7::BIGINT END AS valid_to, s.community_id
    FROM stored s FULL JOIN incoming i ON s.id = i.id""", _UPSERT)
def upsert_nodes(spark, sf):
    skills = t.skills(spark, sf)
    return store.upsert_nodes(_stored(skills), _incoming(skills), t.PART_NOW)


@query("upsert_edges", """SELECT coalesce(s.from_id, i.from_id) AS from_id, coalesce(s.to_id, i.to_id) AS to_id, coalesce(s.type, i.type) AS type, coalesce(i.w, s.weight) AS weight
    FROM edges s FULL JOIN (SELECT from_id, to_id, CASE WHEN type = 'LEADS_TO' THEN 'RELATES_TO' ELSE type END AS type, weight + 5 AS w FROM edges WHERE type = 'LEADS_TO' OR weight > 1 UNION ALL SELECT 'S1', 'S' || l_partkey, 'PATCHES', 2.0::DOUBLE FROM (SELECT DISTINCT l_partkey + 1000000 * (l_partkey % 2) AS l_partkey FROM lineitem WHERE l_partkey < 40)) i ON s.from_id = i.from_id AND s.to_id = i.to_id AND s.type = i.type
    WHERE i.from_id IS NULL OR (i.from_id IN (SELECT id FROM nodes) AND i.to_id IN (SELECT id FROM nodes))""")
def upsert_edges(spark, sf):
    edges = t.edges(spark, sf)
    more = edges.where("type = 'LEADS_TO' or weight > 1").withColumns({"type": F.when(F.col("type") == "LEADS_TO", "RELATES_TO").otherwise(F.col("type")), "weight": F.col("weight") + 5})
    # Half of these ends are no nodes.
    part = F.col("l_partkey")
    lost = t.read(spark, sf, "lineitem").where("l_partkey < 40").select(F.lit("S1").alias("from_id"), F.concat(F.lit("S"), part + 1000000 * (part % 2)).alias("to_id"), F.lit("PATCHES").alias("type"), F.lit(2.0).alias("weight")).distinct()
    return store.upsert_edges(edges, more.unionByName(lost), t.nodes(spark, sf))


@query("evolvable_embedding", """SELECT vec_id, label % 2 = 0 AND label <> 4 AS changed, CASE WHEN label % 2 = 0 AND label <> 4 THEN least(3, label + 1) ELSE label END::BIGINT AS history, CASE WHEN label % 2 = 0 AND label <> 4 THEN NULL ELSE 'h' || (label // 2) END AS embedding_hash,
    CASE WHEN label % 2 = 0 AND label <> 4 THEN NULL ELSE len(embedding) END::BIGINT AS dims FROM embeddings""")
def evolvable_embedding(spark, sf):
    rows = t.read(spark, sf, "embeddings")
    entry = F.struct(F.col("embedding"), F.lit("m0").alias("model"), F.lit("h").alias("hash"), F.lit(0).cast("bigint").alias("archived_at"))
    half = F.floor(F.col("label") / 2).cast("string")
    old = F.when(F.col("label") == 4, F.lit(None)).when(F.col("label") % 2 == 0, F.lit("old")).otherwise(F.concat(F.lit("h"), half))
    rows = rows.select("vec_id", "label", "embedding", F.lit("m1").alias("embedding_model"), old.alias("embedding_hash"), F.concat(F.lit("h"), half).alias("new_hash"), F.array_repeat(entry, F.col("label")).alias("embedding_history"))
    out = store.archive_embedding(rows, t.EVENT_NOW)
    return out.select("vec_id", "changed", F.size("embedding_history").cast("bigint").alias("history"), "embedding_hash", F.when(F.col("embedding").isNotNull(), F.size("embedding")).cast("bigint").alias("dims"))


_MERGE = {"pairs": "SELECT id AS merge_id, 'S' || (substr(id, 2)::INT - 1) AS keep_id FROM skills WHERE substr(id, 2)::INT % 10 = 1"}


_TOLD = "SELECT *, CASE WHEN weight > 1 THEN 'often' WHEN type = 'PATCHES' THEN 'patch ' || to_id END AS instruction FROM structural"


@query("merge_redirect", """SELECT from_id, to_id, type, round(sum(weight), 6) AS weight, nullif(string_agg(instruction, ' | ' ORDER BY touched, a, b), '') AS instruction FROM (SELECT coalesce(x.keep_id, e.from_id) AS from_id, coalesce(y.keep_id, e.to_id) AS to_id, e.type, e.weight, x.keep_id IS NOT NULL OR y.keep_id IS NOT NULL AS touched, e.from_id AS a, e.to_id AS b,
    CASE WHEN row_number() OVER (PARTITION BY coalesce(x.keep_id, e.from_id), coalesce(y.keep_id, e.to_id), e.type, instruction, from_id <> to_id ORDER BY x.keep_id IS NOT NULL OR y.keep_id IS NOT NULL, e.from_id, e.to_id) = 1 THEN instruction END AS instruction
    FROM told e LEFT JOIN pairs x ON e.from_id = x.merge_id LEFT JOIN pairs y ON e.to_id = y.merge_id) WHERE NOT touched OR from_id <> to_id GROUP BY 1, 2, 3
    UNION ALL SELECT from_id, to_id, type, CASE WHEN type IN ('NEXT_SESSION', 'CONTAINS', 'MENTIONS') THEN weight ELSE 0.1::DOUBLE END, instruction FROM told WHERE from_id IN (SELECT merge_id FROM pairs) OR to_id IN (SELECT merge_id FROM pairs)""", _MERGE | {"told": _TOLD})
def merge_redirect(spark, sf):
    """Conflicting parts' edges are of types that no other edge has, so they are redirected apart from the others, as they are made."""
    n = F.substring("id", 2, 9).cast("int")
    parts = t.read(spark, sf, "part").select(F.concat(F.lit("S"), "p_partkey").alias("id"))
    # Written first, so its size is known and edges are not shuffled for a small one.
    pairs = cut(parts.where(n % 10 == 1).select(F.col("id").alias("merge_id"), F.concat(F.lit("S"), n - 1).alias("keep_id")))
    told = F.when(F.col("weight") > 1, "often").when(F.col("type") == "PATCHES", F.concat(F.lit("patch "), "to_id"))
    plain, rivals = (t.structural(e).withColumn("instruction", told) for e in (t.plain_edges(spark, sf), t.rival_edges(spark, sf, pairs)))
    # A customer and a part have one edge, whose weight counts how often.
    out = store.merge_redirect(plain, pairs, keyed=F.col("type") == "USED_SKILL").unionByName(store.redirect(rivals))
    return out.withColumn("weight", F.round("weight", 6))


@query("merge_nodes", """SELECT s.id, s.validated_count + CASE WHEN p.merge_id IS NULL THEN coalesce(g.gain, 0) ELSE 0 END AS validated_count, CASE WHEN p.merge_id IS NULL THEN s.status ELSE 'merged' END AS status, CASE WHEN p.merge_id IS NULL THEN s.state ELSE 'superseded' END AS state, CASE WHEN p.merge_id IS NULL THEN s.valid_to ELSE 1007164800000 END AS valid_to, CASE WHEN p.merge_id IS NULL THEN s.updated_at ELSE 1007164800000 END AS updated_at, p.keep_id AS superseded_by
    FROM skills s LEFT JOIN pairs p ON s.id = p.merge_id LEFT JOIN (SELECT keep_id, sum(validated_count)::BIGINT AS gain FROM pairs JOIN skills ON id = merge_id GROUP BY 1) g ON s.id = g.keep_id""", _MERGE)
def merge_nodes(spark, sf):
    skills = t.skills(spark, sf)
    n = F.substring("id", 2, 9).cast("int")
    pairs = skills.where(n % 10 == 1).select(F.col("id").alias("merge_id"), F.concat(F.lit("S"), n - 1).alias("keep_id"))
    return store.merge_nodes(skills, pairs, t.PART_NOW).select("id", "validated_count", "status", "state", "valid_to", "updated_at", "superseded_by")


@query("timestamp_backfill", """SELECT id, coalesce(u, c, 1007164800000) AS updated_at, coalesce(c, coalesce(u, c, 1007164800000)) AS created_at, coalesce(r, c, u, 1007164800000) AS recorded_at
    FROM (SELECT id, CASE WHEN validated_count % 3 <> 0 THEN updated_at END AS u, CASE WHEN validated_count % 4 = 0 THEN updated_at - 1000 END AS c, CASE WHEN validated_count % 5 = 0 THEN updated_at - 5 END AS r FROM skills)""")
def timestamp_backfill(spark, sf):
    rows = t.skills(spark, sf)
    v, u = F.col("validated_count"), F.col("updated_at")
    rows = rows.select("id", F.when(v % 3 != 0, u).alias("updated_at"), F.when(v % 4 == 0, u - 1000).alias("created_at"), F.when(v % 5 == 0, u - 5).alias("recorded_at"), F.lit(None).cast("bigint").alias("timestamp"))
    return store.backfill_times(rows, t.PART_NOW).drop("timestamp")


def _with_model(rows):
    return rows.withColumns({"embedding_model": F.when(F.col("label") % 3 == 0, "m1").when(F.col("label") % 3 == 1, "m2"), "embedding_hash": F.lit("h")})


@query("model_distribution", "SELECT coalesce(model, 'unknown') AS model, count(*) AS n, coalesce(model, 'unknown') <> 'm1' AS needs_migration FROM (SELECT CASE label % 3 WHEN 0 THEN 'm1' WHEN 1 THEN 'm2' END AS model FROM embeddings) GROUP BY 1, 3")
def model_distribution(spark, sf):
    return store.model_distribution(_with_model(t.read(spark, sf, "embeddings")), "m1")


@query("model_migration", "SELECT vec_id, label % 3 = 0 AS has_embedding, CASE WHEN label % 3 = 0 THEN 'h' END AS embedding_hash FROM embeddings")
def model_migration(spark, sf):
    out = store.migrate_model(_with_model(t.read(spark, sf, "embeddings")), "m1")
    return out.select("vec_id", F.col("embedding").isNotNull().alias("has_embedding"), "embedding_hash")


def _records(spark, sf):
    k = F.substring("id", 2, 9).cast("int")
    nodes = t.nodes(spark, sf)
    missing = {"type": F.when(k % 3 != 0, F.col("type")), "name": F.when(k % 4 != 0, F.col("name")), "validated_count": F.when(k % 5 != 0, F.col("validated_count")), "created_at": F.lit(None).cast("long"), "label": F.when(k % 2 == 0, F.initcap("type"))}
    return nodes.select("id", "description", "content", "status", "pagerank", "updated_at", "type", "name", "validated_count").withColumns(missing)


_RECORDS = {"records": "SELECT id, description, content, status, pagerank, updated_at, CASE WHEN substr(id, 2)::INT % 3 <> 0 THEN type END AS type, CASE WHEN substr(id, 2)::INT % 4 <> 0 THEN name END AS name, CASE WHEN substr(id, 2)::INT % 5 <> 0 THEN validated_count END AS validated_count, CASE WHEN substr(id, 2)::INT % 2 = 0 THEN type END AS label FROM nodes"}


@query("node_projection", "SELECT id, coalesce(type, upper(label), 'TASK') AS type, coalesce(name, '') AS name, coalesce(status, 'active') AS status, coalesce(validated_count, 0) AS validated_count, 0::BIGINT AS created_at, coalesce(updated_at, 0) AS updated_at FROM records", _RECORDS)
def node_projection(spark, sf):
    return store.project_nodes(_records(spark, sf)).select("id", "type", "name", "status", "validated_count", "created_at", "updated_at")


@query("edge_projection", "SELECT from_id || '-' || to_id || '-' || type AS id, CASE WHEN weight > 1 THEN weight ELSE 1.0::DOUBLE END AS weight, '' AS instruction, 0::BIGINT AS created_at FROM edges")
def edge_projection(spark, sf):
    none = F.lit(None).cast("string")
    rows = t.unwritten_edges(spark, sf).withColumns({"id": none, "instruction": none, "condition": none, "weight": F.when(F.col("weight") > 1, F.col("weight")), "created_at": F.lit(None).cast("long"), "updated_at": F.lit(None).cast("long")})
    return store.project_edges(rows).select("id", "weight", "instruction", "created_at")


@query("scope_filter", "SELECT id FROM nodes WHERE validated_count % 6 <> 2")
def scope_filter(spark, sf):
    scope = F.when(F.col("validated_count") % 6 == 2, "benchmark").when(F.col("validated_count") % 6 == 3, "production")
    return store.in_scope(t.nodes(spark, sf).withColumn("scope", scope)).select("id")


@query("prefix_delete", "SELECT 'node' AS kind, count(*) AS n FROM nodes WHERE id NOT LIKE 'E1%' UNION ALL SELECT 'edge', count(*) FROM edges WHERE from_id NOT LIKE 'E1%' AND to_id NOT LIKE 'E1%'")
def prefix_delete(spark, sf):
    nodes, edges = store.without_prefix(t.nodes(spark, sf), t.edges(spark, sf), "E1")
    return nodes.agg(F.lit("node").alias("kind"), F.count(F.lit(1)).alias("n")).unionByName(edges.agg(F.lit("edge").alias("kind"), F.count(F.lit(1)).alias("n")))


@query("session_exclusion", "SELECT session_key FROM (SELECT DISTINCT CASE conv_id % 4 WHEN 0 THEN conv_id || ':active-memory:x' WHEN 1 THEN 'dreaming-narrative-rem' || conv_id ELSE conv_id::VARCHAR END AS session_key FROM conversations WHERE conv_id % 4 > 1)")
def session_exclusion(spark, sf):
    conv = F.col("conv_id")
    keys = t.read(spark, sf, "conversations").select(F.when(conv % 4 == 0, F.concat(conv, F.lit(":active-memory:x"))).when(conv % 4 == 1, F.concat(F.lit("dreaming-narrative-rem"), conv)).otherwise(conv.cast("string")).alias("session_key"))
    return store.without_sessions(keys.distinct())


_MESSAGES = {"stored_messages": "SELECT *, turn * 10 AS created_at, CASE WHEN turn = 0 THEN 5::BIGINT END AS mark FROM messages WHERE turn < 4", "new_messages": "SELECT *, turn * 10 + 1 AS created_at FROM messages WHERE turn > 1"}


@query("message_upsert", "SELECT coalesce(i.id, s.id) AS id, CASE WHEN i.id IS NULL THEN s.content ELSE '> ' || i.content END AS content, coalesce(i.created_at, s.created_at) AS created_at, s.mark AS rebuild_processed_at FROM stored_messages s FULL JOIN new_messages i ON s.id = i.id", _MESSAGES)
def message_upsert(spark, sf):
    rows = t.messages(spark, sf)
    stored = rows.where("turn < 4").withColumns({"created_at": F.col("turn") * 10, "rebuild_processed_at": F.when(F.col("turn") == 0, F.lit(5).cast("long"))})
    new = rows.where("turn > 1").withColumns({"created_at": F.col("turn") * 10 + 1, "content": F.concat(F.lit("> "), "content")})
    return store.upsert_messages(stored, new).select("id", "content", "created_at", "rebuild_processed_at")


@query("message_page_open", "SELECT id, created_at FROM (SELECT id, CASE WHEN turn % 2 = 0 THEN turn * 1000 ELSE turn * 1000 END AS created_at, turn FROM messages WHERE session_key = '5') WHERE (created_at > 1000 OR (created_at = 1000 AND id > 'm5-0')) AND turn % 3 <> 2 ORDER BY created_at, id LIMIT 4")
def message_page_open(spark, sf):
    """Times are numbers or text; processed rows don't count on any page."""
    turn = F.col("turn")
    iso = F.date_format(F.timestamp_millis(turn * 1000), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = t.messages(spark, sf).withColumns({"created_at": F.when(turn % 2 == 0, (turn * 1000).cast("string")).otherwise(iso), "rebuild_processed_at": F.when(turn % 3 == 2, F.lit(1).cast("long"))})
    return store.tolerant_page(rows, "5", 1000, "m5-0", 4, only_open=True).select("id", "created_at")


@query("vectors_saved", "SELECT id, CASE WHEN vec_id IS NULL THEN NULL ELSE 'h' || label END AS embedding_hash, CASE WHEN vec_id IS NULL THEN NULL ELSE len(embedding) END AS dims FROM skills LEFT JOIN embeddings ON id = 'S' || vec_id")
def vectors_saved(spark, sf):
    none = F.lit(None)
    nodes = t.nodes(spark, sf).where("type = 'SKILL'").withColumns({"embedding": none.cast("array<float>"), "embedding_hash": none.cast("string"), "embedding_model": none.cast("string")})
    vectors = t.read(spark, sf, "embeddings").select(F.concat(F.lit("S"), "vec_id").alias("id"), "embedding", F.concat(F.lit("h"), "label").alias("embedding_hash"), F.lit("m").alias("embedding_model"))
    return store.save_vectors(nodes, vectors).select("id", "embedding_hash", F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("dims"))


@query("cleared_graph", "SELECT (SELECT count(*) FROM nodes WHERE false) AS nodes, (SELECT count(*) FROM edges WHERE false) AS edges")
def cleared_graph(spark, sf):
    nodes, edges = store.cleared(t.unwritten_nodes(spark, sf), t.unwritten_edges(spark, sf))
    return nodes.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(edges.agg(F.count(F.lit(1)).alias("edges")))  # one row each
