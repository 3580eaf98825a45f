"""Scans, lookups, pages, upserts and merges over node, edge and message frames.

Frames are immutable: every write is a function from the stored rows and the incoming
ones to the rows that a store would hold afterwards.  Each limit has a total order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut


def active(status: str = "status") -> Column:
    """Strictly active."""
    return F.coalesce(F.col(status) == "active", F.lit(False))


def active_or_unset(status: str = "status") -> Column:
    return F.col(status).isNull() | (F.col(status) == "active")


def by_id(nodes: DataFrame, ids: list[str]) -> DataFrame:
    """Any status."""
    return nodes.where(F.col("id").isin(ids))


def by_type(nodes: DataFrame, kind: str, limit: int | None = None) -> DataFrame:
    found = nodes.where((F.col("type") == kind) & active_or_unset())
    order = [F.col("validated_count").desc(), F.col("id")]
    return found.orderBy(*order).limit(limit) if limit else found.orderBy(*order)


def top_nodes(nodes: DataFrame, limit: int = 10) -> DataFrame:
    found = nodes.where(active_or_unset())
    return found.orderBy(F.col("pagerank").desc(), F.col("validated_count").desc(), "id").limit(limit)


def induced_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ``ids`` (one column, id)."""
    first = edges.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi")
    return first.join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")


def incident_edges(edges: DataFrame, ids: list[str]) -> DataFrame:
    return edges.where(F.col("from_id").isin(ids) | F.col("to_id").isin(ids))


def edge_count(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return induced_edges(edges, nodes.select("id").distinct()).agg(F.count(F.lit(1)).alias("edges"))


def last_messages(messages: DataFrame, session: str, limit: int) -> DataFrame:
    """The newest ``limit`` of a session, oldest first."""
    own = messages.where(F.col("session_key") == session)
    return own.orderBy(F.col("turn").desc(), F.col("id").desc()).limit(limit).orderBy("turn", "id")


def message_page(messages: DataFrame, session: str, after: int, after_id: str, limit: int, only_open: bool = False) -> DataFrame:
    """Keyset page after (turn, id); ``only_open`` holds for every row of the page."""
    own = messages.where(F.col("session_key") == session)
    own = own.where((F.col("turn") > after) | ((F.col("turn") == after) & (F.col("id") > after_id)))
    if only_open:
        own = own.where("rebuild_processed_at is null")
    return own.orderBy("turn", "id").limit(limit)


def tolerant_page(messages: DataFrame, session: str, after_ms: int, after_id: str, limit: int, only_open: bool = False) -> DataFrame:
    """Keyset page by (created_at, id) where the times are numbers or text; rows without a time go last, as time 0 would go first."""
    timed = messages.withColumn("turn", F.coalesce(tolerant_millis(F.col("created_at")), F.lit((1 << 62))))
    return message_page(timed, session, after_ms, after_id, limit, only_open).withColumn("created_at", F.col("turn"))


def tolerant_millis(value: Column) -> Column:
    """Epoch milliseconds from a number or an ISO time in text; null if neither."""
    return F.coalesce(value.try_cast("bigint"), F.unix_millis(value.try_cast("timestamp")))


def session_keys(messages: DataFrame) -> DataFrame:
    return messages.where("session_key is not null").select("session_key").distinct()


def recent_distinct(messages: DataFrame, session: str, limit: int) -> DataFrame:
    """Of the newest 2 * limit, the first of each role and 100-character start, at most ``limit``."""
    recent = last_messages(messages, session, 2 * limit)
    same = Window.partitionBy("role", F.substring("content", 1, 100)).orderBy("turn", "id")
    return recent.withColumn("nth", F.row_number().over(same)).where("nth = 1").drop("nth").orderBy("turn", "id").limit(limit)


def type_counts(frame: DataFrame, kind: str) -> DataFrame:
    return frame.groupBy("type").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(kind))


def contains(nodes: DataFrame, needle: str, limit: int) -> DataFrame:
    """Case-sensitive substring in name, description or content."""
    hit = F.col("name").contains(needle) | F.col("description").contains(needle) | F.col("content").contains(needle)
    return nodes.where(hit & active_or_unset()).orderBy(F.col("validated_count").desc(), F.col("updated_at").desc(), "id").limit(limit)


def cooccurrence(mentions: DataFrame, least: int = 1) -> DataFrame:
    """(a, b, weight): how many messages mention both, a < b."""
    a = mentions.select("msg_id", F.col("node_id").alias("a"))
    b = mentions.select("msg_id", F.col("node_id").alias("b"))
    pairs = a.join(b, "msg_id").where("a < b").distinct()
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight")).where(F.col("weight") >= least)


def upsert_nodes(stored: DataFrame, incoming: DataFrame, now_ms: int, parity: bool = False) -> DataFrame:
    """Rows after merging ``incoming`` into ``stored`` by id.

    Given fields win, and missing ones keep what is stored; pagerank, validated count and
    creation time survive unless ``parity`` asks for the incoming values; the times of
    validity fall back to creation, the origin to experience, the state to current.
    ``valid_to`` is taken from the incoming row even if null.
    """
    s, i = stored.alias("s"), incoming.withColumn("__new", F.lit(True)).alias("i")
    both = s.join(i, F.col("s.id") == F.col("i.id"), "full_outer")
    new = F.coalesce(F.col("i.__new"), F.lit(False))

    def given(c: str, default=None) -> Column:
        return F.coalesce(F.col(f"i.{c}"), F.col(f"s.{c}"), *([] if default is None else [default]))

    def kept(c: str) -> Column:
        return F.coalesce(F.col(f"i.{c}"), F.col(f"s.{c}")) if parity else F.coalesce(F.col(f"s.{c}"), F.col(f"i.{c}"))

    created = F.coalesce(F.col("s.created_at"), F.col("i.created_at"), F.lit(now_ms))
    return both.select(
        F.coalesce("s.id", "i.id").alias("id"), given("type").alias("type"), given("name").alias("name"), given("description").alias("description"),
        F.coalesce(F.col("i.status"), F.col("s.status"), F.lit("active")).alias("status"), given("state", F.lit("current")).alias("state"), given("source", F.lit("experience")).alias("source"),
        kept("validated_count").alias("validated_count"), kept("pagerank").alias("pagerank"), created.alias("created_at"),
        F.when(new, F.lit(now_ms)).otherwise(F.col("s.updated_at")).alias("updated_at"),
        given("valid_from", created).alias("valid_from"), F.when(new, F.col("i.valid_to")).otherwise(F.col("s.valid_to")).alias("valid_to"), F.col("s.community_id").alias("community_id"),
    )


def upsert_edges(stored: DataFrame, incoming: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows after merging by (from_id, type, to_id); incoming edges without both ends go, given weights win."""
    valid = induced_edges(incoming, nodes.select("id")).select("from_id", "to_id", "type", F.col("weight").alias("new_weight"))
    both = stored.join(valid, ["from_id", "to_id", "type"], "full_outer")
    return both.select("from_id", "to_id", "type", F.coalesce("new_weight", "weight", F.lit(1.0)).alias("weight"))


def archive_embedding(nodes: DataFrame, now_ms: int, keep: int = 3) -> DataFrame:
    """Applies ``new_hash``: a changed text moves its embedding to the history (newest first) and clears it."""
    changed = F.col("embedding_hash").isNotNull() & (F.col("embedding_hash") != F.col("new_hash")) & (F.size("embedding") > 0)
    changed = F.coalesce(changed, F.lit(False))
    entry = F.struct(F.col("embedding"), F.col("embedding_model").alias("model"), F.col("embedding_hash").alias("hash"), F.lit(now_ms).alias("archived_at"))
    out = nodes.withColumn("changed", changed)
    out = out.withColumn("embedding_history", F.when(F.col("changed"), F.slice(F.concat(F.array(entry), F.col("embedding_history")), 1, keep)).otherwise(F.col("embedding_history")))
    out = out.withColumn("embedding_hash", F.when(F.col("changed"), F.lit(None)).otherwise(F.col("new_hash")))
    return out.withColumn("embedding", F.when(~F.col("changed"), F.col("embedding")))


def merge_targets(pairs: DataFrame) -> DataFrame:
    """(merge_id, keep_id) with chains followed to their end, twice as far in each step; a cycle is an error."""
    mapped = cut(pairs.select("merge_id", "keep_id"))
    for _ in range(40):
        onward = mapped.alias("m").join(mapped.alias("p"), F.col("m.keep_id") == F.col("p.merge_id"), "left")
        onward = cut(onward.select("m.merge_id", F.coalesce("p.keep_id", "m.keep_id").alias("keep_id"), F.col("p.keep_id").isNotNull().alias("moved")))
        if not onward.where("merge_id = keep_id").isEmpty():
            break
        if onward.where("moved").isEmpty():
            return mapped
        mapped = onward.drop("moved")
    raise ValueError("merges run in a cycle")


#: Edge types whose weight a merge leaves alone; fixed values.
_STRUCTURAL = ("NEXT_SESSION", "CONTAINS", "MENTIONS")


def merge_redirect(edges: DataFrame, mapping: DataFrame, leftover: float = 0.1, keyed: Column | None = None) -> DataFrame:
    """Edges after merging nodes: redirected to the kept node, weights of equal edges summed.

    What still touches a merged node stays, with weight ``leftover`` unless it is
    structural; an edge that would become a loop is not redirected.  Different instructions
    of edges that become one are joined by `` | ``, the kept node's own first.  ``keyed``
    says which edges are surely the only ones of their ends and type.
    """
    m = mapping.select(F.col("merge_id"), F.col("keep_id"))
    moved = edges.join(m.toDF("from_id", "keep_from"), "from_id", "left").join(m.toDF("to_id", "keep_to"), "to_id", "left")
    if keyed is not None:
        # Of these, only edges at a node that merges or is kept may become equal to others.
        ends = cut(m.select(F.explode(F.array("merge_id", "keep_id")).alias("from_id")).distinct())
        moved = moved.join(ends.withColumn("__f", F.lit(True)), "from_id", "left").join(ends.select(F.col("from_id").alias("to_id"), F.lit(True).alias("__t")), "to_id", "left")
        moved = moved.withColumn("alone", F.coalesce(keyed, F.lit(False)) & F.col("__f").isNull() & F.col("__t").isNull()).drop("__f", "__t")
    return redirect(moved, leftover)


def redirect(moved: DataFrame, leftover: float = 0.1) -> DataFrame:
    """:func:`merge_redirect` of edges that have the nodes which their ends go to, if any (``keep_from``, ``keep_to``).

    Those that are ``alone`` (if there is that column) equal no other edge after the merge
    and are not grouped.
    """
    moved = moved.withColumn("touched", F.col("keep_from").isNotNull() | F.col("keep_to").isNotNull())
    told, marked = "instruction" in moved.columns, "alone" in moved.columns
    extra = [F.when(F.trim("instruction") != "", F.struct("touched", "from_id", "to_id", "instruction")).alias("said")] if told else []
    ends = moved.select(F.coalesce("keep_from", "from_id").alias("new_from"), F.coalesce("keep_to", "to_id").alias("new_to"), "type", "weight", "touched", *extra, *(["alone"] if marked else []))
    ends = ends.where("not touched or new_from <> new_to")
    sums = [F.sum("weight").alias("weight")]
    if told:
        said = F.transform(F.sort_array(F.collect_list("said")), lambda x: x["instruction"])
        sums.append(F.when(F.size(said) > 0, F.array_join(F.array_distinct(said), " | ")).alias("instruction"))
    redirected = (ends.where("not alone") if marked else ends).groupBy("new_from", "new_to", "type").agg(*sums)
    if marked:
        redirected = ends.where("alone").select("new_from", "new_to", "type", "weight", *([F.col("said.instruction").alias("instruction")] if told else [])).unionByName(redirected)
    redirected = redirected.withColumnsRenamed({"new_from": "from_id", "new_to": "to_id"})
    weight = F.when(F.col("type").isin(*_STRUCTURAL), F.col("weight")).otherwise(F.lit(leftover)).alias("weight")
    left = moved.where("touched").select("from_id", "to_id", "type", weight, *(["instruction"] if told else []))
    return redirected.unionByName(left)


def merge_nodes(nodes: DataFrame, mapping: DataFrame, now_ms: int) -> DataFrame:
    """Nodes after a merge: kept ones gain the merged ones' validated counts, merged ones are superseded now; others stay as they are."""
    gained = nodes.join(mapping, F.col("id") == F.col("merge_id")).groupBy("keep_id").agg(F.sum("validated_count").alias("gain"))
    out = nodes.join(mapping, F.col("id") == F.col("merge_id"), "left").join(gained.withColumnRenamed("keep_id", "gained_id"), F.col("id") == F.col("gained_id"), "left")
    out = out if "superseded_by" in nodes.columns else out.withColumn("superseded_by", F.lit(None).cast("string"))
    gone = F.col("merge_id").isNotNull()
    changed = {"validated_count": F.coalesce("validated_count", F.lit(0)) + F.when(gone, 0).otherwise(F.coalesce("gain", F.lit(0)))}
    new = {"status": F.lit("merged"), "state": F.lit("superseded"), "valid_to": F.lit(now_ms).cast("long"), "updated_at": F.lit(now_ms).cast("long"), "superseded_by": F.col("keep_id")}
    changed |= {c: F.when(gone, v).otherwise(F.col(c)) for c, v in new.items()}
    return out.withColumns(changed).drop("merge_id", "keep_id", "gained_id", "gain")


def backfill_times(rows: DataFrame, now_ms: int) -> DataFrame:
    """Fills null times in order: recorded, then updated, then created, from what is known."""
    recorded = F.coalesce("recorded_at", "timestamp", "created_at", "updated_at", F.lit(now_ms))
    updated = F.coalesce("updated_at", "timestamp", "created_at", F.lit(now_ms))
    created = F.coalesce("created_at", "timestamp", "updated_at", F.lit(now_ms))
    return rows.withColumns({"recorded_at": recorded}).withColumns({"updated_at": updated}).withColumns({"created_at": created})


def model_distribution(rows: DataFrame, configured: str) -> DataFrame:
    """(model, n, needs_migration) of the embeddings."""
    model = F.coalesce("embedding_model", F.lit("unknown"))
    return rows.groupBy(model.alias("model")).agg(F.count(F.lit(1)).alias("n")).withColumn("needs_migration", F.col("model") != configured)


def migrate_model(rows: DataFrame, configured: str) -> DataFrame:
    """Clears embedding and hash of every row of another model."""
    same = F.coalesce("embedding_model", F.lit("unknown")) == configured
    return rows.withColumns({c: F.when(same, F.col(c)) for c in ("embedding", "embedding_hash")})


def project_nodes(records: DataFrame) -> DataFrame:
    """Node records with the defaults of what is missing; the type falls back to the label, else TASK."""
    text = {c: F.coalesce(c, F.lit("")) for c in ("name", "description", "content")}
    numbers = {c: F.coalesce(c, F.lit(0)).cast(t) for c, t in (("pagerank", "double"), ("validated_count", "long"), ("created_at", "long"), ("updated_at", "long"))}
    return records.withColumns({"type": F.coalesce("type", F.upper("label"), F.lit("TASK")), "status": F.coalesce("status", F.lit("active"))} | text | numbers).drop("label")


def project_edges(records: DataFrame) -> DataFrame:
    """Edge records with defaults: the id is from-to-type, the weight 1, the instruction empty."""
    ends = {c: F.coalesce(c, F.lit("")) for c in ("from_id", "to_id", "instruction")}
    out = records.withColumns(ends)
    return out.withColumns({"id": F.coalesce("id", F.concat_ws("-", "from_id", "to_id", "type")), "weight": F.coalesce(F.col("weight").cast("double"), F.lit(1.0)), "created_at": F.coalesce("created_at", F.lit(0)).cast("long"), "updated_at": F.coalesce("updated_at", F.lit(0)).cast("long")})


def in_scope(nodes: DataFrame, scope: str = "production") -> DataFrame:
    """All nodes in the benchmark scope, else those that are not of it."""
    return nodes if scope == "benchmark" else nodes.where(F.coalesce(F.col("scope") != "benchmark", F.lit(True)))


def without_prefix(nodes: DataFrame, edges: DataFrame, prefix: str = "bench-") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after deleting every node whose id starts so, with its edges."""
    return nodes.where(~F.col("id").startswith(prefix)), edges.where(~F.col("from_id").startswith(prefix) & ~F.col("to_id").startswith(prefix))


#: Parts of the names of sessions that hold no dialogue; fixed values.
INNER_SESSIONS = (":active-memory:", "dreaming-narrative")


def without_sessions(keys: DataFrame, parts: tuple[str, ...] = (), memory: bool = False) -> DataFrame:
    """Session keys that hold none of ``parts``, by default of the inner sessions (``memory`` lets those of memory in)."""
    barred = parts or tuple(p for p in INNER_SESSIONS if not (memory and p == ":active-memory:"))
    for part in barred:
        keys = keys.where(~F.col("session_key").contains(part))
    return keys


def cleared(*frames: DataFrame) -> tuple[DataFrame, ...]:
    """Every frame without its rows."""
    return tuple(f.limit(0) for f in frames)


def upsert_messages(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows after merging by id; an incoming message replaces all its fields, and the processed mark stays."""
    fields = ["session_key", "turn", "role", "content", "created_at"]
    both = stored.alias("s").join(incoming.withColumn("__new", F.lit(True)).alias("i"), F.col("s.id") == F.col("i.id"), "full_outer")
    new = F.coalesce(F.col("i.__new"), F.lit(False))
    taken = [F.when(new, F.col(f"i.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in fields]
    return both.select(F.coalesce("s.id", "i.id").alias("id"), *taken, "s.rebuild_processed_at")


def save_vectors(nodes: DataFrame, vectors: DataFrame) -> DataFrame:
    """``nodes`` with embedding, hash and model of those in ``vectors`` (id, ...), and their chunks if it has any."""
    fields = ["embedding", "embedding_hash", "embedding_model", *[c for c in ("chunk_texts", "chunk_embeddings") if c in vectors.columns]]
    both = nodes.alias("n").join(vectors.select("id", *fields).withColumn("__new", F.lit(True)).alias("v"), "id", "left")
    return both.select(*[F.when(F.col("v.__new"), F.col(f"v.{c}")).otherwise(F.col(f"n.{c}")).alias(c) if c in fields else F.col("id") if c == "id" else F.col(f"n.{c}") for c in nodes.columns])


def vector_hash(nodes: DataFrame, ids: list[str]) -> DataFrame:
    return by_id(nodes, ids).select("id", "embedding_hash")


#: Most that an argument may be.
MOST = {"top": 100, "search": 50, "nodes": 500, "messages": 1000, "depth": 5}


def clamped(kind: str, value: int | None, default: int = 10) -> int:
    """A limit of a request, at least 1 and at most what its kind allows."""
    return max(1, min(MOST[kind], default if value is None else int(value)))
