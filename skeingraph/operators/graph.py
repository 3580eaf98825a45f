"""Graph algorithms as DataFrame loops: walks, PageRank, label propagation, hierarchies.

A loop's frames are cut to the shared checkpoint folder every few rounds, so plans stay
short and a lost executor costs little.  Edges in both directions are written once and keep
their partitioning through the rounds.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut, drop, partitioned, replace
from . import arrays
from .components import components

_CUT_EVERY = 5


def both_ways(edges: DataFrame) -> DataFrame:
    """(a, b) for each edge in both directions; parallel edges stay."""
    return edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")).unionByName(edges.select(F.col("to_id").alias("a"), F.col("from_id").alias("b")))


def linked_cliques(cliques: DataFrame) -> DataFrame:
    """(clique, id, n) of the cliques that have at least two nodes.

    A clique stands for edges between all its nodes, n times n' between two that are in it n
    and n' times and none from a node to itself, so the pairs need not be made.
    """
    summed = cliques.groupBy("clique", "id").agg(F.sum("n").alias("n"))
    several = summed.groupBy("clique").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("clique")
    return summed.join(several, "clique")


def walk(edges: DataFrame, seeds: DataFrame, depth: int, limit: int | None = None, cliques: DataFrame | None = None) -> DataFrame:
    """(id, distance) of what trails of 1 to ``depth`` edges from the seeds reach, seeds with an edge at 0.

    With ``limit`` the nearest so many nodes, ties to the smaller id.  ``cliques`` are edges too.
    """
    if not 0 <= depth <= 5:
        raise ValueError("depth is 0 to 5")
    ways = both_ways(edges)
    members = None if cliques is None else cut(linked_cliques(cliques).select("clique", "id"))
    ends = ways.select("a") if members is None else ways.select("a").unionByName(members.select(F.col("id").alias("a")))
    found = seeds.select("id").distinct().join(ends, F.col("id") == ends["a"], "left_semi").withColumn("distance", F.lit(0))
    frontier = found = cut(found)
    for k in range(1, depth + 1):
        # The frontier is a small file at first, which Spark broadcasts by its size; edges are only read.
        reached = ways.join(frontier, ways["a"] == frontier["id"], "left_semi").select(F.col("b").alias("id"))
        if members is not None:
            reached = reached.unionByName(members.join(members.join(frontier, "id", "left_semi").select("clique"), "clique", "left_semi").select("id"))
        reached = reached.distinct().join(found, "id", "left_anti")
        frontier = cut(reached.withColumn("distance", F.lit(k)))
        found = cut(found.unionByName(frontier))
    return found.orderBy("distance", "id").limit(limit) if limit else found


def pagerank(nodes: DataFrame, edges: DataFrame, seeds: DataFrame | None = None, damping: float = 0.85, rounds: int = 20, cliques: DataFrame | None = None) -> DataFrame:
    """(id, rank) after exactly ``rounds`` rounds over the undirected multigraph.

    r = (1 - d) t + d * sum over neighbours of r / degree, with t = 1 for every node, or
    for seeds alone.  Nodes without edges keep (1 - d) t.  Edges lie by their start and
    ranks by their node through all rounds, so a round shuffles sums by target alone.
    ``cliques`` are edges too: each node of one gets the sum of all, less its own part.
    Graphs of at most ``arrays.MOST`` nodes take their rounds over arrays.
    """
    base = nodes.select("id").distinct()
    if seeds is None:
        base = base.withColumn("teleport", F.lit(1.0))
    else:
        base = base.join(seeds.select("id").distinct().withColumn("seed", F.lit(1.0)), "id", "left").select("id", F.coalesce("seed", F.lit(0.0)).alias("teleport"))
    held = arrays.packed(nodes, edges, None if cliques is None else cut(linked_cliques(cliques)))
    if held is not None:
        return arrays.ranks(held, nodes.sparkSession, base, damping, rounds)
    steps = both_ways(edges).withColumn("n", F.lit(1).cast("long"))
    if cliques is not None:
        members = cut(linked_cliques(cliques))
        steps = steps.unionByName(members.select(F.col("id").alias("a"), F.col("id").alias("b"), (-F.col("n") * F.col("n")).alias("n")))
    steps = partitioned(steps.groupBy("a", "b").agg(F.sum("n").alias("n")), "a")
    degree = steps.select("a", "n")
    if cliques is not None:
        senders, receivers = partitioned(members, "id"), partitioned(members, "clique")
        totals = members.groupBy("clique").agg(F.sum("n").alias("total"))
        degree = degree.unionByName(receivers.join(totals.hint("shuffle_hash"), "clique").select(F.col("id").alias("a"), (F.col("n") * F.col("total")).alias("n")))
    degree = degree.groupBy("a").agg(F.sum("n").alias("degree"))
    base = partitioned(base.join(degree, base["id"] == degree["a"], "left").select("id", "teleport", F.coalesce("degree", F.lit(1)).alias("degree")), "id")
    ranks = base.withColumn("rank", (1 - damping) * F.col("teleport"))
    for k in range(rounds):
        share = ranks.select("id", (F.col("rank") / F.col("degree")).alias("share")).hint("shuffle_hash")
        flow = steps.join(share, steps["a"] == share["id"]).select("b", (F.col("share") * F.col("n")).alias("flow"))
        if cliques is not None:
            told = senders.join(share, "id").groupBy("clique").agg(F.sum(F.col("share") * F.col("n")).alias("total"))
            flow = flow.unionByName(receivers.join(told.hint("shuffle_hash"), "clique").select(F.col("id").alias("b"), (F.col("n") * F.col("total")).alias("flow")))
        flow = flow.groupBy("b").agg(F.sum("flow").alias("flow"))
        ranks = base.join(flow.hint("shuffle_hash"), base["id"] == flow["b"], "left").select("id", "teleport", "degree", ((1 - damping) * F.col("teleport") + damping * F.coalesce("flow", F.lit(0.0))).alias("rank"))
        # With cliques a round reads the ranks twice, so each is kept.
        if ((k + 1) % _CUT_EVERY == 0 or cliques is not None) and k + 1 < rounds:
            ranks = ranks.checkpoint()
    return ranks.select("id", "rank")


def uniform_rank(nodes: DataFrame) -> DataFrame:
    """(id, rank) where there is no edge at all: 1 / n for each active node."""
    live = nodes.where(F.col("status") == "active").select("id")
    return live.crossJoin(F.broadcast(live.agg(F.count(F.lit(1)).alias("n")))).select("id", (1 / F.col("n")).alias("rank"))  # one row


def global_rank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 20, cliques: DataFrame | None = None) -> DataFrame:
    """PageRank of all nodes; without edges the same for every active node."""
    none = edges.isEmpty() and (cliques is None or linked_cliques(cliques).isEmpty())
    return uniform_rank(nodes) if none else pagerank(nodes, edges, None, damping, rounds, cliques)


def personal_rank(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, candidates: DataFrame, damping: float = 0.85, rounds: int = 20) -> DataFrame:
    """(id, rank) of the active among ``candidates`` (id, pos) from the active seeds; without seeds or edges 1 / (pos + 1)."""
    live = nodes.where(F.col("status") == "active").select("id")
    start = seeds.select("id").join(live, "id", "left_semi")
    asked = candidates.join(live, "id", "left_semi")
    if start.isEmpty() or edges.isEmpty():
        return asked.select("id", (1 / (F.col("pos") + 1)).alias("rank"))
    return pagerank(nodes, edges, start, damping, rounds).join(asked.select("id"), "id", "left_semi")


def label_propagation(nodes: DataFrame, edges: DataFrame, rounds: int = 50, stop_early: bool = True, cliques: DataFrame | None = None) -> DataFrame:
    """(id, label): synchronous rounds from own ids as labels.

    A node takes the most frequent label among its neighbours; its own label if that ties
    for most, else the smallest of the most frequent.  Edges lie by their end through all
    rounds; a round shuffles counts by (node, label), summed before they move, then the best.
    Once all labels are those of two rounds ago they take turns, so what the last round
    would give is known.

    ``cliques`` are edges too.  Labels are counted once a clique, and a node of one has to
    weigh its other neighbours' labels, its own and the clique's two first ones: the third
    is behind one of those two that is not its own.  Nodes of several cliques get their pairs.
    Graphs of at most ``arrays.MOST`` nodes take their rounds over arrays.
    """
    members = pairs = None
    if cliques is not None:
        members = cut(linked_cliques(cliques))
        times = members.groupBy("id").agg(F.count(F.lit(1)).alias("k"), F.max("clique").alias("clique"), F.max("n").alias("m"))
        own = cut(times.where("k = 1").drop("k"))
        several = members.join(times.where("k > 1").select("id"), "id", "left_semi").select("clique", F.col("id").alias("a"), F.col("n").alias("na"))
        pairs = several.join(members, "clique").where("a <> id").groupBy("a", F.col("id").alias("b")).agg(F.sum(F.col("na") * F.col("n")).alias("n"))
    graph = arrays.packed(nodes, edges, members, pairs)
    if graph is not None:
        return arrays.labels(graph, nodes.sparkSession, rounds, stop_early)
    steps = both_ways(edges).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    labels = nodes.select("id", F.col("id").alias("label")).distinct().withColumn("before", F.col("label"))
    if cliques is None:
        labels, free = labels.withColumn("m", F.lit(None).cast("long")), partitioned(steps, "b")
    else:
        free = partitioned(steps.join(own.select(F.col("id").alias("a")), "a", "left_anti").unionByName(pairs), "b")
        held = partitioned(steps.join(own.withColumnRenamed("id", "a"), "a"), "b")
        senders, receivers = partitioned(members, "id"), partitioned(own, "clique")
        labels = labels.join(own, "id", "left")
    labels = partitioned(labels, "id")
    best = F.min(F.struct((-F.col("n")).alias("n"), (-F.col("own")).alias("own"), "near")).alias("best")
    none = F.lit(0).cast("long").alias("n")

    def told(steps: DataFrame, of: DataFrame, *more: str) -> DataFrame:
        """(a, near, n, own) from neighbours; a node's own label is there with no vote, which says how ties go."""
        heard = steps.join(labels.select("id", "label").hint("shuffle_hash"), steps["b"] == labels["id"]).select("a", *more, F.col("label").alias("near"), "n", F.lit(0).alias("own"))
        return heard.unionByName(of.select(F.col("id").alias("a"), *more, F.col("label").alias("near"), none, F.lit(1).alias("own")))

    for k in range(rounds):
        summed = told(free, labels.where("m is null")).groupBy("a", "near").agg(F.sum("n").alias("n"), F.max("own").alias("own"))
        if cliques is not None:
            shares = senders.join(labels.select("id", "label").hint("shuffle_hash"), "id").groupBy("clique", F.col("label").alias("near")).agg(F.sum("n").alias("h"))
            place = F.row_number().over(Window.partitionBy("clique").orderBy(F.col("h").desc(), "near"))
            first = shares.withColumn("place", place).where("place <= 2").select("clique", "near")
            offered = receivers.join(first.hint("shuffle_hash"), "clique").select(F.col("id").alias("a"), "clique", "m", "near", none, F.lit(0).alias("own"))
            asked = told(held, labels.where("m is not null"), "clique", "m").unionByName(offered)
            asked = asked.groupBy("a", "clique", "m", "near").agg(F.sum("n").alias("n"), F.max("own").alias("own"))
            # A node hears all of its clique but itself.
            heard = F.col("n") + F.col("m") * F.coalesce("h", none) - F.col("own") * F.col("m") * F.col("m")
            summed = summed.unionByName(asked.join(shares, ["clique", "near"], "left").select("a", "near", heard.alias("n"), "own"))
        chosen = summed.groupBy("a").agg(best)
        kept = [c for c in ("clique", "m") if c in labels.columns]
        moved = labels.join(chosen.hint("shuffle_hash"), labels["id"] == chosen["a"]).select("id", F.col("best.near").alias("label"), F.col("label").alias("before"), *kept, (F.col("best.near") != F.col("label")).alias("changed"), (F.col("best.near") != F.col("before")).alias("new")).checkpoint()
        labels = moved.drop("changed", "new")
        if stop_early:
            changed, new = moved.agg(F.max("changed"), F.max("new")).first()
            if not changed:
                break
            if not new:
                # These labels and the last ones take turns from here on.
                return labels.select("id", F.col("label" if (rounds - 1 - k) % 2 == 0 else "before").alias("label"))
    return labels.select("id", "label")


def communities(labels: DataFrame) -> DataFrame:
    """(label, community, size, first_member): renamed c-1, c-2, ... by size, ties by smallest member."""
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("first_member"))
    order = Window.orderBy(F.col("size").desc(), "first_member")
    return sizes.withColumn("community", F.concat(F.lit("c-"), F.row_number().over(order)))


def community_links(edges: DataFrame, labels: DataFrame, cliques: DataFrame | None = None) -> DataFrame:
    """(a, b, weight): edges between members of two communities, unordered pairs; those of ``cliques`` are counted from its labels."""
    ends = edges.join(labels.toDF("from_id", "x"), "from_id").join(labels.toDF("to_id", "y"), "to_id").where("x <> y")
    links = ends.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count(F.lit(1)).alias("weight"))
    if cliques is None:
        return links
    own = cliques.join(labels, "id").groupBy("clique", "label").agg(F.sum("n").alias("n"))
    inner = own.toDF("clique", "a", "na").join(own.toDF("clique", "b", "nb"), "clique").where("a < b").select("a", "b", (F.col("na") * F.col("nb")).alias("weight"))
    return links.unionByName(inner).groupBy("a", "b").agg(F.sum("weight").alias("weight"))


def _ordered(links: DataFrame, columns: tuple[str, str] = ("a", "b")):
    return F.struct((-F.col("weight")).alias("weight"), *columns)


def spanning_forest(links: DataFrame) -> DataFrame:
    """The links (a, b, weight) that a greedy merge in order of weight (ties by names) would use.

    Each round every cluster takes its first link in that order, which a greedy merge
    would take as well; clusters at least halve, so the rounds are few.
    """
    live = cut(links.select("a", "b", "weight", F.col("a").alias("ca"), F.col("b").alias("cb")))
    taken: DataFrame | None = None
    while not live.isEmpty():
        ends = live.select(F.col("ca").alias("c"), _ordered(live).alias("o")).unionByName(live.select(F.col("cb").alias("c"), _ordered(live).alias("o")))
        first = ends.groupBy("c").agg(F.min("o").alias("o")).select("o.a", "o.b").distinct()
        chosen = cut(live.join(first, ["a", "b"]))
        new = chosen.select("a", "b", "weight")
        taken = replace(taken, new if taken is None else taken.unionByName(new))
        label = components(chosen.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        drop(chosen)
        for end in ("ca", "cb"):
            named = label.select(F.col("node").alias(end), F.col("component").alias("to"))
            live = live.join(named, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        live = cut(live.where("ca <> cb"))
    return taken if taken is not None else links.select("a", "b", "weight").limit(0)


def _first_in_order(links: DataFrame, most: int) -> DataFrame:
    """The first ``most`` links in order of weight, by a sort and the sizes of its partitions."""
    placed = cut(links.orderBy(_ordered(links)).withColumn("at", F.monotonically_increasing_id()))
    # One row for each partition of the sort.
    sizes = placed.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n")).select("part", "before")
    nth = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)
    return placed.join(F.broadcast(before), F.shiftright("at", 33) == F.col("part")).where(nth < most).select("a", "b", "weight")


def hierarchy_level(links: DataFrame, members: DataFrame) -> DataFrame:
    """(label, cluster): communities merged greedily by link weight down to the square root of their number.

    The greedy merge takes the links of a spanning forest in order, so the forest is grown
    in rounds on the cluster and cut after as many links as merges are wanted.  Clusters are
    named h-1, h-2, ... in order of their smallest community.
    """
    names = cut(members.select("label").distinct())
    count = names.count()
    taken = _first_in_order(spanning_forest(links), count - max(1, isqrt(count)))
    root = components(taken).withColumnRenamed("node", "label")
    rooted = names.join(root, "label", "left").select("label", F.coalesce("component", "label").alias("root"))
    # As many roots as the square root of the communities, or as parts that no link joins.
    order = F.row_number().over(Window.orderBy("root"))
    named = rooted.select("root").distinct().withColumn("cluster", F.concat(F.lit("h-"), order))
    return rooted.join(named, "root").select("label", "cluster")


def drill_down(nodes: DataFrame, *, domain: str | None = None, topic: str | None = None, community: str | None = None) -> DataFrame:
    """Ids of the active nodes of the widest of the levels that is named; none without a name."""
    for column, value in (("domain_id", domain), ("topic_id", topic), ("community_id", community)):
        if value is not None:
            return nodes.where((F.col("status") == "active") & (F.col(column) == value)).select("id")
    return nodes.limit(0).select("id")


def write_levels(nodes: DataFrame, levels: DataFrame) -> DataFrame:
    """``nodes`` with topic and domain of their community from ``levels`` (community_id, topic_id, domain_id)."""
    kept = [c for c in nodes.columns if c not in ("topic_id", "domain_id")]
    return nodes.select(*kept).join(levels, "community_id", "left").select(*kept, "topic_id", "domain_id")


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that a node reaches over edges in any direction."""
    found = components(edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")))
    return nodes.select("id").join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, different linked pairs, and their share of all pairs."""
    pairs = edges.where("from_id <> to_id").select(F.least("from_id", "to_id").alias("a"), F.greatest("from_id", "to_id").alias("b")).distinct()
    out = nodes.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(pairs.agg(F.count(F.lit(1)).alias("pairs")))  # one row each
    most = F.col("nodes") * (F.col("nodes") - 1) / 2
    return out.withColumn("density", F.when(most > 0, F.col("pairs") / most).otherwise(0.0))


def summary_members(nodes: DataFrame, most: int = 10) -> DataFrame:
    """(community_id, place, name, type, description): the members that a summary is written from, most validated first."""
    order = Window.partitionBy("community_id").orderBy(F.col("validated_count").desc(), "id")
    own = nodes.where((F.col("status") == "active") & F.col("community_id").isNotNull())
    return own.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("community_id", "place", "name", "type", "description")


def community_peers(nodes: DataFrame, node_id: str, limit: int = 5) -> DataFrame:
    """Others of a node's community, by pagerank, validations and id."""
    own = nodes.where(F.col("id") == node_id).select("community_id")
    peers = nodes.where((F.col("status") == "active") & (F.col("id") != node_id)).join(own, "community_id", "left_semi")
    return peers.orderBy(F.col("pagerank").desc(), F.col("validated_count").desc(), "id").limit(limit)


def representatives(nodes: DataFrame, per_community: int = 2) -> DataFrame:
    """The first members of each community by pagerank and validations."""
    order = Window.partitionBy("community_id").orderBy(F.col("pagerank").desc(), F.col("validated_count").desc(), "id")
    own = nodes.where((F.col("status") == "active") & F.col("community_id").isNotNull())
    return own.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= per_community)
