"""Connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut, replace


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the smallest node it reaches.

    Large-star and small-star steps in turn: each points nodes at smaller neighbours and
    keeps connectivity, so chains shorten by halves.  No step gathers a node's whole
    neighbourhood in one row; only minima are aggregated.  Stops when nothing changes.
    """
    pairs = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("big"), F.least("a", "b").alias("small")).distinct())
    if pairs.isEmpty():
        return pairs.select(F.col("big").alias("node"), F.col("small").alias("component"))
    before = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("small").alias("big"), F.col("big").alias("small"))).toDF("node", "near")
        low = both.groupBy("node").agg(F.least(F.min("near"), F.col("node")).alias("low"))
        large = both.join(low, "node").where("near > node").select(F.col("near").alias("big"), F.col("low").alias("small")).where("big <> small").distinct()
        low = large.groupBy("big").agg(F.min("small").alias("low"))
        joined = large.join(low, "big")
        small = joined.select(F.col("small").alias("big"), F.col("low").alias("small")).unionByName(joined.select("big", F.col("low").alias("small")))
        pairs = replace(pairs, small.where("big <> small").distinct())
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("big", "small").cast("decimal(38,0)"))).first()
        if now == before:
            out = pairs.groupBy("big").agg(F.min("small").alias("component")).withColumnRenamed("big", "node").unionByName(pairs.select(F.col("small").alias("node"), F.col("small").alias("component")).distinct())
            return replace(pairs, out)
        before = now
