"""Exact top-k search by inner product, exhaustive and term at a time.

Candidates are cut into blocks.  A block is inverted: each term (component) has postings,
the rows that have it and their weights.  A task takes one block of queries and one of
candidates; each query keeps a dense array of scores over the block, and each of its
terms adds its weight times the posting's into it.  Partition selection keeps the best k
of the block, and the blocks' bests are merged.

Vectors that are null, empty of numbers or hold a null or non-finite component take no
part, on either side, and neither do rows without an id.  Vectors of unequal lengths share
the terms that both have.  A candidate with the query's own id is the query's own.  Every
row is a row of its own: one that repeats an id is a candidate as often as it occurs, with
ties to the smaller id; a query whose id repeats answers for each of its rows, and those
answers are ranked from 1 each.  Empty tables
give no rows; other columns of the input are not looked at.

A vector travels as bytes, its components in the smallest integer type that holds them all,
and queries are dealt in blocks of 4096, so a candidate moves once for each 4096 queries.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut

#: Rows of a block of candidates and of a block of queries.
CANDIDATE_BLOCK, QUERY_BLOCK = 8192, 4096


def usable(vector: Column) -> Column:
    """Neither null nor with a null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def quantised(vector: Column, scale: int = 64) -> Column:
    """Each component x as the integer floor(scale * x), x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def _postings(vectors: list[np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows and weights of each term that is not zero."""
    length = np.fromiter((len(v) for v in vectors), dtype=np.int64, count=len(vectors))
    row = np.repeat(np.arange(len(vectors)), length)
    term = np.concatenate([np.arange(n) for n in length]) if len(length) else np.zeros(0, np.int64)
    weight = np.concatenate(vectors) if vectors else np.zeros(0, np.int64)
    there = weight != 0
    row, term, weight = row[there], term[there], weight[there]
    order = np.argsort(term, kind="stable")
    row, term, weight = row[order], term[order], weight[order]
    cuts = np.flatnonzero(np.diff(term)) + 1
    return {int(t[0]): (r, w) for t, r, w in zip(np.split(term, cuts), np.split(row, cuts), np.split(weight, cuts), strict=True) if len(t)}


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids."""
    if len(scores) > k:
        bound = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > bound)
        level = np.flatnonzero(scores == bound)
        need = k - len(above)
        if len(level) > need:
            level = level[np.argpartition(ids[level], need - 1)[:need]]
        at = np.concatenate((above, level))
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))]


def search_block(queries: pd.DataFrame, candidates: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best k of one block of candidates for each query of one block."""
    candidates = candidates.sort_values("id", kind="stable")
    ids = candidates["id"].to_numpy(dtype=np.int64)
    postings = _postings([_unpacked(v) for v in candidates["vector"]])
    out: list[pd.DataFrame] = []
    scores = np.zeros(len(ids), dtype=np.int64)
    for own, number, packed in zip(queries["id"], queries["query"], queries["vector"], strict=True):
        vector = _unpacked(packed)
        scores[:] = 0
        for term in np.flatnonzero(vector):
            rows, weights = postings.get(int(term), (None, None))
            if rows is None:
                continue
            if len(rows) == len(scores):
                scores += weights * vector[term]
            else:
                scores[rows] += weights * vector[term]
        others = np.flatnonzero(ids != own)
        at = others[_best(scores[others], ids[others], k)]
        out.append(pd.DataFrame({"query": number, "query_id": own, "vec_id": ids[at], "score": scores[at]}))
    return pd.concat(out) if out else pd.DataFrame({"query": [], "query_id": [], "vec_id": [], "score": []})


def _packed(vector: Column) -> Column:
    """Integers as bytes, big-endian, of the narrowest of 1, 2, 4 or 8 that holds them all; a first byte tells which."""
    widest = F.coalesce(F.array_max(F.transform(vector, lambda x: F.greatest(x, -x - 1))), F.lit(0))

    def joined(size: int) -> Column:
        return F.concat(F.lit(f"{size:02x}"), F.array_join(F.transform(vector, lambda x: F.substring(F.lpad(F.hex(x), 16, "0"), 17 - 2 * size, 2 * size)), ""))

    chosen = F.when(widest < 1 << 7, joined(1)).when(widest < 1 << 15, joined(2)).when(widest < 1 << 31, joined(4)).otherwise(joined(8))
    return F.unhex(chosen)


def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, dtype=f">i{packed[0]}", offset=1).astype(np.int64)


def top_k(vectors: DataFrame, queries: Column, *, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` best candidates of each row where ``queries`` holds.

    Blocks are dealt by a hash of the row's number.  Every candidate block meets every
    query block in a task of its own, so a task's memory is bounded by the two block sizes.
    """
    rows = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col)))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), _packed(quantised(F.col(vector_col), scale)).alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks"))
    # The number of a row is fixed by the table that is written here.
    rows = cut(rows.withColumn("query", F.monotonically_increasing_id()))
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("q")).first()
    blocks, query_blocks = -(-total["n"] // CANDIDATE_BLOCK) or 1, -(-total["q"] // QUERY_BLOCK) or 1
    place = F.xxhash64("query")
    left = rows.where("asks").select("id", "query", "vector", F.pmod(place, F.lit(query_blocks)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("cb"))
    right = rows.select("id", "vector", F.pmod(place, F.lit(blocks)).cast("int").alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"))

    def run(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        return search_block(asked, held, k)

    near = left.groupBy("cb", "qb").cogroup(right.groupBy("cb", "qb")).applyInPandas(run, "query long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
