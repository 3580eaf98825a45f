"""Embedding of nodes: a deterministic hashed embedder as an expression, batches, what is missing, sync.

Any ``Callable[[Column], Column]`` from text to ``array<double>`` can stand for the embedder; a
model behind a service would be a Pandas UDF over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores, text
from . import store

Embedder = Callable[[Column], Column]
DIMS = 64


def hashed(value: Column, dims: int = DIMS) -> Column:
    """Unit vector of a text: each token adds 1 or -1 to the place that its MD5 chooses; zeros for no token."""
    marks = F.transform(text.tokens(value), lambda t: F.md5(t.cast("binary")))
    spots = F.transform(marks, lambda m: F.struct((F.conv(F.substring(m, 1, 8), 16, 10).cast("long") % dims).alias("at"), F.when(F.conv(F.substring(m, 9, 1), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0).alias("sign")))

    def once(x: Column, use: Callable[[Column], Column]) -> Column:
        """``use`` of ``x``, which is computed once rather than wherever a lambda names it."""
        return F.get(F.transform(F.array(x), use), F.lit(0))

    def raw(s: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.aggregate(F.filter(s, lambda p: p["at"] == i), F.lit(0.0), lambda total, p: total + p["sign"]))

    return once(spots, lambda s: once(raw(s), lambda v: once(scores.norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(0.0)))))


def embed_nodes(nodes: DataFrame, model: str, embedder: Embedder = hashed, *, chunk: int = 400, overlap: int = 40, least: int = 800) -> DataFrame:
    """(id, embedding, embedding_hash, embedding_model, chunk_texts, chunk_embeddings) of nodes with a text.

    A text of more than ``least`` characters is cut in overlapping chunks, each with its
    vector, and the first one's is the node's; others have no chunks.
    """
    whole = text.embed_text(F.col("name"), F.col("description"), F.col("content"), 1 << 30)
    long = F.char_length("whole") > least
    rows = nodes.where(F.trim(F.concat_ws("", "name", "description", "content")) != "").withColumn("whole", whole)
    pieces = F.when(long, text.chunks(F.col("whole"), chunk, overlap)).otherwise(F.array("whole"))
    rows = rows.select("id", text.content_hash(F.col("name"), F.col("description"), F.col("content")).alias("embedding_hash"), long.alias("long"), F.posexplode(pieces).alias("pos", "piece"))
    # Pieces are embedded one by one wherever they lie, then put together by node.
    rows = rows.withColumn("vector", embedder(F.col("piece")))
    listed = F.sort_array(F.collect_list(F.struct("pos", "piece", "vector")))
    held = rows.groupBy("id", "embedding_hash", "long").agg(listed.alias("x"))
    return held.select("id", F.col("x")[0]["vector"].alias("embedding"), "embedding_hash", F.lit(model).alias("embedding_model"), F.when(F.col("long"), F.transform("x", lambda p: p["piece"])).alias("chunk_texts"), F.when(F.col("long"), F.transform("x", lambda p: p["vector"])).alias("chunk_embeddings"))


def missing(nodes: DataFrame) -> DataFrame:
    """Active nodes without a vector that have a text."""
    empty = F.col("embedding").isNull() | (F.size("embedding") == 0)
    return nodes.where(store.active() & empty & (F.trim(F.concat_ws("", "name", "description", "content")) != ""))


def embed_missing(nodes: DataFrame, model: str, embedder: Embedder = hashed) -> DataFrame:
    """``nodes`` after one pass that embeds those without a vector."""
    return store.save_vectors(nodes, embed_nodes(missing(nodes), model, embedder))


def to_sync(nodes: DataFrame) -> DataFrame:
    """Nodes whose vector is missing or of another text."""
    own = text.content_hash(F.col("name"), F.col("description"), F.col("content"))
    return nodes.where(F.col("embedding").isNull() | F.coalesce(F.col("embedding_hash") != own, F.lit(True)))
