"""Token counts from an exact histogram of encoded lengths.

Documents are reduced to (length, documents) before anything is shuffled; the histogram
has no more rows than the longest document has tokens.  Suffix sums over it answer, for
every context limit, how many documents and tokens lie at or beyond it, what all texts
total when cut at it, and which share of documents fits.  Answers change at lengths that
occur only, so the suffix sums have a row for each of those, and :func:`at_limits` reads the
answer of any limit from them; :func:`quantiles` reads the length of any share.

Null and empty texts have length 0 and are counted.  Rows that repeat are counted each.
Ids are not looked at and neither are other columns, so nulls and clashing names there do
nothing.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import count_tokens


def length_histogram(docs: DataFrame, path: str, pattern: str, *, text_col: str = "text") -> DataFrame:
    """(n_tokens, n_docs), one row per length that occurs."""
    return count_tokens(docs, path, pattern, text_col=text_col).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def context_limits(histogram: DataFrame) -> DataFrame:
    """Answers for each length as a context limit.

    ``docs_at_least`` and ``tokens_at_least`` are suffix sums; ``truncated_total`` is the
    sum of min(length, limit) over all documents; ``quantile`` is the share of documents
    no longer than the limit; ``total_docs`` and ``total_tokens`` cover everything.
    """
    up = Window.orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy(F.lit(1))
    tokens = F.col("n_tokens") * F.col("n_docs")
    return (
        histogram.withColumns({"docs_at_least": F.sum("n_docs").over(up), "tokens_at_least": F.sum(tokens).over(up)})
        .withColumns({"total_docs": F.sum("n_docs").over(everything), "total_tokens": F.sum(tokens).over(everything)})
        .withColumn("truncated_total", F.col("total_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least"))
        .withColumn("quantile", (F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("total_docs"))
    )


def at_limits(sums: DataFrame, limits: DataFrame) -> DataFrame:
    """The answers of :func:`context_limits` for each of ``limits`` (one column, n_tokens), whether it occurs as a length or not.

    A limit looks up the first length at or beyond it: both are put in one descending
    order, and the last length before a limit is carried to it.  The histogram is small.
    """
    known = ["docs_at_least", "tokens_at_least", "total_docs", "total_tokens"]
    asked = limits.select(F.col("n_tokens").cast("long").alias("n_tokens")).where("n_tokens is not null").distinct()
    everything = sums.agg(F.max("total_docs").alias("total_docs"), F.max("total_tokens").alias("total_tokens"))
    both = sums.select("n_tokens", F.lit(0).alias("asks"), F.col("n_docs"), *known[:2]).unionByName(asked.select("n_tokens", F.lit(1).alias("asks"), F.lit(None).cast("long").alias("n_docs"), *[F.lit(None).cast("long").alias(c) for c in known[:2]]))
    down = Window.orderBy(F.col("n_tokens").desc(), "asks").rowsBetween(Window.unboundedPreceding, 0)
    own = F.last(F.when(F.col("asks") == 0, F.struct("n_tokens", "n_docs")), ignorenulls=True).over(down).alias("own")
    carried = both.select("n_tokens", "asks", *[F.coalesce(F.last(c, ignorenulls=True).over(down), F.lit(0)).alias(c) for c in known[:2]], own).where("asks = 1").crossJoin(F.broadcast(everything))  # one row
    here = F.when(F.col("own.n_tokens") == F.col("n_tokens"), F.col("own.n_docs")).otherwise(0)
    return carried.select(
        "n_tokens", *known, (F.col("total_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_total"),
        ((F.col("total_docs") - F.col("docs_at_least") + here) / F.col("total_docs")).alias("quantile"),
    )


def every_limit(sums: DataFrame) -> DataFrame:
    """The answers for each limit from 0 to the longest length."""
    longest = sums.agg(F.max("n_tokens").alias("most")).where("most is not null")
    return at_limits(sums, longest.select(F.explode(F.sequence(F.lit(0).cast("long"), "most")).alias("n_tokens")))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the smallest length that at least this share of documents does not exceed."""
    asked = sums.sparkSession.createDataFrame([(float(s),) for s in shares], "share double")
    fits = sums.join(F.broadcast(asked), F.col("quantile") >= F.col("share") - 1e-12)  # the shares asked for
    return fits.groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
