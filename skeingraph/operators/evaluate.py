"""Retrieval evaluation and run statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def match(ranked: DataFrame, expected: DataFrame, nodes: DataFrame) -> DataFrame:
    """``expected`` (case_id, id) with names put in place of ids where a ranked node has such a name."""
    named = ranked.select("case_id", "id").join(nodes.select("id", "name"), "id")
    other = expected.toDF("case_id", "name").join(named, ["case_id", "name"]).select("case_id", "id")
    return expected.select("case_id", "id").unionByName(other).distinct()


def hits(ranked: DataFrame, expected: DataFrame) -> DataFrame:
    """(case_id, first_rank) for every case of ``expected`` (case_id, id): rank of the first hit or null."""
    found = ranked.join(expected, ["case_id", "id"]).groupBy("case_id").agg(F.min("rank").alias("first_rank"))
    return expected.select("case_id").distinct().join(found, "case_id", "left")


def report(results: DataFrame, group: list[str]) -> DataFrame:
    """P@1, P@3, MRR over each combination of ``group`` and its first column alone."""
    r = F.col("first_rank")
    measures = [
        F.count(F.lit(1)).alias("cases"), F.avg(F.when(r <= 1, 1.0).otherwise(0.0)).alias("p1"),
        F.avg(F.when(r <= 3, 1.0).otherwise(0.0)).alias("p3"), F.avg(F.coalesce(1.0 / r, F.lit(0.0))).alias("mrr"),
    ]
    return results.rollup(*group).agg(*measures).where(F.col(group[0]).isNotNull())


def macro(report: DataFrame) -> DataFrame:
    """One row: the measures of whole datasets (rows of :func:`report` without a category), each dataset alike."""
    whole = report.where("category is null")
    return whole.agg(F.count(F.lit(1)).alias("datasets"), *[F.avg(c).alias(c) for c in ("p1", "p3", "mrr")])


def average_tokens(results: DataFrame) -> DataFrame:
    return results.agg(F.coalesce(F.avg("tokens"), F.lit(0.0)).alias("tokens"))


def failed_cases(results: DataFrame) -> DataFrame:
    """Results whose first hit is not the first."""
    return results.where(~F.col("hit1"))


def findings(results: DataFrame) -> DataFrame:
    """One row: what the failed cases and the whole suffer from, counted and judged."""
    lost = ~F.col("hit1")
    counts = results.agg(
        F.count_if(lost).alias("failed"), F.count_if(lost & (F.col("f1") < 0.3) & (F.col("recalled") < 5)).alias("too_few"), F.count_if(lost & (F.col("latency_ms") > 1000)).alias("slow"),
        F.avg(F.col("hit1").cast("double")).alias("p1"), F.avg(F.col("hit3").cast("double")).alias("p3"), F.avg("f1").alias("f1"),
    )
    return counts.withColumns({"coverage": F.col("too_few") > 0, "latency": F.col("slow") > F.col("failed") / 2, "ranking": (F.col("p1") < 0.3) & (F.col("p3") > 2 * F.col("p1")), "answers": F.col("f1") < 0.2})


def percentiles(samples: DataFrame, group: str, value: str, points: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """Nearest-rank percentiles of each group."""
    exact = [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").alias(f"p{int(p * 100)}") for p in points]
    return samples.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), *exact)


def recent(samples: DataFrame, group: str, order: str, tie: str, n: int = 1000) -> DataFrame:
    """The newest ``n`` samples of each group."""
    newest = Window.partitionBy(group).orderBy(F.col(order).desc(), F.col(tie).desc())
    return samples.withColumn("nth", F.row_number().over(newest)).where(F.col("nth") <= n).drop("nth")


def histogram(samples: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """(bucket, upper, n): first bound at or above the value; the last bucket has no bound; empty ones stay."""
    spot = F.lit(len(bounds))
    for i in reversed(range(len(bounds))):
        spot = F.when(F.col(value) <= bounds[i], i).otherwise(spot)
    counts = samples.where(F.col(value).isNotNull()).groupBy(spot.cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    every = samples.sparkSession.createDataFrame([(i, float(b)) for i, b in enumerate(bounds)] + [(len(bounds), None)], "bucket int, upper double")
    return every.join(F.broadcast(counts), "bucket", "left").select("bucket", "upper", F.coalesce("n", F.lit(0)).alias("n"))


def usage(calls: DataFrame) -> DataFrame:
    """Totals by provider, by purpose and over all: (level, key, calls, prompt, completion, total)."""
    sums = [F.count(F.lit(1)).alias("calls"), F.sum("prompt_tokens").alias("prompt"), F.sum("completion_tokens").alias("completion")]
    grouped = calls.groupingSets([["provider"], ["purpose"], []], "provider", "purpose").agg(F.grouping_id().alias("gid"), *sums)
    level = F.when(F.col("gid") == 1, "provider").when(F.col("gid") == 2, "purpose").otherwise("total")
    return grouped.select(level.alias("level"), F.coalesce("provider", "purpose", F.lit("all")).alias("key"), "calls", "prompt", "completion", (F.col("prompt") + F.col("completion")).alias("total"))


def within_budget(rows: DataFrame, group: str, order: list, size: str, budget: int) -> DataFrame:
    """The rows of each group before the first that overflows the budget."""
    running = F.sum(size).over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("used", running).where(F.col("used") <= budget)


def last_exchange(messages: DataFrame) -> DataFrame:
    """(session_key, user, assistant): the last message of each role."""
    last = [F.max_by(F.when(F.col("role") == r, F.col("content")), F.when(F.col("role") == r, F.struct("turn", "id"))).alias(r) for r in ("user", "assistant")]
    return messages.groupBy("session_key").agg(*last)


def extremes(messages: DataFrame, page: int = 50) -> DataFrame:
    """(session_key, messages, max_turn, pages): the running figures of a rebuild."""
    return messages.groupBy("session_key").agg(F.count(F.lit(1)).alias("messages"), F.max("turn").alias("max_turn"), F.ceil(F.count(F.lit(1)) / page).cast("long").alias("pages"))


def running_best(rounds: DataFrame) -> DataFrame:
    """Tuning rounds (turn, p1) with the best so far and how many rounds it stands; rounds are few."""
    order = Window.orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    out = rounds.withColumn("best", F.max("p1").over(order))
    since = F.max(F.when((F.col("p1") == F.col("best")) & F.coalesce(F.col("p1") > F.lag("best").over(Window.orderBy("turn")), F.lit(True)), F.col("turn"))).over(order)
    return out.withColumn("stagnant", F.col("turn") - since)


def metrics_text(measures: DataFrame, prefix: str = "skeingraph") -> str:
    """A line ``prefix_name{label="..."} value`` for each (name, label, value); a small table, in order."""
    rows = measures.orderBy("name", "label").collect()
    lines = []
    for name in dict.fromkeys(r["name"] for r in rows):
        lines.append(f"# TYPE {prefix}_{name} gauge")
        lines += [f"{prefix}_{name}" + (f'{{kind="{r["label"]}"}}' if r["label"] else "") + f" {r['value']:g}" for r in rows if r["name"] == name]
    return "\n".join(lines) + "\n"
