"""Scalar score expressions.  Time is epoch milliseconds and ``now_ms`` is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def age_days(updated_at: Column, now_ms: int) -> Column:
    """Days since the last update; a missing time counts as now."""
    return F.when(updated_at.isNull(), 0.0).otherwise((F.lit(now_ms) - updated_at) / F.lit(float(DAY_MS)))


def staleness(state: Column, updated_at: Column, in_degree: Column, source: Column, now_ms: int) -> Column:
    """1 for superseded nodes, else steps by age, +0.2 without incoming edges, -0.1 for knowledge."""
    age = age_days(updated_at, now_ms)
    by_age = (
        F.when(age > 365, 0.8).when(age > 180, 0.5).when(age > 90, 0.3)
        .when(age > 45, 0.1 + 0.2 * (age - 45) / 45).otherwise(0.0)
    )
    lonely = F.when(in_degree == 0, 0.2).otherwise(0.0)
    trusted = F.when(source == "knowledge", 0.1).otherwise(0.0)
    return F.when(state == "superseded", 1.0).otherwise(F.round(clamp(by_age + lonely - trusted), 3))


def staleness_incremental(state: Column, updated_at: Column, source: Column, now_ms: int) -> Column:
    """The coarser rule of incremental runs: steps only, no in-degree, not rounded."""
    age = F.when(F.coalesce(updated_at, F.lit(0)) <= 0, 0.0).otherwise((F.lit(now_ms) - updated_at) / F.lit(float(DAY_MS)))
    by_age = F.when(age > 365, 0.8).when(age > 180, 0.5).when(age > 90, 0.3).when(age > 45, 0.1).otherwise(0.0)
    trusted = F.when(source == "knowledge", 0.1).otherwise(0.0)
    return F.when(state == "superseded", 1.0).otherwise(clamp(by_age - trusted))


def importance(updated_at: Column, validated: Column, pagerank: Column, max_pagerank: Column, source: Column, now_ms: int, weights: tuple[float, ...] = (0.3, 0.3, 0.2, 0.2)) -> Column:
    """Weighted recency, use, centrality and source; weights are normalised."""
    total = sum(weights)
    recency = F.greatest(F.lit(0.0), 1 - F.least(age_days(updated_at, now_ms), F.lit(30.0)) / 30)
    use = F.least(validated / F.lit(10.0), F.lit(1.0))
    central = F.when(max_pagerank > 0, clamp(pagerank / max_pagerank)).otherwise(0.0)
    trust = F.when(source == "knowledge", 1.0).when(source == "imported", 0.5).otherwise(0.7)
    return sum(part * (w / total) for part, w in zip((recency, use, central, trust), weights, strict=True))


def importance_incremental(updated_at: Column, validated: Column, pagerank: Column, source: Column, now_ms: int, weights: tuple[float, ...] = (0.3, 0.3, 0.2, 0.2)) -> Column:
    """Exponential recency and use, ten-fold centrality; weights as given."""
    recency = F.exp(-age_days(updated_at, now_ms) / 30)
    use = 1 - F.exp(-validated / F.lit(10.0))
    central = F.least(F.lit(1.0), 10 * pagerank)
    trust = F.when(source == "knowledge", 1.0).when(source == "experience", 0.7).otherwise(0.5)
    return clamp(sum(part * w for part, w in zip((recency, use, central, trust), weights, strict=True)))


def temporal_recency(updated_at: Column, valid_to: Column, state: Column, now_ms: int) -> Column:
    """exp(-age / 30 days); 0 for nodes that expired or are superseded or transitional."""
    expired = (valid_to > 0) & (valid_to < now_ms)
    gone = F.coalesce(expired, F.lit(False)) | state.isin("transitional", "superseded")
    return F.when(gone, 0.0).otherwise(F.exp(-F.greatest(F.lit(0.0), age_days(updated_at, now_ms)) / 30))


def combined(similarity: Column, structure: Column, stale: Column, recency: Column, temporal_weight: float = 0.3) -> Column:
    """(1 - tw) * (0.7 similarity + 0.3 structure * freshness) + tw * recency."""
    base = 0.7 * similarity + 0.3 * structure * (1 - clamp(F.coalesce(stale, F.lit(0.0))))
    return (1 - temporal_weight) * base + temporal_weight * recency


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 for null, empty or zero vectors and for unequal lengths."""
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm(a) > 0) & (norm(b) > 0)
    return F.when(F.coalesce(usable, F.lit(False)), dot(a, b) / (norm(a) * norm(b))).otherwise(0.0)


def reward(used: Column, unused: Column) -> Column:
    """(used - unused) / (used + unused), 0 without feedback."""
    return F.when(used + unused > 0, (used - unused) / (used + unused)).otherwise(0.0)
