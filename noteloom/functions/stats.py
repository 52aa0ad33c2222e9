"""Wilson interval, nearest-rank percentiles and sample notes as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.96


def wilson(hits: Column, total: Column, z: float = Z) -> tuple[Column, Column]:
    """Bounds of the score interval, clamped to [0, 1]; (0, 1) for no observations."""
    n = total.cast("double")
    p = hits.cast("double") / n
    base = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / base
    margin = z / base * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    low, high = F.greatest(F.lit(0.0), centre - margin), F.least(F.lit(1.0), centre + margin)
    return F.when(total > 0, low).otherwise(0.0), F.when(total > 0, high).otherwise(1.0)


def nearest_rank(column: str, p: float) -> Column:
    """Smallest value with at least a share p of the rows at or below it."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})")


def resolution(n: Column) -> Column:
    """What a sample of n latencies can say about its tail."""
    return F.when(n <= 0, "").when(n <= 20, "p95 and p99 are the maximum").when(n <= 100, "p99 is the maximum").otherwise("")
