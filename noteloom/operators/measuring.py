"""Measured phases and counts: laps of a run, percentiles by phase, and counts observed with the rows."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from noteloom.operators.evaluation import latency_report

#: Column groups of a measured search, in milliseconds.
PHASES = ("embed", "store", "overhead", "total")


class Clock:
    """Milliseconds of each phase of a run."""

    def __init__(self) -> None:
        self.phases: dict[str, float] = {}
        self.begun = self._at = time.perf_counter()

    def lap(self, name: str, work: Callable[[], object] | None = None) -> None:
        if work is not None:
            work()
        now = time.perf_counter()
        self.phases[name] = round(self.phases.get(name, 0.0) + 1000 * (now - self._at), 3)
        self._at = now

    @property
    def total(self) -> float:
        return round(1000 * (time.perf_counter() - self.begun), 3)


def search_report(timings: DataFrame, p95_gate: float, p99_gate: float) -> DataFrame:
    """phase, n, p50, p95, p99, slowest, note, passed of each phase, from the columns PHASES; the gates are for the total."""
    by_phase = timings.select(F.explode(F.array(*[F.struct(F.lit(p).alias("phase"), F.lit(i).alias("place"), F.col(p).alias("ms")) for i, p in enumerate(PHASES)])).alias("t")).select("t.*")
    report = latency_report(by_phase, ["phase", "place"])
    held = (F.col("phase") != "total") | ((F.col("p95") <= p95_gate) & (F.col("p99") <= p99_gate))
    return report.withColumn("passed", held).orderBy("place").drop("place")


def observed(rows: DataFrame, **counts: Column) -> tuple[DataFrame, Callable[[], dict[str, Any]]]:
    """rows, and a function that gives aggregates over them once they were computed. An attempt of a task that fails counts
    nothing, because its values come with its result."""
    seen = Observation()
    return rows.observe(seen, *[c.alias(n) for n, c in counts.items()]), lambda: seen.get


def with_token_counts(texts: DataFrame, count: Callable[[Column], Column], column: str = "text") -> tuple[DataFrame, Callable[[], dict[str, Any]]]:
    """Adds `tokens`; the counts (calls, bytes, tokens) are exact when tasks fail and run again."""
    rows = texts.withColumn("tokens", count(F.col(column)))
    return observed(rows, calls=F.count("*"), bytes=F.coalesce(F.sum(F.octet_length(column)), F.lit(0)), tokens=F.coalesce(F.sum("tokens"), F.lit(0)))
