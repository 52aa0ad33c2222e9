"""Evaluation: hits, recall with intervals, ties, baselines, coverage, latency and ingest verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from noteloom.functions.stats import nearest_rank, resolution, wilson


def judge(questions: DataFrame, ranked: DataFrame, k: int) -> DataFrame:
    """One row per question: hit within the first k, and whether a tie at the cut decided it.

    questions: question_id, uid, chunk_index (null accepts any chunk), area, errored. ranked: question_id, uid,
    chunk_index, score, rank.
    """
    top = ranked.where(F.col("rank") <= k)
    edge = Window.partitionBy("question_id")
    top = top.withColumn("_n", F.count("*").over(edge)).withColumn("_last", F.min("score").over(edge)).withColumn("_shared", F.sum((F.col("score") == F.col("_last")).cast("int")).over(edge))
    q = questions.select("question_id", F.col("uid").alias("want"), F.col("chunk_index").alias("want_chunk"), "area", "errored")
    match = (F.col("uid") == F.col("want")) & (F.col("want_chunk").isNull() | (F.col("want_chunk") == F.col("chunk_index")))
    tied = match & (F.col("_n") >= k) & (F.col("_shared") > 1) & (F.col("score") == F.col("_last"))
    joined = q.join(top, "question_id", "left").groupBy("question_id", "area", "errored").agg(F.max(F.coalesce(match, F.lit(False)).cast("int")).alias("hit"), F.max(F.coalesce(tied, F.lit(False)).cast("int")).alias("tied"))
    return joined.select("question_id", "area", "errored", ((F.col("hit") == 1) & ~F.col("errored")).alias("hit"), ((F.col("tied") == 1) & ~F.col("errored")).alias("tied"))


def recall(results: DataFrame) -> DataFrame:
    """Global row (area null) and one per area in one pass; errored questions are on neither side."""
    asked = (~F.col("errored")).cast("long")
    grouped = results.groupingSets([["area"], []], "area").agg(F.grouping("area").alias("overall"), F.sum((F.col("hit") & ~F.col("errored")).cast("long")).alias("hits"), F.sum(asked).alias("total"), F.sum(F.col("tied").cast("long")).alias("tied"), F.bool_and(~F.col("errored")).alias("complete"))
    low, high = wilson(F.col("hits"), F.col("total"))
    value = F.when(F.col("total") > 0, F.col("hits") / F.col("total")).otherwise(0.0)
    return grouped.select(F.when(F.col("overall") == 1, "*").otherwise(F.col("area")).alias("area"), "hits", "total", F.round(value, 6).alias("recall"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"), "tied", "complete")


def outcomes(results: DataFrame) -> DataFrame:
    """The questions that a person looks at: question_id, area, kind (failed, errored or tied)."""
    kind = F.when(F.col("errored"), "errored").when(~F.col("hit"), "failed").when(F.col("tied"), "tied")
    return results.withColumn("kind", kind).where(F.col("kind").isNotNull()).select("question_id", "area", "kind")


METHOD = "Wilson 95 %"
TITLES = {"failed": "Questions without their note", "tied": "Hits that a tie at the cut decided", "errored": "Questions that could not be asked"}


def recall_markdown(report: Sequence[Row], listed: Sequence[Row], k: int, mode: str, commit: str = "", stale: Sequence[Row] = (), coverage: Sequence[Row] = ()) -> str:
    """The report of a run for people. report: rows of `recall`; listed: rows of `outcomes` with their question."""
    rows = {r["area"]: r for r in report}
    total = rows.pop("*")
    span = lambda r: f"{r['recall']:.4f} | {r['low']:.4f} to {r['high']:.4f}"
    lines = ["# Recall", "", f"Mode {mode}, first {k} results, intervals by {METHOD}.", ""]
    if not total["complete"]:
        lines += ["**Incomplete: some questions could not be asked. They are in no number below, so this run passes no gate.**", ""]
    lines += ["| area | hits | asked | recall | interval |", "|-|-|-|-|-|", f"| all | {total['hits']} | {total['total']} | {span(total)} |"]
    lines += [f"| {a} | {r['hits']} | {r['total']} | {span(r)} |" for a, r in sorted(rows.items())]
    for kind, title in TITLES.items():
        own = [r for r in listed if r["kind"] == kind]
        lines += ["", f"## {title}", "", *([f"* {r['question']} ({r['area']})" for r in own] or ["None."])]
    lines += ["", "## Origin of the questions", "", f"Commit {commit}." if commit else "Nobody looked up the commit of the questions."]
    lines += [f"* {r['question']}: {r['reason']}" for r in stale]
    if coverage:
        lines += ["", "## Coverage", "", *[f"* {r['kind']}: {r['area'] or 'all'} has {r['have']}, bound {r['bound']}" for r in coverage]]
    return "\n".join(lines) + "\n"


def decision_markdown(hybrid: Row, dense: Row, k: int, date: str) -> str:
    """Which mode a collection should use, and the numbers behind it. Both are overall rows of `recall`."""
    if not (hybrid["complete"] and dense["complete"]):
        raise ValueError("a run is incomplete: its number is not the recall of the whole set")
    if hybrid["total"] != dense["total"]:
        raise ValueError(f"the runs asked {hybrid['total']} and {dense['total']} questions")
    keep = "dense" if dense["recall"] > hybrid["recall"] else "hybrid"
    lines = ["# Hybrid or dense", "", f"{date}, {hybrid['total']} questions, first {k} results, intervals by {METHOD}.", "", "| mode | hits | recall | interval |", "|-|-|-|-|"]
    lines += [f"| {name} | {r['hits']} | {r['recall']:.4f} | {r['low']:.4f} to {r['high']:.4f} |" for name, r in (("hybrid", hybrid), ("dense", dense))]
    return "\n".join([*lines, "", f"Keep {keep}: the larger recall, and hybrid if they are equal.", ""])


BASELINE_KEYS = {"k", "mode", "recall"}


def baseline_of(report: Sequence[Row], k: int, mode: str) -> dict:
    """A run as the document that later runs are compared with."""
    return {"k": k, "mode": mode, "recall": {r["area"]: r["recall"] for r in report}}


def baseline_rows(spark: SparkSession, saved: dict, k: int, mode: str) -> DataFrame:
    if (saved["k"], saved["mode"]) != (k, mode):
        raise ValueError(f"the baseline is of mode {saved['mode']} and {saved['k']} results, not {mode} and {k}")
    return spark.createDataFrame(sorted(saved["recall"].items()), "area string, recall double")


def gate(report: DataFrame, threshold: float) -> DataFrame:
    """Whether the overall row is complete and at or above the threshold."""
    return report.where("area = '*'").select("hits", "total", "complete", (F.col("complete") & (F.col("recall") >= threshold)).alias("passed"))


def baseline_delta(now: DataFrame, before: DataFrame) -> DataFrame:
    """Recall per area against a saved run; a missing side counts as zero."""
    a, b = now.select("area", F.col("recall").alias("now")), before.select("area", F.col("recall").alias("before"))
    out = a.join(b, "area", "full_outer").select("area", F.coalesce("before", F.lit(0.0)).alias("before"), F.coalesce("now", F.lit(0.0)).alias("now"))
    return out.withColumn("delta", F.round(F.col("now") - F.col("before"), 6)).withColumn("regressed", F.col("delta") < 0)


def compare_modes(hybrid: DataFrame, dense: DataFrame) -> DataFrame:
    """Overall recall of two runs; a tie keeps hybrid."""
    h, d = hybrid.where("area = '*'").select(F.col("recall").alias("hybrid")), dense.where("area = '*'").select(F.col("recall").alias("dense"))
    return h.crossJoin(d).withColumn("keep", F.when(F.col("dense") > F.col("hybrid"), "dense").otherwise("hybrid"))


def stale_questions(questions: DataFrame, commits: DataFrame, baseline: Column) -> DataFrame:
    """Questions written after the baseline, or without a known commit. commits: identity, committed."""
    reason = F.when(F.col("committed").isNull(), "no commit").when(F.col("committed") > baseline, "after the baseline")
    return questions.join(commits, "identity", "left").withColumn("reason", reason).where(F.col("reason").isNotNull())


def full(have: Column, most: Column) -> Column:
    return (most > 0) & (have >= most)


def coverage_status(questions: DataFrame, groups: DataFrame) -> DataFrame:
    """Areas of the coverage table, neediest first. groups: name, area, min, max (one row per area)."""
    have = questions.groupBy("area").agg(F.count("*").alias("have"))
    out = groups.join(have, "area", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    out = out.withColumn("needs", F.greatest(F.col("min") - F.col("have"), F.lit(0))).withColumn("full", full(F.col("have"), F.col("max")))
    order = Window.orderBy("full", F.desc("needs"), "have", "area")  # one row per declared area
    return out.withColumn("position", F.row_number().over(order))


def coverage_violations(questions: DataFrame, groups: DataFrame, min_total: int, max_total: int) -> DataFrame:
    """Every violation at once: kind, area, have, bound."""
    if min_total <= 0 and max_total <= 0:
        raise ValueError("the coverage table bounds no total")
    status = coverage_status(questions, groups)
    total = questions.agg(F.count("*").alias("have"))
    none = F.lit(None).cast("string").alias("area")
    parts = [
        total.where((F.lit(min_total) > 0) & (F.col("have") < min_total)).select(F.lit("total below").alias("kind"), none, "have", F.lit(min_total).cast("long").alias("bound")),
        total.where((F.lit(max_total) > 0) & (F.col("have") > max_total)).select(F.lit("total above").alias("kind"), none, "have", F.lit(max_total).cast("long").alias("bound")),
        status.where((F.col("min") > 0) & (F.col("have") < F.col("min"))).select(F.lit("area below").alias("kind"), "area", "have", F.col("min").cast("long").alias("bound")),
        status.where((F.col("max") > 0) & (F.col("have") > F.col("max"))).select(F.lit("area above").alias("kind"), "area", "have", F.col("max").cast("long").alias("bound")),
        questions.groupBy("area").agg(F.count("*").alias("have")).join(groups, "area", "left_anti").select(F.lit("unlisted").alias("kind"), "area", "have", F.lit(None).cast("long").alias("bound")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def draw_note(status: DataFrame, cards: DataFrame, seed: int) -> DataFrame:
    """A note of the neediest area that is not full, the same for the same seed."""
    areas = status.where(~F.col("full")).select("area", "position")
    return cards.join(areas, "area").orderBy("position", F.md5(F.concat(F.lit(f"{seed}:"), "uid")), "uid").limit(1).drop("position")


def latency_report(timings: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Nearest-rank percentiles of `ms`, and what the sample size allows to say."""
    out = timings.groupBy(*(by or [])).agg(F.count("*").alias("n"), *[nearest_rank("ms", p).alias(f"p{int(p * 100)}") for p in (0.5, 0.95, 0.99)], F.max("ms").alias("slowest"))
    return out.withColumn("note", resolution(F.col("n")))


def latency_verdict(report: DataFrame, p95_gate: float, p99_gate: float) -> DataFrame:
    return report.withColumn("passed", (F.col("p95") <= p95_gate) & (F.col("p99") <= p99_gate))


def ingest_verdict(runs: DataFrame, gate_ms: float) -> DataFrame:
    """runs: total, lock, scan, orchestrate (ms), notes, reprocessed. A run that reprocessed notes gives no verdict."""
    out = runs.withColumn("unaccounted", F.round(F.col("total") - (F.col("lock") + F.col("scan") + F.col("orchestrate")), 6))
    return out.withColumn("verdict", F.when(F.col("reprocessed") > 0, "not measured").when(F.col("total") <= gate_ms, "passed").otherwise("failed"))


def suite_verdict(cases: DataFrame) -> DataFrame:
    """All cases must hold; an empty suite fails."""
    return cases.agg(F.count("*").alias("cases"), (F.coalesce(F.bool_and("passed"), F.lit(False)) & (F.count("*") > 0)).alias("passed"))


def foreign_rows(results: DataFrame, owners: DataFrame) -> DataFrame:
    """Rows of a search that another tenant owns. results: tenant_id, uid; owners: uid, owner."""
    return results.join(owners, "uid").where(F.col("owner") != F.col("tenant_id"))
