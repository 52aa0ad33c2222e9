"""The point table: expected points, integrity, keyed merge, pruning, orphans, statistics, ingest report."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteloom.functions.identity import NUL, fingerprint_fields, point_hash, point_id
from noteloom.operators.retrieval import of_tenant

KEY, NOTE = ["tenant_id", "uid", "chunk_index"], ["tenant_id", "uid"]
#: Payload fields that may differ from disk without making a point stale.
LOOSE_FIELDS = ("updated", "point_hash")
STATES = ("skipped", "embedded", "upsert_confirmed", "pruned", "failed")


def expected_points(chunks: DataFrame, pipeline: Mapping[str, str], embedder: Mapping[str, str]) -> DataFrame:
    """Chunk rows named like the payload, with point_id and point_hash."""
    return chunks.withColumn("point_id", point_id(F.col("tenant_id"), F.col("uid"), F.col("chunk_index"))).withColumn("point_hash", point_hash(F.col("text"), fingerprint_fields(pipeline, embedder)))


def _short(digest: Column) -> Column:
    return F.when(F.length(digest) <= 12, digest).otherwise(F.concat(F.substring(digest, 1, 12), F.lit("…")))


def integrity(expected: DataFrame, stored: DataFrame, fields: Sequence[str]) -> DataFrame:
    """tenant_id, uid, intact, reason: per note, the first of duplicate index, missing index, count, hash and field drift."""
    compared = [c for c in fields if c not in LOOSE_FIELDS and c not in KEY]
    have = stored.groupBy(*KEY).agg(F.count("*").alias("_copies"), *[F.first(c).alias(f"_{c}") for c in [*compared, "point_hash"]])
    both = expected.select(*KEY, *compared, "point_hash", F.lit(True).alias("_wanted")).join(have, KEY, "full_outer")
    drift = F.coalesce(*[F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in compared], F.lit(None).cast("string")) if compared else F.lit(None).cast("string")
    wanted, found = F.coalesce("_wanted", F.lit(False)), F.col("_copies").isNotNull()
    index = F.col("chunk_index").cast("string")
    step, reason = F.lit(None).cast("int"), F.lit(None).cast("string")
    for number, broken, text in (
        (3, wanted & found & drift.isNotNull(), F.concat(F.lit("chunk_index "), index, F.lit(": field "), drift, F.lit(" differs"))),
        (2, wanted & found & (F.col("point_hash") != F.col("_point_hash")), F.concat(F.lit("chunk_index "), index, F.lit(": hash "), _short(F.col("_point_hash")), F.lit(" is not "), _short(F.col("point_hash")))),
        (1, wanted & ~found, F.concat(F.lit("missing chunk_index "), index)),
        (0, F.col("_copies") > 1, F.concat(F.lit("duplicate chunk_index "), index)),
    ):
        # Hash and fields are compared index by index; they share a step.
        step = F.when(broken, number if number < 2 else 3).otherwise(step)
        reason = F.when(broken, text).otherwise(reason)
    rows = both.select("tenant_id", "uid", "chunk_index", F.struct(step.alias("step"), F.col("chunk_index"), reason.alias("reason")).alias("_problem"), step.alias("_step"), wanted.alias("_wanted"), F.coalesce("_copies", F.lit(0)).alias("_copies"))
    notes = rows.groupBy("tenant_id", "uid").agg(F.sum(F.col("_wanted").cast("int")).alias("wanted"), F.sum("_copies").alias("found"), F.min(F.when(F.col("_step").isNotNull(), F.col("_problem"))).alias("first"))
    early = F.col("first.step") <= 1
    count = F.when(F.col("wanted") != F.col("found"), F.concat(F.lit("found "), F.col("found").cast("string"), F.lit(" points, expected "), F.col("wanted").cast("string")))
    return notes.select("tenant_id", "uid", F.coalesce(F.when(early, F.col("first.reason")), count, F.col("first.reason")).alias("reason")).withColumn("intact", F.col("reason").isNull())


def _known(columns: Sequence[str]) -> list[Column]:
    """Columns and which of them are null, for hashes that pass over nulls."""
    return [F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in columns]), *map(F.col, columns)]


def point_digests(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """tenant_id, uid, n, digest: one hash over the points of a note, of their order, hashes and payloads."""
    compared = [c for c in fields if c not in LOOSE_FIELDS and c not in KEY]
    own = F.struct("chunk_index", "point_hash", F.xxhash64(*_known(compared)).alias("payload"))
    return rows.groupBy(*NOTE).agg(F.count("*").alias("n"), F.sha2(F.to_json(F.sort_array(F.collect_list(own))), 256).alias("digest"))


def source_digest(notes: DataFrame, settings: Mapping[str, str], fields: Sequence[str], body: str = "body") -> Column:
    """A hash of all that a note's points are made from: its text and metadata, and the settings of pipeline and embedder."""
    made = F.lit(NUL.join(f"{k}={settings[k]}" for k in sorted(settings)))
    return F.sha2(F.concat_ws(NUL, made, F.to_json(F.struct(*sorted(fields))), F.col(body)), 256)


def differing(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """tenant_id, uid of notes whose digests are not the same on both sides; both: tenant_id, uid, digest."""
    own, have = expected.select(*NOTE, F.col("digest").alias("_own")), stored.select(*NOTE, F.col("digest").alias("_have"))
    return own.join(have, NOTE, "full_outer").where(~F.col("_own").eqNullSafe(F.col("_have"))).select(*NOTE)


def integrity_by_digest(expected: DataFrame, stored: DataFrame, fields: Sequence[str], known: DataFrame | None = None) -> DataFrame:
    """What `integrity` tells, with the payloads of differing notes alone. known: stored digests, if they were kept."""
    have = point_digests(stored, fields) if known is None else known
    wanted = point_digests(expected, fields)
    odd = differing(wanted, have)
    told = integrity(expected.join(odd, NOTE, "left_semi"), stored.join(odd, NOTE, "left_semi"), fields)
    same = wanted.select(*NOTE).join(odd, NOTE, "left_anti").select(*NOTE, F.lit(None).cast("string").alias("reason"), F.lit(True).alias("intact"))
    return told.unionByName(same)


def upsert(stored: DataFrame, fresh: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Keyed merge: fresh rows replace stored ones with the same key; replaying it changes nothing."""
    return stored.join(fresh.select(*key), list(key), "left_anti").select(*fresh.columns).unionByName(fresh)


def prune_tail(stored: DataFrame, counts: DataFrame) -> DataFrame:
    """Drop points at or beyond each note's chunk count. counts: tenant_id, uid, n_chunks."""
    return stored.join(counts, ["tenant_id", "uid"], "left").where(F.col("n_chunks").isNull() | (F.col("chunk_index") < F.col("n_chunks"))).drop("n_chunks")


def write_tenants(points: DataFrame, path: str, tenants: Sequence[str] = ()) -> None:
    """Overwrite the tenants that occur in points, and empty those of `tenants` that have no points left; no others."""
    points.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tenant_id").parquet(path)
    if not tenants:
        return
    spark = points.sparkSession
    left = {r.tenant_id for r in points.where(F.col("tenant_id").isin(*tenants)).select("tenant_id").distinct().collect()}
    for tenant in set(tenants) - left:
        escaped = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(tenant)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path, f"tenant_id={escaped}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


class WriteFailed(RuntimeError):
    pass


def write_confirmed(write: Callable[[], None], confirmed: Callable[[], bool], attempts: int = 3) -> None:
    """Run an idempotent write until it is confirmed: an error leaves open whether rows arrived, so it is never taken as
    success, and nothing may be pruned after WriteFailed."""
    problem: Exception | None = None
    for _ in range(max(1, attempts)):
        try:
            write()
            if confirmed():
                return
        except OSError as e:
            problem = e
    raise WriteFailed(f"not confirmed after {max(1, attempts)} attempts") from problem


def scroll_tenant(points: DataFrame, tenant: str) -> DataFrame:
    """All points of one tenant without vectors, as payload rows."""
    return points.where(of_tenant(tenant)).select(*[c for c in points.columns if c not in ("dense", "sparse")])


def assert_rows(rows: DataFrame, expected: int) -> DataFrame:
    """The rows, of which there must be so many: a read that lost a part is an error, not a shorter answer."""
    if (n := rows.count()) != expected:
        raise ValueError(f"read {n} rows of {expected}")
    return rows


def foreign_tenants(rows: DataFrame, tenant: str) -> DataFrame:
    """Rows about to be written that do not carry the tenant of the run."""
    return rows.where(~F.col("tenant_id").eqNullSafe(tenant))


def orphans(stored: DataFrame, live: DataFrame, vaults: Sequence[str]) -> DataFrame:
    """Stored notes that no live note has, within the scanned vaults; path_claimed if another note now has the path."""
    notes = stored.groupBy("uid").agg(F.min(F.struct("chunk_index", "vault", "path")).alias("head"), F.count("*").alias("points")).select("uid", "head.vault", "head.path", "points")
    gone = notes.where(F.col("vault").isin(*vaults)).join(live.select("uid"), "uid", "left_anti")
    claimed = live.select("vault", "path", F.lit(True).alias("_claimed")).distinct()
    return gone.join(claimed, ["vault", "path"], "left").select("uid", "vault", "path", "points", F.coalesce("_claimed", F.lit(False)).alias("path_claimed"))


def in_order(orphaned: DataFrame) -> DataFrame:
    """Orphans by vault, path and uid with their position, for a person to read."""
    return orphaned.withColumn("position", F.row_number().over(Window.orderBy("vault", "path", "uid")))


def on_disk(orphaned: DataFrame, files: DataFrame) -> DataFrame:
    """Adds `state`: claimed or absent orphans may be pruned; present ones are indexed but not scanned.

    files: vault, path, of every file seen, excluded, empty and unreadable ones included. Only a proven absence allows a
    prune, so the listing must be whole: whoever could not list a vault leaves its orphans out.
    """
    seen = files.select("vault", "path", F.lit(True).alias("_seen")).distinct()
    state = F.when(F.col("path_claimed"), "prunable").when(F.coalesce("_seen", F.lit(False)), "on_disk").otherwise("prunable")
    return orphaned.join(seen, ["vault", "path"], "left").withColumn("state", state).drop("_seen")


class PruneRefused(ValueError):
    pass


def prune_refusal(confirmed: bool, filtered: bool = False, interrupted: bool = False, scanned: bool = True) -> str | None:
    """Why orphans must not be pruned; None if they may."""
    for refused, why in ((filtered, "the run was filtered"), (not scanned, "orphans were not scanned"), (interrupted, "the run was interrupted"), (not confirmed, "not confirmed")):
        if refused:
            return why
    return None


def prune_orphans(stored: DataFrame, prunable: DataFrame, confirmed: bool, filtered: bool = False, interrupted: bool = False, scanned: bool = True) -> DataFrame:
    if why := prune_refusal(confirmed, filtered, interrupted, scanned):
        raise PruneRefused(why)
    return stored.join(prunable.select("uid"), "uid", "left_anti")


def collection_stats(points: DataFrame, collections: DataFrame, tenant: str = "") -> DataFrame:
    """Points and exact distinct notes of every declared collection, of one tenant if given; those without points show 0.
    A point without a uid is an error."""
    own = points.where(of_tenant(tenant)) if tenant else points
    uid = F.coalesce("uid", F.raise_error(F.lit("a point without a uid")).cast("string"))
    counts = own.withColumn("uid", uid).groupBy("collection").agg(F.count("*").alias("points"), F.countDistinct("uid").alias("notes"))
    return collections.join(counts, "collection", "left").select("collection", F.coalesce("points", F.lit(0)).alias("points"), F.coalesce("notes", F.lit(0)).alias("notes"))


def state_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("state").agg(F.count("*").alias("n"))


def points_written(results: DataFrame) -> Column:
    return F.coalesce(F.sum(F.when(F.col("state").isin("upsert_confirmed", "pruned"), F.col("chunks"))), F.lit(0))


def classify(expected: DataFrame, stored: DataFrame, fields: Sequence[str], full: bool = False, notes: DataFrame | None = None, failed: DataFrame | None = None) -> DataFrame:
    """The whole batch at once: tenant_id, uid, chunks, state, reason. Intact notes are skipped unless `full`.

    notes: every scanned note (tenant_id, uid); without it the notes are those with chunks. A note without chunks is
    pruned if it has points. failed: tenant_id, uid, error of notes that must be left as they are.
    """
    checked = integrity(expected, stored, fields)
    chunks = expected.groupBy(*NOTE).agg(F.count("*").alias("chunks"))
    own = chunks.select(*NOTE) if notes is None else notes.select(*NOTE).distinct()
    intact = F.coalesce("intact", F.lit(True)) & F.lit(not full)
    error = F.lit(None).cast("string")
    rows = own.join(chunks, NOTE, "left").join(checked, NOTE, "left")
    if failed is not None:
        rows, error = rows.join(failed.select(*NOTE, F.col("error").alias("_error")), NOTE, "left"), F.col("_error")
    state = F.when(error.isNotNull(), "failed").when(intact, "skipped").otherwise("pruned")
    return rows.select(*NOTE, F.when(error.isNotNull(), F.lit(0)).otherwise(F.coalesce("chunks", F.lit(0))).alias("chunks"), state.alias("state"), F.coalesce(error, F.col("reason")).alias("reason"))


def changed_points(expected: DataFrame, results: DataFrame) -> DataFrame:
    """The expected points of notes that must be written; only these need a vector."""
    return expected.join(results.where("state = 'pruned'").select(*NOTE), NOTE, "left_semi")


def merge(stored: DataFrame, fresh: DataFrame, results: DataFrame) -> DataFrame:
    """The point table after a run: fresh points by key, and no tail beyond the chunks of a note that was written."""
    counts = results.where("state = 'pruned'").select(*NOTE, F.col("chunks").alias("n_chunks"))
    return prune_tail(upsert(stored, fresh.select(*stored.columns)), counts)


def ingest(expected: DataFrame, stored: DataFrame, fields: Sequence[str], full: bool = False, notes: DataFrame | None = None, failed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """New point table and note results. Only changed notes are taken from `expected`; their tails fall away."""
    results = classify(expected, stored, fields, full, notes, failed)
    return merge(stored, changed_points(expected, results), results), results


def ingest_report(results: DataFrame, orphaned: DataFrame, mode: str, kept: DataFrame | None = None) -> DataFrame:
    """One JSON document; lists are empty, never null. kept: orphans whose file is still on disk.

    The lists are what a person has to act on: failed notes and orphans, not the notes of the run.
    """
    counts = state_counts(results).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("state", "n")))).alias("counts"))
    totals = results.agg(F.count("*").alias("notes"), points_written(results).alias("points_written"))
    bad = results.where("state = 'failed'").agg(F.sort_array(F.collect_list(F.struct("uid", "reason"))).alias("failed"))
    listed = lambda df, name: df.agg(F.sort_array(F.collect_list(F.struct("vault", "path", "uid", "points", "path_claimed"))).alias(name))
    # Tables of one row each.
    rows = totals.crossJoin(counts).crossJoin(bad).crossJoin(listed(orphaned, "orphans")).crossJoin(listed(orphaned.limit(0) if kept is None else kept, "on_disk"))
    return rows.select(F.to_json(F.struct(F.lit(mode).alias("mode"), "notes", "counts", "points_written", "failed", "orphans", "on_disk")).alias("report"))


def human_report(report: Mapping[str, object]) -> str:
    """The report for a terminal; orphans are named even if there are none."""
    counts = report["counts"] or {}
    lines = [f"{report['mode']}: {report['notes']} notes, " + ", ".join(f"{counts.get(s, 0)} {s}" for s in STATES if counts.get(s)), f"{report['points_written']} points written"]  # type: ignore[attr-defined]
    for name, title in (("failed", "failed"), ("orphans", "orphans"), ("on_disk", "indexed, not scanned, still on disk")):
        rows = report[name]
        lines.append(f"{title}: {len(rows) or 'none'}")  # type: ignore[arg-type]
        lines += [f"  {r.get('vault', '')}/{r.get('path', '')} ({r['uid']})" if name != "failed" else f"  {r['uid']}: {r.get('reason', '')}" for r in rows]  # type: ignore[attr-defined]
    return "\n".join(lines)
