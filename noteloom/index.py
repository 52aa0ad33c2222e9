"""The stored collection: points, posting lists, bounds and note digests of a snapshot, and the run that makes the next one.

Points lie in buckets of notes below their tenant; a run rewrites the buckets of the notes that it changes and no other.
Postings of changed points are added, those of older versions meet no point any more; now and then they are written anew.
Digests are one bucketed table for each tenant, so that they meet the digests of a scan without being shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from noteloom import schemas
from noteloom.operators import points, postings, retrieval
from noteloom.sources.lease import Lease
from noteloom.sources.snapshots import Snapshot, Snapshots, new_run

PAYLOAD = [f.name for f in schemas.PAYLOAD]
ROWS = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.PAYLOAD if f.name != "tenant_id") + f", point_id string, dense array<double>, sparse {postings.SPARSE}, seq bigint"
POINTS = f"{ROWS}, run string, tenant_id string, bucket int"
DIGESTS = "uid string, n bigint, source string, vault string, path string"
#: Entries of posting lists that one question sums in one job.
ONE_JOB = 5_000_000
#: Metadata of a note that its points carry.
NOTE_FIELDS = ("uid", "vault", "path", "area", "sub", "type", "status", "visibility", "tags", "title", "lang", "created")


def note_bucket(uid: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(uid), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class Run:
    """What a run found: per note its state, the points that take their place, and the digests that follow."""

    base: Snapshot | None
    results: DataFrame  # tenant_id, uid, chunks, state, reason
    expected: DataFrame  # points of the notes whose digests differ
    sources: DataFrame  # uid, source, vault, path of all scanned notes
    kept: tuple[DataFrame, ...] = ()

    def release(self) -> None:
        """Give back what the run kept in memory."""
        for rows in self.kept:
            rows.unpersist()


class Index:
    def __init__(self, spark: SparkSession, root: str, buckets: int = postings.BUCKETS):
        self.spark, self.table = spark, Snapshots(spark, root)
        self._buckets = buckets

    def current(self) -> Snapshot | None:
        return self.table.current()

    def buckets(self, snapshot: Snapshot | None) -> int:
        """Fixed when the table was made."""
        return int(snapshot.info["buckets"]) if snapshot else self._buckets

    def create(self, fence: int = 0) -> Snapshot:
        """An empty table with its buckets."""
        return self.table.commit(None, {}, fence, {"buckets": self._buckets})

    def points(self, snapshot: Snapshot | None, tenant: str = "", buckets: Sequence[int] | None = None) -> DataFrame:
        values = ({"tenant_id": [tenant]} if tenant else {}) | ({} if buckets is None else {"bucket": buckets})
        return self.table.read(snapshot, "points", POINTS, **values).select(*PAYLOAD, "point_id", "dense", "sparse", "seq")

    def lists(self, snapshot: Snapshot | None, tenants: Sequence[str], terms: Sequence[int] | None = None) -> tuple[DataFrame, DataFrame]:
        """Posting lists and bounds of tenants; of a few known terms only their buckets and row groups are read."""
        values = {"tenant_id": tenants} | ({} if terms is None else {"bucket": postings.buckets_of(self.spark, terms, self.buckets(snapshot))})
        own = self.table.read(snapshot, "postings", postings.POSTINGS, **values), self.table.read(snapshot, "bounds", postings.BOUNDS, **values)
        return own if terms is None else (postings.of_terms(own[0], terms), postings.of_terms(own[1], terms))

    def digests(self, snapshot: Snapshot | None, tenant: str) -> DataFrame:
        """uid, n, source, vault, path of the stored notes of a tenant, bucketed by uid."""
        parts = snapshot.parts("digests", tenant_id=[tenant]) if snapshot else []
        if not parts:
            return self.spark.createDataFrame([], DIGESTS)
        name = f"digests_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} ({DIGESTS}) USING parquet CLUSTERED BY (uid) SORTED BY (uid) INTO {self.buckets(snapshot)} BUCKETS LOCATION '{self.table.root}/digests/{parts[0]}'")
        rows = self.spark.table(name)  # analysed while the name is there
        self.spark.sql(f"DROP TABLE {name}")  # the files stay
        return rows

    def _write_digests(self, rows: DataFrame, tenant: str, run: str, buckets: int) -> list[str]:
        escaped = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(tenant)
        part, name = f"run={run}/tenant_id={escaped}", f"digests_{uuid.uuid4().hex}"
        rows.select("uid", "n", "source", "vault", "path").repartition(buckets, "uid").write.bucketBy(buckets, "uid").sortBy("uid").option("path", f"{self.table.root}/digests/{part}").saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")
        return [part]

    def compare(self, notes: DataFrame, tenant: str, settings: dict[str, str], expected_of: Callable[[DataFrame], tuple[DataFrame, DataFrame]], full: bool = False, verify: bool = False) -> Run:
        """What changed. notes: scanned notes with a body. expected_of: points of some notes and the notes that failed.

        A note whose source digest is the stored one has the stored points and is not even chunked, unless `full`, or
        `verify`, which compares the points themselves.
        """
        base = self.current()
        sources = notes.select(*notes.columns, points.source_digest(notes, settings | {"tenant_id": tenant}, NOTE_FIELDS).alias("source"))
        known = self.digests(base, tenant).select("uid", "n", F.col("source").alias("_source"))
        met = sources.join(known, "uid", "left").withColumn("_same", F.col("source").eqNullSafe(F.col("_source")) & F.lit(not (full or verify))).persist()
        same = met.where("_same").select(F.lit(tenant).alias("tenant_id"), "uid", F.col("n").alias("chunks"), F.lit("skipped").alias("state"), F.lit(None).cast("string").alias("reason"))
        odd = met.where(~F.col("_same")).drop("n", "_source", "_same")
        expected, failed = expected_of(odd.drop("source"))
        expected = expected.persist()
        scanned = odd.select(F.lit(tenant).alias("tenant_id"), "uid")
        fields = [c for c in PAYLOAD if c != "point_id"]
        stored = self.points(base, tenant).drop("dense", "sparse", "seq").join(scanned.select("uid"), "uid", "left_semi")
        results = points.classify(expected, stored, fields, full, scanned, failed).unionByName(same).persist()
        return Run(base, results, expected, met.select("uid", "source", "vault", "path"), (met, expected, results))

    def orphans(self, run: Run, tenant: str, live: DataFrame, vaults: Sequence[str]) -> DataFrame:
        """Stored notes that no live note has, told by the digests alone."""
        stored = self.digests(run.base, tenant)
        gone = stored.where(F.col("vault").isin(*vaults)).join(live.select("uid"), "uid", "left_anti")
        claimed = live.select("vault", "path", F.lit(True).alias("_claimed")).distinct()
        return gone.join(claimed, ["vault", "path"], "left").select("uid", "vault", "path", F.col("n").alias("points"), F.coalesce("_claimed", F.lit(False)).alias("path_claimed"))

    def write(self, run: Run, tenant: str, embed: Callable[[DataFrame], DataFrame], pruned: DataFrame | None = None, lease: Lease | None = None, check: Callable[[], None] | None = None) -> Snapshot | None:
        """The state after a run; None if nothing changed. pruned: uids whose points go. Readers see all of it or none."""
        changed = run.results.where("state = 'pruned'").select("uid")
        touched = (changed if pruned is None else changed.unionByName(pruned.select("uid"))).distinct()
        buckets = self.buckets(run.base)
        own = [r[0] for r in touched.select(note_bucket(F.col("uid"), buckets)).distinct().collect()]  # at most as many as there are buckets
        number = max([0, *self.table.numbers()]) + 1
        if not own and not self._moved(run, tenant):
            return None
        name = new_run(number)
        tables = {k: list(v) for k, v in (run.base.tables if run.base else {}).items()}
        if own:
            fresh = embed(points.changed_points(run.expected, run.results)).withColumn("seq", F.lit(number).cast("bigint"))
            stored = self.points(run.base, tenant, own)
            merged = points.merge(stored, fresh.select(*stored.columns), run.results)
            if pruned is not None:
                merged = merged.join(pruned.select("uid"), "uid", "left_anti")
            placed = merged.withColumn("bucket", note_bucket(F.col("uid"), buckets))
            placed = placed.hint("rebalance", "bucket")  # few files for small buckets, several for large ones
            parts = self.table.stage(placed, "points", ["tenant_id", "bucket"], name)
            if not all(self._unescaped(p, "tenant_id") == tenant for p in parts):
                raise ValueError("a row of another tenant is about to be written")
            gone = set(run.base.parts("points", tenant_id=[tenant], bucket=own)) if run.base else set()
            tables["points"] = [p for p in tables.get("points", []) if p not in gone] + parts
            state = Snapshot(number, tables=tables)
            self._write_lists(state, tables, tenant, number, name, buckets)
        tables["digests"] = [p for p in tables.get("digests", []) if p not in (run.base.parts("digests", tenant_id=[tenant]) if run.base else [])] + self._write_digests(self._next_digests(run, tenant, pruned), tenant, name, buckets)
        if check:
            check()
        info = dict(run.base.info) if run.base else {"buckets": self._buckets}
        return self.table.commit(run.base, tables, lease.number if lease else run.base.fence if run.base else 0, info, lease.check if lease else None)

    @staticmethod
    def _unescaped(part: str, column: str) -> str:
        from noteloom.sources.snapshots import unescape

        return unescape(dict(s.split("=", 1) for s in part.split("/"))[column])

    def _moved(self, run: Run, tenant: str) -> bool:
        """Whether digests changed though no point did (a note that only lost its tie to other settings, say)."""
        known = self.digests(run.base, tenant).select("uid", F.col("source").alias("_source"))
        failed = run.results.where("state = 'failed'").select("uid")
        with_points = run.results.where("state <> 'failed' AND chunks > 0").select("uid")
        return not run.sources.join(with_points, "uid", "left_semi").join(failed, "uid", "left_anti").join(known, "uid", "left").where(~F.col("source").eqNullSafe(F.col("_source"))).isEmpty()

    def _next_digests(self, run: Run, tenant: str, pruned: DataFrame | None) -> DataFrame:
        """Digests of the notes that are stored now; failed notes keep what they had."""
        told = run.results.where("state <> 'failed'").select("uid", F.col("chunks").alias("n"))
        fresh = run.sources.join(told, "uid").select("uid", "n", "source", "vault", "path")
        kept = self.digests(run.base, tenant).join(told.select("uid"), "uid", "left_anti").select(*fresh.columns)
        out = kept.unionByName(fresh.where("n > 0"))
        return out if pruned is None else out.join(pruned.select("uid"), "uid", "left_anti")

    def _write_lists(self, state: Snapshot, tables: dict[str, list[str]], tenant: str, number: int, name: str, buckets: int) -> None:
        runs = {p.split("/")[0] for p in state.parts("postings", tenant_id=[tenant])}
        anew = len(runs) >= postings.MOST_RUNS
        rows = self.points(state, tenant)
        lists = postings.postings_of(rows if anew else rows.where(F.col("seq") == number), buckets)
        for kind, made in (("postings", postings.in_lists(lists)), ("bounds", postings.bounds_of(lists).repartition("tenant_id", "bucket"))):
            kept = [] if anew else tables.get(kind, [])
            if anew:
                kept = [p for p in tables.get(kind, []) if p not in state.parts(kind, tenant_id=[tenant])]
            tables[kind] = kept + self.table.stage(made, kind, ["tenant_id", "bucket"], name)

    def search(self, questions: DataFrame, tenants: Sequence[str], terms: Sequence[int] | None = None, mode: str = "hybrid", top_k: int = retrieval.TOP_K, offset: int = 0, snapshot: Snapshot | None = None) -> DataFrame:
        """Ranked points for a table of questions (`retrieval.search_batch`) over the current state."""
        state = snapshot or self.current()
        stored = self.table.read(state, "points", POINTS, tenant_id=tenants)
        lists, bounds = self.lists(state, tenants, terms)
        return retrieval.search_batch(questions, stored, lists, bounds, mode, top_k, offset)

    def ask(self, asked: retrieval.Query, vector: retrieval.Vector, weights: retrieval.Weights, snapshot: Snapshot | None = None) -> DataFrame:
        """Answers to one embedded question. Both legs run side by side as jobs of their own, each over the points of the
        tenant and the lists of the question's terms; what they bring is fused here, and its rows are looked up.

        A question whose lists are long (ONE_JOB entries) goes the way of many questions, which looks at parts of them.
        """
        state = snapshot or self.current()
        request = retrieval.request_of(asked.validate())
        points = self.table.read(state, "points", POINTS, tenant_id=[asked.tenant_id])
        legs = [lambda: retrieval.best_dense(points, asked, vector, (request.single or request.fused[0]).limit)]
        if not request.single:
            lists, bounds = self.lists(state, [asked.tenant_id], list(weights))
            if (bounds.agg(F.sum("n")).first()[0] or 0) > ONE_JOB:
                made = self.spark.createDataFrame([(0, list(map(float, vector)), sorted((int(t), float(w)) for t, w in weights.items()))], f"query_id int, query_vector array<double>, sparse {postings.SPARSE}")
                return retrieval.search(made, points, lists, bounds, asked)
            legs.append(lambda: retrieval.best_sparse(points, lists, asked, weights, request.fused[1].limit))
        with ThreadPoolExecutor(len(legs)) as pool:
            done = [pool.submit(inheritable_thread_target(self.spark)(leg)) for leg in legs]
            found = retrieval.fused_window([f.result() for f in done], asked)
        return retrieval.shown(points, asked, found)
