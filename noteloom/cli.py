"""Command line: schema, ingest, search, get, stats, eval. Exit codes: 0, 1 failure, 2 usage, 3 lock held, 4 gate failed."""

from __future__ import annotations

import argparse
import json
import os
import signal
import sys
import threading
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import asdict, dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom import config, index, outage, schemas
from noteloom.functions.identity import golden_identity
from noteloom.operators import chunking, counting, embedding, evaluation, measuring, notes, points, retrieval
from noteloom.session import get_session
from noteloom.sources import embedder, golden, lease, sinks, vault

OK, FAILURE, USAGE, LOCKED, GATE = 0, 1, 2, 3, 4
PIPELINE = {"chunker_version": schemas.CHUNKER_VERSION, "floor_tokens": "256", "ceiling_tokens": "1024", "merge_rule": schemas.MERGE_RULE}
#: The built-in embedder; a real one is a service at the address of the setting `embedder`.
HANDSHAKE = schemas.Handshake("hash-1", "none", 64, "l2", "none", "fp64")


class Usage(ValueError):
    pass


@dataclass(frozen=True)
class Embedder:
    handshake: schemas.Handshake
    passages: Callable[[DataFrame], DataFrame]
    queries: Callable[[DataFrame], DataFrame]
    #: Both vectors of one question, without a job.
    question: Callable[[SparkSession, str], tuple[Sequence[float], Mapping[int, float]]]
    #: Token counts of texts by the model, if it has a tokenizer of its own.
    count: Callable[[Sequence[str]], Sequence[int]] | None = None


def embedder_of(settings: config.Config) -> Embedder:
    """The service that the settings name, or the built-in embedder. Asking the service who it is comes before any work."""
    if not settings.embedder:
        return Embedder(HANDSHAKE, embedding.both_by_hash, embedding.both_by_hash, embedding.hash_question)
    service = embedder.Service(settings.embedder)
    said = service.handshake()

    def through(kind: str) -> Callable[[DataFrame], DataFrame]:
        return lambda rows: embedding.embed_both(rows, lambda: lambda texts: service.embed(texts, kind), said.dim)

    return Embedder(said, through("passage"), through("query"), lambda spark, text: service.embed([text], "query")[0], service.count)


class Interrupt:
    """Whether the run was asked to stop. Nothing is written before its table is whole, so stopping leaves the old one."""

    seen = False

    def check(self) -> None:
        if self.seen:
            raise outage.Interrupted("interrupted; nothing was written")


@contextmanager
def interruptible(spark: SparkSession) -> Iterator[Interrupt]:
    """The first interrupt cancels the running jobs of this run, and later steps refuse to start."""
    state, group = Interrupt(), f"noteloom-{os.getpid()}"

    def stop(*_: object) -> None:
        state.seen = True
        spark.sparkContext.cancelJobGroup(group)

    main = threading.current_thread() is threading.main_thread()
    before = signal.signal(signal.SIGINT, stop) if main else None
    spark.sparkContext.setJobGroup(group, "ingest", interruptOnCancel=True)
    try:
        yield state
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        if main:
            signal.signal(signal.SIGINT, before)


def index_of(spark: SparkSession, settings: config.Config, collection: str = "") -> index.Index:
    return index.Index(spark, f"{settings.tables}/{collection or settings.collection}")


@contextmanager
def locked(spark: SparkSession, settings: config.Config, own: index.Index) -> Iterator[lease.Lease]:
    """The lease of a collection, in the folder of the setting or beside the tables. Local folders must be on a file system
    whose files hosts see alike."""
    folder = settings.locks or f"{settings.tables}/_locks"
    if "://" not in folder:
        sinks.check_file_system(folder)
    with lease.held(spark, folder, sinks.canonical(own.table.root)) as held:
        yield held


def applied_state(settings: config.Config) -> dict | None:
    """What the last run recorded about the model, if a state file is configured and there."""
    return sinks.read_json(settings.state, embedding.STATE_KEYS) if settings.state and os.path.exists(settings.state) else None


def check_flags(dry_run: bool, prune: bool, only: str, yes: bool) -> None:
    for broken, why in ((prune and dry_run, "--prune-orphans does not go with --dry-run"), (prune and bool(only), "--prune-orphans does not go with --only"), (prune and not yes, "--prune-orphans needs --yes")):
        if broken:
            raise Usage(why)


def exclusions_of(v: config.Vault) -> vault.Exclusions:
    return vault.Exclusions(v.exclude_folders, v.exclude_root_files)


def scan(spark: SparkSession, vaults: Sequence[config.Vault]) -> DataFrame:
    """Valid notes of all vaults; any bad note or repeated uid fails the whole scan."""
    vault.check_vaults({v.name: (v.path, v.areas) for v in vaults})
    parsed = None
    for v in vaults:
        files = vault.read_vault(spark, v.path, v.name, exclusions_of(v))
        own = notes.parse_notes(files, v.areas).join(files.select("vault", "path", "modified"), ["vault", "path"])
        own = notes.with_updated(own, vault.git_dates(spark, v.path), F.col("modified"))
        parsed = own if parsed is None else parsed.unionByName(own)
    if parsed is None:
        raise Usage("no vault is configured")
    bad = parsed.where(F.col("error").isNotNull()).select("vault", "path", "error").orderBy("vault", "path").limit(100).collect()
    if bad:
        raise ValueError("; ".join(f"{r.vault}/{r.path}: {r.error}" for r in bad))
    good = parsed.where(~F.col("skipped")).drop("skipped", "error")
    twice = good.groupBy("uid").count().where("count > 1").limit(10).collect()
    if twice:
        raise ValueError("repeated uid: " + ", ".join(sorted(r.uid for r in twice)))
    return good


def expected_of(chunks: DataFrame, tenant: str, model: str, handshake: schemas.Handshake = HANDSHAKE) -> DataFrame:
    stamp = "yyyy-MM-dd'T'HH:mm:ss'Z'"
    rows = chunks.withColumns({"tenant_id": F.lit(tenant), "headings": F.coalesce("breadcrumb", F.array().cast("array<string>")), "created": F.date_format(F.col("created").cast("timestamp"), stamp), "updated": F.date_format("updated", stamp), "embedding_model": F.lit(model)})
    return points.expected_points(rows, PIPELINE, {k: str(v) for k, v in asdict(handshake).items()})


def run_ingest(spark: SparkSession, settings: config.Config, args: argparse.Namespace) -> dict:
    """Scan, compare by digests, chunk and embed what changed, commit one new state of the table, record the model."""
    check_flags(args.dry_run, args.prune_orphans, args.only, args.yes)
    tenant, vaults, model, own = settings.tenant, settings.chosen(args.vault), embedder_of(settings), index_of(spark, settings)
    embedding.verify(model.handshake, applied_state(settings), settings.embedding_model)
    made_by = PIPELINE | {f"embedder_{k}": str(v) for k, v in asdict(model.handshake).items()} | {"model": settings.embedding_model}

    def expected_points(changed: DataFrame) -> tuple[DataFrame, DataFrame]:
        chunks = chunking.chunk_notes(changed) if model.count is None else counting.chunk_notes(changed, lambda: model.count)
        failed = chunking.failed_notes(chunks, ["uid"]).withColumn("tenant_id", F.lit(tenant))
        rows = expected_of(chunks.join(failed.select("uid"), "uid", "left_anti"), tenant, settings.embedding_model, model.handshake)
        return rows.select(*index.PAYLOAD, "point_id"), failed

    clock = measuring.Clock()
    with locked(spark, settings, own) as held, interruptible(spark) as interrupt:
        clock.lap("lock")
        found = scan(spark, vaults).persist()
        chosen = found.where(notes.glob_filter(F.concat_ws("/", "vault", "path"), args.only))
        clock.lap("scan", found.count)
        run = own.compare(chosen, tenant, made_by, expected_points, args.full, args.verify)
        # A filtered run has not seen the other notes, so it knows nothing about orphans.
        lost = own.orphans(run, tenant, found, ["-"] if args.only else [v.name for v in vaults])
        files = None
        for v in vaults:
            seen = vault.every_file(spark, v.path, v.name)
            files = seen if files is None else files.unionByName(seen)
        split = points.on_disk(lost, files).persist()
        gone, kept = split.where("state = 'prunable'"), split.where("state = 'on_disk'")
        report = json.loads(points.ingest_report(run.results, gone, "dry-run" if args.dry_run else "full" if args.full else "incremental", kept).first()["report"])
        clock.lap("compare")
        if not args.dry_run:
            interrupt.check()
            if args.prune_orphans and (why := points.prune_refusal(args.yes, bool(args.only), interrupt.seen)):
                raise points.PruneRefused(why)
            own.write(run, tenant, model.passages, gone if args.prune_orphans else None, held, interrupt.check)
            own.table.expire()
            if settings.state:
                sinks.write_json(settings.state, {"model": settings.embedding_model, "handshake": asdict(model.handshake)})
            clock.lap("write")
        for rows in (found, split):
            rows.unpersist()
        run.release()
        report["phases_ms"] = clock.phases
        return report


def run_search(spark: SparkSession, settings: config.Config, args: argparse.Namespace) -> list[dict]:
    asked = retrieval.Query(settings.collection, settings.tenant, args.text, top_k=args.top_k, mode=args.mode, area=args.area, type=args.type, vault=args.vault, tags=tuple(args.tag)).validate()
    own = index_of(spark, settings)
    state = own.current()
    if state is None:
        raise outage.StoreDown("the collection is empty")
    model, applied = embedder_of(settings), applied_state(settings)
    embedding.verify(model.handshake, applied, settings.embedding_model or (applied or {}).get("model", ""))
    rows = retrieval.format_results(own.ask(asked, *model.question(spark, args.text), state)).orderBy("position").collect()
    return [{"uid": r.uid, "chunk_index": r.chunk_index, "title": r.title, "breadcrumb": r.breadcrumb, "path": r.path, "score": r.score, "text": r.text, "untrusted": r.untrusted} for r in rows]


def run_schema(spark: SparkSession, settings: config.Config, manifest: schemas.Manifest, applied: str | None, apply: bool) -> str:
    """`verified`, or `create` and with `apply` `created`; drift raises. A collection is created empty, under its lease."""
    own = index_of(spark, settings, manifest.name)
    state = own.current()
    told = schemas.check_applied(manifest, None if state is None else own.points(state), applied)
    if told == "create" and apply:
        with locked(spark, settings, own) as held:
            own.create(held.number)
        return "created"
    return told


def ranked_answers(spark: SparkSession, settings: config.Config, args: argparse.Namespace, asked: DataFrame, mode: str) -> DataFrame:
    """question_id, uid, chunk_index, score, rank of the first k answers: of the corpus file, or of the stored collection."""
    own = asked.where(~F.col("errored")).select(F.col("question_id").alias("query_id"), F.lit(args.tenant).alias("tenant_id"), F.col("question").alias("text"))
    if mode == "lexical":
        if not args.corpus:
            raise Usage("--mode lexical needs --corpus")
        corpus = golden.read_corpus(spark, args.corpus)
        return retrieval.lexical_search(own, corpus.where(retrieval.of_tenant(args.tenant)), args.k).withColumnRenamed("query_id", "question_id")
    table, model, applied = index_of(spark, settings), embedder_of(settings), applied_state(settings)
    embedding.verify(model.handshake, applied, settings.embedding_model or (applied or {}).get("model", ""))
    if (state := table.current()) is None:
        raise outage.StoreDown("the collection is empty")
    questions = model.queries(own).withColumnRenamed("dense", "query_vector").drop("text").persist()
    found = table.search(questions, [args.tenant], mode=mode, top_k=args.k, snapshot=state)
    return found.select(F.col("query_id").alias("question_id"), "uid", "chunk_index", "score", F.col("position").alias("rank"))


def run_eval(spark: SparkSession, settings: config.Config, args: argparse.Namespace) -> tuple[bool, dict]:
    """Ask the golden questions; compare with the saved run, write the Markdown reports, and tell whether the gate holds."""
    questions, groups, bounds = golden.read_golden(spark, args.golden)
    asked = questions.withColumn("question_id", F.monotonically_increasing_id()).withColumn("errored", ~F.coalesce(notes.valid_uid(F.col("uid")), F.lit(False)))
    mode = args.mode
    results = evaluation.judge(asked, ranked_answers(spark, settings, args, asked, mode), args.k).persist()
    report = evaluation.recall(results)
    rows = report.collect()
    verdict = evaluation.gate(report, args.threshold).first().asDict()
    if args.compare:
        other = evaluation.recall(evaluation.judge(asked, ranked_answers(spark, settings, args, asked, "dense"), args.k))
        both = {"hybrid": report, "dense": other} if mode == "hybrid" else {}
        if not both:
            raise Usage("--compare goes with --mode hybrid")
        total = {name: r.where("area = '*'").first() for name, r in both.items()}
        with open(args.compare, "w", encoding="utf-8") as file:
            file.write(evaluation.decision_markdown(total["hybrid"], total["dense"], args.k, datetime.now(UTC).date().isoformat()))
        verdict["keep"] = evaluation.compare_modes(report, other).first()["keep"]
    if settings.baseline and os.path.exists(settings.baseline):
        before = evaluation.baseline_rows(spark, sinks.read_json(settings.baseline, evaluation.BASELINE_KEYS), args.k, mode)
        verdict["delta"] = [r.asDict() for r in evaluation.baseline_delta(report, before).orderBy("area").collect()]
    if args.save_baseline:
        if not settings.baseline:
            raise Usage("--save-baseline needs a baseline setting")
        sinks.write_json(settings.baseline, evaluation.baseline_of(rows, args.k, mode))
    if settings.report:
        commit, dates = golden.commits(spark, args.golden)
        since = F.lit(args.since).cast("timestamp") if args.since else F.lit(None).cast("timestamp")
        stale = evaluation.stale_questions(asked.withColumn("identity", golden_identity(F.col("question"), F.col("uid"))), dates, since).collect() if commit else []
        violations = evaluation.coverage_violations(asked, groups, *bounds).collect() if any(bounds) else []
        listed = evaluation.outcomes(results).join(asked.select("question_id", "question"), "question_id").orderBy("question_id").collect()
        with open(settings.report, "w", encoding="utf-8") as file:
            file.write(evaluation.recall_markdown(rows, listed, args.k, mode, commit, stale, violations))
    return bool(verdict["passed"]), verdict


def run_golden(spark: SparkSession, settings: config.Config, args: argparse.Namespace, answers: Iterator[str], say: Callable[[str], None]) -> int:
    """An authoring session: cards of notes from the neediest areas, one question each. An empty line skips a note, `.`
    ends the session. A note is offered once, notes that have a question never. Returns how many were saved."""
    found = scan(spark, settings.chosen(args.vault))
    cards = notes.note_cards(found).join(found.select("uid", "area"), "uid").persist()
    saved = turn = 0
    offered: set[str] = set()
    while True:
        questions, groups, (_, most) = golden.read_golden(spark, args.golden, allow_empty=True)
        status = evaluation.coverage_status(questions, groups).persist()
        have = questions.count()
        if turn == 0:
            say("\n".join([f"{have} questions", *[f"  {r.area}: {r.have} of {r.min} to {r.max or 'any'}" for r in status.orderBy("position").collect()]]))
        asked = {r.uid for r in questions.select("uid").distinct().collect()} | offered  # a golden set is written by hand
        if most and have >= most:
            break
        card = evaluation.draw_note(status, cards.where(~F.col("uid").isin(*asked)) if asked else cards, args.seed + turn).first()
        if card is None:
            break
        turn += 1
        offered.add(card.uid)
        say(f"{card.area}: {card.title}\n{card.path}\n{card.excerpt}")
        text = next(answers, ".").strip()
        if text == ".":
            break
        if not text:
            say("skipped")
            continue
        golden.append_question(args.golden, {"question": text, "uid": card.uid, "area": card.area, "author": args.author, "date": datetime.now(UTC).date().isoformat()})
        saved += 1
        say(f"saved: {have + 1}")
    return saved


def run_measure_search(spark: SparkSession, settings: config.Config, args: argparse.Namespace) -> tuple[bool, list[dict]]:
    """Searches one after another, with the milliseconds of embedder, store, the rest and all; gates hold for all of it."""
    own, model = index_of(spark, settings), embedder_of(settings)
    if (state := own.current()) is None:
        raise outage.StoreDown("the collection is empty")
    questions = [r.question for r in golden.read_golden(spark, args.golden)[0].select("question").collect()]  # a golden set
    timings = []
    for at in range(args.warm + args.count):
        asked = retrieval.Query(settings.collection, settings.tenant, questions[at % len(questions)]).validate()
        clock = measuring.Clock()
        vector, weights = model.question(spark, asked.text)
        clock.lap("embed")
        rows = own.ask(asked, vector, weights, state)
        found = rows.collect()
        clock.lap("store")
        [r.asDict() for r in found]
        clock.lap("overhead")
        if at >= args.warm:
            timings.append((*[float(clock.phases[p]) for p in ("embed", "store", "overhead")], clock.total))
    report = measuring.search_report(spark.createDataFrame(timings, ", ".join(f"{p} double" for p in measuring.PHASES)), args.p95, args.p99)
    rows = [r.asDict() for r in report.collect()]
    return all(r["passed"] for r in rows), rows


def run_measure_ingest(spark: SparkSession, settings: config.Config, args: argparse.Namespace) -> tuple[bool, dict]:
    """A run that should find nothing to do, by phases. One that reprocessed notes is no measurement."""
    clock = measuring.Clock()
    report = run_ingest(spark, settings, parser().parse_args(["ingest"]))
    total, phases = clock.total, report["phases_ms"]
    reprocessed = sum(n for state, n in (report["counts"] or {}).items() if state != "skipped")
    work = sum(v for k, v in phases.items() if k not in ("lock", "scan"))
    row = spark.createDataFrame([(total, phases.get("lock", 0.0), phases["scan"], work, report["notes"], reprocessed)], "total double, lock double, scan double, orchestrate double, notes long, reprocessed long")
    verdict = evaluation.ingest_verdict(row, args.gate).first().asDict()
    return verdict["verdict"] == "passed", verdict


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="noteloom")
    out.add_argument("--config", default=None)
    sub = out.add_subparsers(dest="command", required=True)
    sub.add_parser("schema").add_argument("--apply", action="store_true", help="create the collections that are not there")
    stats = sub.add_parser("stats")
    stats.add_argument("--tenant", default="")
    ingest = sub.add_parser("ingest")
    for flag in ("--dry-run", "--full", "--prune-orphans", "--yes"):
        ingest.add_argument(flag, action="store_true")
    ingest.add_argument("--only", default="")
    ingest.add_argument("--verify", action="store_true", help="compare stored points, not digests alone")
    ingest.add_argument("--vault", default="both")
    ingest.add_argument("--human", action="store_true")
    search = sub.add_parser("search")
    search.add_argument("text")
    search.add_argument("--top-k", type=int, default=retrieval.TOP_K)
    search.add_argument("--mode", default="hybrid")
    for facet in ("--area", "--type", "--vault"):
        search.add_argument(facet, default="")
    search.add_argument("--tag", action="append", default=[])
    get = sub.add_parser("get")
    get.add_argument("uid")
    run = sub.add_parser("eval")
    run.add_argument("--golden", required=True)
    run.add_argument("--corpus", default="")
    run.add_argument("--mode", default="lexical", choices=["lexical", *retrieval.MODES])
    run.add_argument("--compare", default="", help="write the decision between hybrid and dense to this file")
    run.add_argument("--tenant", required=True)
    run.add_argument("--k", type=int, default=5)
    run.add_argument("--threshold", type=float, default=0.75)
    run.add_argument("--save-baseline", action="store_true")
    session = sub.add_parser("golden")
    session.add_argument("golden")
    session.add_argument("--vault", default="both")
    session.add_argument("--author", default="")
    session.add_argument("--seed", type=int, default=0)
    measured = sub.add_parser("measure-search")
    measured.add_argument("--golden", required=True)
    measured.add_argument("--count", type=int, default=30)
    measured.add_argument("--warm", type=int, default=1)
    measured.add_argument("--p95", type=float, default=3000.0)
    measured.add_argument("--p99", type=float, default=5000.0)
    sub.add_parser("measure-ingest").add_argument("--gate", type=float, default=60_000.0)
    run.add_argument("--since", default="", help="questions written after this time are stale")
    return out


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return USAGE if e.code else OK
    try:
        settings = config.load(args.config)
        if args.command != "get":
            settings.require(args.command if args.command != "eval" or args.mode != "lexical" else "")
        session = spark or get_session()
        if args.command == "ingest":
            report = run_ingest(session, settings, args)
            print(points.human_report(report) if args.human else json.dumps(report, ensure_ascii=False, separators=(",", ":")))
            return FAILURE if report["failed"] else OK
        elif args.command == "search":
            print(sinks.envelope(run_search(session, settings, args)))
        elif args.command == "get":
            own = index_of(session, settings)
            rows = retrieval.get_note(own.points(own.current(), settings.tenant), retrieval.Query(settings.collection, settings.tenant, uid=args.uid)).collect()
            print(sinks.envelope([r.asDict() for r in rows]))
        elif args.command == "stats":
            names = [(c,) for c in schemas.COLLECTIONS]
            every = None
            for (name,) in names:
                of_name = index_of(session, settings, name)
                if (state := of_name.current()) is not None:
                    own = of_name.points(state).select(F.lit(name).alias("collection"), "tenant_id", "uid")
                    every = own if every is None else every.unionByName(own)
            every = session.createDataFrame([], "collection string, tenant_id string, uid string") if every is None else every
            rows = points.collection_stats(every, session.createDataFrame(names, "collection string"), args.tenant).orderBy("collection").collect()
            print(sinks.envelope([r.asDict() for r in rows]))
        elif args.command == "golden":
            print(f"{run_golden(session, settings, args, iter(sys.stdin.readline, ''), print)} saved")
        elif args.command in ("measure-search", "measure-ingest"):
            passed, said = (run_measure_search if args.command == "measure-search" else run_measure_ingest)(session, settings, args)
            print(sinks.envelope(said))
            return OK if passed else GATE
        elif args.command == "schema":
            for name, manifest in schemas.manifests(settings.embedding_model).items():
                applied = applied_state(settings) if name == settings.collection else None
                print(name, run_schema(session, settings, manifest, applied["model"] if applied else None, args.apply))
        else:
            passed, verdict = run_eval(session, settings, args)
            print(sinks.envelope(verdict))
            return OK if passed else GATE
        return OK
    except (Usage, config.ConfigError, retrieval.QueryError, notes.BadPattern) as e:
        print(sinks.envelope(error=str(e)))
        return USAGE
    except sinks.LockHeld as e:
        print(sinks.envelope(error=str(e)))
        return LOCKED
    except Exception as e:  # noqa: BLE001 - the boundary of the process
        secrets = {k.removeprefix(config.PREFIX).lower(): v for k, v in os.environ.items() if k.startswith(config.PREFIX)}
        print(sinks.envelope(error=f"{outage.part_of(e)}: {config.scrub(str(e), secrets)}"))
        return FAILURE


if __name__ == "__main__":
    sys.exit(main())
