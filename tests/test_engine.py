"""Retrieval, points, evaluation, sources, streaming and the command line; guards have twins that prove they can fail."""

import ast
import http.server
import json
import os
import pathlib
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

import noteloom
from noteloom import cli, config, index, outage, schemas
from noteloom.operators import embedding, evaluation, points, postings, retrieval
from noteloom.plans import ingest_queries
from noteloom.sources import embedder, golden, lease, sinks, vault
from noteloom.streaming import continuous

ROOT = pathlib.Path(noteloom.__file__).parent
U = "0198a7f2-4b31-7c42-9e15-{:012x}".format
POINTS = "tenant_id string, uid string, chunk_index int, status string, visibility string, area string, type string, vault string, tags array<string>, text string, path string, headings array<string>, title string, point_id string, dense array<double>"


def point(tenant, n, chunk=0, status="stable", visibility="internal", area="a", text="t", dense=(1.0, 0.0)):
    return (tenant, U(n), chunk, status, visibility, area, "concept", "v", ["x", "y"], text, f"a/{n}.md", ["H"], "T", f"{tenant}-{n}-{chunk}", list(dense))


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([point("t1", 1), point("t1", 2, status="archived"), point("t1", 3, visibility="private"), point("t1", 4, status=None, visibility=None), point("t2", 5), point("t1", 6, area="b")], POINTS).cache()


def uids(df):
    return sorted(int(r.uid[-12:], 16) for r in df.collect())


def test_filter_guards_and_their_twins(table):
    q = retrieval.Query("interno", "t1", "x")
    assert uids(table.where(retrieval.build_filter(q))) == [1, 4, 6]
    assert uids(table.where((F.col("tenant_id") == "t1") & (F.col("status") != "archived") & (F.col("visibility") != "private"))) == [1, 6]  # what a plain comparison would lose
    wide = retrieval.Query("interno", "t1", "x", include_archived=True, include_private=True)
    assert uids(table.where(retrieval.build_filter(wide))) == [1, 2, 3, 4, 6]
    assert uids(table.where(retrieval.build_filter(retrieval.Query("interno", "t1", "x", area="b", tags=("x", "y"))))) == [6]
    assert uids(table.where(retrieval.build_filter(retrieval.Query("interno", "t1", "x", tags=("z",))))) == []
    for tenant in ("", "' OR 1=1 --", "t1\x00", "T1"):
        hostile = retrieval.Query("interno", tenant, "x")
        if not tenant:
            with pytest.raises(retrieval.QueryError):
                retrieval.build_filter(hostile)
        else:
            assert uids(table.where(retrieval.build_filter(hostile))) == []


def test_tenant_predicate_reaches_the_scan(spark, table, tmp_path):
    path = str(tmp_path / "points")
    points.write_tenants(table, path)
    plan = spark.read.parquet(path).where(retrieval.build_filter(retrieval.Query("interno", "t1", "x"))).select("uid")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tenant_id" in plan and "dense" not in plan


def test_query_validation():
    q = retrieval.Query("interno", "t", "x")
    assert q.validate() is q
    for bad in (dict(tenant_id=""), dict(text=" "), dict(top_k=0), dict(top_k=1001), dict(offset=-1), dict(mode="fuzzy"), dict(collection="")):
        with pytest.raises(retrieval.QueryError):
            retrieval.Query(**{"collection": "interno", "tenant_id": "t", "text": "x", **bad}).validate()
    assert retrieval.leg_limit(5) == 40 and retrieval.window_size(5, 0) == 5
    with pytest.raises(retrieval.QueryError):
        retrieval.leg_limit(1000, 2**31)
    with pytest.raises(retrieval.QueryError):
        retrieval.check_filterable("text")
    assert [retrieval.clamp_top_k(x) for x in (None, 0, -3, 7, 99)] == [5, 5, 5, 7, 20]


def test_search_caps_and_pages(spark):
    rows = [point("t", n, c, text="w", dense=(1.0, n * 0.01 + c * 0.001)) for n in range(4) for c in range(3)]
    stored = spark.createDataFrame(rows, POINTS)
    stored = stored.withColumns({"seq": F.lit(1).cast("bigint"), "sparse": F.array(F.struct(F.lit(7).cast("bigint").alias("id"), F.lit(1.0).alias("weight")))})
    lists = postings.postings_of(stored)
    bounds = postings.bounds_of(lists)
    asked = spark.createDataFrame([(0, [1.0, 0.0], [(7, 1.0)])], f"query_id int, query_vector array<double>, sparse {postings.SPARSE}")
    got = retrieval.search(asked, stored, lists, bounds, retrieval.Query("interno", "t", "w", top_k=4)).orderBy("position").collect()
    assert len(got) == 4 and max(sum(r.uid == x.uid for x in got) for r in got) <= 2 and [r.position for r in got] == [1, 2, 3, 4]
    dense = retrieval.search(asked, stored, lists, bounds, retrieval.Query("interno", "t", "w", top_k=3, mode="dense"), cap=0).orderBy("position").collect()
    assert [r.point_id for r in dense] == ["t-0-0", "t-0-1", "t-0-2"]
    assert not retrieval.is_dead_area(stored, retrieval.Query("interno", "t", "w", area="a", tags=("none",)))
    assert retrieval.is_dead_area(stored, retrieval.Query("interno", "t", "w", area="zzz"))
    assert retrieval.get_note(stored, retrieval.Query("interno", "t", uid=U(2))).count() == 3


STORED = "tenant_id string, uid string, chunk_index int, text string, title string, point_hash string"


def note(n, texts, title="T"):
    return [("t", U(n), i, x, title, f"{x}-hash-{i}-long-enough") for i, x in enumerate(texts)]


def reasons(spark, expected, stored):
    got = points.integrity(spark.createDataFrame(expected, STORED), spark.createDataFrame(stored, STORED), ["text", "title"])
    return {int(r.uid[-12:], 16): r.reason for r in got.collect()}


def test_integrity_conditions_in_order(spark):
    want = note(1, "ab") + note(2, "ab") + note(3, "ab") + note(4, "ab") + note(5, "ab") + note(6, "ab")
    have = note(1, "ab") + note(2, "a") + note(3, "ab") + note(3, "a") + note(4, "abc") + note(5, "xb") + note(6, "ab", "Old") + note(7, "a")
    got = reasons(spark, want, have)
    assert got[1] is None and got[2] == "missing chunk_index 1" and got[3] == "duplicate chunk_index 0" and got[4] == "found 3 points, expected 2"
    assert got[5].startswith("chunk_index 0: hash x-hash-0-lon… is not a-hash-0-lon…") and got[6] == "chunk_index 0: field title differs" and got[7] == "found 1 points, expected 0"


def test_ingest_converges_and_prunes(spark):
    want = spark.createDataFrame(note(1, "ab") + note(2, "cd") + note(3, "e"), STORED)
    have = spark.createDataFrame(note(1, "ab") + note(2, "cxy") + note(9, "z"), STORED)
    table, results = points.ingest(want, have, ["text", "title"])
    assert {(int(r.uid[-12:], 16), r.state) for r in results.collect()} == {(1, "skipped"), (2, "pruned"), (3, "pruned")}
    assert sorted((int(r.uid[-12:], 16), r.text) for r in table.collect()) == [(1, "a"), (1, "b"), (2, "c"), (2, "d"), (3, "e"), (9, "z")]
    again, second = points.ingest(want, table, ["text", "title"])
    assert {r.state for r in second.collect()} == {"skipped"} and again.count() == table.count()
    report = points.ingest_report(results, spark.createDataFrame([], "uid string, vault string, path string, points long, path_claimed boolean"), "full").first()["report"]
    assert '"orphans":[]' in report and '"points_written":3' in report


def test_ingest_converges_whatever_the_order_of_doubled_points(spark, monkeypatch):
    want = spark.createDataFrame([row for n in range(60) for row in note(n, "ab")], STORED)
    order = F.udf(lambda _: random.random(), "double").asNondeterministic()
    stale = want.where("chunk_index = 0").withColumn("title", F.lit("Old"))
    # Each read of the stored points has its rows in another order.
    have = want.unionByName(stale).repartition(1).sortWithinPartitions(order("uid"))
    monkeypatch.setattr(ingest_queries, "expected_and_stored", lambda *_: (want, have))
    monkeypatch.setattr(ingest_queries, "FIELDS", ["text", "title"])
    reuse = spark.conf.get("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        assert [tuple(r) for r in ingest_queries.ingest_converges(spark, "").collect()] == [("skipped", 60)]
    finally:
        spark.conf.set("spark.sql.exchange.reuse", reuse)


def test_prune_refusals(spark):
    stored = spark.createDataFrame(note(1, "a"), STORED)
    for bad in (dict(confirmed=False), dict(confirmed=True, filtered=True), dict(confirmed=True, interrupted=True), dict(confirmed=True, scanned=False)):
        with pytest.raises(points.PruneRefused):
            points.prune_orphans(stored, stored, **bad)
    assert points.prune_orphans(stored, stored.select("uid"), confirmed=True).count() == 0


def test_hermetic_recall(spark, tmp_path):
    corpus, questions = tmp_path / "corpus.yaml", tmp_path / "golden.yaml"
    corpus.write_text("chunks:\n" + "".join(f"  - {{uid: {U(i)}, chunk_index: 0, tenant_id: t, area: a, path: p{i}.md, text: 'alpha word{i} beta'}}\n" for i in range(8)) + f"  - {{uid: {U(99)}, chunk_index: 0, tenant_id: other, area: a, path: q.md, text: 'word7 word6 word5'}}\n")
    questions.write_text("coverage: {min_total: 1, max_total: 20, groups: [{name: g, areas: [a], min: 1, max: 0}]}\nquestions:\n" + "".join(f"  - {{question: 'where is word{i if i < 6 else i + 50}', uid: {U(i)}, area: a}}\n" for i in range(8)))
    args = ["eval", "--golden", str(questions), "--corpus", str(corpus), "--tenant", "t", "--k", "1", "--threshold"]
    assert cli.main([*args, "0.75"], spark) == cli.OK
    assert cli.main([*args, "0.76"], spark) == cli.GATE
    golden.append_question(str(questions), {"question": "new: 'one'", "uid": U(3), "area": "a"})
    assert golden.read_golden(spark, str(questions))[0].count() == 9
    for text in ("chunks:\n  - {uid: u, extra: 1}\n", "chunks: []\n"):
        corpus.write_text(text)
        with pytest.raises(ValueError):
            golden.read_corpus(spark, str(corpus))


def test_embedding_batches_are_bounded_by_bytes(spark):
    def load():
        return lambda texts: [[float(sum(map(len, texts))), 1.0] for _ in texts]

    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(1 << 30))
    try:
        rows = spark.range(300).repartition(1).select("id", F.repeat(F.lit("x"), 100_000).alias("text"))
        got = embedding.embed(rows, load, 2, batch=1_000_000).select("id", F.get("dense", F.lit(0)).alias("held")).collect()
    finally:
        spark.conf.set(setting, before)
    assert len(got) == 300 and max(r.held for r in got) <= 9_000_000


def test_judge_errors_ties_and_chunks(spark):
    q = spark.createDataFrame([(1, "a", None, "x", False), (2, "b", 1, "x", False), (3, "c", None, "y", True)], "question_id int, uid string, chunk_index int, area string, errored boolean")
    r = spark.createDataFrame([(1, "z", 0, 5.0, 1), (1, "a", 3, 2.0, 2), (1, "y", 0, 2.0, 3), (2, "b", 0, 9.0, 1), (2, "b", 1, 1.0, 2)], "question_id int, uid string, chunk_index int, score double, rank int")
    got = {x.question_id: (x.hit, x.tied) for x in evaluation.judge(q, r, 2).collect()}
    assert got == {1: (True, False), 2: (True, False), 3: (False, False)}
    assert {x.question_id: x.tied for x in evaluation.judge(q, r, 3).collect()}[1]
    report = {x.area: x for x in evaluation.recall(evaluation.judge(q, r, 2)).collect()}
    assert (report["*"].hits, report["*"].total, report["*"].complete) == (2, 2, False) and (report["y"].total, report["y"].low, report["y"].high) == (0, 0.0, 1.0)
    assert not evaluation.gate(evaluation.recall(evaluation.judge(q, r, 2)), 0.0).first().passed


def test_suite_verdict_of_an_empty_suite(spark):
    cases = spark.createDataFrame([], "passed boolean")
    assert not evaluation.suite_verdict(cases).first().passed


def test_embedder_contract(spark):
    rows = spark.createDataFrame([("a",), ("bb",)], "text string")
    got = embedding.embed(rows, lambda: lambda texts: [[float(len(t)), 1.0] for t in texts], 2).collect()
    assert [r.dense for r in got] == [[1.0, 1.0], [2.0, 1.0]]
    with pytest.raises(Exception, match="other vectors"):
        embedding.embed(rows, lambda: lambda texts: [[1.0]], 2).collect()
    a = schemas.Handshake("r", "t", 2, "l2", "cls", "fp32")
    with pytest.raises(ValueError, match="dim"):
        a.require(schemas.Handshake("r", "t", 3, "l2", "cls", "fp32"))


def test_vault_walk(spark, tmp_path):
    for name in ("a/x.md", "a/_draft.MD", "a/.hidden.md", ".git/y.md", "skip/z.md", "README.md", "a/p.png", "b/empty.md"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text("" if "empty" in name else "x")
    listed, violations = vault.walk(spark, str(tmp_path), vault.Exclusions(("SKIP",), ("readme.md",)))
    paths = sorted(r.path for r in listed.collect())
    assert paths == ["a/.hidden.md", "a/_draft.MD", "a/x.md", "b/empty.md"] and violations == []
    assert sorted(r.path for r in vault.read_vault(spark, str(tmp_path), "v", vault.Exclusions(("skip",))).collect()) == ["README.md", "a/.hidden.md", "a/_draft.MD", "a/x.md", "b/empty.md"]
    by_uri = vault.read_vault(spark, f"file://{tmp_path}", "v", vault.Exclusions(("skip",)))
    assert sorted((r.path, r.raw) for r in by_uri.collect()) == [(p, "" if "empty" in p else "x") for p in ["README.md", "a/.hidden.md", "a/_draft.MD", "a/x.md", "b/empty.md"]]
    os.symlink(tmp_path / "a/x.md", tmp_path / "b/link.md")
    with pytest.raises(ValueError, match="symbolic"):
        vault.read_vault(spark, str(tmp_path), "v")


def points_at(spark, tmp_path):
    own = index.Index(spark, f"{tmp_path}/tables/interno")
    return own.points(own.current())


NOTE = "---\nuid: {}\ntype: concept\nstatus: stable\ncreated: 2026-08-07\ntags: [a]\n---\n# Title\n\n{}\n"


def test_command_line_end_to_end(spark, tmp_path, monkeypatch, capsys):
    root = tmp_path / "vault"
    (root / "area").mkdir(parents=True)
    for n, body in ((1, "the quick brown fox"), (2, "an unrelated text")):
        (root / "area" / f"{n}.md").write_text(NOTE.format(U(n), body))
    for key, value in {"TABLES": tmp_path / "tables", "COLLECTION": "interno", "TENANT": "t", "EMBEDDING_MODEL": "hash-1", "LOCKS": tmp_path / "locks", "VAULTS": "main", "VAULT_MAIN_PATH": root, "VAULT_MAIN_AREAS": "area"}.items():
        monkeypatch.setenv(config.PREFIX + key, str(value))
    assert cli.main(["ingest", "--dry-run"], spark) == cli.OK and not (tmp_path / "tables").exists()
    assert cli.main(["ingest"], spark) == cli.OK
    assert '"pruned":2' in capsys.readouterr().out
    assert cli.main(["ingest"], spark) == cli.OK and '"skipped":2' in capsys.readouterr().out
    assert cli.main(["search", "brown fox", "--mode", "hybrid"], spark) == cli.OK and U(1) in capsys.readouterr().out
    assert cli.main(["get", U(2)], spark) == cli.OK and "unrelated" in capsys.readouterr().out
    assert cli.main(["stats"], spark) == cli.OK and '"points": 2' in capsys.readouterr().out
    (root / "area" / "2.md").unlink()
    assert cli.main(["ingest", "--prune-orphans"], spark) == cli.USAGE
    assert cli.main(["ingest", "--prune-orphans", "--yes"], spark) == cli.OK and "area/2.md" in capsys.readouterr().out
    assert cli.main(["stats"], spark) == cli.OK and '"points": 1' in capsys.readouterr().out
    assert cli.main(["search", " "], spark) == cli.USAGE and cli.main(["nothing"], spark) == cli.USAGE
    (root / "area" / "3.md").write_text("no front matter")
    assert cli.main(["ingest"], spark) == cli.FAILURE
    (root / "area" / "3.md").unlink()
    with lease.held(spark, str(tmp_path / "locks"), sinks.canonical(f"{tmp_path}/tables/interno")):
        assert cli.main(["ingest"], spark) == cli.LOCKED


def test_notes_without_chunks_blank_files_and_oversize(spark, tmp_path, monkeypatch, capsys):
    root = tmp_path / "vault"
    (root / "area" / "old").mkdir(parents=True)
    for n in range(1, 6):
        (root / "area" / f"{n}.md").write_text(NOTE.format(U(n), f"text {n}"))
    (root / "area" / "old" / "7.md").write_text(NOTE.format(U(7), "excluded later"))
    settings = {"TABLES": tmp_path / "tables", "COLLECTION": "interno", "TENANT": "t", "EMBEDDING_MODEL": "hash-1", "LOCKS": tmp_path / "locks", "STATE": tmp_path / "state.json", "VAULTS": "main", "VAULT_MAIN_PATH": root, "VAULT_MAIN_AREAS": "area"}
    for key, value in settings.items():
        monkeypatch.setenv(config.PREFIX + key, str(value))
    assert cli.main(["ingest"], spark) == cli.OK
    stored = lambda: {int(r.uid[-12:], 16): r.text for r in points_at(spark, tmp_path).collect()}
    assert sorted(stored()) == [1, 2, 3, 4, 5, 7] and sinks.read_json(str(tmp_path / "state.json"), embedding.STATE_KEYS)["model"] == "hash-1"
    capsys.readouterr()
    (root / "area" / "1.md").write_text(NOTE.format(U(1), "").split("# Title")[0])  # front matter only
    (root / "area" / "2.md").write_text("  \n")  # blank: not a note, but on disk
    (root / "area" / "3.md").write_text(NOTE.format(U(3), "word " * 9000))  # one chunk over the hard limit
    (root / "area" / "4.md").unlink()
    monkeypatch.setenv(config.PREFIX + "VAULT_MAIN_EXCLUDE_FOLDERS", "Area/OLD")
    assert cli.main(["ingest", "--prune-orphans", "--yes"], spark) == cli.FAILURE
    report = json.loads(capsys.readouterr().out)
    assert report["notes"] == 3 and report["counts"] == {"failed": 1, "pruned": 1, "skipped": 1}
    assert [o["path"] for o in report["orphans"]] == ["area/4.md"] and [o["path"] for o in report["on_disk"]] == ["area/2.md", "area/old/7.md"]
    assert report["failed"][0]["uid"] == U(3)
    assert {n: t.split()[-1] for n, t in stored().items()} == {2: "2", 3: "3", 5: "5", 7: "later"}
    # Everything goes: the tenant's old partition must not stay.
    for path in root.rglob("*.md"):
        path.unlink()
    assert cli.main(["ingest", "--prune-orphans", "--yes", "--human"], spark) == cli.OK
    assert "orphans: 4" in capsys.readouterr().out and stored() == {}
    monkeypatch.setenv(config.PREFIX + "EMBEDDING_MODEL", "other")
    assert cli.main(["ingest"], spark) == cli.FAILURE and "come from hash-1" in capsys.readouterr().out


def test_only_changed_notes_are_embedded(spark):
    want = spark.createDataFrame(note(1, "ab") + note(2, "cd"), STORED)
    have = spark.createDataFrame(note(1, "ab") + note(2, "cx"), STORED)
    results = points.classify(want, have, ["text", "title"])
    assert {r.uid for r in points.changed_points(want, results).collect()} == {U(2)}
    assert {r.uid for r in points.changed_points(want, points.classify(want, have, ["text", "title"], full=True)).collect()} == {U(1), U(2)}


def test_writes_are_confirmed_or_fail():
    tries = []

    def write():
        tries.append(1)
        if len(tries) == 1:
            raise OSError("lost")

    points.write_confirmed(write, lambda: True)
    assert len(tries) == 2
    with pytest.raises(points.WriteFailed):
        points.write_confirmed(lambda: None, lambda: False, attempts=2)


def test_interrupt_refuses_to_write(spark):
    with cli.interruptible(spark) as state:
        state.check()
        os.kill(os.getpid(), 2)
        with pytest.raises(outage.Interrupted):
            state.check()
    with pytest.raises(points.PruneRefused, match="interrupted"):
        points.prune_orphans(spark.createDataFrame(note(1, "a"), STORED), None, confirmed=True, interrupted=True)


def test_requests_have_one_shape():
    one, two = retrieval.Leg(5, dense=True), retrieval.Leg(5, sparse=True)
    assert retrieval.Request(single=one).validate() and retrieval.Request(fused=(one, two)).validate()
    for bad in (retrieval.Request(), retrieval.Request(single=one, fused=(one, two)), retrieval.Request(single=retrieval.Leg(5)), retrieval.Request(single=retrieval.Leg(5, True, True)), retrieval.Request(single=retrieval.Leg(0, True))):
        with pytest.raises(retrieval.QueryError):
            bad.validate()


def test_secrets_and_vault_choice():
    values = {"embedder_token": "s3cret", "tables": "x"}
    assert config.redacted(values) == {"embedder_token": "***", "tables": "x"} and config.scrub("no s3cret here", values) == "no *** here"
    own = config.Config({}, (config.Vault("a", "p", ("x",)), config.Vault("b", "q", ("x",))))
    assert len(own.chosen("both")) == 2 and own.chosen("b")[0].path == "q"
    with pytest.raises(config.ConfigError):
        own.chosen("c")


def test_lock_scope_and_file_systems(tmp_path):
    (tmp_path / "real").mkdir()
    os.symlink(tmp_path / "real", tmp_path / "link")
    assert sinks.canonical(f"{tmp_path}/link/../real/") == sinks.canonical(f"file://{tmp_path}/link") == str(tmp_path / "real")
    mounts = tmp_path / "mounts"
    mounts.write_text(f"/dev/a / ext4 rw 0 0\nhost:/x {tmp_path} nfs4 rw 0 0\n")
    assert sinks.file_system(str(tmp_path / "real"), str(mounts)) == "nfs4" and sinks.file_system("/usr", str(mounts)) == "ext4"


def test_embedder_start(spark):
    embedding.probe([[0.6, 0.8]], [{1: 0.5}])
    for bad in (([[1.0, 1.0]], None), ([[0.6, 0.8]], [{}])):
        with pytest.raises(ValueError):
            embedding.probe(*bad)
    own = schemas.Handshake("r", "t", 2, "l2", "cls", "fp32")
    assert not embedding.verify(own, None, "m")


class Answers(http.server.BaseHTTPRequestHandler):
    """An embedding service of two dimensions that fails once, then works."""

    failures = 1

    def answer(self, code, data):
        self.send_response(code)
        self.end_headers()
        self.wfile.write(json.dumps(data).encode())

    def do_GET(self):  # noqa: N802
        self.answer(200, {"model_revision": "m", "tokenizer_revision": "t", "dense_dim": 2, "normalized": True, "pooling": "cls", "precision": "float16", "sparse": {"b": "2", "a": "1"}})

    def do_POST(self):  # noqa: N802
        texts = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["inputs"]
        if Answers.failures:
            Answers.failures -= 1
            return self.answer(503, {})
        if self.path == "/tokenize":
            return self.answer(200, {"counts": [len(t.split()) for t in texts]})
        if "refuse" in texts:
            return self.answer(413, {"error": "too long"})
        self.answer(200, {"dense": [[0.6, 0.8] if "fox" in t else [0.8, 0.6] for t in texts], "sparse": [{"indices": [1], "values": [0.5]} for _ in texts]})

    def log_message(self, *_):
        pass


@pytest.fixture
def service():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/"
    server.shutdown()


def test_embedding_service(spark, service, tmp_path, monkeypatch, capsys):
    own = embedder.Service(service, delay=0.01)
    assert own.handshake() == schemas.Handshake("m", "t", 2, "l2", "cls", "fp16", "a=1,b=2")
    Answers.failures = 1
    assert own.count(["a b", ""]) == [2, 0]
    assert own.embed(["the fox"], "query") == [([0.6, 0.8], {1: 0.5})]
    with pytest.raises(ValueError, match="413"):
        own.embed(["refuse"], "query")
    for bad in ("ftp://x", "nothing"):
        with pytest.raises(ValueError):
            embedder.Service(bad)
    root = tmp_path / "vault"
    (root / "area").mkdir(parents=True)
    for n, body in ((1, "the quick brown fox"), (2, "an unrelated text")):
        (root / "area" / f"{n}.md").write_text(NOTE.format(U(n), body))
    settings = {"TABLES": tmp_path / "tables", "COLLECTION": "interno", "TENANT": "t", "EMBEDDING_MODEL": "m", "EMBEDDER": service, "LOCKS": tmp_path / "locks", "STATE": tmp_path / "state.json", "VAULTS": "main", "VAULT_MAIN_PATH": root, "VAULT_MAIN_AREAS": "area"}
    for key, value in settings.items():
        monkeypatch.setenv(config.PREFIX + key, str(value))
    Answers.failures = 1
    assert cli.main(["ingest"], spark) == cli.OK
    assert {tuple(r.dense) for r in points_at(spark, tmp_path).collect()} == {(0.6, 0.8), (0.8, 0.6)}
    assert cli.main(["search", "fox", "--mode", "dense", "--top-k", "1"], spark) == cli.OK and U(1) in capsys.readouterr().out
    monkeypatch.delenv(config.PREFIX + "EMBEDDER")  # the built-in embedder is another model
    assert cli.main(["search", "fox"], spark) == cli.FAILURE and "embedder: the embedder differs in model_revision" in capsys.readouterr().out


def test_report_and_decision_documents(spark, tmp_path):
    import subprocess

    rows = spark.createDataFrame([("*", 3, 4, 0.75, 0.3, 0.95, 1, True), ("x", 3, 4, 0.75, 0.3, 0.95, 1, True)], "area string, hits long, total long, recall double, low double, high double, tied long, complete boolean").collect()
    text = evaluation.recall_markdown(rows, [{"kind": "failed", "question": "q?", "area": "x"}], 5, "dense", "abc")
    assert "| x | 3 | 4 | 0.7500 | 0.3000 to 0.9500 |" in text and "* q? (x)" in text and "Commit abc." in text
    assert "Keep hybrid" in evaluation.decision_markdown(rows[0], rows[0], 5, "2026-01-01")
    with pytest.raises(ValueError):
        evaluation.decision_markdown(rows[0], {**rows[0].asDict(), "complete": False}, 5, "2026-01-01")
    saved = evaluation.baseline_of(rows, 5, "dense")
    assert {r.area: r.recall for r in evaluation.baseline_rows(spark, saved, 5, "dense").collect()} == {"*": 0.75, "x": 0.75}
    with pytest.raises(ValueError):
        evaluation.baseline_rows(spark, saved, 10, "dense")
    path = tmp_path / "golden.yaml"
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    git("init", "-q")
    path.write_text(f"questions:\n  - {{question: 'one', uid: {U(1)}, area: a}}\n")
    git("add", "."), git("commit", "-qm", "1")
    golden.append_question(str(path), {"question": "two", "uid": U(2), "area": "a"})
    git("commit", "-qam", "2")
    commit, dates = golden.commits(spark, str(path))
    assert len(commit) == 40 and dates.count() == 2


def test_config_reports_everything_at_once():
    with pytest.raises(config.ConfigError) as e:
        config.load(None, {config.PREFIX + k: v for k, v in {"VAULTS": "both,Bad", "VAULT_OTHER_PATH": "x", "COLLECTION": "zzz", "WHAT": "1"}.items()})
    assert all(x in str(e.value) for x in ("'both'", "'Bad'", "vault_other_path", "collection is", "unknown setting what"))


def test_schema_drift(spark):
    manifest = schemas.manifests("m")["interno"]
    empty = spark.createDataFrame([], schemas.PAYLOAD)
    assert schemas.check_applied(manifest, None) == "create" and schemas.check_applied(manifest, empty, "m") == "verified"
    for stored, model in ((empty.drop("area"), "m"), (empty.withColumn("oversize", F.lit("x")), "m"), (empty, "other")):
        with pytest.raises(schemas.SchemaDrift):
            schemas.check_applied(manifest, stored, model)


def test_state_files(tmp_path):
    path = str(tmp_path / "state.json")
    sinks.write_json(path, {"a": 1})
    assert sinks.read_json(path, {"a"}) == {"a": 1}
    with pytest.raises(ValueError):
        sinks.read_json(path, {"a", "b"})
    assert sinks.scope_key("ab", "c") != sinks.scope_key("a", "bc")


def test_stream_merges_by_key_and_replays(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    shape = "tenant_id string, uid string, chunk_index int, text string"
    for rows in ([("t", "u", 0, "old"), ("t", "u", 1, "b")], [("t", "u", 0, "new"), ("s", "v", 0, "c")]):
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(source)
        for checkpoint in ("c1", "c1"):
            continuous.ingest_stream(spark.readStream.schema(shape).parquet(source), table, str(tmp_path / checkpoint)).awaitTermination()
    got = sorted((r.tenant_id, r.uid, r.chunk_index, r.text) for r in spark.read.parquet(table).collect())
    assert got == [("s", "v", 0, "c"), ("t", "u", 0, "new"), ("t", "u", 1, "b")]


def test_late_rows_leave_the_windows(spark, tmp_path):
    source = str(tmp_path / "events")
    shape = "ts timestamp, event_type string, value double"
    day = "2026-01-01 {:02d}:30:00".format
    for n, hours in enumerate(([1, 2], [10], [10], [1, 10], [20])):
        spark.createDataFrame([(day(h), "a", 1.0) for h in hours], "ts string, event_type string, value double").selectExpr("cast(ts as timestamp) ts", "event_type", "value").coalesce(1).write.parquet(f"{source}/{n}")
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(source)
    run = continuous.windowed_counts(stream).writeStream.outputMode("append").format("memory").queryName("late").trigger(availableNow=True).start()
    run.awaitTermination()
    got = {r.start.hour: r.n for r in spark.sql("select * from late").collect()}
    assert got[1] == 1 and got[2] == 1


def imports_of(path):
    for node in ast.walk(ast.parse(path.read_text())):
        if isinstance(node, ast.Import):
            yield from (a.name for a in node.names)
        elif isinstance(node, ast.ImportFrom) and node.module:
            yield node.module


def test_nothing_else_imports_the_optional_subpackage():
    for path in ROOT.rglob("*.py"):
        if "llm" not in path.parts:
            assert not [x for x in imports_of(path) if x.startswith("noteloom.llm")], path


def import_graph():
    """Module to the modules of the package that it imports, inside functions too."""
    names = {".".join(("noteloom", *path.relative_to(ROOT).with_suffix("").parts)).removesuffix(".__init__"): path for path in ROOT.rglob("*.py")}
    graph = {}
    for name, path in names.items():
        found = set()
        for node in ast.walk(ast.parse(path.read_text())):
            if isinstance(node, ast.Import):
                found |= {a.name for a in node.names}
            elif isinstance(node, ast.ImportFrom) and node.module:
                found |= {node.module, *(f"{node.module}.{a.name}" for a in node.names)}
        graph[name] = {x for x in found if x in names and x != name}
    return graph


def reached(graph, start):
    seen, left = set(), [start]
    while left:
        for x in graph[left.pop()] - seen:
            seen.add(x)
            left.append(x)
    return seen


def test_layers_hold_through_all_imports():
    graph = import_graph()
    assert reached({"a": {"b"}, "b": {"c"}, "c": set()}, "a") == {"b", "c"}
    below = {"noteloom.functions": ("noteloom.functions",), "noteloom.operators": ("noteloom.functions", "noteloom.operators", "noteloom.schemas", "noteloom"), "noteloom.sources": ("noteloom.sources", "noteloom.schemas", "noteloom")}
    for name in graph:
        for layer, allowed in below.items():
            if name.startswith(layer + "."):
                assert all(x in allowed or x.startswith(tuple(a + "." for a in allowed if a != "noteloom")) for x in reached(graph, name)), (name, reached(graph, name))
        if not name.startswith("noteloom.llm"):
            assert not [x for x in reached(graph, name) if x.startswith("noteloom.llm")], name


def is_column(node, name=None):
    return isinstance(node, ast.Call) and getattr(node.func, "attr", "") == "col" and (name is None or [a.value for a in node.args if isinstance(a, ast.Constant)] == [name])


def compares_tenants(source):
    """Comparisons of the tenant column with a value; two columns side by side are a join, not a filter."""
    for node in ast.walk(ast.parse(source)):
        if isinstance(node, ast.Compare):
            sides = [node.left, *node.comparators]
            if any(is_column(x, "tenant_id") for x in sides) and not all(is_column(x) for x in sides):
                yield node.lineno


def test_only_one_place_makes_point_predicates():
    assert list(compares_tenants('df.where(F.col("tenant_id") == t)')) == [1]
    for path in ROOT.rglob("*.py"):
        found = list(compares_tenants(path.read_text()))
        assert len(found) == (1 if path.name == "retrieval.py" else 0), path


def test_folders_of_a_vault_are_partitions(spark, tmp_path, monkeypatch):
    from noteloom.sources import vault_listing

    want = set()
    for i in range(6):
        for j in range(3):
            folder = tmp_path / f"f{i}" / f"g{j}" / "deep" / "er"
            folder.mkdir(parents=True)
            (folder / "n.md").write_text("x")
    (tmp_path / ".dot").mkdir()
    (tmp_path / ".dot" / "n.md").write_text("x")
    os.symlink(tmp_path / "f0", tmp_path / "f1" / "again")
    for top, inside, names in os.walk(tmp_path):
        inside[:] = [d for d in inside if not d.startswith(".")]
        for name in [*inside, *names]:
            path = os.path.join(top, name)
            want.add((os.path.relpath(path, tmp_path), os.path.islink(path), os.path.isdir(path)))
    for enough in (1, 8, 32):
        monkeypatch.setattr(vault_listing, "ENOUGH", enough)
        rows = vault_listing.listing(spark, str(tmp_path))
        found = [tuple(r) for r in rows.collect()]
        assert set(found) == want and len(found) == len(want)
        assert rows.rdd.getNumPartitions() > 6
    assert vault_listing.listing(spark, str(tmp_path / "f0/g0/deep/er")).count() == 1


def index_with(spark, root, rows):
    """An index of one state that holds these points."""
    own = index.Index(spark, root, buckets=4)
    full = rows.select(*[F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.PAYLOAD], "point_id")
    stored = embedding.both_by_hash(full).withColumns({"seq": F.lit(1).cast("bigint"), "bucket": index.note_bucket(F.col("uid"), 4)})
    lists = postings.postings_of(stored, 4)
    parts = {name: own.table.stage(made, name, ["tenant_id", "bucket"], "1") for name, made in (("points", stored), ("postings", postings.in_lists(lists)), ("bounds", postings.bounds_of(lists)))}
    own.table.commit(None, parts, info={"buckets": 4})
    return own


def test_tools_keep_their_scope(spark, tmp_path):
    from noteloom import tools

    stored = spark.createDataFrame([point("t1", 1, text="alpha beta"), point("t2", 2, text="alpha gamma"), *[point("t1", 3, c, text=f"c{c}") for c in range(64)]], POINTS)
    own = tools.KnowledgeTools(tools.Scope("interno", "t1", ("a", "b")), index_with(spark, str(tmp_path / "t"), stored))
    answer = own.search_knowledge("alpha", top_k=3)
    assert "alpha beta" in answer and "gamma" not in answer and answer.startswith(security_open())
    assert own.search_knowledge("alpha", area="b").startswith("No results. The area 'b'")
    assert "alpha beta" in own.get_note(U(1)) and own.get_note(U(2)) == tools.NO_RESULTS
    with pytest.raises(ValueError, match="too large"):
        own.get_note(U(3))
    with pytest.raises(retrieval.QueryError):
        own.search_knowledge("alpha", area="unknown")
    with pytest.raises(retrieval.QueryError):
        tools.Scope("interno", "", ())


def test_a_search_that_takes_too_long_is_cancelled(spark):
    from noteloom import deadline

    @F.udf("long")
    def slow(i):
        import time

        time.sleep(60)
        return i

    begun = time.perf_counter()
    with pytest.raises(outage.DeadlineExceeded) as e:
        deadline.within(spark, 1.0, lambda: spark.range(2).select(slow("id")).collect())
    assert outage.part_of(e.value) == "deadline" and time.perf_counter() - begun < 30
    assert deadline.within(spark, 30.0, lambda: spark.range(3).count()) == 3 and not spark.sparkContext.getJobTags()
    with pytest.raises(KeyError):
        deadline.within(spark, 30.0, lambda: {}["x"])


def test_evaluation_of_the_stored_collection(spark, tmp_path, monkeypatch, capsys):
    root = tmp_path / "vault"
    (root / "area").mkdir(parents=True)
    words = ["amber", "birch", "cedar", "dahlia", "elm"]
    for n, word in enumerate(words, 1):
        (root / "area" / f"{n}.md").write_text(NOTE.format(U(n), f"all about {word} and {word}"))
    path = tmp_path / "golden.yaml"
    path.write_text("coverage: {min_total: 1, max_total: 6, groups: [{name: g, areas: [area], min: 2, max: 6}]}\nquestions:\n" + "".join(f"  - {{question: 'what is {w}', uid: {U(n)}, area: area}}\n" for n, w in enumerate(words[:4], 1)))
    settings = {"TABLES": tmp_path / "tables", "COLLECTION": "interno", "TENANT": "t", "EMBEDDING_MODEL": "hash-1", "LOCKS": tmp_path / "locks", "VAULTS": "main", "VAULT_MAIN_PATH": root, "VAULT_MAIN_AREAS": "area"}
    for key, value in settings.items():
        monkeypatch.setenv(config.PREFIX + key, str(value))
    assert cli.main(["schema"], spark) == cli.OK and "interno create\n" in capsys.readouterr().out
    assert cli.main(["schema", "--apply"], spark) == cli.OK and "interno created\n" in capsys.readouterr().out
    assert cli.main(["schema"], spark) == cli.OK and "interno verified\n" in capsys.readouterr().out
    assert cli.main(["ingest"], spark) == cli.OK
    assert set(json.loads(capsys.readouterr().out)["phases_ms"]) == {"lock", "scan", "compare", "write"}
    decision = tmp_path / "decision.md"
    asked = ["eval", "--golden", str(path), "--tenant", "t", "--k", "2", "--mode", "hybrid", "--threshold", "1.0", "--compare", str(decision)]
    assert cli.main(asked, spark) == cli.OK
    assert json.loads(capsys.readouterr().out)["data"]["hits"] == 4 and "Keep hybrid" in decision.read_text() and "4 questions" in decision.read_text()
    assert cli.main([*asked[:7], "--mode", "dense", "--compare", str(decision)], spark) == cli.USAGE
    assert cli.main(["eval", "--golden", str(path), "--tenant", "other", "--mode", "hybrid"], spark) == cli.GATE  # another tenant has no notes
    capsys.readouterr()
    assert cli.main(["measure-search", "--golden", str(path), "--count", "2", "--p95", "1e9", "--p99", "1e9"], spark) == cli.OK
    rows = json.loads(capsys.readouterr().out)["data"]
    assert [r["phase"] for r in rows] == ["embed", "store", "overhead", "total"] and all(r["n"] == 2 for r in rows) and rows[3]["p95"] >= rows[1]["p95"] > 0
    assert cli.main(["measure-ingest", "--gate", "1e9"], spark) == cli.OK and '"reprocessed": 0' in capsys.readouterr().out
    (root / "area" / "1.md").write_text(NOTE.format(U(1), "other words"))
    assert cli.main(["measure-ingest", "--gate", "1e9"], spark) == cli.GATE and "not measured" in capsys.readouterr().out
    # One note has no question yet; after it the session ends by itself.
    args = cli.parser().parse_args(["golden", str(path), "--author", "me"])
    said = []
    assert cli.run_golden(spark, config.load(), args, iter(["what is an elm?\n"]), said.append) == 1
    assert golden.read_golden(spark, str(path))[0].where(f"uid = '{U(5)}' AND author = 'me'").count() == 1 and "4 questions" in said[0] and "all about elm" in said[1] and said[-1] == "saved: 5"
    assert cli.run_golden(spark, config.load(), args, iter(["never asked\n"]), said.append) == 0


def security_open():
    from noteloom.operators.security import OPEN_TAG

    return OPEN_TAG


def tool_parameters(source):
    """Parameters of the public methods of classes whose name ends in Tools."""
    for node in ast.walk(ast.parse(source)):
        if isinstance(node, ast.ClassDef) and node.name.endswith("Tools"):
            for f in node.body:
                if isinstance(f, ast.FunctionDef) and not f.name.startswith("_"):
                    yield from (a.arg for a in f.args.args + f.args.kwonlyargs)


def test_no_tool_takes_a_tenant_or_collection():
    forbidden = {"tenant", "tenant_id", "collection", "scope"}
    assert not forbidden & set(tool_parameters((ROOT / "tools.py").read_text()))
    leaking = "class BadTools:\n    def search(self, text, tenant_id): ..."
    assert forbidden & set(tool_parameters(leaking))
