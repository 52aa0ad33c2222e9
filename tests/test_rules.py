"""Rules that guard a run, case by case: requests, settings, handshakes, prunes, writes, outages, secrets, lock folders."""

import itertools

import pytest

from noteloom import cli, config, outage, schemas
from noteloom.operators import chunking, embedding, points, retrieval
from noteloom.sources import embedder, golden, lease, sinks, snapshots

HANDSHAKE = schemas.Handshake("r1", "t1", 64, "l2", "cls", "fp32", "s")


@pytest.mark.parametrize(
    ("change", "said"),
    [
        ({"tenant_id": ""}, "tenant_id is required"), ({"collection": ""}, "collection is required"), ({"text": " "}, "text is required"), ({"top_k": 0}, "top_k must be positive"),
        ({"top_k": 1001}, "top_k is at most 1000"), ({"offset": -1}, "offset must not be negative"), ({"mode": "fuzzy"}, "mode is one of hybrid, dense"), ({"tenant_id": "", "top_k": 0}, "tenant_id is required"),
    ],
)
def test_the_first_rule_a_query_breaks(change, said):
    with pytest.raises(retrieval.QueryError, match=said):
        retrieval.Query(**{"collection": "interno", "tenant_id": "t", "text": "x", **change}).validate()


def test_legs_of_a_request():
    assert len(retrieval.request_of(retrieval.Query("interno", "t", "x")).fused) == 2
    assert retrieval.request_of(retrieval.Query("interno", "t", "x", mode="dense")).single.limit == retrieval.leg_limit(5)


@pytest.mark.parametrize(("floor", "ceiling"), [(0, 5), (5, 4), (1, chunking.HARD_LIMIT + 1), (-1, 5)])
def test_chunk_settings(floor, ceiling):
    with pytest.raises(ValueError, match=f"got {floor} and {ceiling}"):
        chunking.ChunkConfig(floor, ceiling)


def test_handshakes():
    fields = HANDSHAKE.__dict__
    assert not embedding.verify(HANDSHAKE, None, "m1") and embedding.verify(HANDSHAKE, {"model": "m1", "handshake": fields}, "m1")
    with pytest.raises(ValueError, match="come from m0, not m1"):
        embedding.verify(HANDSHAKE, {"model": "m0", "handshake": fields}, "m1")
    for name in fields:
        with pytest.raises(ValueError, match=f"differs in {name}$"):
            embedding.verify(HANDSHAKE, {"model": "m1", "handshake": fields | {name: 1 if name == "dim" else "other"}}, "m1")
    embedding.probe([[0.6, 0.8], [0.6003, 0.8]], [{7: 0.5}])
    for vectors, sparse, said in (([[0.61, 0.81]], None, "unit length"), ([[0.6, 0.8]], [{}], "empty sparse")):
        with pytest.raises(ValueError, match=said):
            embedding.probe(vectors, sparse)


def test_when_orphans_may_be_pruned():
    for confirmed, filtered, interrupted, scanned in itertools.product([True, False], repeat=4):
        why = points.prune_refusal(confirmed, filtered, interrupted, scanned)
        assert (why is None) == (confirmed and not filtered and not interrupted and scanned)
        assert why == ("the run was filtered" if filtered else "orphans were not scanned" if not scanned else "the run was interrupted" if interrupted else None if confirmed else "not confirmed")
    cli.check_flags(False, True, "", True), cli.check_flags(True, False, "x", False)
    for flags in ((True, True, "", True), (False, True, "x", True), (False, True, "", False)):
        with pytest.raises(cli.Usage):
            cli.check_flags(*flags)


@pytest.mark.parametrize(("fails", "shows", "attempts"), [(0, True, 1), (2, True, 3), (3, True, 3), (0, False, 3)])
def test_writes_that_fail_or_never_show(fails, shows, attempts):
    tries = []

    def write():
        tries.append(1)
        if len(tries) <= fails:
            raise OSError("lost")

    if fails < 3 and shows:
        points.write_confirmed(write, lambda: True)
    else:
        with pytest.raises(points.WriteFailed, match="after 3 attempts"):
            points.write_confirmed(write, lambda: shows)
    assert len(tries) == attempts


def test_schema_drift_of_every_column(spark):
    from pyspark.sql import functions as F

    manifest, empty = schemas.manifests("m1")["interno"], spark.createDataFrame([], schemas.PAYLOAD)
    for f in schemas.PAYLOAD:
        assert f"column {f.name} is binary, not {f.dataType.simpleString()}" in schemas.drift(manifest, empty.withColumn(f.name, F.lit(None).cast("binary")))
        assert schemas.drift(manifest, empty.drop(f.name)) == [f"missing column {f.name}", *([f"filterable column {f.name} is missing"] if f.name in schemas.FILTERABLE else [])]


@pytest.mark.parametrize(
    ("environment", "said"),
    [
        ({"TENANT": "a"}, "search needs tables, collection"), ({"VAULTS": "both", "VAULT_BOTH_PATH": "/p", "VAULT_BOTH_AREAS": "x"}, "a vault cannot be called 'both'"),
        ({"VAULT_OLD_PATH": "/p"}, "setting vault_old_path belongs to no vault"), ({"VAULTS": "a", "VAULT_A_AREAS": "Bad"}, "area 'Bad'; vault a needs a path and areas"),
        ({"COLLECTION": "other", "WHAT": "1"}, "unknown setting what; collection is one of interno, clientes, base_paga"),
    ],
)
def test_settings(environment, said):
    with pytest.raises(config.ConfigError) as e:
        config.load(None, {config.PREFIX + k: v for k, v in environment.items()}).require("search")
    assert str(e.value) == said


def test_outages_are_told_by_type(spark, tmp_path):
    from pyspark.sql import functions as F

    assert outage.part_of(schemas.EmbedderMismatch("x")) == outage.part_of(embedder.ServiceError("busy")) == outage.part_of(embedder.Refused("x")) == "embedder"
    assert {outage.part_of(e("x")) for e in (points.WriteFailed, schemas.SchemaDrift, lease.LeaseLost, snapshots.Conflict, outage.StoreDown)} == {"store"}
    assert outage.part_of(outage.Interrupted("x")) == "interrupted" and outage.part_of(outage.DeadlineExceeded("x")) == "deadline"
    # Words in a message decide nothing.
    assert outage.part_of(ValueError("the embedder's parquet filesystem")) == "other" and outage.part_of(OSError("parquet")) == "other"
    try:
        try:
            raise embedder.ServiceError("down")
        except OSError as e:
            raise RuntimeError("no vectors") from e
    except RuntimeError as e:
        assert outage.part_of(e) == "embedder"

    @F.pandas_udf("long")
    def fails(ids):
        raise embedder.Refused("no")

    with pytest.raises(Exception) as e:
        spark.range(1).select(fails("id")).collect()
    assert outage.part_of(e.value) == "embedder"
    with pytest.raises(Exception) as e:
        spark.read.schema("a int").parquet(str(tmp_path / "gone")).collect()
    assert outage.part_of(e.value) == "store"
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.parquet").write_text("not parquet at all")
    with pytest.raises(Exception) as e:
        spark.read.schema("a int").parquet(str(tmp_path / "bad")).collect()
    assert outage.part_of(e.value) == "store"
    with pytest.raises(Exception) as e:
        spark.range(1).select(F.raise_error(F.lit("the embedder is a parquet"))).collect()
    assert outage.part_of(e.value) == "other"


def test_lock_folders(tmp_path):
    mounts = tmp_path / "mounts"
    mounts.write_text("/dev/a /var ext4 rw 0 0\nhost:/x /mnt nfs4 rw 0 0\n")
    assert sinks.check_file_system("/var/x", str(mounts)) == "ext4" and sinks.check_file_system("/other", str(mounts)) == ""
    with pytest.raises(ValueError, match="locks do not hold on nfs4: /mnt/x"):
        sinks.check_file_system("/mnt/x", str(mounts))


def test_golden_files_round_trip(spark, tmp_path):
    uid = "0198a7f2-4b31-7c42-9e15-{:012x}".format
    path = tmp_path / "golden.yaml"
    path.write_text("coverage: {min_total: 1, max_total: 0, groups: [{name: g, areas: [a, b], min: 1, max: 9}]}\nquestions:\n")
    rows = [("what: is it?", uid(1), "a", 0), ("'quoted' \"too\"é", uid(2), "b", 2)]
    for question, own, area, chunk in rows:
        golden.append_question(str(path), {"question": question, "uid": own, "area": area, "chunk_index": chunk})
    questions, groups, bounds = golden.read_golden(spark, str(path))
    assert sorted((r.question, r.uid, r.area, r.chunk_index) for r in questions.collect()) == sorted(rows) and groups.count() == 2 and bounds == (1, 0)
