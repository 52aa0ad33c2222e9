"""Posting lists, the stored index, batch search with a filter per question, chunking by a model's tokens."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from noteloom import index
from noteloom.operators import chunking, counting, embedding, measuring, points, postings, retrieval
from noteloom.plans import base, search_queries
from tests.conftest import SF

U = "0198a7f2-4b31-7c42-9e15-{:012x}".format


def plain_chunks(lines, ends, sections, config, count):
    """The rules, straight: sections over the ceiling give way to their children, pieces below the floor absorb what follows."""
    text = lambda p: counting.prefixed(lines, ends, p)
    pieces = []
    for whole, children in sections:
        pieces += children if children and count(text(whole)) > config.ceiling else [whole]
    out = []
    while pieces:
        now = pieces.pop(0)
        while count(text(now)) < config.floor and pieces:
            union = (now[0], pieces[0][1], counting.common(now[2], pieces[0][2]))
            if count(text(union)) > config.ceiling:
                break
            now = union
            pieces.pop(0)
        out.append((list(now[2]), text(now), count(text(now))))
    return out


def test_chunks_by_a_byte_pair_counter(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    config = chunking.ChunkConfig(floor=60, ceiling=200)

    def load():
        own = Tokenizer.from_file(path)
        return lambda texts: [len(e.ids) for e in own.encode_batch(list(texts))]

    notes = base.markdown(spark, SF).unionByName(spark.createDataFrame([(-1, ""), (-2, " \n\n"), (-3, "# A\n\n## B\ntext\n### C\n" + "word " * 400 + "\n### D\nx"), (-4, None)], "doc_id long, body string")).repartition(3)
    got = {}
    for r in sorted(counting.chunk_notes(notes, load, config).collect(), key=lambda r: (r.doc_id, r.chunk_index)):
        got.setdefault(r.doc_id, []).append((list(r.breadcrumb), r.text, r.tokens))
        assert r.oversize == (r.tokens > config.ceiling)
    one = Tokenizer.from_file(path)
    count = lambda t: len(one.encode(t).ids)
    piece = lambda p: (p["start"], p["end"], tuple(p["breadcrumb"]))
    want = {}
    for r in chunking.scan_sections(notes.where("body IS NOT NULL")).collect():
        if made := plain_chunks(list(r.lines), r.ends, [(piece(s["piece"]), [piece(c) for c in s["children"]]) for s in r.sections], config, count):
            want[r.doc_id] = made
    assert got == want and max(map(len, got.values())) > 3 and -1 not in got and -2 not in got and -4 not in got


def test_an_additive_counter_gives_the_chunks_of_the_columns(spark):
    config = chunking.ChunkConfig(floor=40, ceiling=120)
    notes = base.markdown(spark, SF)
    shown = lambda rows: {(r.doc_id, r.chunk_index, " > ".join(r.breadcrumb), r.text, r.tokens) for r in rows.collect()}
    assert shown(counting.chunk_notes(notes, lambda: lambda texts: [len(t.split()) for t in texts], config)) == shown(chunking.chunk_notes(notes, config))


def test_calls_to_a_counter_are_shared_and_remembered():
    asked = []

    def count(texts):
        asked.append(list(texts))
        return [len(t) for t in texts]

    def fold(words):
        total = 0
        for w in words:
            total += yield w
        return [((0, 1, ()), total)]

    counts = counting.Counts(count)
    out = counting.fold_all([fold(["a", "bb", "a"]), fold(["bb", "a"]), fold([])], counts)
    assert out == [[((0, 1, ()), 4)], [((0, 1, ()), 3)], [((0, 1, ()), 0)]] and asked == [["a", "bb"]] and counts.calls == 1
    with pytest.raises(ValueError, match="counts for"):
        counting.Counts(lambda texts: [1]).of(["x", "y"])


def vectors(n, seed):
    r = random.Random(seed)
    return [(U(i), i, [(t, r.choice([0.25, 0.5, 1.0, 2.0, 8.0])) for t in sorted(r.sample(range(40), r.randrange(1, 12)))]) for i in range(n)]


def test_posting_search_equals_the_whole_dot_product(spark):
    rows = vectors(400, 1)
    stored = spark.createDataFrame([("t" if i % 3 else "s", f"p{i}", 1, v) for _, i, v in rows], f"tenant_id string, point_id string, seq bigint, sparse {postings.SPARSE}")
    lists = postings.postings_of(stored).persist()
    old = lists.where("point_id < 'p2'").withColumns({"seq": F.lit(0).cast("bigint"), "weight": F.lit(100.0)})  # an older version of some points
    asked = [(q, "t" if q % 2 else "s", t, w) for q, v in enumerate(x[2] for x in vectors(20, 2)) for t, w in v] + [(99, "t", 1_000, 1.0)]
    questions = spark.createDataFrame(asked, "query_id int, tenant_id string, term bigint, weight double")
    live = stored.select("point_id", "seq", "tenant_id")
    eligible = lambda found: found.join(live.where("point_id <> 'p7'").select("point_id", "seq"), ["point_id", "seq"], "left_semi").select(*found.columns)
    every = lists.unionByName(old)
    got = postings.top_points(questions, every, postings.bounds_of(every), 5, eligible).collect()
    want = set()
    for q in {a[0] for a in asked}:
        own = {t: w for x, _, t, w in asked if x == q}
        tenant = next(a[1] for a in asked if a[0] == q)
        scores = [(-round(sum(w * own.get(t, 0) for t, w in v), 6), f"p{i}") for _, i, v in rows if ("t" if i % 3 else "s") == tenant and i != 7]
        want |= {(q, p, -s, n + 1) for n, (s, p) in enumerate(sorted(x for x in scores if x[0] < 0)[:5])}
    assert {(r.query_id, r.point_id, r.sparse_score, r.sparse_rank) for r in got} == want
    share = postings.visited(questions, lists, postings.bounds_of(lists), 5).agg(F.sum("visited").alias("v"), F.sum("entries").alias("n")).first()
    assert 0 < share.v < share.n


def test_odd_sparse_vectors_are_refused(spark):
    shape = f"sparse {postings.SPARSE}"
    assert spark.createDataFrame([([(1, 0.5), (2, 1.0)],)], shape).select(postings.checked(F.col("sparse"))).count() == 1
    for bad, said in (([], "empty"), ([(2, 1.0), (1, 1.0)], "order"), ([(1, 1.0), (1, 1.0)], "order"), ([(1, 0.0)], "values"), ([(1, math.nan)], "values"), ([(1, -1.0)], "negative"), (None, "missing")):
        with pytest.raises(Exception, match=f"sparse vector: {said}"):
            spark.createDataFrame([(bad,)], shape).select(postings.checked(F.col("sparse"))).collect()


def test_a_model_gives_both_vectors_or_none(spark):
    rows = spark.createDataFrame([("a b",), ("c",)], "text string")
    tries = []

    def load():
        def model(texts):
            tries.append(1)
            if len(tries) == 1:
                raise OSError("busy")
            return [([1.0, 0.0], {5: 2.0, 3: 1.0}) for _ in texts]

        return model

    got = embedding.embed_both(rows.coalesce(1), load, 2, delay=0.01, in_flight=1).collect()
    assert all(r.dense == [1.0, 0.0] and [tuple(s) for s in r.sparse] == [(3, 1.0), (5, 2.0)] for r in got)
    for answer, said in ((([1.0], {1: 1.0}), "width"), (([0.0, 0.0], {1: 1.0}), "zero"), (([1.0, 0.0], {}), "empty")):
        with pytest.raises(Exception, match=said):
            embedding.embed_both(rows, lambda answer=answer: lambda texts: [answer for _ in texts], 2).collect()
    own = embedding.both_by_hash(rows).orderBy("text").collect()
    assert [len(r.sparse) for r in own] == [2, 1] and all(s.weight == 1.0 for r in own for s in r.sparse)


NOTE = "uid string, vault string, path string, area string, sub string, type string, status string, visibility string, tags array<string>, title string, lang string, created string, updated string, body string"


def note(n, body, area="a", status="stable", visibility="internal", tags=("x",)):
    return (U(n), "v", f"{area}/{n}.md", area, "", "concept", status, visibility, list(tags), f"T{n}", "en", "2026-01-01", "2026-01-01", body)


class Runs:
    """Runs over an index, with what each chunked and embedded."""

    def __init__(self, spark, root):
        self.spark, self.own, self.embedded = spark, index.Index(spark, root, buckets=4), []

    def expected_of(self, tenant):
        def run(changed):
            chunks = chunking.chunk_notes(changed, chunking.ChunkConfig(5, 20))
            failed = chunking.failed_notes(chunks, ["uid"]).withColumn("tenant_id", F.lit(tenant))
            rows = chunks.withColumns({"tenant_id": F.lit(tenant), "headings": F.col("breadcrumb"), "embedding_model": F.lit("m")})
            return points.expected_points(rows, {"p": "1"}, {"e": "1"}).select(*index.PAYLOAD, "point_id"), failed

        return run

    def run(self, tenant, notes, prune=False, verify=False, dry=False):
        table = self.spark.createDataFrame(notes, NOTE)
        run = self.own.compare(table, tenant, {"p": "1"}, self.expected_of(tenant), verify=verify)
        states = {r.state: r["count"] for r in run.results.groupBy("state").count().collect()}
        gone = self.own.orphans(run, tenant, table, ["v"]) if prune else None

        def embed(rows):
            self.embedded.append(rows.select("uid").distinct().count())
            return embedding.both_by_hash(rows, 8)

        return states, None if dry else self.own.write(run, tenant, embed, gone)

    def stored(self, tenant=""):
        return sorted((r.tenant_id, int(r.uid[-12:], 16), r.chunk_index, r.text) for r in self.own.points(self.own.current(), tenant).collect())


def test_runs_write_what_changed_and_nothing_else(spark, tmp_path):
    runs = Runs(spark, str(tmp_path / "t"))
    notes = [note(n, f"# H\n\nwords of note {n}\n\n## S\n" + "more " * (n % 4 * 8)) for n in range(20)]
    states, first = runs.run("t", notes)
    assert states == {"pruned": 20} and runs.embedded == [20] and first.number == 1
    states, none = runs.run("t", notes)
    assert states == {"skipped": 20} and none is None and runs.embedded == [20] and runs.own.current().number == 1
    other = [note(n, f"of another tenant {n}") for n in range(3)]
    runs.run("t/2 x", other)
    before = runs.stored("t")
    changed = [notes[0], note(1, "entirely new"), *notes[2:18], note(30, "added")]
    states, second = runs.run("t", changed)
    assert states == {"pruned": 2, "skipped": 17} and runs.embedded[-1] == 2
    kept = set(runs.own.table.at(2).parts("points", tenant_id=["t"])) & set(second.parts("points", tenant_id=["t"]))
    assert kept  # buckets without a changed note are the same files
    assert [r for r in runs.stored("t") if r[1] not in (1, 30)] == [r for r in before if r[1] != 1]
    assert [r[3] for r in runs.stored("t") if r[1] == 1] == ["entirely new"]
    states, third = runs.run("t", changed, prune=True)  # notes 18 and 19 are gone
    assert states == {"skipped": 19} and {r[1] for r in runs.stored("t")} == {*range(18), 30} and runs.embedded[-1] == 0
    assert {r[1] for r in runs.stored("t/2 x")} == {0, 1, 2}
    # A note that lost its text loses its points, one that fails keeps them.
    states, _ = runs.run("t", [note(0, " "), note(1, "word " * 9000), *changed[2:]])
    assert states == {"pruned": 1, "failed": 1, "skipped": 17}
    assert [r[3] for r in runs.stored("t") if r[1] in (0, 1)] == ["entirely new"]
    # Verifying compares the points themselves.
    assert runs.run("t", changed[1:], verify=True)[0] == {"skipped": 18}
    # Old states stay readable until they expire.
    assert runs.own.points(runs.own.table.at(1)).count() == len(before)
    runs.own.table.expire(keep=2)
    assert {r[1] for r in runs.stored("t/2 x")} == {0, 1, 2} and len(runs.own.table.numbers()) == 2


def test_digests_meet_without_a_shuffle_of_the_stored_side(spark, tmp_path):
    runs = Runs(spark, str(tmp_path / "t"))
    runs.run("t", [note(n, f"text {n}") for n in range(30)])
    stored = runs.own.digests(runs.own.current(), "t")
    fresh = spark.createDataFrame([(U(n), "x") for n in range(40)], "uid string, source string").withColumnRenamed("source", "own")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = fresh.join(stored, "uid", "left")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange") == 1 and "SelectedBucketsCount: 4 out of 4" in plan and "text" not in plan.split("FileScan")[1]
    assert fresh.join(stored, "uid").count() == 30


def test_postings_are_written_anew_after_some_runs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "MOST_RUNS", 2)
    runs = Runs(spark, str(tmp_path / "t"))
    for i in range(4):
        runs.run("t", [note(1, f"round {i} alpha"), note(2, "beta alpha")])
        state = runs.own.current()
        lists, bounds = runs.own.lists(state, ["t"])
        vector, weights = embedding.hash_question(spark, "alpha round", 8)
        terms = list(weights)
        rows = runs.own.ask(retrieval.Query("interno", "t", "alpha round"), vector, weights, state).collect()
        assert [r.text for r in sorted(rows, key=lambda r: r.position)][0].startswith(f"round {i}") and len(rows) == 2
        assert lists.select("run").distinct().count() <= 2 and bounds.count() > 0
    few, _ = runs.own.lists(state, ["t"], terms)
    assert {r.term for r in few.collect()} <= set(terms) and few.count() >= 2


def test_many_questions_each_with_its_own_filter(spark, tmp_path, monkeypatch):
    runs = Runs(spark, str(tmp_path / "t"))
    r = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "rho"]
    tables = {}
    for tenant in ("t", "s"):
        tables[tenant] = [note(n + (100 if tenant == "s" else 0), " ".join(r.choice(words) for _ in range(6)), area=r.choice("ab"), status=r.choice(["stable", "archived", None]), visibility=r.choice(["internal", "private", None]), tags=r.sample(["x", "y", "z"], 2)) for n in range(40)]
        runs.run(tenant, tables[tenant])
    filters = [dict(), dict(area="a"), dict(tags=["x", "y"]), dict(include_archived=True), dict(include_private=True, include_archived=True), dict(area="b", tags=["z"]), dict(uid=U(3)), dict(type="none"), dict(vault="v", tags=[])]
    shape = "query_id int, tenant_id string, text string, area string, type string, vault string, uid string, tags array<string>, include_archived boolean, include_private boolean"
    asked = [(i, ("t", "s")[i % 2], " ".join(r.sample(words, 2)), f.get("area"), f.get("type"), f.get("vault"), f.get("uid"), f.get("tags"), f.get("include_archived"), f.get("include_private")) for i, f in enumerate(filters * 2)]
    questions = embedding.both_by_hash(spark.createDataFrame(asked, shape), 8).withColumnRenamed("dense", "query_vector").drop("text")
    got = runs.own.search(questions, ["t", "s"], top_k=5).collect()
    assert got
    owners = {n[0]: (tenant, n) for tenant, rows in tables.items() for n in rows}
    for row in got:
        q = asked[row.query_id]
        tenant, n = owners[row.uid]
        assert tenant == q[1] and (q[3] is None or n[3] == q[3]) and (q[6] is None or n[0] == q[6]) and q[4] is None
        assert set(q[7] or []) <= set(n[8]) and (q[8] or n[6] != "archived") and (q[9] or n[7] != "private")
    # Each question alone, with the filter as literals, gives the same.
    assert embedding.hash_question(spark, "rho rho Alpha", 8)[1] == {s.id: s.weight for s in embedding.both_by_hash(spark.createDataFrame([("rho rho Alpha",)], "text string"), 8).first().sparse}
    for i in (0, 1, 2, 5, 12, 1):
        monkeypatch.setattr(index, "ONE_JOB", 10**6 if i != 12 else 0)
        q = asked[i]
        query = retrieval.Query("interno", q[1], q[2], area=q[3] or "", type=q[4] or "", vault=q[5] or "", uid=q[6] or "", tags=tuple(q[7] or ()), include_archived=bool(q[8]), include_private=bool(q[9]))
        alone = runs.own.ask(query, *embedding.hash_question(spark, q[2], 8)).collect()
        key = lambda x: (x.position, x.point_id, x.score)
        assert sorted(map(key, alone)) == sorted(key(x) for x in got if x.query_id == i)


FAILS_ONCE = """
import os, sys
from collections.abc import Iterator
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from noteloom.operators import measuring

folder = sys.argv[1]
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
texts = spark.range(0, 100, 1, 4).select(F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))

@F.pandas_udf("int")
def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for column in batches:
        yield column.str.split().str.len().astype("int32")
    try:
        os.mkdir(folder + "/failed")
    except FileExistsError:
        return
    raise OSError("lost after its rows were counted")

rows, seen = measuring.with_token_counts(texts, count)
rows.write.parquet(folder + "/out")
got = seen()
print("COUNTS", got["calls"], got["bytes"], got["tokens"], os.path.isdir(folder + "/failed"))
spark.stop()
"""


def test_counts_are_exact_when_a_task_fails_once(tmp_path):
    import subprocess
    import sys

    script = tmp_path / "run.py"
    script.write_text(FAILS_ONCE)
    done = subprocess.run([sys.executable, str(script), str(tmp_path)], capture_output=True, text=True, env=os.environ | {"PYTHONPATH": os.getcwd()}, timeout=300, check=False)
    assert f"COUNTS 100 {sum(len(f'word {i}') for i in range(100))} 200 True" in done.stdout, done.stderr[-2000:]


def test_posting_lists_and_question_terms_are_made_once(spark):
    plan = search_queries.posting_ranks(spark, SF, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan  # no text is cut into words again
