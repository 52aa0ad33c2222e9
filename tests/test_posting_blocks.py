"""Posting lists of blocks against the plain dot product, over odd rows, blocks of any size and every way to score them."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from noteloom.operators import posting_blocks, postings, retrieval
from noteloom.plans import search_queries
from tests.conftest import SF
from tests.test_oracles import plain


@pytest.fixture
def small(monkeypatch):
    for name, n in (("POINTS", 7), ("QUESTIONS", 3), ("ENTRIES", 30), ("HEAD", 9)):
        monkeypatch.setattr(posting_blocks, name, n)


def points(n):
    """Few long and many short vectors, copies, and rows that take no part."""
    r = random.Random(3)
    rows = [(("t", "s")[i % 3 == 0], f"p{i:03d}", [(k, r.choice([0.25, 1.0, 2.0]) * (1 + 400 // (i + 1))) for k in sorted(r.sample(range(30), r.randrange(1, 12)))]) for i in range(n)]
    rows += [(t, f"copy{i}", v) for i, (t, _, v) in enumerate(rows[::5])]
    return [*rows, (None, "p1", [(1, 50.0)]), ("t", "none", None), ("t", "empty", []), ("u", "alone", [(5, 1.0)])]


def stored(spark, rows):
    return spark.createDataFrame(rows, f"tenant_id string, point_id string, sparse {postings.SPARSE}").withColumn("norm", posting_blocks.norm(F.col("sparse"))).repartition(3)


def wanted(asked, rows, limit):
    out = set()
    for tenant, q, own in asked:
        own = dict(own or [])
        scored = [(-round(sum(w * own.get(k, 0) for k, w in v), 6), p) for t, p, v in rows if v and t is not None and t == tenant]
        out |= {(q, p, -s, i) for i, (s, p) in enumerate(sorted(x for x in scored if x[0] < 0)[:limit], 1)}
    return out


@pytest.mark.parametrize("limit", [1, 4, 200])
def test_the_leg_equals_the_whole_dot_product(spark, small, limit):
    rows = points(150)
    asked = [*rows[::7], ("t", "rare", [(29, 0.001)]), ("t", "unknown", [(1000, 3.0)]), ("v", "nowhere", [(1, 1.0)]), *rows[-4:]]
    leg = retrieval.posting_leg(stored(spark, asked).withColumnRenamed("point_id", "query_id"), stored(spark, rows), limit, search_queries.kept)
    assert {(r.query_id, r.point_id, r.sparse_score, r.sparse_rank) for r in leg.collect()} == wanted(asked, rows, limit)


def block_of(spark, rows, floor=0.0, most=1000):
    made = posting_blocks.packed(stored(spark, rows).coalesce(1).sortWithinPartitions(F.desc("norm")).withColumn("floor", F.lit(floor)), "point_id", most)
    (batch,) = made.toArrow().combine_chunks().to_batches()
    return posting_blocks.Block(batch, 0)


@pytest.mark.parametrize("frequent", [0, 0.02, 2])
@pytest.mark.parametrize("most", [1, 3, 4096])
def test_scores_do_not_depend_on_how_terms_meet(spark, monkeypatch, frequent, most):
    monkeypatch.setattr(posting_blocks, "FREQUENT", frequent)
    monkeypatch.setattr(posting_blocks, "MOST_FREQUENT", most)
    monkeypatch.setattr(posting_blocks, "MOST_PAIRS", 5)
    rows = [("t", p, v) for _, p, v in points(40)[:40]]
    q, p = block_of(spark, rows[::4]), block_of(spark, rows)
    asked, found = posting_blocks.scores(q, p)
    vectors = {name: dict(v) for _, name, v in rows}
    got = {(q.ids[int(a)].as_py(), p.ids[j].as_py()): found[i, j] for i, a in enumerate(asked) for j in range(found.shape[1])}
    want = {(a, b): sum(w * vectors[b].get(k, 0) for k, w in vectors[a].items()) or -np.inf for a, b in got}
    assert len(got) == 10 * 40 and got == pytest.approx(want)


def test_points_that_cannot_reach_the_floor_are_not_scored(spark):
    rows = [("t", f"p{i:02d}", [(1, 100.0 / (i + 1)), (2, 1.0)]) for i in range(50)]
    asked = [("t", "q", [(1, 1.0)])]
    found = posting_blocks.scores(block_of(spark, asked, 10.0), block_of(spark, rows))[1]
    assert 10 <= np.isfinite(found).sum() < 15
    assert posting_blocks.scores(block_of(spark, asked, 10.0), block_of(spark, rows[20:]))[1].size == 0
    # Long enough, but the block's largest weight of the shared term is not.
    assert posting_blocks.scores(block_of(spark, asked, 10.0), block_of(spark, [("t", "x", [(1, 2.0), (3, 500.0)])]))[1].size == 0


def test_of_equal_scores_the_first_ids_are_enough():
    found = np.array([[3.0, 5.0, 5.0, 5.0, 5.0, -np.inf, 3.0]])
    x, y = posting_blocks.best_of(found, np.zeros(1), 2, np.array([0, 4, 3, 2, 1, 5, 6]))
    assert list(x) == [0, 0] and sorted(y) == [3, 4]
    x, y = posting_blocks.best_of(found, np.zeros(1), 6, np.arange(7))
    assert sorted(y) == [0, 1, 2, 3, 4, 6]
    assert posting_blocks.best_of(np.zeros((0, 0)), np.zeros(0), 6, np.arange(7))[0].size == 0


def test_pairs_are_neither_grouped_nor_joined_by_terms(spark):
    """posting_topk summed in a row for each pair of a question and a point, which grow with the square of the points."""
    plan = search_queries.posting_topk(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Aggregate" not in plan and "term" not in plan.replace("terms", "")


def test_odd_tables_equal_the_sql(spark, tmp_path):
    """Numbers that occur twice, missing labels and texts, words that tie."""
    texts = [(i, " ".join(f"w{(i * k) % 13}" for k in range(1, 2 + i % 17 * (1 + (i % 50 == 0))))) for i in range(160)]
    texts += [(7, "W3, w5"), (50, "w1 w1"), (100, "Ünïcode w2"), (170, None), (171, ""), (172, " ,; "), (None, "w1")]
    with duckdb.connect() as con:
        con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
        con.executemany("INSERT INTO documents VALUES (?, ?)", texts)
        con.execute("CREATE TABLE embeddings AS SELECT vec_id, [1.0::FLOAT, 2.0] AS embedding, CAST(CASE WHEN vec_id % 11 = 3 THEN NULL ELSE vec_id % 2 END AS INTEGER) AS label FROM (SELECT unnest(range(0, 180)) AS vec_id UNION ALL SELECT unnest([50, 51, NULL]))")
        for name in ("documents", "embeddings"):
            con.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        cursor = con.execute(search_queries.ORACLES["posting_topk"])
        found = [d[0] for d in cursor.description]
        want = sorted(tuple(map(plain, r)) for r in cursor.fetchall())
    assert len(want) > 100
    assert sorted(tuple(plain(r[c]) for c in found) for r in search_queries.posting_topk(spark, str(tmp_path)).collect()) == want
