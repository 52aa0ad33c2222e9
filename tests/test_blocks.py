"""Legs of packed blocks against the plain formula, over odd rows and blocks of any size."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from noteloom.operators import blocks, retrieval


@pytest.fixture
def small(monkeypatch):
    for kind in (blocks.Dense, blocks.Sparse):
        monkeypatch.setattr(kind, "points", 7)
        monkeypatch.setattr(kind, "queries", 3)


def vectors(n, width=6):
    rng = np.random.default_rng(5)
    rows = [(i, i % 3, [float(x) for x in rng.integers(-3, 4, width)]) for i in range(n)]
    rows = [(i, label, v if any(v) else [1.0] * width) for i, label, v in rows]
    # Copies tie; other vectors have no cosine, or NaN.
    rows += [(n + i, i % 3, rows[i][2]) for i in range(9)] + [(n + 20, 0, None), (n + 21, 0, [1.0] * 5 + [None]), (n + 22, 1, [1.0] * 5), (n + 23, 2, [math.nan] * width), (n + 24, None, [1.0] * width)]
    return rows


@pytest.mark.parametrize("limit", [1, 4, 100])
def test_dense_leg_equals_the_plain_product(spark, small, limit):
    rows = spark.createDataFrame(vectors(60), "point_id long, label int, dense array<double>").repartition(3)
    asked = rows.where("point_id % 10 = 0").select(F.col("point_id").alias("query_id"), "label", F.col("dense").alias("query_vector"))
    got = {}
    for r in retrieval.dense_leg(asked, rows, limit, on=["label"]).collect():
        got[r.query_id, r.dense_rank] = (r.point_id, r.dense_score)
    own = [r for r in vectors(60) if r[1] is not None]
    want = {}
    for q, label, a in own:
        if q % 10:
            continue
        scored = []
        for p, other, b in own:
            if other == label:
                fine = a is not None and b is not None and None not in a and None not in b and len(a) == len(b)
                scored.append((p, round(float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))), 6) if fine else None))
        scored.sort(key=lambda x: ((2, 0) if x[1] is None else (0, 0) if math.isnan(x[1]) else (1, -x[1]), x[0]))
        want |= {(q, i): x for i, x in enumerate(scored[:limit], 1)}
    assert str(sorted(got.items())) == str(sorted(want.items()))


@pytest.mark.parametrize("limit", [1, 5, 100])
@pytest.mark.parametrize("frequent", [0, 3, 4096])
def test_sparse_leg_equals_the_plain_sums(spark, small, monkeypatch, limit, frequent):
    monkeypatch.setattr(blocks, "MOST_FREQUENT", frequent)
    monkeypatch.setattr(blocks, "MOST_PAIRS", 5)
    texts = [(i, f"t{i % 2}", " ".join(f"w{(i * k) % 11}" for k in range(1, i % 9 + 1))) for i in range(50)] + [(90, "t0", None), (91, "t0", "only here"), (100, "t1", "W1, w1; w2")]
    rows = spark.createDataFrame(texts, "point_id long, label string, text string").repartition(3)
    asked = retrieval.terms_of(rows.where("point_id % 10 = 0"), "point_id", "label").withColumnRenamed("point_id", "query_id")
    got = {(r.query_id, r.sparse_rank): (r.point_id, r.sparse_score) for r in retrieval.sparse_leg(asked, retrieval.terms_of(rows, "point_id", "label"), limit, on=["label"]).collect()}
    counts = {p: (label, [w.strip(",;") for w in (text or "").lower().split()]) for p, label, text in texts}
    want = {}
    for q, (label, own) in counts.items():
        if q % 10 == 0:
            scored = [(p, float(sum(other.count(w) for w in own))) for p, (tenant, other) in counts.items() if tenant == label and set(own) & set(other)]
            scored.sort(key=lambda x: (-x[1], x[0]))
            want |= {(q, i): x for i, x in enumerate(scored[:limit], 1)}
    assert got == want


def test_neither_terms_nor_pairs_are_grouped_or_shuffled(spark):
    """Pairs of a question and a point would be held by a task, and grow with the square of the points."""
    rows = retrieval.terms_of(spark.createDataFrame([(i, 0, f"w{i % 5}") for i in range(40)], "point_id long, label int, text string"), "point_id", "label")
    leg = retrieval.sparse_leg(rows.where("point_id % 10 = 0").withColumnRenamed("point_id", "query_id"), rows, 5, on=["label"])
    plan = leg._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Aggregate" not in plan
