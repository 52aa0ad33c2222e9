"""Connected components: contraction within tasks, then alternating large-star and small-star rounds.

Each task replaces the edges it has by links of every node to the smallest one it knows to be connected, which keeps all
components. What is left goes through star rounds to the fixpoint; up to ONE_TASK edges one more contraction ends it.
Empty edges give no rows; self-links and repeated edges change nothing; ids are unique, so there are no ties.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.llm.common import hot_limit, materialize

#: Edges of which a task can hold all (16 bytes each), and edges that it gathers before it contracts them.
ONE_TASK, GATHERED = 1_000_000, 1_000_000


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (larger, smaller) of every node but the smallest of its component to that one."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        new = label.copy()
        least = np.minimum(label[u], label[v])
        np.minimum.at(new, label[u], least)
        np.minimum.at(new, label[v], least)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(ids))
    return ids[moved], ids[label[moved]]


def _contract_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Everything a task has, a bounded number of edges at a time; links of the part before are edges of the next."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        return contract(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))

    for batch in batches:
        held.append((batch["a"].to_numpy(np.int64), batch["b"].to_numpy(np.int64)))
        size += len(batch)
        if size >= GATHERED:
            x, y = merged()
            # Few nodes for many edges: keep gathering. Else the links leave as they are.
            if len(x) > GATHERED // 2:
                yield pd.DataFrame({"a": x, "b": y})
                held, size = [], 0
            else:
                held, size = [(x, y)], len(x)
    if held:
        x, y = merged()
        yield pd.DataFrame({"a": x, "b": y})


def _star(edges: DataFrame, total: int, large: bool) -> DataFrame:
    """Link the neighbours of each node (the larger ones, or the smaller ones) to the smallest of them and itself.

    edges: (a, b) with a > b, `total` of them. The smallest neighbour comes from an aggregation and a join, never from a
    collected list; nodes with many neighbours, of which there are few, meet theirs by a broadcast.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges
    least = both.groupBy("a").agg(F.min("b").alias("least"), F.count("*").alias("n")).select("a", F.least("a", "least").alias("m"), "n")
    limit = hot_limit(2 * total)
    hubs = F.broadcast(least.where(F.col("n") > limit).select("a", F.col("m").alias("hub")))  # fewer than HOT_KEYS rows
    marked = both.join(hubs, "a", "left")
    rest = marked.where(F.col("hub").isNull()).select("a", "b").join(least.select("a", "m"), "a")
    joined = marked.where(F.col("hub").isNotNull()).select("a", "b", F.col("hub").alias("m")).unionByName(rest)
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def _counted(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, roots: bool = True) -> DataFrame:
    """edges: (src, dst). Returns (id, component) for every node of an edge; component is the smallest id reached. Without
    `roots`, nodes that are the smallest of their component are left out."""
    now = edges.where(F.col("src") != F.col("dst")).select(F.greatest("src", "dst").cast("long").alias("a"), F.least("src", "dst").cast("long").alias("b"))
    now = materialize(now.mapInPandas(_contract_all, "a long, b long"), "edges")
    found = _counted(now)
    while found[0] > ONE_TASK:
        now = materialize(_star(_star(now, found[0], True), found[0], False), "edges")
        # Both stars leave the edges alone once every node points at its smallest; a checksum tells.
        before, found = found, _counted(now)
        if found == before:
            break
    else:
        now = materialize(now.coalesce(1).mapInPandas(_contract_all, "a long, b long"), "edges")
    stars = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    if not roots:
        return stars
    return stars.unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
