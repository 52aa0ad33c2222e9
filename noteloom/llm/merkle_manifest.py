"""Merkle dataset manifest: Pregel-style supersteps over an RDD of tree nodes.

Leaves are hashed by SQL functions and numbered along one sort (lang, doc_id, leaf). A vertex of the computation is a
block of 2 ** LEVELS consecutive nodes of one group, so that a superstep climbs LEVELS levels: nodes send their digests to
their block, a block that has all of its nodes hashes them level by level and forwards its digest as a node of the next
superstep. A group that is down to one node is complete; the complete groups are the leaves of the tree above them. The
reverse supersteps go down: a block that knows the path above it (subroot and the siblings from there to the root) sends
each of its nodes that path with the node's own siblings in front, until the leaves have theirs and fold them.

A task streams its blocks in sorted order and holds one block and one path, both bounded. The nodes of each superstep are
a table in the shared folder, so a lost executor costs one superstep. Only counts come to the driver.

Nulls: a null field is hashed as `-`; a null lang is a group of its own, before all others; null ids come first in their
group and are never tampered with. Ties (rows of one id) are ordered by their leaf; equal rows are leaves of their own. A
lone leaf is its own subroot, a lone subroot is the root, whose proof is the hash of nothing. Empty tables give no rows;
further columns are not read. Texts are hashed whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256
from itertools import groupby

from pyspark import RDD
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteloom.llm.common import materialize, stage_path

#: Levels that a superstep climbs; blocks that a task takes where the session has partitions enough, and nodes that it takes
#: at most: its Python worker sorts them in memory.
LEVELS, TASK_BLOCKS, TASK_NODES = 12, 4, 131_072
#: A document is tampered with where this divides the checksum of its id.
TAMPERED = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODES = "grp binary, i long, n long, digest string"

Path = list[tuple[int, str]]  # from a node upwards: whether it is the right one of its pair, and its sibling or ""


def _hex(data: str) -> str:
    return sha256(data.encode()).hexdigest()


def framed(values: list[Column]) -> Column:
    """Digest of values, each with its length in front, or `-` for null."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def group_key(group: Column) -> Column:
    """Bytes that sort as the group does, null first."""
    return F.when(group.isNull(), F.lit(b"")).otherwise(F.concat(F.lit(b"\x01"), group.cast("binary")))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with i, the place of each in its group `grp` by `order`, and n, the size of the group."""
    placed = rows.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order)
    placed = materialize(placed.withColumns({"row": F.monotonically_increasing_id(), "part": F.spark_partition_id()}), "numbered")
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("grp", "part").agg(F.count("*").alias("m"), F.min("row").alias("first"))
    starts = parts.select("grp", "part", (F.coalesce(F.sum("m").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("m").over(Window.partitionBy("grp")).alias("n"))
    return placed.join(starts, ["grp", "part"]).withColumn("i", F.col("row") + F.col("shift")).drop("row", "part", "shift")


def depth(n: int) -> int:
    """Levels above the leaves of a tree of n."""
    return (n - 1).bit_length()


def climb(digests: list[str], levels: int) -> list[list[str]]:
    """The nodes of a block, level by level."""
    out = [digests]
    for _ in range(levels):
        now = out[-1]
        out.append([_hex("".join(now[j : j + 2])) for j in range(0, len(now), 2)])
    return out


def own_path(levels: list[list[str]], j: int) -> Path:
    """Sides and siblings of node j of a block, up to the block's own digest."""
    out = []
    for row in levels[:-1]:
        out.append((j & 1, row[j ^ 1] if j ^ 1 < len(row) else ""))
        j >>= 1
    return out


def fold(digest: str, path: Path) -> str:
    for right, sibling in path:
        digest = _hex(sibling + digest if right else digest + sibling)
    return digest


def _dealt(pairs: RDD, tasks: int) -> RDD:
    """((group, block, place), value) sorted within tasks, the rows of a block together."""
    return pairs.repartitionAndSortWithinPartitions(tasks, lambda k: zlib.crc32(k[1].to_bytes(8, "big"), zlib.crc32(k[0])))


def _blocks(rows: Iterator[tuple]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    return groupby(rows, key=lambda r: r[0][:2])


class Forest:
    """The trees of all groups. nodes: grp, i, n, digest; i from 0 to n - 1 in each group."""

    def __init__(self, nodes: DataFrame, levels: int = LEVELS, task_nodes: int = TASK_NODES):
        self.spark, self.levels = nodes.sparkSession, levels
        self.steps: list[DataFrame] = []  # nodes that each superstep starts from
        count, largest = nodes.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
        # Each task writes a file, for which Hadoop starts processes: a block alone is too little for one.
        most = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.tasks = max(1, min(most, count // (TASK_BLOCKS << levels)), -(-count // task_nodes))
        supersteps = max(1, -(-depth(largest) // levels)) if count else 0
        complete = []
        for step in range(supersteps):
            self.steps.append(nodes)
            done = self._up(nodes, step)
            complete.append(done.where("done").select("grp", "n", "digest"))
            nodes = done.where(~F.col("done")).select("grp", "i", "n", "digest")
        self.roots = None
        for part in complete:
            self.roots = part if self.roots is None else self.roots.unionByName(part)

    def _up(self, nodes: DataFrame, step: int) -> DataFrame:
        levels, below = self.levels, step * self.levels

        def run(rows: Iterator[tuple]) -> Iterator[tuple]:
            for (group, block), members in _blocks(rows):
                digests, n = [], 0
                for _, (digest, size) in members:
                    digests.append(digest)
                    n = size
                top = depth(n)
                yield bytearray(group), block, n, climb(digests, min(levels, top - below))[-1][0], top <= below + levels

        pairs = nodes.select("grp", "i", "n", "digest").rdd.map(lambda r: ((bytes(r[0]), r[1] >> levels, r[1]), (r[3], r[2])))
        table = self.spark.createDataFrame(_dealt(pairs, self._tasks(step)).mapPartitions(run), NODES + ", done boolean", verifySchema=False)
        return materialize(table, "merkle-nodes")

    def _tasks(self, step: int) -> int:
        return max(1, self.tasks >> step * self.levels)

    def down(self, paths: DataFrame, extra: list[str], finish, schema: str) -> DataFrame:
        """paths: grp, subroot, path (sides and siblings above a complete group). `finish(row, subroot, path)` makes a row
        of the result from a row (i, digest, *extra) of the first nodes."""
        levels = self.levels
        # Row (group, block, -1) of a superstep is the path above the block.
        ready = paths.join(self.roots.select("grp", "n"), "grp").select("grp", "n", "subroot", "path").rdd.map(lambda r: (bytes(r[0]), r[1], r[2], [tuple(x) for x in r[3]]))
        told = None
        for step in reversed(range(len(self.steps))):
            below, last = step * levels, step == 0
            start = ready.filter(lambda r, step=step: max(1, -(-depth(r[1]) // levels)) == step + 1).map(lambda r: ((r[0], 0, -1), (r[2], r[3])))
            told = start if told is None else told.union(start)
            members = self.steps[step].select("grp", "i", "n", "digest", *(extra if last else [])).rdd.map(lambda r: ((bytes(r[0]), r[1] >> levels, r[1]), tuple(r)[1:]))

            def run(rows: Iterator[tuple], below=below, last=last) -> Iterator[tuple]:
                for (group, _), inside in _blocks(rows):
                    _, (subroot, above) = next(inside)
                    held = [row for _, row in inside]
                    tree = climb([row[2] for row in held], min(levels, depth(held[0][1]) - below))
                    for j, row in enumerate(held):
                        path = own_path(tree, j) + above
                        yield finish((row[0], row[2], *row[3:]), subroot, path) if last else ((group, row[0], -1), (subroot, path))

            told = _dealt(members.union(told), self._tasks(step)).mapPartitions(run)
            if not last:
                stored = told.map(lambda r: (bytearray(r[0][0]), r[0][1], r[1][0], r[1][1]))
                table = self.spark.createDataFrame(stored, "grp binary, block long, subroot string, path array<struct<side:int,sibling:string>>", verifySchema=False)
                told = materialize(table, "merkle-paths").rdd.map(lambda r: ((bytes(r[0]), r[1], -1), (r[2], [tuple(x) for x in r[3]])))
        return self.spark.createDataFrame(told, schema, verifySchema=False)


MANIFEST = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def leaves_of(documents: DataFrame) -> DataFrame:
    """grp, doc_id, digest, and the digest of the tampered row where there is one."""
    fields = [F.col(c) for c in FIELDS]
    longer = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)")
    changed = [longer if c == "n_chars" else F.col(c) for c in FIELDS]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    return documents.select(group_key(F.col("lang")).alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), framed(fields).alias("digest"), F.when(hit, framed(changed)).alias("tampered"))


def build_manifest(documents: DataFrame, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    spark = documents.sparkSession
    leaves = materialize(leaves_of(documents), "leaves")
    forest = Forest(materialize(numbered(leaves, ["doc_id", "digest"]), "merkle-leaves"), levels)
    if forest.roots is None:
        return spark.createDataFrame([], MANIFEST)
    # The subroots are the leaves of one more tree, whose only group is all of them.
    subroots = numbered(forest.roots.select(F.lit(b"").alias("grp"), F.col("grp").alias("lang"), "digest"), ["lang"])
    above = Forest(materialize(subroots, "merkle-subroots"), levels)
    root = above.roots.first()["digest"]
    top = above.roots.select("grp", F.col("digest").alias("subroot"), F.array().cast("array<struct<side:int,sibling:string>>").alias("path"))
    paths = above.down(top, ["lang"], lambda row, _, path: (row[2], row[1], path), "grp binary, subroot string, path array<struct<side:int,sibling:string>>")

    def finish(row: tuple, subroot: str, path: Path) -> tuple:
        _, leaf, doc_id, tampered = row
        folded = fold(tampered or leaf, path)
        return doc_id, leaf, subroot, root, _hex("".join(s for _, s in path)), folded, folded == root

    return forest.down(materialize(paths, "merkle-paths"), ["doc_id", "tampered"], finish, MANIFEST)


def write_manifest(documents: DataFrame, path: str | None = None, levels: int = LEVELS) -> str:
    """Write the manifest and return its folder."""
    path = path or stage_path(documents.sparkSession, "manifest")
    build_manifest(documents, levels).write.option("compression", "zstd").parquet(path)
    return path


def oracle() -> str:
    frame = lambda x: f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen(CAST({x} AS VARCHAR)) || ':' || {x} END"
    leaf = lambda n: f"sha256({' || '.join(frame(n if c == 'n_chars' else c) for c in FIELDS)})"
    crc = "list_reduce(list_concat([4294967295::BIGINT], list_transform(range(strlen(CAST(doc_id AS VARCHAR))), lambda i: CAST(ord(substr(CAST(doc_id AS VARCHAR), i + 1, 1)) AS BIGINT))), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))"
    return f"""
WITH RECURSIVE crcs AS (SELECT i AS b, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i)),
steps AS (SELECT list(CAST(c AS BIGINT) ORDER BY b) AS t FROM crcs),
leaves AS (SELECT doc_id, lang, {leaf('n_chars')} AS leaf, CASE WHEN xor({crc}, 4294967295) % {TAMPERED} = 0 THEN {leaf('(n_chars + 1)')} END AS tampered,
  row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents, steps),
nodes AS (SELECT lang, 0 AS level, i, n, leaf AS d FROM leaves
  UNION ALL SELECT lang, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY lang, level, i // 2, n),
subroots AS (SELECT lang, d AS subroot, level AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (SELECT 0 AS level, i, n, subroot AS d FROM subroots
  UNION ALL SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY level, i // 2, n),
walks AS (SELECT l.doc_id, l.lang, l.leaf, l.tampered, s.subroot, s.height, s.i AS place, l.i, 0 AS level, coalesce(l.tampered, l.leaf) AS folded, '' AS proof FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang
  UNION ALL SELECT w.doc_id, w.lang, w.leaf, w.tampered, w.subroot, w.height, w.place, w.i // 2, w.level + 1,
    sha256(CASE WHEN w.i % 2 = 1 THEN coalesce(s.d, '') || w.folded ELSE w.folded || coalesce(s.d, '') END), w.proof || coalesce(s.d, '')
  FROM walks w LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM w.lang AND s.level = w.level AND s.i = xor(w.i, 1) WHERE w.level < w.height),
climbs AS (SELECT doc_id, lang, leaf, subroot, folded, proof, place AS i, 0 AS level FROM walks WHERE level = height
  UNION ALL SELECT w.doc_id, w.lang, w.leaf, w.subroot, sha256(CASE WHEN w.i % 2 = 1 THEN coalesce(s.d, '') || w.folded ELSE w.folded || coalesce(s.d, '') END), w.proof || coalesce(s.d, ''), w.i // 2, w.level + 1
  FROM climbs w LEFT JOIN tops s ON s.level = w.level AND s.i = xor(w.i, 1) WHERE w.level < (SELECT max(level) FROM tops))
SELECT doc_id, leaf, subroot, r.d AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = r.d AS verified
FROM climbs, (SELECT d FROM tops WHERE n = 1) r WHERE level = (SELECT max(level) FROM tops)"""
