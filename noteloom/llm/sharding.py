"""Sharding: minimax contiguous partition.

Documents with equal texts form an atomic group. Groups are ordered by their smallest doc_id, then by a hash of the text;
a binary search finds the smallest capacity for which a greedy scan fills at most `shards` shards, and cuts are then
spread as evenly as that capacity allows. Group sizes never reach the driver: it sees sums over key ranges and zooms
(each round splits a range in `fan`) only into the ranges where a cut may fall, until every cut falls on a single group.
Slots come from one range-partitioned sort and the counts of its partitions. Law: `bytes`.

Nulls: a null text is an empty one, a null doc_id sorts before all others. A repeated id with different texts counts in
the group of each. Repeated rows keep their own slots. Groups of any size: rows of the largest groups meet their shard by
a broadcast of at most HOT_KEYS groups. Empty tables give no rows; further columns are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from decimal import Decimal
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteloom.llm.common import join_hot_keys, materialize

OVERHEAD = 16
#: Value that orders a null doc_id before all others.
NULL_KEY = -(1 << 63) - 1
#: Bits of the text's hash behind the doc_id in a group's key.
HASH_BITS = 56
KEY = "decimal(38,0)"


@dataclass
class Segment:
    """A run of units in key order: a cell of the grid of `width`, from `low`."""

    low: int
    width: int
    total: int
    largest: int
    units: int


def _number(x: int) -> Column:
    return F.lit(Decimal(x)).cast(KEY)


class Ranges:
    """Sums over key ranges of units (distinct key, bytes), refined on demand. fan: a power of two."""

    def __init__(self, units: DataFrame, first: int = 4096, fan: int = 64):
        self.units, self.fan = units.select(F.col("key").cast(KEY).alias("key"), "bytes"), fan
        low, high = self.units.agg(F.min("key"), F.max("key")).first()
        self.segments: list[Segment] = []
        if low is not None:
            # Widths are powers of two, so that all cells of a width lie on one grid.
            self.origin, cell = int(low), 1 << (int(high - low) // first).bit_length()
            self.segments = self._cells([int(low)], 2 * first * cell, 2 * first)

    def _cells(self, lows: list[int], width: int, fan: int) -> list[Segment]:
        """Cells of the ranges of this width that begin at `lows`."""
        finer, key = max(1, width // fan), F.col("key")
        places = self.units.sparkSession.createDataFrame([(i, Decimal(x)) for i, x in enumerate(lows)], f"place int, low {KEY}")  # where a cut may fall
        low = (key - ((key - _number(self.origin)) % _number(width)).cast(KEY)).cast(KEY)
        cells = self.units.withColumn("low", low).join(F.broadcast(places), "low").withColumn("inside", (key - F.col("low")).cast(KEY))
        cells = cells.withColumn("width", _number(finer)).withColumn("cell", F.expr("inside div width"))
        rows = cells.groupBy("place", "cell").agg(F.sum("bytes"), F.max("bytes"), F.count("*")).collect()
        return [Segment(lows[r[0]] + r[1] * finer, finer, r[2], r[3], r[4]) for r in sorted(rows)]

    def refine(self, at: set[int]) -> bool:
        """Split the segments at these positions; False if none can be split."""
        at = {i for i in at if self.segments[i].units > 1 and self.segments[i].width > 1}
        if not at:
            return False
        out = [s for i, s in enumerate(self.segments) if i not in at]
        for width in {self.segments[i].width for i in at}:
            out += self._cells(sorted(self.segments[i].low for i in at if self.segments[i].width == width), width, self.fan)
        self.segments = sorted(out, key=lambda s: s.low)
        return True


def _greedy(segments: list[Segment], capacity: int, shards: int, hopeful: bool) -> bool:
    """Whether greedy filling needs at most `shards` shards. A segment of many units is divided anywhere (hopeful) or nowhere."""
    used, room = 1, capacity
    for s in segments:
        if s.total <= room:
            room -= s.total
        elif hopeful and s.units > 1:
            rest = s.total - room
            more = -(-rest // capacity)
            used, room = used + more, more * capacity - rest
        elif s.total > capacity:
            return False
        else:
            used, room = used + 1, capacity - s.total
        if used > shards:
            return False
    return True


def _smallest(segments: list[Segment], shards: int, low: int, hopeful: bool) -> int:
    high = sum(s.total for s in segments)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if _greedy(segments, mid, shards, hopeful) else (mid + 1, high)
    return low


def minimax(ranges: Ranges, shards: int) -> int:
    """The smallest capacity with which contiguous shards hold all units."""
    while True:
        segments = ranges.segments
        total = sum(s.total for s in segments)
        least = max(max(s.largest for s in segments), -(-total // shards))
        low, high = _smallest(segments, shards, least, True), _smallest(segments, shards, least, False)
        if low == high:
            return high
        ends = list(accumulate(s.total for s in segments))
        window: set[int] = set()
        below = above = 0
        for _ in range(shards):
            i = min(bisect_right(ends, below + low), len(ends) - 1)
            below = max(ends[i] - segments[i].total, below + low - segments[i].largest)
            above = min(above + high, ends[-1])
            window.update(range(min(bisect_right(ends, below), len(ends) - 1), min(bisect_right(ends, above), len(ends) - 1) + 1))
        if not ranges.refine(window):
            return high


def cut_keys(ranges: Ranges, shards: int, capacity: int) -> list[int]:
    """First keys of shards 1, 2, ...: each shard takes its even share of what is left, within the capacity."""
    while True:
        segments = ranges.segments
        for even in (True, False):  # filling up to the capacity always works; sharing evenly nearly always
            cuts, landing, held, left, at = [], set(), 0, sum(s.total for s in segments), shards
            aim = left / at if even else capacity
            for i, s in enumerate(segments):
                over = held + s.total - aim
                if held and at > 1 and (held + s.total > capacity or over > 0 and (s.units > 1 or over > s.total / 2)):
                    if s.units > 1:
                        landing.add(i)
                    cuts.append(s.low)
                    left, at, held = left - held, at - 1, 0
                    aim = left / at if even else capacity
                elif s.units > 1 and over > 0:
                    landing.add(i)
                held += s.total
                if held > capacity and not landing:
                    break
            else:
                if landing and ranges.refine(landing):
                    break
                return cuts
        else:
            raise ValueError("no cut within the capacity")


def shard_documents(documents: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce("text", F.lit(""))
    light = materialize(
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("sha"), F.monotonically_increasing_id().alias("place")),
        "sizes",
    )
    first = F.coalesce(F.min("doc_id").cast("decimal(20,0)"), F.lit(Decimal(NULL_KEY)).cast("decimal(20,0)"))
    first = F.when(F.count("*") > F.count("doc_id"), F.lit(Decimal(NULL_KEY)).cast("decimal(20,0)")).otherwise(first)
    key = (first * F.lit(Decimal(1 << HASH_BITS)) + F.xxhash64("sha").bitwiseAND((1 << HASH_BITS) - 1)).cast(KEY)
    groups = materialize(light.groupBy("sha").agg(key.alias("key"), F.sum("size").alias("bytes"), F.count("*").alias("copies")), "groups")
    ranges = Ranges(groups)
    cuts = cut_keys(ranges, shards, minimax(ranges, shards)) if ranges.segments else []
    shard = F.size(F.filter(F.array(*[_number(c) for c in cuts]), lambda c: c <= F.col("key"))) if cuts else F.lit(0)
    placed = join_hot_keys(light, groups.withColumn("shard", shard.cast("int")), ["sha"], "copies", ["shard"]).drop("sha")

    # Rows are numbered along one sort; a shard's rows in a partition start where those in earlier partitions end.
    order = ["shard", "doc_id", "text_crc32", "size", "place"]
    dealt = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = materialize(dealt.drop("place").withColumns({"row": F.monotonically_increasing_id(), "part": F.spark_partition_id()}), "placed")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("shard", "part").agg(F.count("*").alias("n"), F.min("row").alias("first"))  # at most partitions + shards rows
    starts = F.broadcast(parts.select("shard", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift")))
    return dealt.join(starts, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") + F.col("shift")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def crc_table() -> list[int]:
    """The 256 steps of CRC-32, from its polynomial."""
    out = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ 0xEDB88320 * (byte & 1)
        out.append(byte)
    return out


def oracle(shards: int = 40) -> str:
    """For tables whose ids are distinct."""
    cut = "held > 0 AND shares > 1 AND (held + bytes > cap OR (held + bytes - aim > 0 AND held + bytes - aim > bytes / 2.0::DOUBLE))"
    return f"""
WITH RECURSIVE docs AS (SELECT doc_id, coalesce(text, '') AS text, CAST(strlen(coalesce(text, '')) + {OVERHEAD} AS BIGINT) AS size FROM documents),
crcs AS (SELECT text, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(strlen(text)), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
  lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])) AS c FROM (SELECT DISTINCT text, hex(encode(text)) AS h, {crc_table()}::BIGINT[] AS t FROM docs)),
units AS (SELECT i, bytes, text, sum(bytes) OVER (ORDER BY i) AS p FROM (SELECT row_number() OVER (ORDER BY min(doc_id) NULLS FIRST) AS i, text, sum(size) AS bytes FROM docs GROUP BY text)),
total AS (SELECT CAST(sum(bytes) AS BIGINT) AS t, CAST(max(bytes) AS BIGINT) AS m FROM units),
search AS (
  SELECT greatest(m, (t + {shards - 1}) // {shards}) AS low, t AS high, (greatest(m, (t + {shards - 1}) // {shards}) + t) // 2 AS mid, 0 AS used, 0::BIGINT AS spot FROM total
  UNION ALL
  SELECT CASE WHEN NOT finished THEN low WHEN fits THEN low ELSE mid + 1 END, CASE WHEN finished AND fits THEN mid ELSE high END,
    CASE WHEN NOT finished THEN mid WHEN fits THEN (low + mid) // 2 ELSE (mid + 1 + high) // 2 END, CASE WHEN finished THEN 0 ELSE used END, CASE WHEN finished THEN 0 ELSE spot END
  FROM (SELECT low, high, mid, used + 1 AS used, CAST(max(p) AS BIGINT) AS spot, max(p) = any_value(t) OR used + 1 >= {shards} AS finished, max(p) = any_value(t) AS fits
    FROM search, units, total WHERE low < high AND p <= search.spot + mid GROUP BY low, high, mid, used)),
capacity AS (SELECT low AS cap FROM search WHERE low = high LIMIT 1),
walk AS (
  SELECT even, 0::BIGINT AS i, 0 AS shard, 0::BIGINT AS held, t AS rest, {shards} AS shares, CASE WHEN even THEN t / {shards}::DOUBLE ELSE cap END AS aim, cap FROM total, capacity, (VALUES (true), (false)) e(even)
  UNION ALL
  SELECT even, u.i, CASE WHEN cut THEN shard + 1 ELSE shard END, CASE WHEN cut THEN u.bytes ELSE held + u.bytes END, CASE WHEN cut THEN rest - held ELSE rest END, CASE WHEN cut THEN shares - 1 ELSE shares END,
    CASE WHEN cut AND even THEN (rest - held) / (shares - 1)::DOUBLE ELSE aim END, cap
  FROM (SELECT w.*, u.i AS next, CAST(u.bytes AS BIGINT) AS bytes, {cut} AS cut FROM walk w JOIN units u ON u.i = w.i + 1) x JOIN (SELECT i, CAST(bytes AS BIGINT) AS bytes FROM units) u ON u.i = x.next),
chosen AS (SELECT bool_and(held <= cap) FILTER (even) AS even FROM walk),
placed AS (SELECT d.*, w.shard FROM docs d JOIN units u ON u.text = d.text JOIN walk w ON w.i = u.i JOIN chosen c ON c.even = w.even)
SELECT doc_id, size, xor(c, 4294967295) AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST) - 1 AS slot, NULL::INTEGER AS grown_shard FROM placed JOIN crcs USING (text)"""
