"""URL filters: Bloom filter cascade.

The block list is a table of hosts; an entry covers its host and all subdomains. The universe is every host of the corpus.
Levels alternate: level 0 encodes the listed keys, level 1 the unlisted keys of the universe that level 0 accepts by
mistake, level 2 the listed keys that level 1 accepts, and so on until a level makes no mistake. A key of the universe is
listed exactly if the first level that rejects it has an odd number. No join is needed to look a key up.

Keys are dealt by hash to parts, so that the filters of a part stay below `max_bytes` for a list of any length. Bits are
set with a map-side combined `bit_or` per 64-bit word and stored in the shared folder; the driver sees counts per part
only, and a worker holds the filters of one part at a time.

Nulls: a null url, or one without `://`, has an empty host and path. Empty hosts are never listed, nor are null entries.
Repeated urls are judged row by row; very long ones are read whole. Empty tables give empty results; further columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.llm.common import filesystem, join_hot_keys, kept, materialize, stage_path

#: The rules of the contract, as (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: The block list of the query: domains with such a word in a label.
LISTED_WORDS = ("ads", "adult", "bets", "casino", "pills", "porn", "spam", "warez", "xxx")
LISTED_LABEL = r"(^|-)(" + "|".join(LISTED_WORDS) + r")(-|$)"
LISTED_PATTERN = r"(^|[.-])(" + "|".join(LISTED_WORDS) + r")([.-]|$)"
URL_PATTERN = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL_PATTERN, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL_PATTERN, 2), F.lit(""))


def rule_column(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest fitting rule; null if none fits."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def suffixes(host: Column) -> Column:
    """The host and the domains above it."""
    labels = F.split(host, "\\.")
    return F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))


class Level:
    """One Bloom filter: bits in 64-bit words."""

    def __init__(self, bits: int, hashes: int, words: np.ndarray):
        self.bits, self.hashes, self.words = bits, hashes, words

    def accepts(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ok = np.ones(len(a), dtype=bool)
        for i in range(self.hashes):
            at = (a + i * b) % self.bits
            ok &= (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
        return ok


def _hash_pair(key: Column, level: int) -> list[Column]:
    """Two non-negative hashes, short enough that a + 64 * b never overflows a long."""
    return [
        F.xxhash64(key, F.lit(2 * level)).bitwiseAND(F.lit((1 << 50) - 1)),
        F.xxhash64(key, F.lit(2 * level + 1)).bitwiseAND(F.lit((1 << 40) - 1)),
    ]


def _part_of(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(parts)).cast("int")


def _assemble(sizes: list[int]):
    """Rows come sorted by part, then word: one row per part with its whole filter."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, held = None, np.zeros(0, np.uint64)
        for batch in batches:
            for p, rows in batch.groupby("part", sort=True):
                if p != part:
                    if part is not None:
                        yield pd.DataFrame({"part": [part], "words": [held.tobytes()]})
                    part, held = p, np.zeros(sizes[p] // 64, np.uint64)
                held[rows["word"].to_numpy(np.int64)] = rows["mask"].to_numpy(np.int64).view(np.uint64)
        if part is not None:
            yield pd.DataFrame({"part": [part], "words": [held.tobytes()]})

    return run


class BloomCascade:
    """Exact membership for every key of a stated universe."""

    def __init__(self, folder: str, parts: int, sizes: list[list[int]], hashes: int):
        """sizes: bits of each part at each level, 0 where a part has no such level."""
        self.folder, self.parts, self.sizes, self.hashes = folder, parts, sizes, hashes

    @property
    def size_bytes(self) -> int:
        return sum(map(sum, self.sizes)) // 8

    @classmethod
    def build(cls, universe: DataFrame, bits_per_key: float = 10.0, hashes: int = 7, max_bytes: int = 16 << 20, max_levels: int = 64) -> BloomCascade:
        """universe: distinct (key, listed)."""
        spark = universe.sparkSession
        n = universe.where("listed").count()
        # The levels after the first two are small; half of the bytes are for them and for uneven parts.
        parts = max(1, -(-int(n * bits_per_key / 8) * 2 // max_bytes))
        dealt = materialize(universe.select("key", "listed", _part_of(F.col("key"), parts).alias("_part")), "cascade-universe")
        cascade = cls(stage_path(spark, "cascade"), parts, [], hashes)
        inside, outside = dealt.where("listed").select("key", "_part"), dealt.where(~F.col("listed")).select("key", "_part")
        while True:
            counts = dict(inside.groupBy("_part").count().collect())  # at most one row per part
            if not counts:
                return cascade
            number = len(cascade.sizes)
            if number == max_levels:
                raise ValueError("the cascade did not close: keys of the universe repeat with both labels")
            cascade.sizes.append([int(counts[p] * bits_per_key) // 64 * 64 + 64 if p in counts else 0 for p in range(parts)])
            cascade._store(inside, number)
            # What this level takes by mistake is what the next level encodes.
            wrong = materialize(cascade._grouped(outside).where(cascade._accepted_by(number)), f"cascade-{number}")
            inside, outside = wrong, inside

    def _store(self, keys: DataFrame, number: int) -> None:
        sizes, hashes = self.sizes[number], self.hashes
        a, b = _hash_pair(F.col("key"), number)
        bits = F.get(F.array(*[F.lit(x).cast("long") for x in sizes]), F.col("_part"))
        at = F.explode(F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.pmod(a + i.cast("long") * b, bits)))
        masks = keys.select(F.col("_part").alias("part"), at.alias("at")).groupBy("part", F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("mask"))
        whole = masks.repartition("part").sortWithinPartitions("part", "word").mapInPandas(_assemble(sizes), "part int, words binary")
        whole.write.partitionBy("part").parquet(f"{self.folder}/level={number}")

    def _grouped(self, rows: DataFrame) -> DataFrame:
        """Rows with a column `_part`, so that a task meets the parts one after another; frequent parts go to many tasks."""
        if self.parts == 1:
            return rows
        salt = F.pmod(F.monotonically_increasing_id(), F.lit(64))
        return rows.withColumn("_salt", salt).repartition("_part", "_salt").sortWithinPartitions("_part").drop("_salt")

    def _levels(self, part: int, upto: int) -> list[Level]:
        """The filters of a part, kept for the worker's next tasks."""
        import pyarrow.parquet as pq
        from pyarrow import fs

        def build() -> list[Level]:
            files, root = filesystem(self.folder)
            levels = []
            for number in range(upto):
                words = b""
                for info in files.get_file_info(fs.FileSelector(f"{root}/level={number}/part={part}", allow_not_found=True)):
                    if info.path.endswith(".parquet"):
                        with files.open_input_file(info.path) as source:
                            words += b"".join(pq.ParquetFile(source).read(["words"])["words"].to_pylist())
                if words:
                    levels.append(Level(self.sizes[number][part], self.hashes, np.frombuffer(words, np.uint64)))
            return levels

        return kept(("levels", self.folder, upto, part), build)

    def _accepted_by(self, number: int) -> Column:
        """Whether level `number` of its part accepts a key."""
        cascade = self

        @F.pandas_udf("boolean")
        def accepts(parts: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
            out = np.zeros(len(parts), bool)
            for part, rows in parts.groupby(parts).indices.items():
                levels = cascade._levels(int(part), number + 1)
                if len(levels) > number:
                    out[rows] = levels[number].accepts(a.to_numpy(np.int64)[rows], b.to_numpy(np.int64)[rows])
            return pd.Series(out)

        return accepts("_part", *_hash_pair(F.col("key"), number))

    def add_listed(self, rows: DataFrame, key: Column, name: str) -> DataFrame:
        """The rows with a boolean column `name`: whether the key, one of the universe, is listed."""
        if not self.sizes:
            return rows.withColumn(name, F.lit(False))
        cascade, depth = self, len(self.sizes)

        @F.pandas_udf("boolean")
        def lookup(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for parts, *series in batches:
                pairs = [s.to_numpy(np.int64) for s in series]
                out = np.zeros(len(parts), bool)
                for part, left in parts.groupby(parts).indices.items():
                    levels = cascade._levels(int(part), depth)
                    verdict = len(levels) % 2 == 1
                    for i, level in enumerate(levels):
                        ok = level.accepts(pairs[2 * i][left], pairs[2 * i + 1][left])
                        out[left[~ok]] = i % 2 == 1
                        left = left[ok]
                    out[left] = verdict
                yield pd.Series(out)

        dealt = self._grouped(rows.withColumn("_part", _part_of(key, self.parts)))
        return dealt.withColumn(name, lookup("_part", *[x for i in range(depth) for x in _hash_pair(key, i)])).drop("_part")


def block_list(pages: DataFrame) -> DataFrame:
    """host: the domains of the pages with a listed word in their first label."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).distinct()
    domains = hosts.select(F.explode(suffixes(F.col("host"))).alias("host"))
    return domains.where(F.regexp_like(F.substring_index("host", ".", 1), F.lit(LISTED_LABEL))).distinct()


def judge_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, max_bytes: int = 16 << 20) -> DataFrame:
    """page_id, host, path, rule, verdict. listed: host, each with all its subdomains."""
    cut = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    hosts = cut.select(F.col("host").alias("key")).distinct()
    entries = listed.select(F.translate("host", UPPER, LOWER).alias("domain")).where(F.col("domain") != "").distinct().withColumn("on_list", F.lit(True))
    domains = materialize(hosts.select("key", F.explode(suffixes(F.col("key"))).alias("domain")), "domains")
    # A third of all hosts may lie below one domain: domains meet the list once each, hosts of hot ones are not shuffled.
    totals = domains.groupBy("domain").agg(F.count("*").alias("hosts")).join(entries, "domain", "left")
    found = join_hot_keys(domains, totals.withColumn("on_list", F.col("on_list").isNotNull()), ["domain"], "hosts", ["on_list"])
    universe = found.groupBy("key").agg(F.max("on_list").alias("listed"))
    judged = BloomCascade.build(universe, max_bytes=max_bytes).add_listed(cut, F.col("host"), "_listed")
    return judged.withColumn("_rule", rule_column(F.col("host"), F.col("path"), rules)).select(
        "page_id", "host", "path", F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), F.when(F.col("_listed"), "block").otherwise("allow")).alias("verdict"),
    )


def oracle() -> str:
    fits = "\n".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{v}:{h}{p}'"
        for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    )
    return f"""
WITH cut AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '{URL_PATTERN}', 1), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '{URL_PATTERN}', 2), '') AS path
  FROM pages),
ruled AS (SELECT *, CASE {fits} END AS hit FROM cut)
SELECT page_id, host, path, CASE WHEN hit IS NOT NULL THEN substr(hit, strpos(hit, ':') + 1) END AS rule,
       CASE WHEN hit IS NOT NULL THEN substr(hit, 1, strpos(hit, ':') - 1)
            WHEN regexp_matches(host, '{LISTED_PATTERN}') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled"""
