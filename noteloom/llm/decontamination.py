"""Benchmark decontamination: pigeonhole edit matching.

Texts are compared in lower case with every run of signs other than letters and digits as one space. An item of m signs
may occur with k = floor(error_rate * m) edits. Cut into k + 1 pieces, at least one piece must occur unchanged, so an
Aho-Corasick automaton over all pieces finds every candidate place; Myers' bit-parallel distance decides there. Places
of one item are merged by diagonal, so a passage is verified once, not once per piece. An item too short for an error
must occur as whole words.

Items lie in the shared folder in slices of about `SLICE_CHARS` signs, by hash. Each slice is a scan of its own, and a
worker holds the automaton of one slice at a time; neither items nor automata pass through the driver.

Nulls and empty texts match nothing, as do items without letters or digits, or without an id. Equal items each report
their own id. Repeated documents are judged row by row; null ids are kept. Of equally good places of an item in a long
text the first counts. Empty tables match nothing; further columns are kept by `decontaminate` and not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.llm.common import bounded_batches, filesystem, kept, materialize, stage_path

ERROR_RATE = 0.08
SLICE_CHARS = 4_000_000
_OTHER = re.compile(r"[\W_]+")
MATCHES = "array<struct<item_id:bigint,distance:int,start:bigint>>"


def normalize(text: str | None) -> str:
    return _OTHER.sub(" ", text.lower()).strip() if text else ""


class Pattern:
    """An item prepared for Myers' algorithm."""

    __slots__ = ("item_id", "text", "errors", "masks")

    def __init__(self, item_id: int, text: str, error_rate: float):
        self.item_id, self.text, self.errors = item_id, text, int(len(text) * error_rate)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def pieces(self) -> Iterator[tuple[int, str]]:
        m, n = len(self.text), self.errors + 1
        for i in range(n):
            a, b = i * m // n, (i + 1) * m // n
            yield a, self.text[a:b]

    def distance(self, window: str) -> tuple[int, int]:
        """Fewest edits between the item and any part of the window, and where the first such part ends."""
        m = len(self.text)
        full, top = (1 << m) - 1, 1 << (m - 1)
        up, down, score, best, end = full, 0, m, m, 0
        get = self.masks.get
        for at, c in enumerate(window):
            eq = get(c, 0)
            vertical = eq | down
            horizontal = (((eq & up) + up) ^ up) | eq
            plus = down | ~(horizontal | up)
            minus = up & horizontal
            if plus & top:
                score += 1
            elif minus & top:
                score -= 1
                if score < best:
                    best, end = score, at + 1
            plus <<= 1
            minus <<= 1
            up = (minus | ~(vertical | plus)) & full
            down = plus & vertical & full
        return best, end


class Matcher:
    def __init__(self, items: list[tuple[int, str]], error_rate: float):
        self.patterns = [Pattern(i, t, error_rate) for i, t in items]
        places: dict[str, list[tuple[int, int]]] = {}
        for number, p in enumerate(self.patterns):
            for offset, piece in p.pieces():
                places.setdefault(piece, []).append((number, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()
        self.empty = not places

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item_id, distance, start in the normalised text) of each item that occurs, at its best place."""
        if self.empty or not text:
            return []
        best: dict[int, tuple[int, int]] = {}
        tried: set[tuple[int, int]] = set()
        for end, (length, where) in self.automaton.iter(text):
            for number, offset in where:
                found = best.get(number)
                if found is not None and found[0] == 0:
                    continue
                p = self.patterns[number]
                start = end + 1 - length - offset
                if start >= 0 and text.startswith(p.text, start):
                    stop = start + len(p.text)
                    if p.errors or (start == 0 or text[start - 1] == " ") and (stop == len(text) or text[stop] == " "):
                        best[number] = (0, start)
                        continue
                step = p.errors + 1
                key = (number, start // step)
                if p.errors == 0 or key in tried:
                    continue
                tried.add(key)
                low = max(0, key[1] * step - p.errors)
                distance, stop = p.distance(text[low : key[1] * step + step + len(p.text) + 2 * p.errors])
                if distance <= p.errors and (found is None or distance < found[0]):
                    best[number] = (distance, max(0, low + stop - len(p.text)))
        return [(self.patterns[n].item_id, d, s) for n, (d, s) in sorted(best.items())]


def normalized(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(normalize)

    return run(text)


def store_slices(benchmark: DataFrame, slice_chars: int = SLICE_CHARS) -> tuple[str, int]:
    """Distinct normalised items in the shared folder; returns the folder and the number of slices."""
    spark = benchmark.sparkSession
    bounded_batches(spark)
    known = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    items = materialize(known.select("item_id", normalized(F.col("text")).alias("text")).where(F.col("text") != "").distinct(), "items")
    slices = -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // slice_chars)
    folder = stage_path(spark, "slices")
    if slices:
        items.withColumn("slice", F.pmod(F.xxhash64("item_id", "text"), F.lit(slices))).repartition("slice").write.partitionBy("slice").parquet(folder)
    return folder, slices


def matcher_of(folder: str, number: int, error_rate: float) -> Matcher:
    """The automaton of a slice, kept for the worker's next tasks."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    def build() -> Matcher:
        files, root = filesystem(folder)
        items: list[tuple[int, str]] = []
        for info in files.get_file_info(fs.FileSelector(f"{root}/slice={number}", allow_not_found=True)):
            if info.path.endswith(".parquet"):
                with files.open_input_file(info.path) as source:
                    rows = pq.ParquetFile(source).read(["item_id", "text"])
                items += zip(rows["item_id"].to_pylist(), rows["text"].to_pylist(), strict=True)
        return Matcher(sorted(items), error_rate)

    return kept(("matcher", folder, number, error_rate), build)


def slice_matches(folder: str, number: int, error_rate: float, text: Column) -> Column:
    """Array of (item_id, distance, start) of the items of one slice."""

    @F.pandas_udf(MATCHES)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = matcher_of(folder, number, error_rate)
        for texts in batches:
            yield pd.Series([[{"item_id": i, "distance": d, "start": s} for i, d, s in matcher.find(normalize(t))] for t in texts])

    return find(text)


def find_contamination(documents: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """One row per document and item that it holds: doc_id, item_id, distance, start."""
    folder, slices = store_slices(benchmark, slice_chars)
    out = documents.select("doc_id", F.array().cast(MATCHES).alias("found")).limit(0)
    for number in range(slices):
        out = out.unionByName(documents.select("doc_id", slice_matches(folder, number, error_rate, F.col("text")).alias("found")))
    return out.select("doc_id", F.explode("found").alias("m")).select("doc_id", "m.item_id", "m.distance", "m.start")


def decontaminate(documents: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """The documents that hold no item, with their columns. What one slice keeps is stored before the next one's pass."""
    folder, slices = store_slices(benchmark, slice_chars)
    for number in range(slices):
        documents = documents.where(F.size(slice_matches(folder, number, error_rate, F.col("text"))) == 0)
        if number < slices - 1:
            documents = materialize(documents, "kept")
    return documents
