"""Vault source: a walk that sees every Markdown file, then reading in parallel.

Spark's file sources skip empty and `_`-prefixed files, which count here; a source of its own therefore lists folders in
tasks (`vault_listing`), what the walk takes is decided by columns, and the bytes are read in Arrow batches through the
file system of the path: a mounted folder, or any that Arrow can open.
"""

from __future__ import annotations

import os
import subprocess
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.sources.vault_listing import is_local, listing, local, open_file

#: Violations that a message names.
MOST_TOLD = 100


@dataclass(frozen=True)
class Exclusions:
    folders: tuple[str, ...] = ()
    root_files: tuple[str, ...] = ()


def fold(path: str) -> str:
    return unicodedata.normalize("NFC", path.replace("\\", "/")).casefold().strip("/")


def folded(path: Column) -> Column:
    """Paths as exclusions compare them: NFC, slashes, no case."""

    @F.pandas_udf("string")
    def run(paths: pd.Series) -> pd.Series:
        return paths.map(fold, na_action="ignore")

    return run(path)


def choose(listing: DataFrame, exclude: Exclusions | None = None) -> DataFrame:
    """listing: path, link, folder. Adds `kind`: note, violation (a symbolic link), or null for what the walk passes over."""
    exclude = exclude or Exclusions()
    folders, files = [fold(f) for f in exclude.folders], [fold(f) for f in exclude.root_files]
    out = listing.withColumn("_folded", folded(F.col("path"))) if folders or files else listing.withColumn("_folded", F.lit(""))
    name = F.element_at(F.split("path", "/"), -1)
    hidden = F.regexp_like("path", F.lit(r"(^|/)\.[^/]+/"))
    inside = reduce(or_, [F.col("_folded").startswith(f + "/") | ((F.col("_folded") == f) & F.col("folder") & ~F.col("link")) for f in folders], F.lit(False))
    at_root = ~F.contains("path", F.lit("/")) & F.col("_folded").isin(*files) if files else F.lit(False)
    kind = (
        F.when(hidden | inside, None)
        .when(F.col("link"), F.when(~name.startswith("."), "violation"))
        .when(~F.col("folder") & F.lower(name).endswith(".md") & ~at_root, "note")
    )
    return out.withColumn("kind", kind).drop("_folded")


def walk(spark: SparkSession, root: str, exclude: Exclusions | None = None) -> tuple[DataFrame, list[str]]:
    """Markdown files (path), and violations, sorted; the first MOST_TOLD of many."""
    chosen = choose(listing(spark, root), exclude)
    violations = sorted(f"symbolic link: {r.path}" for r in chosen.where("kind = 'violation'").orderBy("path").limit(MOST_TOLD).collect())
    return chosen.where("kind = 'note'").select("path"), violations


def read_vault(spark: SparkSession, root: str, vault: str, exclude: Exclusions | None = None) -> DataFrame:
    """vault, path, raw, modified. Fails if the walk met a violation."""
    paths, violations = walk(spark, root, exclude)
    if violations:
        raise ValueError("; ".join(violations))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw, modified = [], []
            for path in batch["path"]:
                file, changed = open_file(root, path)
                with file:
                    raw.append(file.read().decode())
                modified.append(int(changed))
            yield pd.DataFrame({"vault": vault, "path": batch["path"], "raw": raw, "modified": pd.to_datetime(modified, unit="s", utc=True)})

    return paths.repartition(spark.sparkContext.defaultParallelism).mapInPandas(read, "vault string, path string, raw string, modified timestamp")


def every_file(spark: SparkSession, root: str, vault: str) -> DataFrame:
    """vault, path of all files there are: excluded, empty, unreadable and linked ones too."""
    return listing(spark, root).where("NOT folder").select(F.lit(vault).alias("vault"), "path")


def git_dates(spark: SparkSession, root: str) -> DataFrame:
    """path, committed: one log of the repository around the vault; empty outside a repository."""
    if not is_local(root):
        return spark.createDataFrame([], "path string, committed timestamp")
    done = subprocess.run(["git", "-C", local(root), "log", "--format=%x00%cI", "--name-only", "--relative", "--", "."], capture_output=True, text=True, check=False)
    rows, when = [], None
    for line in done.stdout.splitlines() if done.returncode == 0 else []:
        if line.startswith("\0"):
            when = pd.Timestamp(line[1:]).tz_convert("UTC").to_pydatetime()
        elif line:
            rows.append((line, when))
    return spark.createDataFrame(rows, "path string, committed timestamp")


def check_vaults(settings: dict[str, tuple[str, Sequence[str]]]) -> None:
    """Every vault needs an existing folder and valid area names."""
    from noteloom.schemas import is_slug

    problems = []
    for name, (root, areas) in sorted(settings.items()):
        if not is_slug(name):
            problems.append(f"vault name {name!r}")
        if is_local(root) and not os.path.isdir(local(root)):
            problems.append(f"vault {name}: no folder {root}")
        problems += [f"vault {name}: area {a!r}" for a in areas if not is_slug(a)]
    if problems:
        raise ValueError("; ".join(problems))
