"""Notes: normalise, split and validate front matter, derive, find duplicates. Row operators are columns; only the YAML
block itself is decoded in Python, in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom import schemas
from noteloom.functions.text import is_blank, strip_bom, unix_lines

FRONT_MATTER = r"(?s)^---\n(.*?\n)?---(?:\n(.*))?$"
DECODED = "struct<uid:string,type:string,status:string,created:string,tags:array<string>,title:string,lang:string,visibility:string,bad:string>"
REQUIRED = ("uid", "type", "status", "created", "tags")


def normalize_text(raw: Column) -> Column:
    return unix_lines(strip_bom(raw))


def has_front_matter(text: Column) -> Column:
    return F.regexp_like(text, F.lit(FRONT_MATTER))


def front_matter(text: Column) -> Column:
    return F.regexp_extract(text, FRONT_MATTER, 1)


def body(text: Column) -> Column:
    return F.regexp_extract(text, FRONT_MATTER, 2)


def decode_yaml(block: Column) -> Column:
    """The eight known keys; unknown ones are ignored and `bad` names the first that has the wrong shape."""

    @F.pandas_udf(DECODED)
    def decode(blocks: pd.Series) -> pd.DataFrame:
        import yaml

        class Plain(yaml.SafeLoader):
            """Scalars stay strings, so that dates and numbers keep their spelling."""

        Plain.yaml_implicit_resolvers = {k: [r for r in v if r[0] == "tag:yaml.org,2002:null"] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}

        def one(text: str | None) -> dict:
            out: dict = dict.fromkeys(("uid", "type", "status", "created", "tags", "title", "lang", "visibility", "bad"))
            try:
                data = yaml.load(text or "", Plain) or {}  # noqa: S506 - a safe loader
                if not isinstance(data, dict):
                    raise yaml.YAMLError
            except yaml.YAMLError:
                return out | {"bad": "---"}
            for key in ("uid", "type", "status", "created", "tags", "title", "lang", "visibility"):
                value = data.get(key)
                fine = value is None or (isinstance(value, list) and all(isinstance(x, str) for x in value) if key == "tags" else isinstance(value, str))
                if not fine:
                    return out | {"bad": key}
                out[key] = value
            return out

        return pd.DataFrame([one(b) for b in blocks])

    return decode(block)


def first_missing(fields: Column) -> Column:
    """The first required field that is empty, in fixed order."""
    empty = lambda c: F.coalesce(F.size(fields[c]) <= 0, F.lit(True)) if c == "tags" else F.coalesce(fields[c], F.lit("")) == ""
    return F.coalesce(*[F.when(empty(c), F.lit(c)) for c in REQUIRED])


def valid_uid(uid: Column) -> Column:
    return F.regexp_like(uid, F.lit(schemas.UID))


def valid_slug(name: Column) -> Column:
    return F.regexp_like(name, F.lit(schemas.SLUG))


def created_date(text: Column) -> Column:
    """Strict yyyy-MM-dd; null for anything else."""
    return F.when(F.regexp_like(text, F.lit(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"))


def enum_error(value: Column, accepted: Sequence[str]) -> Column:
    return F.when(~F.coalesce(value, F.lit("")).isin(*accepted), F.concat(F.lit('"'), F.coalesce(value, F.lit("")), F.lit('" is not one of ' + "|".join(sorted(accepted)))))


def validation_error(fields: Column) -> Column:
    """First problem of decoded front matter; null if there is none."""
    missing = first_missing(fields)
    visibility = F.coalesce(F.when(fields["visibility"] != "", fields["visibility"]), F.lit(schemas.DEFAULT_VISIBILITY))
    return F.coalesce(
        F.when(fields["bad"].isNotNull(), F.concat(F.lit("bad "), fields["bad"])), F.when(missing.isNotNull(), F.concat(F.lit("missing "), missing)),
        F.when(~valid_uid(fields["uid"]), F.lit("uid")), F.when(created_date(fields["created"]).isNull(), F.lit("created")),
        enum_error(fields["type"], schemas.NOTE_TYPES), enum_error(fields["status"], schemas.STATUSES), enum_error(visibility, schemas.VISIBILITIES),
    )


def area_of(path: Column) -> Column:
    """First folder in lower case; null for a file at the root."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.lower(F.element_at(parts, 1)))


def sub_of(path: Column) -> Column:
    """Second folder of a path deeper than two."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 2, F.element_at(parts, 2)).otherwise(F.lit(""))


def parse_notes(files: DataFrame, areas: Sequence[str]) -> DataFrame:
    """files: vault, path, raw. Adds the note columns, `skipped` for blank files and `error` for bad ones."""
    out = files.withColumn("text", normalize_text(F.col("raw"))).withColumn("skipped", is_blank(F.col("text")))
    out = out.withColumn("fields", decode_yaml(F.when(has_front_matter(F.col("text")), front_matter(F.col("text")))))
    area = area_of(F.col("path"))
    error = F.when(~has_front_matter(F.col("text")), F.lit("no front matter")).otherwise(
        F.coalesce(validation_error(F.col("fields")), F.when(~F.coalesce(area.isin(*areas), F.lit(False)), F.lit("area"))),
    )
    return out.select(
        "vault", "path", "fields.uid", "fields.type", "fields.status", F.coalesce(F.when(F.col("fields.visibility") != "", F.col("fields.visibility")), F.lit(schemas.DEFAULT_VISIBILITY)).alias("visibility"),
        "fields.tags", created_date(F.col("fields.created")).alias("created"), F.coalesce("fields.title", F.lit("")).alias("title"), F.coalesce("fields.lang", F.lit("")).alias("lang"),
        area.alias("area"), sub_of(F.col("path")).alias("sub"), body(F.col("text")).alias("body"), "skipped", F.when(~F.col("skipped"), error).alias("error"),
    )


def duplicate_uids(notes: DataFrame) -> DataFrame:
    """uids that two notes of one vault share, with their first two paths."""
    first = notes.groupBy("vault", "uid").agg(F.count("*").alias("n"), F.min("path").alias("first_path")).where("n > 1")
    later = notes.join(first, ["vault", "uid"]).where(F.col("path") > F.col("first_path")).groupBy("vault", "uid").agg(F.min("path").alias("second_path"))
    return first.join(later, ["vault", "uid"], "left").select("vault", "uid", "n", "first_path", "second_path")


def cross_vault_duplicates(notes: DataFrame) -> DataFrame:
    """Every pair of vaults that share a uid."""
    a, b = notes.select("uid", "vault", "path").alias("a"), notes.select("uid", "vault", "path").alias("b")
    return a.join(b, (F.col("a.uid") == F.col("b.uid")) & (F.col("a.vault") < F.col("b.vault"))).select("a.uid", F.col("a.vault").alias("vault_a"), F.col("a.path").alias("path_a"), F.col("b.vault").alias("vault_b"), F.col("b.path").alias("path_b"))


def with_updated(notes: DataFrame, git_dates: DataFrame, modified: Column) -> DataFrame:
    """git_dates: path, committed (many per path, the newest wins); else the file's own time."""
    latest = git_dates.groupBy("path").agg(F.max("committed").alias("_committed"))
    return notes.join(latest, "path", "left").withColumn("updated", F.coalesce("_committed", modified)).drop("_committed")


class BadPattern(ValueError):
    pass


def glob_filter(target: Column, pattern: str) -> Column:
    """Shell pattern over `vault/path`; a trailing /** is a subtree, ** elsewhere is refused."""
    if pattern == "":
        return F.lit(True)
    prefix = pattern.removesuffix("/**")
    if "**" in prefix:
        raise BadPattern(f"{pattern!r}: ** stands only at the end")
    if prefix != pattern:
        return (target == prefix) | target.startswith(prefix + "/")
    return F.regexp_like(target, F.lit(glob_regex(pattern)))


def glob_regex(pattern: str) -> str:
    """Anchored expression of a pattern with *, ?, [classes] and escapes; none crosses a slash."""
    out, at = "", 0
    while at < len(pattern):
        c = pattern[at]
        at += 1
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "\\":
            if at == len(pattern):
                raise BadPattern(pattern)
            out += re.escape(pattern[at])
            at += 1
        elif c == "[":
            end = pattern.find("]", at + 1)
            if end < 0:
                raise BadPattern(pattern)
            inner = pattern[at:end]
            negated = inner.startswith("^")
            inner = inner[1:] if negated else inner
            out += "[" + ("^/" if negated else "") + re.sub(r"([\[\]&~])", r"\\\1", inner) + "]"
            at = end + 1
        else:
            out += re.escape(c)
    return f"^{out}$"


def note_cards(notes: DataFrame, lines: int = 3, signs: int = 200) -> DataFrame:
    """uid, path, title (else the file name) and the first non-empty lines within a budget of signs."""
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", "")
    kept = F.filter(F.transform(F.split("body", "\n"), lambda x: F.regexp_replace(x, r"[ \t\r]+$", "")), lambda x: x != "")
    state = F.struct(F.lit(signs).alias("left"), F.array().cast("array<string>").alias("out"), F.lit(False).alias("done")).cast("struct<left:int,out:array<string>,done:boolean>")

    def step(s: Column, line: Column) -> Column:
        cut = F.struct(F.lit(0).alias("left"), F.concat(s["out"], F.array(F.concat(F.substring(line, F.lit(1), s["left"]), F.lit("...")))).alias("out"), F.lit(True).alias("done"))
        more = F.struct((s["left"] - F.length(line)).alias("left"), F.concat(s["out"], F.array(line)).alias("out"), (F.size(s["out"]) + 1 >= lines).alias("done"))
        return F.when(s["done"], s).when(F.length(line) > s["left"], cut).otherwise(more).cast("struct<left:int,out:array<string>,done:boolean>")

    # The budget ends within its first lines + 1 non-empty lines.
    excerpt = F.aggregate(F.slice(kept, 1, lines + 1), state, step, lambda s: s["out"])
    return notes.select("uid", "path", F.coalesce(F.when(F.col("title") != "", F.col("title")), name).alias("title"), F.array_join(excerpt, "\n").alias("excerpt"))
