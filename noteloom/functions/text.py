"""String functions with the exact semantics of the data model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space: ASCII, Unicode separators and NEL.
SPACE = r"[\s\p{Z}\x{85}]"
NOT_WORD = r"[^\p{L}\p{Nd}]+"


def strip_bom(text: Column) -> Column:
    return F.regexp_replace(text, r"^\x{FEFF}+", "")


def unix_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def trim_space(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def is_blank(text: Column) -> Column:
    return ~F.regexp_like(text, F.lit(r"[^\s\p{Z}\x{85}]"))


def fields(text: Column) -> Column:
    """White-space separated fields."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def count_fields(text: Column) -> Column:
    return F.size(fields(text))


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(text), NOT_WORD), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Distinct lower-case runs of letters and digits."""
    return F.array_distinct(words(text))
