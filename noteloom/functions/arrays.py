"""Folds over arrays that give one value per element."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values that a fold gathers before it sets them aside.
BLOCK = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once: a column named inside a lambda is computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold(items: Column, state: Column, state_type: str, step: Callable[[Column, Column], Column], out: Callable[[Column], Column], out_type: str, last: Callable[[Column], Column] | None = None) -> Column:
    """States along an array, seen through `out`, which may give null for nothing; `last` may add one value at the end.

    Appending copies an array, so values are gathered in blocks: the cost stays near linear for long arrays.
    """
    none, nothing = F.array().cast(f"array<{out_type}>"), F.array().cast(f"array<array<{out_type}>>")
    shape = f"struct<s:{state_type},now:array<{out_type}>,done:array<array<{out_type}>>>"
    start = F.struct(state.alias("s"), none.alias("now"), nothing.alias("done")).cast(shape)

    def after(a: Column, item: Column) -> Column:
        return let(step(a["s"], item).cast(state_type), lambda s: let(out(s).cast(out_type), lambda v: gathered(a, s, v)))

    def gathered(a: Column, s: Column, v: Column) -> Column:
        now = F.when(v.isNull(), a["now"]).otherwise(F.concat(a["now"], F.array(v)))
        aside = F.struct(s.alias("s"), none.alias("now"), F.concat(a["done"], F.array(now)).alias("done")).cast(shape)
        return F.when(F.size(a["now"]) >= BLOCK - 1, aside).otherwise(F.struct(s.alias("s"), now.alias("now"), a["done"].alias("done")).cast(shape))

    def whole(a: Column) -> Column:
        tail = [] if last is None else [let(last(a["s"]).cast(out_type), lambda v: F.when(v.isNull(), none).otherwise(F.array(v)))]
        return F.concat(F.flatten(a["done"]), a["now"], *tail)

    return F.aggregate(items, start, after, whole)


def running_sum(values: Column) -> Column:
    """The sum of each element and all before it."""
    return fold(values, F.lit(0), "int", lambda s, v: s + v, lambda s: s, "int")
