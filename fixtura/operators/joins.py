"""Joins that check what they assume: a size before broadcasting, uniqueness before a 1:1 join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fixtura.session import cut_lineage

BROADCAST_ROWS = 200_000
SALTS = 32


class CardinalityError(ValueError):
    """A join key is not as unique as the join needs it."""


def join_lookup(df: DataFrame, lookup: DataFrame, on: list[str], how: str = "left", bound: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a lookup of few rows per key: broadcast behind a check of its size, salted beyond it.

    Beyond the bound every lookup row is copied once per salt and `df` spreads each key over the
    salts, so that a key with a third of all rows is shared by many tasks. `how` is left or inner.
    """
    lookup = cut_lineage(lookup)
    if lookup.limit(bound + 1).count() <= bound:
        return df.join(F.broadcast(lookup), on, how)
    salted = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if c not in on and dict(df.dtypes)[c][:3] != "map"] or [F.lit(0)]), F.lit(SALTS)).cast("int")
    return df.withColumn("_salt", spread).join(salted, [*on, "_salt"], how).drop("_salt")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).count().filter("count > 1")


def at_most_one(condition: Column, message: str) -> Column:
    """An aggregate that is true, and fails the job where more than one row of a group is meant: a
    cardinality check inside the plan, without a pass of its own over the data."""
    return F.when(F.count_if(condition) > 1, F.raise_error(F.lit(message))).otherwise(True).cast("boolean")


def require_unique(lookup: DataFrame, keys: list[str], message: str) -> DataFrame:
    """The lookup, if no key of it comes twice; equal rows count as one."""
    once = lookup.distinct()
    wrong = [", ".join(str(r[k]) for k in keys) for r in duplicate_keys(once, keys).orderBy(*keys).limit(5).collect()]
    if wrong:
        raise CardinalityError(f"{message}: {'; '.join(wrong)}")
    return once


def checked_join(left: DataFrame, right: DataFrame, on: list[str] | str, how: str, validate: str, message: str = "join keys are not unique") -> DataFrame:
    """A join that asserts its cardinality, "1:1" or "m:1": rows per key are counted on each side that
    must be unique, and a key that comes twice fails the job. Null keys never join and are not counted.
    The count needs the rows by key, as the join does, so both share one shuffle and one sort."""
    on = [on] if isinstance(on, str) else list(on)

    def once(side: DataFrame) -> DataFrame:
        null_key = reduce(lambda a, b: a | b, [F.col(f"`{k}`").isNull() for k in on])
        counted = side.withColumn("_rows", F.count(F.lit(1)).over(Window.partitionBy(*on)))
        wrong = F.when((F.col("_rows") > 1) & ~null_key, F.raise_error(F.lit(f"{message}: {', '.join(on)}"))).otherwise(True)
        return counted.filter(wrong.cast("boolean")).drop("_rows")

    if validate not in ("1:1", "m:1"):
        raise ValueError("validate is 1:1 or m:1")
    return (once(left) if validate == "1:1" else left).join(once(right), on, how)


def key_differences(first: DataFrame, second: DataFrame, keys: list[str], shown: int = 5) -> dict[str, list[tuple]]:
    """The keys that only one of two frames has, the first `shown` of each in order (two anti joins)."""
    a, b = first.select(*keys).distinct(), second.select(*keys).distinct()
    only = lambda x, y: [tuple(r) for r in x.join(y, keys, "left_anti").orderBy(*keys).limit(shown).collect()]
    return {"only_first": only(a, b), "only_second": only(b, a)}


def null_safe_differs(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)
