"""Joins whose key relation is checked, and reconciliation of two tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.expectations import ExpectationError, examples, repeated_keys, require_columns

#: Sides of each relation whose keys must be unique.
_UNIQUE = {"one_to_one": "lr", "many_to_one": "r", "one_to_many": "l", "many_to_many": ""}


def validated_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", validate: str = "many_to_one", check: bool = True) -> DataFrame:
    """A join that raises if a side that must be unique repeats a key. The check aggregates keys only, and needs the same partitioning as a
    shuffled join would. With check=False the caller knows the keys."""
    require_columns(left, on)
    require_columns(right, on)
    if check:
        for side, df in (("l", left), ("r", right)):
            if side in _UNIQUE[validate] and (repeated := examples(repeated_keys(df, on).filter(F.col("n") > 1).select(*on), on).collect()):
                raise ExpectationError(f"{validate}: the {'left' if side == 'l' else 'right'} keys {on} repeat, such as {[r.asDict() for r in repeated]}")
    return left.join(right, on, how)


def reconcile(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Full outer join of two tables with unique keys, and `side`: both, left_only or right_only."""
    a, b = left.withColumn("_in_left", F.lit(True)), right.withColumn("_in_right", F.lit(True))
    side = F.when(F.col("_in_left").isNull(), "right_only").when(F.col("_in_right").isNull(), "left_only").otherwise("both")
    return a.join(b, on, "full_outer").withColumn("side", side).drop("_in_left", "_in_right")


def keep_matching(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(*on), on, "left_semi")


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, default: Column | None = None) -> DataFrame:
    """Adds the looked-up value; Spark broadcasts the table if it is small enough."""
    out = df.join(table.select(key, value), key, "left")
    return out if default is None else out.withColumn(value, F.coalesce(F.col(value), default))


def first_of_sources(sources: list[tuple[str, DataFrame]], key: list[str]) -> DataFrame:
    """Union in order of priority, with source and priority; of a key the row of the first source stays.

    An aggregation with map-side combine, not a window, so that hot keys don't meet in one task."""
    out = None
    for k, (name, df) in enumerate(sources):
        df = df.withColumn("source", F.lit(name)).withColumn("priority", F.lit(k))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    rest = [c for c in out.columns if c not in key and c != "priority"]
    return out.groupBy(*key).agg(F.min(F.struct("priority", *rest)).alias("first")).select(*key, "first.*")
