"""Checks of tables. Each gives a table of results, so that several checks can be one job; require() raises."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ExpectationError(ValueError):
    pass


def result(name: str, violations: DataFrame) -> DataFrame:
    """check, violations (a row count)."""
    return violations.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")


def together(*results: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, results)


def examples(rows: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """The first n rows in an order that names them."""
    return rows.orderBy(*order).limit(n)


def require(results: DataFrame, rows: dict[str, DataFrame] | None = None) -> None:
    """Raises with all checks that were violated; of those in `rows`, with the first five violating rows by their first column."""
    bad = results.filter(F.col("violations") > 0).orderBy("check").collect()  # a row for each check
    if bad:
        shown = {r["check"]: [x.asDict() for x in examples(rows[r["check"]], rows[r["check"]].columns[:1]).collect()] for r in bad if r["check"] in (rows or {})}
        raise ExpectationError("; ".join(f"{r['check']}: {r['violations']}" + (f", such as {shown[r['check']]}" if r["check"] in shown else "") for r in bad))


def require_columns(df: DataFrame, columns: list[str], exactly: bool = False) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ExpectationError(f"missing columns: {', '.join(missing)}")
    if exactly and df.columns != list(columns):
        raise ExpectationError(f"columns are {df.columns}, not {list(columns)}")
    return df


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, or hold a NULL; pre-aggregated, so hot keys cost nothing."""
    any_null = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter((F.col("n") > 1) | any_null)


def unique(df: DataFrame, keys: list[str], name: str = "unique") -> DataFrame:
    return result(name, repeated_keys(df, keys))


def within(df: DataFrame, c: str, low, high, name: str | None = None) -> DataFrame:
    """Violated by NULLs and values outside [low, high]."""
    return result(name or f"{c} in [{low}, {high}]", df.filter(F.col(c).isNull() | ~F.col(c).between(low, high)))


def holds(df: DataFrame, condition: Column, name: str) -> DataFrame:
    return result(name, df.filter(~F.coalesce(condition, F.lit(False))))


def same_keys(a: DataFrame, b: DataFrame, keys: list[str], name: str = "same keys") -> DataFrame:
    return result(name, key_difference(a, b, keys))


def key_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of one side only, with side 'left' or 'right': one union and one aggregation, one shuffle."""
    both = a.select(*keys, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(b.select(*keys, F.lit(0).alias("l"), F.lit(1).alias("r")))
    flags = both.groupBy(*keys).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return flags.filter("l <> r").select(*keys, F.when(F.col("l") == 1, "left").otherwise("right").alias("side"))


def disjoint(a: DataFrame, b: DataFrame, keys: list[str], name: str = "disjoint") -> DataFrame:
    return result(name, common_keys(a, b, keys))


def common_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct non-null keys of both sides."""
    return a.select(*keys).dropna().distinct().join(b.select(*keys).dropna().distinct(), keys, "left_semi")


def constant_in_group(df: DataFrame, keys: list[str], c: str, atol: float = 0.0, rtol: float = 0.0) -> DataFrame:
    """Groups in which c varies beyond the tolerance, or is partly NULL."""
    g = df.groupBy(*keys).agg(F.min(c).alias("low"), F.max(c).alias("high"), F.count("*").alias("n"), F.count(c).alias("present"))
    varies = F.col("high") - F.col("low") > atol + rtol * F.abs(F.col("low")) if dict(df.dtypes)[c] in ("double", "float", "int", "bigint") else F.col("low") < F.col("high")
    return g.filter(varies | ((F.col("present") > 0) & (F.col("present") < F.col("n"))))
