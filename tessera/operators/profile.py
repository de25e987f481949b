"""Dataset profiles: distributions, outliers, duplicates, conflicts, availability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.expr import col, ratio, skew_g1
from tessera.operators.quantile import exact_quantiles, with_quantiles
from tessera.operators.scan import Carried, Line


def first_n(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group; Spark limits groups before it shuffles them."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def fences(df: DataFrame, by: list[str], value: str, k: float, approximate: int | None = None) -> DataFrame:
    """Quartiles and the fences k IQR beyond them, exact for groups of any size; approximate: the accuracy of percentile_approx instead, which
    takes one pass."""
    if approximate:
        g = df.groupBy(*by).agg(F.percentile_approx(value, [0.25, 0.75], approximate).alias("_q"))
    else:
        g = exact_quantiles(df, by, value, (0.25, 0.75)).withColumnRenamed("q", "_q")
    iqr = F.col("_q")[1] - F.col("_q")[0]
    return g.select(*by, F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("q3"), (F.col("_q")[0] - k * iqr).alias("low"), (F.col("_q")[1] + k * iqr).alias("high"))


def tukey_outliers(df: DataFrame, by: list[str], value: str, k: float = 1.5, low: bool = True) -> DataFrame:
    """Rows outside the fences of their group, or above the upper one only."""
    limits = fences(df, by, value, k).withColumnsRenamed({"low": "_low", "high": "_high"})
    out = F.col(value) > F.col("_high")
    return df.join(limits.select(*by, "_low", "_high"), by).filter(out | (F.col(value) < F.col("_low")) if low else out).drop("_low", "_high")


def two_arm_label(direct: Column | str, other: Column | str, shift: float = 0.301) -> Column:
    direct, other = col(direct), col(other)
    above = F.when(other - direct > shift, "positive").otherwise("negative")
    below = F.when(other > 4 + shift, "positive").when(other < 4, "negative").otherwise("excluded")
    return F.when(direct > 4, above).when(direct < 4, below)


def _above(v: Column, thresholds: dict[str, float]) -> list[Column]:
    return [c for name, t in thresholds.items() for c in (F.count_if(v >= t).alias(f"n_{name}"), ratio(F.count_if(v >= t), F.count(v)).alias(f"fraction_{name}"))]


def moments(df: DataFrame, by: list[str], value: str, thresholds: dict[str, float] | None = None, *more: Column) -> DataFrame:
    """A distribution by group: n, mean, median, sd, q1, q3, iqr, min, max, skew, counts at or above thresholds, and further aggregates. Quantiles are
    exact, and no task holds a group's values."""
    v = col(value)
    aggs = [F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.min(v).alias("min"), F.max(v).alias("max"), skew_g1(v).alias("skew"), *_above(v, thresholds or {}), *more]
    out = with_quantiles(df, by, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, *aggs).withColumn("iqr", F.col("q3") - F.col("q1"))
    first = [*by, "n", "mean", "median", "sd", "q1", "q3", "iqr", "min", "max", "skew"]
    return out.select(*first, *(c for c in out.columns if c not in first))


def quantiles(value: Column | str, at: tuple[float, ...], prefix: str = "p") -> list[Column]:
    """Aggregates, for groups that a task can hold; exact_quantiles is for others."""
    q = F.percentile(col(value), F.array(*map(F.lit, at)))
    return [q[k].alias(f"{prefix}{round(100 * p):02d}") for k, p in enumerate(at)]


def stat_vector(df: DataFrame, by: list[str], value: str, *more: Column) -> DataFrame:
    """n, mean, population sd, min, max, seven exact quantiles, and further aggregates, by group."""
    v = col(value)
    aggs = [F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), F.min(v).alias("min"), F.max(v).alias("max"), *more]
    return with_quantiles(df, by, value, {f"p{p:02d}": p / 100 for p in (1, 5, 25, 50, 75, 95, 99)}, *aggs)


def pair_statistics(df: DataFrame, by: list[str], value: str, ranges: int = 1) -> DataFrame:
    """Of |a - b| over all pairs of a group's rows that have a value: pairs, mean, sd, min, max. No pair is made: in order, a value counts as often
    as its place is past the middle, the squares follow from the variance, the least difference is one of neighbours, the largest the range."""
    rows = df.filter(F.col(value).isNotNull())
    totals = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.avg(value).alias("_mean"), F.var_pop(value).alias("_var"), F.min(value).alias("_low"), F.max(value).alias("_high"))
    line = Line(rows.select(*by, value), by, [value], ranges).carry(_i=Carried("count", F.col(value)), _next=Carried("next", F.col(value))).done()
    line = line.join(totals, by) if by else line.join(F.broadcast(totals))  # one row
    sums = line.groupBy(*by, "_n", "_var", "_low", "_high").agg(F.sum((2 * F.col("_i") - F.col("_n") - 1) * (F.col(value) - F.col("_mean"))).alias("_sum"), F.min(F.col("_next") - F.col(value)).alias("min"))
    pairs = F.col("_n") * (F.col("_n") - 1) / F.lit(2.0)
    square = F.col("_n").cast("double") * F.col("_n") * F.col("_var")
    sd = F.sqrt(F.greatest(square - F.col("_sum") * F.col("_sum") / pairs, F.lit(0.0)) / (pairs - 1))
    out = sums.filter("_n > 1").select(*by, pairs.cast("long").alias("pairs"), (F.col("_sum") / pairs).alias("mean"), F.when(pairs > 1, sd).alias("sd"), "min", (F.col("_high") - F.col("_low")).alias("max"))
    return out


def duplicate_groups(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """Groups of several rows, with their distinct names in order."""
    names = F.array_sort(F.collect_set(name))
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.countDistinct(name).alias("n_names"), F.array_join(names, "|").alias("names")).filter("n > 1")


def replicate_conflicts(df: DataFrame, by: list[str], value: str, atol: float = 1e-8) -> DataFrame:
    g = df.groupBy(*by).agg(F.count("*").alias("n"), F.min(value).alias("min"), F.max(value).alias("max")).filter("n > 1")
    return g.withColumn("range", F.col("max") - F.col("min")).withColumn("conflict", F.col("range") > atol)


def availability(columns: dict[str, str]) -> Column:
    """'A+B' of the columns that are present; 'none'."""
    text = F.concat_ws("+", *(F.when(F.col(c).isNotNull(), F.lit(n)) for n, c in columns.items()))
    return F.when(text == "", "none").otherwise(text)


def fold_rare(df: DataFrame, by: list[str], name: str, least: int = 5) -> DataFrame:
    """Names of fewer than `least` rows as one; counts come from an aggregation, so frequent names don't meet in a task."""
    rare = df.groupBy(*by, name).agg(F.count("*").alias("_n"))
    return df.join(rare, [*by, name]).withColumn(name, F.when(F.col("_n") < least, f"<OTHER_LT{least}>").otherwise(F.col(name))).drop("_n")


def density(df: DataFrame, by: list[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """Histogram density over equal bins of [low, high]; the last one is closed."""
    width = (high - low) / bins
    k = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int")
    rows = df.filter(F.col(value).between(low, high))
    counts = rows.groupBy(*by, k.alias("bin")).agg(F.count("*").alias("n"))
    total = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    joined = counts.join(total, by) if by else counts.join(F.broadcast(total))  # one row
    return joined.select(*by, "bin", "n", ratio("n", F.col("total") * width).alias("density"))


def two_level(df: DataFrame, group: list[str], value: str) -> DataFrame:
    return df.groupBy(*group).agg(F.avg(value).alias(value))


def inventory(df: DataFrame, source: str, cells: list[str], name: str, invalid: Column) -> DataFrame:
    nulls = sum((F.count("*") - F.count(c) for c in cells), F.lit(0).cast("long"))
    return df.agg(F.count("*").alias("n_rows"), nulls.alias("null_cells"), F.countDistinct(name).alias("n_names"), F.count_if(invalid).alias("invalid")).select(F.lit(source).alias("source"), "*")


def size_summary(sizes: DataFrame, name: str, *more: Column) -> DataFrame:
    """From a table with a size n for each group: how many, singletons, largest, median."""
    return sizes.agg(F.count("*").alias(name), F.count_if(F.col("n") == 1).alias("singletons"), ratio(F.count_if(F.col("n") == 1), F.count("*")).alias("singleton_fraction"), F.max("n").alias("largest"), F.median("n").alias("median"), *more)


def modal(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """The most frequent name of each group (ties: the smallest), its share, and how many names there are."""
    counts = df.groupBy(*by, name).agg(F.count("*").alias("n"))
    g = counts.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("m"), name)).alias("top"), F.sum("n").alias("total"), F.count("*").alias("kinds"))
    return g.select(*by, F.col("top")[name].alias("modal"), ratio(-F.col("top.m"), "total").alias("fraction"), "kinds")


def missing_units(seen: DataFrame, by: list[str], unit: str, n: int) -> DataFrame:
    """Units 0..n-1 that a group lacks."""
    expected = seen.select(*by).distinct().withColumn(unit, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    return expected.join(seen, [*by, unit], "left_anti")
