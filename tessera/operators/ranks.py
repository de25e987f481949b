"""Ranks, empirical distributions and running minima.

Tables of ranks and distributions count equal values first, with map-side combine, and order the distinct values only: in one task for each
group by default, by ranges of the values (scan.Line) with `ranges`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.expr import ratio
from tessera.operators.quantile import _attached as attached
from tessera.operators.scan import Carried, Line
from tessera.sources.work import stored


def value_counts(df: DataFrame, by: list[str], value: str, *counts: Column) -> DataFrame:
    return df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"), *counts)


def rank_table(df: DataFrame, by: list[str], value: str, rank: str, ranges: int = 1) -> DataFrame:
    """by, value, n, and the average rank of the value's rows. ranges: by how many ranges of the values they are ranked."""
    line = Line(value_counts(df, by, value), by, [value], ranges).carry(_up_to=Carried("sum", F.col("n")))
    return line.done().select(*by, value, "n", (F.col("_up_to") - (F.col("n") - 1) / F.lit(2.0)).alias(rank))


def average_rank(df: DataFrame, by: list[str], value: str, rank: str, ranges: int = 1) -> DataFrame:
    """Adds the average rank (ties share the mean of theirs) of value within each group; NULLs have none.

    By default a group is ordered in one task: one shuffle, which other ranks of the same groups share. With `ranges` a group is
    dealt out by that many ranges of its values, whose limits are approximate quantiles stored beforehand; ranks within a range
    start from the count of the ranges below. Use it where groups are few and large."""
    if ranges > 1:
        return _ranged_rank(df, by, value, rank, ranges)
    v, w = F.col(value), Window.partitionBy(*by).orderBy(F.col(value).asc_nulls_last())
    last = F.count(v).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))  # of the value's rows
    return df.withColumn(rank, F.when(v.isNotNull(), (F.rank().over(w) + last) / F.lit(2.0)))


def _ranged_rank(df: DataFrame, by: list[str], value: str, rank: str, ranges: int) -> DataFrame:
    at = [k / ranges for k in range(1, ranges)]
    limits = stored(df.groupBy(*by).agg(F.percentile_approx(value, at, 20 * ranges).alias("_limits")))
    keys = [F.col(k).alias(f"_by_{k}") for k in by]
    a = limits.select(*keys, "_limits")
    rows = df.join(a, [df[k].eqNullSafe(a[f"_by_{k}"]) for k in by], "left") if by else df.join(F.broadcast(limits))  # one row
    rows = rows.drop(*(f"_by_{k}" for k in by)).withColumn("_range", F.size(F.filter("_limits", lambda x: x < F.col(value)))).drop("_limits")
    counts = rows.groupBy(*by, "_range").agg(F.count(value).alias("_n"))
    below = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, F.col("_range").alias("_at"), F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_start"))
    rows = rows.join(starts, [rows[k].eqNullSafe(starts[f"_by_{k}"]) for k in by] + [rows["_range"] == starts["_at"]], "left").drop(*(f"_by_{k}" for k in by), "_at")
    return average_rank(rows, [*by, "_range"], value, rank).withColumn(rank, F.col(rank) + F.col("_start")).drop("_range", "_start")


def unpivoted(rows: DataFrame, kept: list[str], values: list[str], **more: str) -> DataFrame:
    """kept, run (the number of the value's column), p, its value if it is not NULL; more: names of columns that a prefix and that number make."""
    own = (F.struct(F.lit(k).alias("run"), F.col(c).alias("p"), *(F.col(f"{x}{k}").alias(n) for n, x in more.items())) for k, c in enumerate(values))
    return rows.select(*kept, F.explode(F.array(*own)).alias("_r")).select(*kept, "_r.*").filter("p IS NOT NULL")


def correlations(df: DataFrame, by: list[str], x: str, others: list[str], counts: DataFrame, ranges: int = 1) -> DataFrame:
    """by, run, rho: Spearman's correlation of x with each of the other columns, over the rows that have it (x is there too). counts: by, run, n of them, small.
    x is ranked along one line for all; of the others only distinct values are, with the sums of x's ranks."""
    keys = [*by, "run"]
    rows = df.filter(F.coalesce(*others).isNotNull()).select(*by, x, *others)
    line = Line(rows, by, [x], ranges).carry(**{f"_c{k}": Carried("count", F.col(c)) for k, c in enumerate(others)})
    ties = Window.partitionBy(*by, *(["_range"] if ranges > 1 else []), x)  # a range has all rows of a value
    rows = line.rows.withColumns({f"_t{k}": F.max(f"_c{k}").over(ties) - (F.count(c).over(ties) - 1) / F.lit(2.0) for k, c in enumerate(others)})
    middle = (F.col("n") + 1) / F.lit(2.0)  # the mean of the ranks
    rows = attached(unpivoted(rows, by, others, t="_t"), counts, keys).withColumn("t", F.col("t") - middle)
    values = rows.groupBy(*keys, "p").agg(F.count("*").alias("m"), F.sum("t").alias("t"), F.sum(F.col("t") * F.col("t")).alias("tt"))
    values = Line(values, keys, ["p"], ranges).carry(_u=Carried("sum", F.col("m"))).done()
    values = attached(values, counts, keys).withColumn("r", F.col("_u") - (F.col("m") - 1) / F.lit(2.0) - middle)
    r = F.col("r")
    return values.groupBy(*keys).agg(ratio(F.sum(r * F.col("t")), F.sqrt(F.sum(F.col("m") * r * r)) * F.sqrt(F.sum("tt"))).alias("rho"))


def positions(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds the place of each row in the order (from 1, NULLs last): rows are dealt out by ranges and sorted there, and start from the
    counts of the ranges below. No task orders more than a range; rows that tie in all of `order` share out their places."""
    by = [F.col(c).asc_nulls_last() for c in order]
    rows = stored(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    counts = rows.groupBy(F.shiftright("_at", 33).alias("_range")).agg(F.count("*").alias("_n"))
    below = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_start"))  # a row for each task
    place = F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    rows = rows.withColumn("_range", F.shiftright("_at", 33)).join(F.broadcast(starts), "_range")
    return rows.withColumn(name, place.cast("long")).drop("_at", "_range", "_start")


def ecdf_gaps(df: DataFrame, by: list[str], value: str, second: Column, ranges: int = 1) -> DataFrame:
    """by, value, gap = F1 - F2 at each pooled distinct value, and next, the value after it. `second` tells the second sample's rows."""
    counts = value_counts(df, by, value, F.count_if(second).alias("n2"))
    line = Line(counts, by, [value], ranges).carry(_n=Carried("sum", F.col("n")), _n2=Carried("sum", F.col("n2")), next=Carried("next", F.col(value)))
    ends = [F.max(c).over(Window.partitionBy(*by)) for c in ("_n", "_n2")]
    rows = line.done()
    if ranges > 1:
        all_of = [F.col(k).alias(f"_all_{k}") for k in by]
        totals = rows.groupBy(*by).agg(F.max("_n").alias("_e"), F.max("_n2").alias("_e2")).select(*all_of, "_e", "_e2")
        rows = rows.join(totals, [rows[k].eqNullSafe(totals[f"_all_{k}"]) for k in by]) if by else rows.join(F.broadcast(totals))  # one row
        ends = [F.col("_e"), F.col("_e2")]
    f2, f1 = ratio("_n2", ends[1]), ratio(F.col("_n") - F.col("_n2"), ends[0] - ends[1])
    return rows.select(*by, value, (f1 - f2).alias("gap"), "next")


def best_so_far(df: DataFrame, by: list[str], step: str, loss: str, patience: int, ranges: int = 1) -> DataFrame:
    """Running minimum of the loss, the step that reached it, how many steps ago, and whether patience ran out."""
    return best_so_far_each(df, by, step, [loss], patience, ranges).drop("run")


def best_so_far_each(df: DataFrame, by: list[str], step: str, losses: list[str], patience: int, ranges: int = 1) -> DataFrame:
    """best_so_far for several losses of the same steps, which move together: a row for each of them, with `run`, its number from 0."""
    line = Line(df, by, [step], ranges).numbered("_i")
    # The least loss, and of equal ones the last.
    least = {f"_l{k}": Carried("min", F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("loss"), (-F.col("_i")).alias("i"), F.col(step).alias("step")))) for k, c in enumerate(losses)}
    runs = F.array(*(F.struct(F.lit(k).alias("run"), F.col(n).alias("least")) for k, n in enumerate(least)))
    rows = line.carry(**least).done().select(*by, step, "_i", F.explode(runs).alias("_r")).select(*by, step, "_i", "_r.*")
    rows = rows.withColumn("stale", F.col("_i") + F.col("least.i"))
    return rows.select(*by, step, "run", F.col("least.loss").alias("best"), F.col("least.step").alias("best_step"), "stale", (F.col("stale") >= patience).alias("stop"))
