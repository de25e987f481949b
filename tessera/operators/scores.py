"""Interval-aware scores, regression metrics, losses, weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.expr import all_finite, clip, col, finite, interval_excess, pearson, ratio
from tessera.operators import ranks
from tessera.operators.quantile import _attached as attached
from tessera.sources.work import stored


def weighted_mean(value: Column | str, weight: Column | str) -> Column:
    """Aggregate over rows that have both."""
    v, w = col(value), col(weight)
    both = v.isNotNull() & w.isNotNull()
    return ratio(F.sum(F.when(both, v * w)), F.sum(F.when(both, w)))


def scored_rows(df: DataFrame, by: list[str], truth: str = "y", predicted: str = "p") -> DataFrame:
    """Rows that can be scored, with _mean, the mean truth of their group. Groups are aggregated and joined back: Spark
    broadcasts the means if they are few, and no window gathers a group in one task."""
    rows = df.filter(all_finite(truth, predicted, "lower", "upper"))
    means = rows.groupBy(*by).agg(F.avg(truth).alias("_mean"))
    return rows.join(means, by) if by else rows.join(F.broadcast(means))  # one row


def st_rae_of(predicted: str = "p") -> Column:
    """Aggregate over scored_rows: excess of the predictions over that of the group's mean."""
    return ratio(F.sum(interval_excess(predicted, "lower", "upper")), F.sum(interval_excess("_mean", "lower", "upper")))


def st_rae(df: DataFrame, by: list[str], truth: str = "y", predicted: str = "p") -> DataFrame:
    return scored_rows(df, by, truth, predicted).groupBy(*by).agg(F.count("*").alias("n"), st_rae_of(predicted).alias("st_rae"))


def regression_metrics(df: DataFrame, by: list[str], truth: str = "y", predicted: str = "p", ranges: int = 1) -> DataFrame:
    """n, st_rae, mae, rmse, spearman, r2 of groups of two rows or more."""
    if ranges > 1:
        rows = scored_rows(df, by, truth, predicted)
    else:  # the ranks bring a group together anyway, so its mean comes from the same shuffle
        rows = df.filter(all_finite(truth, predicted, "lower", "upper")).withColumn("_mean", F.avg(truth).over(Window.partitionBy(*by)))
    for c in (truth, predicted):
        rows = ranks.average_rank(rows, by, c, f"_rank_{c}", ranges)
    error = F.col(truth) - F.col(predicted)
    g = rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        st_rae_of(predicted).alias("st_rae"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        pearson(f"_rank_{truth}", f"_rank_{predicted}", 2).alias("spearman"),
        (1 - ratio(F.sum(error * error), F.count("*") * F.var_pop(truth))).alias("r2"),
    )
    return g.filter("n >= 2")


def regression_metrics_each(df: DataFrame, by: list[str], predicted: list[str], truth: str = "y", ranges: int = 1) -> DataFrame:
    """regression_metrics of several predictions of the same truths, with `run`, the prediction's number from 0. The truths are ranked along one line for all
    of them; of the predictions only distinct values are ranked, with the sums of their truths' ranks."""
    df = stored(df.select(*by, truth, "lower", "upper", *(F.when(all_finite(truth, c, "lower", "upper"), F.col(c)).alias(c) for c in predicted)))

    def runs(rows: DataFrame, *kept: str) -> DataFrame:
        return ranks.unpivoted(rows, [*by, *kept], predicted)

    keys = [*by, "run"]
    means = stored(runs(df, truth).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(truth).alias("_mean")))
    error = F.col(truth) - F.col("p")
    g = attached(runs(df, truth, "lower", "upper"), means.drop("n"), keys).groupBy(*keys).agg(
        F.count("*").alias("n"), st_rae_of("p").alias("st_rae"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"),
        (1 - ratio(F.sum(error * error), F.count("*") * F.var_pop(truth))).alias("r2"),
    )
    rho = ranks.correlations(df, by, truth, predicted, means.select(*keys, "n"), ranges).withColumnRenamed("rho", "spearman")
    return attached(g, rho, keys).select(*keys, "n", "st_rae", "mae", "rmse", "spearman", "r2").filter("n >= 2")


def objective(*scores: Column | str) -> tuple[Column, Column]:
    """The first finite score, else infinity, and its number from 0 (NULL if none is finite): what a search minimises."""
    first, used = F.lit(float("inf")), F.lit(None).cast("int")
    for k, c in reversed(list(enumerate(scores))):
        first, used = F.when(finite(c), col(c)).otherwise(first), F.when(finite(c), F.lit(k)).otherwise(used)
    return first, used


def macro(metrics: DataFrame, by: list[str], score: str, endpoint: str = "endpoint") -> DataFrame:
    """Unweighted mean of the endpoints' scores, with the endpoints that have one."""
    g = metrics.filter(F.col(score).isNotNull()).groupBy(*by)
    return g.agg(F.avg(score).alias("macro"), F.array_join(F.array_sort(F.collect_set(F.col(endpoint).cast("string"))), "|").alias("endpoints"), F.count("*").alias("scored"))


def uncertainty_weights(df: DataFrame, by: list[str], sd: str, low: float = 0.2, high: float = 5.0) -> DataFrame:
    """Adds weight: 1 / sd^2 over the group's median, clipped; 1 where sd is missing or not positive."""
    w = F.when(F.col(sd) > 0, 1 / (F.col(sd) * F.col(sd)))
    rows = df.withColumn("_w", w)
    medians = rows.groupBy(*by).agg(F.median("_w").alias("_m"))
    return rows.join(medians, by).withColumn("weight", F.coalesce(clip(ratio("_w", "_m"), low, high), F.lit(1.0))).drop("_w", "_m")


def effective_sample_size(df: DataFrame, by: list[str], sd: str) -> DataFrame:
    """n and (sum w)^2 / sum w^2 of inverse-variance weights, raw and clipped to their 5th and 95th percentile."""
    rows = df.filter(F.col(sd) > 0).withColumn("_w", 1 / (F.col(sd) * F.col(sd)))
    q = rows.groupBy(*by).agg(F.percentile("_w", F.array(F.lit(0.05), F.lit(0.95))).alias("_q"))
    rows = rows.join(q, by).withColumn("_c", clip("_w", F.col("_q")[0], F.col("_q")[1]))
    ess = lambda c: ratio(F.sum(c) * F.sum(c), F.sum(F.col(c) * F.col(c)))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), ess("_w").alias("ess_raw"), ess("_c").alias("ess_clipped"))


def interval_loss(truth: Column | str, predicted: Column | str, lower: Column | str, upper: Column | str) -> Column:
    """Squared distance to the interval; to the truth where bounds are missing."""
    e = interval_excess(predicted, lower, upper)
    d = col(predicted) - col(truth)
    return F.coalesce(e * e, d * d)


def masked_losses(df: DataFrame, by: list[str], weight: str = "weight") -> DataFrame:
    """Mean over tasks of the mean loss of each task that has rows: squared, weighted squared, interval."""
    d = F.col("p") - F.col("y")
    rows = df.filter(all_finite("y", "p")).withColumns({"_s": d * d, "_i": interval_loss("y", "p", "lower", "upper")})
    tasks = rows.groupBy(*by, "endpoint").agg(F.avg("_s").alias("mse"), weighted_mean("_s", weight).alias("weighted"), F.avg("_i").alias("interval"))
    return tasks.groupBy(*by).agg(F.count("*").alias("tasks"), *(F.avg(c).alias(c) for c in ("mse", "weighted", "interval")))


def fold_safe_scale(df: DataFrame, by: list[str], value: str, train: Column) -> DataFrame:
    """Adds mean and scale, fit on the train rows only (population sd; below 1e-8 it is 1), and z."""
    fit = df.filter(train & F.col(value).isNotNull()).groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("_s"))
    fit = fit.withColumn("scale", F.when(F.col("_s") < 1e-8, F.lit(1.0)).otherwise(F.col("_s"))).drop("_s")
    return df.join(fit, by, "left").withColumn("z", (F.col(value) - F.col("mean")) / F.col("scale"))
