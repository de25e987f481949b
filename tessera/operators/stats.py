"""Association and shift statistics. Ranks come from ranks.py."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.expr import pearson, ratio
from tessera.operators import ranks
from tessera.operators.scan import Carried, Line


def pairwise_complete(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """x_name, y_name, x, y of every pair of columns, rows that have both."""
    rows = F.inline(F.array(*(F.struct(F.lit(a).alias("x_name"), F.lit(b).alias("y_name"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a, b in pairs)))
    return df.select(rows).filter("x IS NOT NULL AND y IS NOT NULL")


def pearson_table(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    return pairwise_complete(df, pairs).groupBy("x_name", "y_name").agg(F.count("*").alias("n"), pearson("x", "y").alias("r"))


def spearman_by(rows: DataFrame, by: list[str], x: str, y: str, least: int = 3, ranges: int = 1) -> DataFrame:
    """n and rho for each group; ranks are over the group's complete rows."""
    rows = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    rows = ranks.average_rank(ranks.average_rank(rows, by, x, "_rx", ranges), by, y, "_ry", ranges)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), pearson("_rx", "_ry", least).alias("rho"))


def spearman_table(df: DataFrame, pairs: list[tuple[str, str]], ranges: int = 1) -> DataFrame:
    return spearman_by(pairwise_complete(df, pairs), ["x_name", "y_name"], "x", "y", ranges=ranges)


def partial_spearman(rows: DataFrame, by: list[str], x: str, y: str, z: str, ranges: int = 1) -> DataFrame:
    """Rank correlation of x and y with z held: the correlation of the residuals, in closed form. Five rows at least."""
    rows = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(z).isNotNull())
    for c in (x, y, z):
        rows = ranks.average_rank(rows, by, c, f"_r_{c}", ranges)
    r = lambda a, b: pearson(f"_r_{a}", f"_r_{b}")
    g = rows.groupBy(*by).agg(F.count("*").alias("n"), r(x, y).alias("xy"), r(x, z).alias("xz"), r(y, z).alias("yz"))
    rest = F.sqrt((1 - F.col("xz") * F.col("xz")) * (1 - F.col("yz") * F.col("yz")))
    return g.select(*by, "n", F.when(F.col("n") >= 5, ratio(F.col("xy") - F.col("xz") * F.col("yz"), rest)).alias("rho"))


def mann_whitney(df: DataFrame, by: list[str], value: str, first: Column, ranges: int = 1) -> DataFrame:
    """n1, n2 and U of the rows for which `first` holds, against the others."""
    t = ranks.value_counts(df.withColumn("_1", first), by, value, F.count_if("_1").alias("n1"))
    t = Line(t, by, [value], ranges).carry(_up_to=Carried("sum", F.col("n"))).done()
    t = t.withColumn("_r", F.col("_up_to") - (F.col("n") - 1) / F.lit(2.0))
    n1 = F.sum("n1")
    return t.groupBy(*by).agg(n1.alias("n1"), F.sum(F.col("n") - F.col("n1")).alias("n2"), (F.sum(F.col("n1") * F.col("_r")) - n1 * (n1 + 1) / F.lit(2.0)).alias("u"))


def kruskal_wallis(df: DataFrame, by: list[str], value: str, group: str, ranges: int = 1) -> DataFrame:
    """groups, n and H with its correction for ties."""
    table = ranks.rank_table(df, by, value, "_r", ranges)
    rows = df.filter(F.col(value).isNotNull()).groupBy(*by, group, value).agg(F.count("*").alias("m")).join(table, [*by, value])
    sums = rows.groupBy(*by, group).agg(F.sum("m").cast("double").alias("m"), F.sum(F.col("m") * F.col("_r")).alias("t"))
    h = sums.groupBy(*by).agg(F.count("*").alias("groups"), F.sum("m").alias("n"), F.sum(F.col("t") * F.col("t") / F.col("m")).alias("s"))
    n = F.col("n").cast("double")
    ties = table.groupBy(*by).agg(F.sum(n * n * n - n).alias("ties"))
    h = h.join(ties, by) if by else h.join(F.broadcast(ties))  # one row
    raw = F.lit(12.0) / (n * (n + 1)) * F.col("s") - 3 * (n + 1)
    return h.select(*by, "groups", n.cast("long").alias("n"), ratio(raw, 1 - ratio("ties", n * n * n - n)).alias("h"))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, chi2 and Cramer's V over the full grid of both columns' values (NULL for fewer than two columns).

    Cells that are empty add (0 - E)^2 / E = E; their sum is n less the expectations of the others, so no grid is built."""
    cells = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").cast("double").alias("o"))
    ra, rb = cells.groupBy(a).agg(F.sum("o").alias("ra")), cells.groupBy(b).agg(F.sum("o").alias("rb"))
    total = ra.agg(F.sum("ra").alias("n"), F.count("*").alias("ka")).join(rb.agg(F.count("*").alias("kb")))  # one row each
    full = cells.join(ra, a).join(rb, b).join(F.broadcast(total))
    e = F.col("ra") * F.col("rb") / F.col("n")
    d = F.col("o") - e
    g = full.agg(F.max("n").alias("n"), (F.sum(d * d / e) + F.max("n") - F.sum(e)).alias("chi2"), F.max("ka").alias("ka"), F.max("kb").alias("kb"))
    v = F.sqrt(ratio("chi2", F.col("n") * F.greatest(F.least("ka", "kb") - 1, F.lit(1))))
    return g.select(F.col("n").cast("long").alias("n"), "chi2", F.when(F.col("kb") >= 2, v).alias("v"))


def ks_and_wasserstein(df: DataFrame, by: list[str], value: str, second: Column, ranges: int = 1) -> DataFrame:
    gaps = ranks.ecdf_gaps(df, by, value, second, ranges)
    width = F.col("next") - F.col(value)
    return gaps.groupBy(*by).agg(F.max(F.abs("gap")).alias("ks"), F.sum(F.abs("gap") * width).alias("w1"))


def smd(df: DataFrame, by: list[str], value: str, second: Column) -> DataFrame:
    """Standardised difference of means, second less first, by the pooled sd; 0 where that is 0."""
    v = F.col(value)
    a, b = F.when(~second, v), F.when(second, v)
    na, nb = F.count(a), F.count(b)
    pooled = F.sqrt(((na - 1) * F.coalesce(F.var_samp(a), F.lit(0.0)) + (nb - 1) * F.coalesce(F.var_samp(b), F.lit(0.0))) / F.greatest(na + nb - 2, F.lit(1)))
    return df.groupBy(*by).agg(na.alias("n_a"), nb.alias("n_b"), F.when(pooled == 0, 0.0).otherwise(ratio(F.avg(b) - F.avg(a), pooled)).alias("smd"))


def shift(df: DataFrame, by: list[str], value: str, second: Column, ranges: int = 1) -> DataFrame:
    """smd, ks and w1 of each group between two samples."""
    return smd(df, by, value, second).join(ks_and_wasserstein(df, by, value, second, ranges), by)


def confusion(df: DataFrame, by: list[str], truth: Column, predicted: Column) -> DataFrame:
    """Counts, accuracy, precision, recall, F1 and Matthews correlation."""
    t, p = F.coalesce(truth, F.lit(False)), F.coalesce(predicted, F.lit(False))
    g = df.groupBy(*by).agg(*(F.count_if(c).cast("double").alias(n) for n, c in (("tp", t & p), ("fp", ~t & p), ("fn", t & ~p), ("tn", ~t & ~p))))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return g.select(
        *by, *(F.col(c).cast("long").alias(c) for c in ("tp", "fp", "fn", "tn")), ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))).alias("mcc"),
    )


def normal_p(z: Column) -> Column:
    """Two-sided p-value of a standard normal statistic, by a rational approximation of erfc (relative error below 1.2e-7)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + x / 2)
    # Coefficients of the Chebyshev fit of erfc.
    fit = F.lit(0.0)
    for c in (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        fit = fit * t + c
    return F.least(F.lit(1.0), t * F.exp(-x * x + fit))


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation by Fisher's transform, from four rows on."""
    bounded = F.greatest(F.least(r, F.lit(1 - 1e-15)), F.lit(-1 + 1e-15))
    return F.when(n > 3, normal_p(F.atanh(bounded) * F.sqrt(n - 3)))


def mann_whitney_p(u: Column, n1: Column, n2: Column) -> Column:
    """Two-sided p-value by the normal approximation, without a correction for ties."""
    n1, n2 = n1.cast("double"), n2.cast("double")  # the product of three counts is beyond a long from some millions of rows on
    sd = F.sqrt(n1 * n2 * (n1 + n2 + 1) / F.lit(12.0))
    return normal_p(ratio(u - n1 * n2 / F.lit(2.0), sd))
