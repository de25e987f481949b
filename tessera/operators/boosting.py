"""Boosted trees with absolute loss, many models at once.

All models (one for each value of the keys: an endpoint, a held-out fold, ...) grow together. A level of a tree is one job for all of them: counts and
sums of gradients by (keys, node, feature, bin), pre-aggregated, from which each node takes its best split. Features are binned once, at approximate
quantiles of each model's training rows. Leaves move by the median residual of their training rows. A model that has not improved its
validation rows for `patience` trees stops, and keeps its best state; the others go on. Splits and leaves, a row a node, pass through the driver;
rows never do. Between trees the rows' predictions are a stored table, which replaces the
last tree's.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.work import drop_stored, stored


def _local(spark, like: DataFrame, keys: list[str], rows: list[tuple], more: str) -> DataFrame:
    """A small table of what the driver knows by keys; joins broadcast it."""
    kinds = [f"`{k}` {like.schema[k].dataType.simpleString()}" for k in keys]
    return spark.createDataFrame(rows, ", ".join([*kinds, more]))


def _best_splits(hist: DataFrame, keys: list[str], least: int) -> DataFrame:
    """keys, _node, s (gain, feature and bin, negated): the best split of each node into bins up to one and beyond; ties to the smaller feature, then
    bin. The gain of a split is how much the squared sums of gradients by row grow."""
    up_to = Window.partitionBy(*keys, "_node", "feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys, "_node", "feature")
    left, n_left = F.sum("g").over(up_to), F.sum("n").over(up_to)
    rows = hist.select(*keys, "_node", "feature", "bin", left.alias("gl"), n_left.alias("nl"), F.sum("g").over(whole).alias("g"), F.sum("n").over(whole).alias("n"))
    rows = rows.filter((F.col("nl") >= least) & (F.col("n") - F.col("nl") >= least))
    right = F.col("g") - F.col("gl")
    gain = F.col("gl") * F.col("gl") / F.col("nl") + right * right / (F.col("n") - F.col("nl")) - F.col("g") * F.col("g") / F.col("n")
    rows = rows.withColumn("gain", gain).filter(F.col("gain") > 1e-9)
    return rows.groupBy(*keys, "_node").agg(F.max(F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"))).alias("s"))


def boosted(
    df: DataFrame, keys: list[str], features: list[str], role: str = "role", y: str = "y", trees: int | None = 20, depth: int = 3, bins: int = 16, rate: float = 0.2, least: int = 10,
    patience: int = 5, accuracy: int = 10_000, seen: dict | None = None,
) -> DataFrame:
    """df's rows of models that have training rows, with the prediction p. role: train, valid, or anything else for rows that are only predicted. A feature's
    NULL is a bin below all others; rows without y are only predicted. Models without validation rows take all trees. trees: None sets no number, a model
    grows until `patience` trees have not improved its validation rows (or, if it has none, its training rows). seen: is given the number of jobs that
    levels took."""
    spark, n_jobs = df.sparkSession, 0
    train, valid = ((F.col(role) == r) & F.col(y).isNotNull() for r in ("train", "valid"))
    at = [i / bins for i in range(1, bins)]
    fit = df.filter(train).groupBy(*keys).agg(*(F.percentile_approx(F.col(f).cast("double"), at, accuracy).alias(f"_e{i}") for i, f in enumerate(features)), F.percentile_approx(F.col(y).cast("double"), 0.5, accuracy).alias("_base"))

    def binned(i: int, feature: str):
        return F.when(F.col(feature).isNull(), -1).otherwise(F.size(F.filter(F.array_distinct(f"_e{i}"), lambda e: e < F.col(feature))))

    state = table = stored(df.join(fit, keys).select(*df.columns, F.array(*(binned(i, f) for i, f in enumerate(features))).alias("_b"), F.col("_base").alias("_f"), F.col("_base").alias("_best")))
    residual = F.col(y).cast("double") - F.col("_f")

    def losses() -> dict[tuple, float]:
        of = lambda rows: F.avg(F.when(rows, F.abs(residual)))
        found = state.groupBy(*keys).agg((of(valid) if trees is not None else F.coalesce(of(valid), of(train))).alias("loss")).filter("loss IS NOT NULL")
        return {tuple(r[k] for k in keys): r["loss"] for r in found.collect()}

    best, since = losses(), {}
    active = [tuple(r) for r in state.select(*keys).distinct().collect()]  # a row for each model
    checked = set(best)
    for _ in itertools.count() if trees is None else range(trees):
        if not active:
            break
        rows = state.join(F.broadcast(_local(spark, df, keys, [(*k, 1) for k in active], "_node int")), keys, "left")
        for _ in range(depth):
            cells = rows.filter(train & F.col("_node").isNotNull()).select(*keys, "_node", F.signum(residual).alias("g"), F.posexplode("_b").alias("feature", "bin"))
            hist = cells.groupBy(*keys, "_node", "feature", "bin").agg(F.sum("g").alias("g"), F.count("*").alias("n"))
            found = _best_splits(hist, keys, least).collect()  # a row for each node
            n_jobs += 1
            if not found:
                break
            splits = _local(spark, df, keys, [(*(r[k] for k in keys), r["_node"], -r["s"]["f"], -r["s"]["b"]) for r in found], "_node int, _feature int, _bin int")
            rows = rows.join(F.broadcast(splits), [*keys, "_node"], "left")
            side = F.when(F.element_at("_b", F.col("_feature") + 1) > F.col("_bin"), 1).otherwise(0)
            rows = rows.withColumn("_node", F.when(F.col("_feature").isNull(), F.col("_node") * 2).otherwise(F.col("_node") * 2 + side)).drop("_feature", "_bin")
        leaves = rows.filter(train & F.col("_node").isNotNull()).groupBy(*keys, "_node").agg(F.percentile_approx(residual, 0.5, accuracy).alias("v")).collect()  # a row for each leaf
        moved = _local(spark, df, keys, [(*(r[k] for k in keys), r["_node"], rate * r["v"]) for r in leaves], "_node int, _move double")
        rows = rows.join(F.broadcast(moved), [*keys, "_node"], "left").withColumn("_f", F.col("_f") + F.coalesce("_move", F.lit(0.0)))
        state = stored(rows.select(*df.columns, "_b", "_f", "_best"))
        drop_stored(table)
        table = state
        now = losses() if checked else {}
        better = [k for k in active if k not in checked or now[k] < best[k]]
        best |= {k: now[k] for k in better if k in checked}
        since |= {k: 0 if k in better else since.get(k, 0) + 1 for k in active}
        if better:
            kept = _local(spark, df, keys, [(*k, True) for k in better], "_new boolean")
            state = state.join(F.broadcast(kept), keys, "left").withColumn("_best", F.when(F.col("_new"), F.col("_f")).otherwise(F.col("_best"))).drop("_new")
        active = [k for k in active if since[k] < patience]
    if seen is not None:
        seen["level_jobs"] = n_jobs
    return state.select(*df.columns, F.col("_best").alias("p"))
