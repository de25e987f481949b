"""Models by endpoint: boosted trees, and the interface for estimators that come from elsewhere."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.expr import finite
from tessera.operators.joins import validated_join
from tessera.operators.reshape import pivot_values

#: A featuriser takes a pandas frame with the input columns and returns one with the feature columns added; it runs in
#: mapInPandas, so it may use any library that the executors have.
Featuriser = Callable[["object"], "object"]


def featurise(df: DataFrame, featuriser: Featuriser, schema: str) -> DataFrame:
    """Rows through an external featuriser, Arrow batch by batch."""

    def run(batches):
        for batch in batches:
            yield featuriser(batch)

    return df.mapInPandas(run, schema)


def export_wide(df: DataFrame, keys: list[str], endpoint: str, value: str, names: list, path: str) -> None:
    """The training table that an external model reads: one row for each key, a column for each endpoint; CSV with a header."""
    pivot_values(df, keys, endpoint, value, names, f"{value}_").write.mode("overwrite").option("header", True).csv(path)


def join_predictions(df: DataFrame, predictions: DataFrame, keys: list[str], p: str = "p") -> DataFrame:
    """df with what an external model predicted. Repeated keys raise, and so do rows of df without a finite prediction, when they are read."""
    out = validated_join(df, predictions.select(*keys, F.col(p).cast("double").alias(p)), keys, "left", "many_to_one")
    missing = F.concat(F.lit("no prediction of "), F.to_json(F.struct(*keys)))
    return out.withColumn(p, F.when(finite(p), F.col(p)).otherwise(F.raise_error(missing).cast("double")))


def fit_predict(df: DataFrame, features: list[str], held_out: int, trees: int = 10, depth: int = 3, endpoint: str = "endpoint", endpoints: list | None = None) -> DataFrame:
    """Predictions p of the held-out fold's rows, by a gradient-boosted regressor for each endpoint fit on the other folds with
    absolute loss. Endpoints are few, and found by a job if not given; each fit is distributed."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    rows = VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="skip").transform(df)
    out = None
    for e in sorted(r[endpoint] for r in df.select(endpoint).distinct().collect()) if endpoints is None else endpoints:
        own = rows.filter(F.col(endpoint) == e)
        model = GBTRegressor(featuresCol="_features", labelCol="y", predictionCol="p", lossType="absolute", maxIter=trees, maxDepth=depth, seed=42).fit(own.filter(F.col("fold") != held_out))
        predicted = model.transform(own.filter(F.col("fold") == held_out)).drop("_features")
        out = predicted if out is None else out.unionByName(predicted)
    return out
