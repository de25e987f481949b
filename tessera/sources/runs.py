"""Prediction rows of run folders, paired with their run's metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.expr import nan_to_null


def _folder() -> Column:
    """Of the file that a row comes from; Spark gives its path as a URI."""
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(path, "/[^/]*$", "")


def run_metadata(spark: SparkSession, root: str, schema: T.StructType | str, name: str = "metadata.json") -> DataFrame:
    """run_dir and the metadata (one JSON object a file, plain or .gz) of every folder below root that has some. Several in a folder raise."""
    reader = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", f"{name}{{,.gz}}")
    rows = reader.json(root).select(_folder().alias("run_dir"), "*")
    fields = [c for c in rows.columns if c != "run_dir"]
    g = rows.groupBy("run_dir").agg(F.count("*").alias("_n"), F.first(F.struct(*fields)).alias("_m"))
    several = F.raise_error(F.concat(F.lit("several metadata files in "), "run_dir")).cast("string")
    return g.select(F.when(F.col("_n") > 1, several).otherwise(F.col("run_dir")).alias("run_dir"), *(F.col(f"_m.{c}").alias(c) for c in fields))


def read_runs(
    spark: SparkSession, root: str, schema: T.StructType | str, metadata_schema: T.StructType | str, where: Column | None = None, predictions: str = "predictions.csv", metadata: str = "metadata.json",
) -> DataFrame:
    """The prediction rows (CSV with a header, plain or .gz; NaN is NULL) of all runs below root: run_dir, their columns, their run's metadata as the struct
    `metadata` (NULL if it has none). `where` is a condition on the metadata's columns: the metadata are read first, and of the predictions only
    the folders that satisfy it are listed and read. Their names, as many as Spark lists for any read, are all that reaches the driver."""
    about = run_metadata(spark, root, metadata_schema, metadata)
    fields = [c for c in about.columns if c != "run_dir"]
    reader = spark.read.schema(schema).option("header", True).option("nanValue", "nan").option("pathGlobFilter", f"{predictions}{{,.gz}}")
    if where is None:
        rows = reader.option("recursiveFileLookup", True).csv(root)
    else:
        about = about.filter(where)
        folders = [r.run_dir for r in about.select("run_dir").collect()]
        rows = reader.csv(folders) if folders else reader.option("recursiveFileLookup", True).csv(root).filter(F.lit(False))
    rows = nan_to_null(rows.select(_folder().alias("run_dir"), "*"))
    about = about.select(F.col("run_dir").alias("_dir"), F.struct(*fields).alias("metadata"))
    return rows.join(about, F.col("run_dir") == F.col("_dir"), "left").drop("_dir")
