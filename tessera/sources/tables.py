"""Tables: scans with NULL for NaN, tagged unions, run artefacts, provenance, and the sinks of results."""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.expr import nan_to_null
from tessera.operators.expectations import require_columns


class Tables:
    """The tables of a folder as attributes; columns are pruned and filters pushed down by what reads them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return nan_to_null(self.raw(name))

    def raw(self, name: str) -> DataFrame:
        """The table as it is stored: filters on its floats reach the files, but NaN must be left out by hand."""
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, columns: list[str] | None = None) -> DataFrame:
    """CSV with a header; NaN cells are NULL. Without a schema types are inferred, which reads the data twice."""
    reader = spark.read.option("header", True).option("nanValue", "nan")
    df = nan_to_null((reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path))
    return df.select(*columns) if columns else df


def read_json_objects(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """One JSON object per file; .gz files are read as they are."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def discover_runs(spark: SparkSession, root: str, predictions: str = "predictions.csv", metadata: str = "metadata.json", schema: T.StructType | str | None = None) -> DataFrame:
    """run_dir, has_predictions, has_metadata of every folder below root that holds either file. Only names are read."""

    def dirs(name: str) -> DataFrame:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(root)
        return files.select(F.regexp_replace("path", "/[^/]*$", "").alias("run_dir"))

    a = dirs(predictions).withColumn("has_predictions", F.lit(True))
    b = dirs(metadata).withColumn("has_metadata", F.lit(True))
    return a.join(b, "run_dir", "full_outer").select("run_dir", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("has_predictions", "has_metadata")))


def file_provenance(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """name, bytes and SHA-256 of every file of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return files.select(F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def canonical_json(entries) -> "F.Column":
    """A map column as JSON with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries))))


def cached(spark: SparkSession, path: str, settings: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """The table that was written for these settings, else build() written there. Each settings have a folder of their own, named by
    their hash; it counts when it is complete, so a build that fails is done again and leaves those of other settings alone."""
    text = json.dumps(settings, sort_keys=True, separators=(",", ":"))
    folder = f"{path}/{hashlib.sha256(text.encode()).hexdigest()}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)


def load_config(path: str, overrides: dict | None = None) -> dict:
    """A YAML file with dotted overrides; override texts are YAML themselves."""
    import yaml

    config = yaml.safe_load(Path(path).read_text()) or {}
    for key, value in (overrides or {}).items():
        *above, last = key.split(".")
        at = config
        for k in above:
            at = at.setdefault(k, {})
            if not isinstance(at, dict):
                raise ValueError(f"{key}: {k} is no section")
        at[last] = yaml.safe_load(value) if isinstance(value, str) else value
    return config


def write_sorted_csv(df: DataFrame, path: str, by: list[str]) -> None:
    """A CSV in order; a missing sort column is an error. Files follow one another in the order."""
    require_columns(df, by)
    df.orderBy(*(F.col(c).asc_nulls_last() for c in by)).write.mode("overwrite").option("header", True).csv(path)


def write_atomic(data: bytes, path: str) -> None:
    """A driver-side file that is never seen half written."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    fd, name = tempfile.mkstemp(dir=folder, suffix=".part")
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(data)
        os.replace(name, path)
    except BaseException:
        with contextlib.suppress(FileNotFoundError):
            os.unlink(name)
        raise


def write_json_atomic(value, path: str) -> None:
    write_atomic(json.dumps(value, sort_keys=True, indent=1).encode(), path)


def append_events(df: DataFrame, path: str) -> None:
    """Adds rows to a JSON-lines log."""
    df.write.mode("append").json(path)
