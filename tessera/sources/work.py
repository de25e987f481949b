"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where none is set, a folder of the warehouse if all runs on this machine; a cluster must set one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: computed once, its size is known to the planner, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/tessera-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def _delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_stored(table: DataFrame) -> None:
    """Deletes a table made by stored() that no later plan reads."""
    _delete(table.sparkSession, table._tessera_path)


def release(spark: SparkSession) -> None:
    """Deletes all tables that stored() made in this application; results that were not written are lost."""
    _delete(spark, f"{work_dir(spark)}/tessera-{spark.sparkContext.applicationId}")
