"""What the operators of this subpackage share: work folder, intermediate tables, Arrow batches."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python function handles at once.
CHUNK_BYTES = 4 << 20


def work_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where none is set, a folder of the warehouse if all runs on this machine; a cluster must set one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"


#: Paths of the tables that stored() made and that were not dropped.
_made: list[str] = []


def stored(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read back: the lineage is cut, the planner knows its size,
    and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/tessera-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    _made.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop_stored(*tables: DataFrame) -> None:
    """Deletes tables made by stored() that no later plan reads."""
    for df in tables:
        path = getattr(df, "_tessera_path", None)
        if path in _made:
            _made.remove(path)
            _delete(df.sparkSession, path)


def finished(spark: SparkSession, build: Callable[[], DataFrame], *read: DataFrame) -> DataFrame:
    """build() as a stored table, without the tables that were stored on the way, nor those that it read. If it fails, what was stored on the
    way goes too. One thread at a time."""
    before, out = set(_made), None
    try:
        out = stored(build())
        return out
    finally:
        for path in [p for p in _made if p not in before and p != getattr(out, "_tessera_path", None)]:
            _made.remove(path)
            _delete(spark, path)
        if out is not None:
            drop_stored(*read)


def bound_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches hold CHUNK_BYTES at most (or one row), if they could hold more."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).rstrip("bB")
    if not (now.isdigit() and 0 < int(now) <= CHUNK_BYTES):
        spark.conf.set(key, str(CHUNK_BYTES))


def release(spark: SparkSession) -> None:
    """Deletes all tables that stored() made in this application; results that were not written are lost."""
    _made.clear()
    _delete(spark, f"{work_dir(spark)}/tessera-{spark.sparkContext.applicationId}")


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """doc_id, and the text as UTF-8 bytes (null stays null); other columns of the table do not matter."""
    bound_batches(df.sparkSession)
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"), *more)


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `limit` bytes of that column, one row at least."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size, dtype=np.int64) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def give_back() -> None:
    """Returns to the system what this process freed. Spark's Python workers live on from task to task, and what they hold counts for the
    executor. Nothing where the C library has no such call."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def doc_id_type(df: DataFrame, id_col: str = "doc_id") -> str:
    return dict(df.dtypes)[id_col]
