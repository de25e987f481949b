"""The registry of runs: upsert, keys, identity, status; ensembles and out-of-fold tables."""

from __future__ import annotations

import os
import random
import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.expr import col, ratio
from tessera.operators.expectations import ExpectationError


def run_key(run: Column | str, endpoint: Column | str) -> Column:
    """NULL endpoints have an empty part."""
    return F.concat_ws("|", col(run).cast("string"), F.coalesce(col(endpoint).cast("string"), F.lit("")))


def relative_run(path: Column | str, root: str) -> Column:
    return F.regexp_replace(F.regexp_replace(col(path), f"^.*?{root}/", ""), "/[^/]*$", "")


def model_identity(model_id: Column | str, experiment: Column | str, run_name: Column | str) -> Column:
    """model_id, else experiment::run_name, else experiment; empty counts as missing."""
    present = lambda c: F.when(F.trim(col(c).cast("string")) != "", col(c).cast("string"))
    return F.coalesce(present(model_id), F.concat(present(experiment), F.lit("::"), present(run_name)), present(experiment))


def status(complete: Column, metrics: Column, age: Column, limit) -> Column:
    return F.when(complete & metrics, "completed").when(complete, "missing metrics").when(age > limit, "stale").otherwise("incomplete")


def _same(a: DataFrame, b: DataFrame, by: list[str], prefix: str) -> Column:
    return reduce(lambda x, y: x & y, (a[k].eqNullSafe(b[f"{prefix}{k}"]) for k in by))


def upsert(existing: DataFrame, current: DataFrame, keys: list[str], run: str | None = None, first_seen: str = "first_seen", order: str | None = None) -> DataFrame:
    """Current rows replace those of their key but keep the earlier first_seen; rows of other keys stay. With `run`, current holds
    all rows of the runs that it names: every old row of these runs goes, and runs that it doesn't name stay. With `order`, what is stored stays
    where its order is later than the current one's (of the key, or of all rows of the run); records may then arrive in any order, and only an
    earlier first_seen is taken over. NULL keys equal NULL keys. Columns that a side lacks are NULL. Upserting twice changes nothing."""
    by = [run] if run else keys
    late = None
    if order:
        new, old = (df.groupBy(*(F.col(k).alias(f"_by_{k}") for k in by)).agg(F.max(order).alias(name)) for df, name in ((current, "_new"), (existing, "_old")))
        old = old.withColumnsRenamed({f"_by_{k}": f"_of_{k}" for k in by})
        late = new.join(old, reduce(lambda x, y: x & y, (F.col(f"_by_{k}").eqNullSafe(F.col(f"_of_{k}")) for k in by))).filter(F.col("_old") > F.col("_new")).select(*(f"_by_{k}" for k in by))
        seen = current.groupBy(*(F.col(k).alias(f"_key_{k}") for k in keys)).agg(F.min(first_seen).alias("_first"))
        existing = existing.join(seen, _same(existing, seen, keys, "_key_"), "left").withColumn(first_seen, F.least(first_seen, "_first")).select(existing.columns)
        current = current.join(late, _same(current, late, by, "_by_"), "left_anti")
    known = existing.groupBy(*(F.col(k).alias(f"_key_{k}") for k in keys)).agg(F.min(first_seen).alias("_first"))
    fresh = current.join(known, _same(current, known, keys, "_key_"), "left")
    fresh = fresh.withColumn(first_seen, F.coalesce(F.least("_first", first_seen), "_first", first_seen)).select(current.columns)
    renewed = current.select(*(F.col(k).alias(f"_new_{k}") for k in by)).distinct()
    kept = existing.join(renewed, _same(existing, renewed, by, "_new_"), "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


class Conflict(RuntimeError):
    """Another writer committed the version first."""


def _commits(spark: SparkSession, path: str) -> list[int]:
    fs, at = _files(spark, f"{path}/commit-*")
    return sorted(int(f.getPath().getName().split("-")[1]) for f in fs.globStatus(at) or [])


def _folder_of(spark: SparkSession, path: str, number: int) -> str:
    fs, at = _files(spark, f"{path}/commit-{number:012d}")
    stream = fs.open(at)
    try:
        return f"{path}/{stream.readLine()}"
    finally:
        stream.close()


def _put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Whether the file came to be with this text; never if it is there, and never with a part of the text. A written file is renamed, which stores
    refuse where the target exists; Hadoop's local files would overwrite, so there a link is made."""
    fs, at = _files(spark, path)
    _, draft = _files(spark, f"{path.rsplit('/', 1)[0]}/_draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.writeBytes(text)
    out.close()
    try:
        if fs.getScheme() == "file":
            os.link(draft.toUri().getPath(), at.toUri().getPath())
        else:
            context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration())
            context.rename(draft, at, spark.sparkContext._gateway.new_array(getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename"), 0))
        return True
    except FileExistsError:
        return False
    except Exception as e:
        if "AlreadyExists" not in str(e):
            raise
        return False
    finally:
        fs.delete(draft, False)


def replace_table(df: DataFrame, path: str, keep: int = 2, base: int | None = None) -> str:
    """Writes a new version beside the old ones, commits it under the number after `base` (the last one), and returns its path. The commit is one
    file that is put only if it is absent: whoever comes second, or read an older version, gets a Conflict and leaves nothing. A writer that dies
    leaves a folder that no commit names, and nobody waits for it. Readers see whole versions only. The folders of all but the last `keep`
    versions are deleted; the commits, a line each, stay, so that no number is ever taken twice."""
    spark = df.sparkSession
    fs, at = _files(spark, path)
    fs.mkdirs(at)
    before = _commits(spark, path)
    number = (base if base is not None else before[-1] if before else -1) + 1
    folder = f"version-{number:012d}-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    if not _put_if_absent(spark, f"{path}/commit-{number:012d}", folder):
        fs.delete(_files(spark, f"{path}/{folder}")[1], True)
        raise Conflict(f"{path} has a version {number} already")
    for old in [n for n in before if n <= number - keep][-8:]:  # earlier ones are gone
        fs.delete(_files(spark, _folder_of(spark, path, old))[1], True)
    return f"{path}/{folder}"


def read_version(spark: SparkSession, path: str) -> tuple[int, DataFrame | None]:
    """Number and rows of the last version; -1 and None if there is none yet."""
    found = _commits(spark, path)
    return (found[-1], spark.read.parquet(_folder_of(spark, path, found[-1]))) if found else (-1, None)


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    return read_version(spark, path)[1]


def update_table(spark: SparkSession, path: str, change: Callable[[DataFrame | None], DataFrame], attempts: int = 20, keep: int = 2) -> str:
    """Read, change and replace; done again on the newer version if another writer was faster. What the change raises is raised, and the
    table stays."""
    for attempt in range(attempts):
        number, old = read_version(spark, path)
        try:
            return replace_table(change(old), path, keep, number)
        except Conflict:
            time.sleep(random.uniform(0, 0.05 * (attempt + 1)))
        except Exception:
            if number == read_version(spark, path)[0]:
                raise  # else the folder that was read may have been deleted by later versions
    raise Conflict(f"{path}: {attempts} attempts were overtaken")


def with_cv(rows: DataFrame, group: list[str], score: str, fold: str = "fold") -> DataFrame:
    """The registry with each row's cross-validation columns: cv_n, cv_mean, cv_sd and cv_folds of the rows of its group that have a score. To be put on
    behind every upsert; columns of these names are replaced. NULL keys are a group."""
    rows = rows.drop("cv_n", "cv_mean", "cv_sd", "cv_folds")
    v = F.col(score)
    g = rows.groupBy(*(F.col(k).alias(f"_cv_{k}") for k in group)).agg(
        F.count(v).alias("cv_n"), F.avg(v).alias("cv_mean"), F.stddev_samp(v).alias("cv_sd"), F.countDistinct(F.when(v.isNotNull(), F.col(fold))).alias("cv_folds")
    )
    return rows.join(g, _same(rows, g, group, "_cv_"), "left").drop(*(f"_cv_{k}" for k in group))


def merge_sources(tables: dict[str, DataFrame], keys: list[str], value: str, check: bool = True) -> DataFrame:
    """One row for each key with a column for each source: one union and one aggregation, however many sources. Keys that a source lacks raise."""
    rows = reduce(DataFrame.unionByName, (df.select(*keys, F.lit(n).alias("_s"), F.col(value).alias("_v")) for n, df in tables.items()))
    out = rows.groupBy(*keys).agg(F.count("*").alias("_n"), *(F.max(F.when(F.col("_s") == n, F.col("_v"))).alias(n) for n in tables))
    if check and out.filter(F.col("_n") != len(tables)).take(1):
        raise ExpectationError("the sources cover other keys")
    return out.drop("_n")


def seed_mean(pred: DataFrame, keys: list[str], value: str = "p") -> DataFrame:
    return pred.groupBy(*keys).agg(F.avg(value).alias(value), F.count("*").alias("seeds"))


def ensemble_mean(pred: DataFrame, keys: list[str], model: str = "model", value: str = "p") -> DataFrame:
    """Mean over models of each model's mean over seeds."""
    return pred.groupBy(*keys, model).agg(F.avg(value).alias(value)).groupBy(*keys).agg(F.avg(value).alias(value), F.count("*").alias("members"))


def ensemble_weights(scores: DataFrame, model: str = "model", score: str = "score") -> DataFrame:
    """model, weight: inverse scores that sum to 1; members of score 0 share all."""
    n_zero = F.sum(F.when(F.col(score) == 0, 1.0).otherwise(0.0))
    total = scores.agg(n_zero.alias("_z"), F.sum(F.when(F.col(score) > 0, 1 / F.col(score))).alias("_t"))
    zero = F.when(F.col(score) == 0, ratio(F.lit(1.0), "_z")).otherwise(0.0)
    weight = F.when(F.col("_z") > 0, zero).otherwise(ratio(ratio(F.lit(1.0), score), "_t"))
    return scores.join(F.broadcast(total)).select(model, weight.alias("weight"))  # one row


def ensemble_weighted(pred: DataFrame, weights: DataFrame, keys: list[str], model: str = "model", value: str = "p") -> DataFrame:
    means = pred.groupBy(*keys, model).agg(F.avg(value).alias(value)).join(weights, model)
    return means.groupBy(*keys).agg(ratio(F.sum(F.col(value) * F.col("weight")), F.sum("weight")).alias(value))


def seed_coverage(pred: DataFrame, keys: list[str], seed: str = "seed") -> DataFrame:
    """For each seed: rows, and keys of the union that it lacks."""
    all_keys = pred.select(*keys).distinct().agg(F.count("*").alias("_all"))
    g = pred.groupBy(seed).agg(F.count("*").alias("n"), F.count_distinct(F.struct(*keys)).alias("_k"))
    return g.join(F.broadcast(all_keys)).select(seed, "n", (F.col("_all") - F.col("_k")).alias("missing"))  # one row


