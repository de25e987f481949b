"""Cross-validation folds by portable hashes, split roles, and checks of splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.expr import bucket, col

N_FOLDS = 5


def k_fold(df: DataFrame, key: str, n: int = N_FOLDS, salt: str = "") -> DataFrame:
    """Adds fold: keys in hashed order, in n parts whose sizes differ by one at most. The global rank is found from the counts of
    4096 ranges of the hash, so that no task orders more than one range."""
    h = bucket(key, 1 << 32, salt)
    rows = df.withColumn("_h", h).withColumn("_b", F.floor(F.col("_h") / (1 << 20)).cast("int"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_b").agg(F.count("*").alias("_c"))
    starts = starts.select("_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_s"), F.sum("_c").over(Window.partitionBy()).alias("_n"))
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("_h", key)) - 1
    rows = rows.join(F.broadcast(starts), "_b").withColumn("_r", F.col("_s") + rank)  # 4096 rows at most
    q, r = F.floor(F.col("_n") / n), F.col("_n") % n
    big = r * (q + 1)
    fold = F.when(F.col("_r") < big, F.floor(F.col("_r") / (q + 1))).otherwise(r + F.floor((F.col("_r") - big) / F.greatest(q, F.lit(1))))
    return rows.withColumn("fold", fold.cast("int")).drop("_h", "_b", "_s", "_n", "_r")


def group_k_fold(df: DataFrame, group: str, n: int = N_FOLDS, salt: str = "") -> DataFrame:
    """Whole groups to folds: the list of groups is shuffled by hash and split evenly."""
    groups = k_fold(df.select(group).distinct(), group, n, salt)
    return df.join(groups, group)


def role(fold: Column | str, held_out: int) -> Column:
    return F.when(col(fold) == held_out, "validation").otherwise("train")


def nested_role(outer: Column | str, inner: Column | str, held_out: int, n: int = N_FOLDS) -> Column:
    """test for the outer fold, validation for the inner fold that follows it, else train."""
    return F.when(col(outer) == held_out, "test").when(col(inner) == (held_out + 1) % n, "validation").otherwise("train")


def balanced_group_folds(df: DataFrame, group: str, n: int = N_FOLDS) -> DataFrame:
    """Group folds by size: groups from large to small are dealt out in snakes, so sizes stay close without a sequential rule."""
    sizes = df.groupBy(group).agg(F.count("*").alias("_n"))
    rank = F.row_number().over(Window.orderBy(F.desc("_n"), group)) - 1  # over groups, not rows
    lap, at = F.floor(rank / n), rank % n
    folds = sizes.withColumn("fold", F.when(lap % 2 == 0, at).otherwise(n - 1 - at).cast("int")).drop("_n")
    return df.join(folds, group)


def stratified_sample(df: DataFrame, band: str, key: str, n: int, salt: str = "sample") -> DataFrame:
    """n rows of each band without replacement, in hashed order."""
    w = Window.partitionBy(band).orderBy(bucket(key, 1 << 32, salt), key)
    return df.withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= n).drop("_i")
