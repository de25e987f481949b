"""Reports, and gates over run folders: small results only, on the driver."""

from __future__ import annotations

import math
import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import expectations, joins
from tessera.sources.tables import file_provenance


def cell(value, decimals: int = 3) -> str:
    """NA for what is missing or not finite; pipes are escaped."""
    if value is None or isinstance(value, float) and not math.isfinite(value):
        return "NA"
    if isinstance(value, bool):
        return str(value)
    return f"{value:,.{decimals}f}" if isinstance(value, float) else f"{value:,}" if isinstance(value, int) else str(value).replace("|", "\\|")


def markdown(df: DataFrame, limit: int = 200) -> str:
    """A Markdown table of an aggregated result; more rows than `limit` are an error, not cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows are no report")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in rows])


PRIORITIES = ("Critical", "High", "Medium", "Low")


def findings(*rows: tuple[str, DataFrame, str, str]) -> DataFrame:
    """analysis, finding, implication, priority, by priority and analysis; a finding is the one cell of an aggregate."""
    known = [(name, df.toDF("finding"), implication, priority) for name, df, implication, priority in rows if priority in PRIORITIES]
    if len(known) < len(rows):
        raise ValueError(f"priorities are {', '.join(PRIORITIES)}")
    parts = [df.select(F.lit(name).alias("analysis"), "finding", F.lit(implication).alias("implication"), F.lit(priority).alias("priority")) for name, df, implication, priority in known]
    return reduce(DataFrame.unionByName, parts).orderBy(F.array_position(F.array(*map(F.lit, PRIORITIES)), F.col("priority")), "analysis")


def same_in_order(a: DataFrame, b: DataFrame, ordinal: str) -> bool:
    """Whether two tables hold the same rows at the same ordinals: when a cached table may be used again."""
    keys = [ordinal, *(c for c in a.columns if c != ordinal)]
    return a.columns == b.columns and not expectations.key_difference(a, b, keys).take(1)


def changed_files(recorded: DataFrame, found: DataFrame) -> DataFrame:
    """name and what happened (changed, missing, new) of files whose SHA-256 differs between two provenance tables."""
    both = joins.reconcile(recorded.select("name", F.col("sha256").alias("was")), found.select("name", F.col("sha256").alias("now")), ["name"])
    what = F.when(F.col("side") == "left_only", "missing").when(F.col("side") == "right_only", "new").when(F.col("was") != F.col("now"), "changed")
    return both.select("name", what.alias("change")).filter("change IS NOT NULL")


def incomplete_tables(spark: SparkSession, expected: dict[str, tuple[list[str], int]]) -> list[str]:
    """What is wrong with the tables of {path: (columns, least rows)}."""
    problems = []
    for path, (columns, least) in expected.items():
        try:
            df = spark.read.parquet(path)
        except Exception:  # noqa: BLE001  whatever the reader says, the table is not there
            problems.append(f"{path}: cannot be read")
            continue
        missing = [c for c in columns if c not in df.columns]
        if missing:
            problems.append(f"{path}: no {', '.join(missing)}")
        elif df.limit(least).count() < least:
            problems.append(f"{path}: fewer than {least} rows")
    return problems


def output_problems(spark: SparkSession, expected: dict[str, tuple[list[str], int]], folder: str | None = None, recorded: DataFrame | None = None) -> list[str]:
    """incomplete_tables, and the files of a folder whose SHA-256 is not the recorded one."""
    problems = incomplete_tables(spark, expected)
    if recorded is not None:
        changed = changed_files(recorded, file_provenance(spark, folder)).orderBy("name").collect()  # a row for each file
        problems += [f"{r['name']}: {r['change']}" for r in changed]
    return problems


def marker_problems(run_dir: str) -> list[str]:
    """A folder marked COMPLETED must hold metadata that says so, and predictions."""
    has = lambda name: os.path.exists(os.path.join(run_dir, name))
    if not has("COMPLETED"):
        return ["marked nowhere"] if has("predictions.csv") else []
    return [f"COMPLETED without {n}" for n in ("metadata.json", "predictions.csv") if not has(n)]


def preflight(files: list[str], writable: list[str], config: dict, required: list[str], checks: DataFrame | None = None, checkpoint: dict[str, tuple[list[str], int]] | None = None) -> list[str]:
    """All that stands in the way of a run, not the first thing only: files, folders, settings, the data's and folds' checks (a table of
    results), and the checkpoint's tables."""
    problems = [f"{f}: missing" for f in files if not os.path.exists(f)]
    problems += [f"{d}: not writable" for d in writable if not os.access(d, os.W_OK)]
    for key in required:
        at = config
        for part in key.split("."):
            at = at.get(part) if isinstance(at, dict) else None
        if at is None:
            problems.append(f"{key}: not set")
    if checks is not None:
        bad = checks.filter("violations > 0").orderBy("check").collect()  # a row for each check
        problems += [f"{r['check']}: {r['violations']} rows" for r in bad]
    if checkpoint:
        problems += [f"checkpoint {p}" for p in incomplete_tables(SparkSession.active(), checkpoint)]
    return problems
