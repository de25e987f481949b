"""Between wide and long forms."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.scan import Carried, Line


def pivot_values(df: DataFrame, keys: list[str], name: str, value: str, names: list, prefix: str = "") -> DataFrame:
    """Long to wide with fixed columns: conditional aggregates, one shuffle, no job to find the names."""
    aggs = [F.max(F.when(F.col(name) == n, F.col(value))).alias(f"{prefix}{n}") for n in names]
    return df.groupBy(*keys).agg(*aggs)


def unpivot_values(df: DataFrame, keys: list[str], columns: list[str], name: str = "name", value: str = "value", keep_null: bool = False) -> DataFrame:
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias(name), F.col(c).alias(value)) for c in columns)))
    out = df.select(*keys, rows.alias("_r")).select(*keys, f"_r.{name}", f"_r.{value}")
    return out if keep_null else out.filter(F.col(value).isNotNull())


def unpivot_groups(df: DataFrame, keys: list[str], groups: dict, name: str = "endpoint") -> DataFrame:
    """Several parallel columns for each name: groups maps a name to {field: column}."""
    rows = [F.struct(F.lit(n).alias(name), *(F.col(c).alias(f) for f, c in fields.items())) for n, fields in groups.items()]
    return df.select(*keys, F.inline(F.array(*rows)))


def columns_like(df: DataFrame, prefix: str = "", suffix: str = "") -> list[str]:
    return [c for c in df.columns if c.startswith(prefix) and c.endswith(suffix)]


def conform(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """The columns of a schema in its order; absent ones are NULL, others are dropped."""
    return df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in schema.items()))


def symmetric(pairs: DataFrame, a: str, b: str, value: str, diagonal: Column) -> DataFrame:
    """All cells of a symmetric matrix, from its pairs."""
    other = pairs.select(F.col(b).alias(a), F.col(a).alias(b), value)
    ids = pairs.select(F.explode(F.array(a, b)).alias(a)).distinct()
    return pairs.select(a, b, value).unionByName(other).unionByName(ids.select(a, F.col(a).alias(b), diagonal.alias(value)))


def index_names(df: DataFrame, name: str, index: str) -> DataFrame:
    """Numbers the distinct names from 0 in their order (the vocabulary is ranked, not the rows)."""
    vocabulary = df.select(name).distinct().withColumn(index, F.dense_rank().over(Window.orderBy(name)) - 1)
    return df.join(vocabulary, name)


def concat_blocks(blocks: dict[str, tuple[Column, int]]) -> tuple[Column, Callable[[Column], Column]]:
    """The arrays of named blocks of fixed widths as one array, and the name of the block that holds a position."""
    ends = list(itertools.accumulate(n for _, n in blocks.values()))

    def block(position: Column) -> Column:
        out = None
        for name, end in zip(blocks, ends):
            out = (F if out is None else out).when(position < end, F.lit(name))
        return out

    return F.concat(*(c for c, _ in blocks.values())), block


def offsets(df: DataFrame, by: list[str], order: str, size: str, name: str, ranges: int = 1) -> DataFrame:
    """Adds where each row's part begins when a batch's parts are laid end to end; a batch may span `ranges` tasks."""
    line = Line(df, by, [order], ranges).carry(**{name: Carried("sum", F.col(size), own=False)})
    return line.done().withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
