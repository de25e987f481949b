"""Exact nearest neighbours by a ball cover.

References belong to the nearest of some centres; a centre's ball is as wide as its farthest reference. A query first meets the ball that its
own centre has, which gives it a distance to beat. By the triangle inequality no reference of a ball is nearer than the distance to its centre less its
width, so the query then visits only the balls that could still beat or equal what it has. Balls are cut into parts and their visitors into
chunks of bounded size; a part meets a chunk in one task, and only such pairs are formed. On vectors without clusters nearly all balls are visited, as
any exact search has to.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.work import stored

#: What rounding to nine decimals and single steps of arithmetic may shift a distance by.
SLACK = 1e-6
#: Rows of visits that are handed on at once.
VISITS = 8192


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cosine_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Between unit vectors, so that a cosine s is a distance of sqrt(2 - 2 s)."""
    return np.sqrt(np.maximum(0, 2 - 2 * _unit(x) @ _unit(centres).T))


def _l1_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.stack([np.abs(x - c).sum(1) for c in centres], 1)


#: For scores that fall with a metric: the distances, and the distance within which a reference may still have a score.
METRICS = {
    "cosine": (_cosine_distances, lambda s: np.sqrt(np.maximum(0, 2 - 2 * s) + 4e-9)),
    "l1": (_l1_distances, lambda s: 12 * (1 / np.maximum(s - 1e-9, 1e-12) - 1)),
}


def _table(numbers: list[int], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, numbers)), at + 1)


def ball_nearest(
    queries: DataFrame, references: DataFrame, score: str = "cosine", other: bool = False, where: tuple[str, str] | None = None, same: tuple[str, str] | None = None,
    centres: int = 256, block_rows: int = 1024, seen: dict | None = None, worth: float | None = None,
) -> DataFrame | None:
    """What similarity.dense_nearest gives, for the scores of METRICS. centres: at most so many, the square root of the references if they are
    fewer. Vectors without a finite score (zero, for cosines) take no part. seen: is given how many pairs of a part and a chunk were
    formed, and how many all parts and all queries would make. worth: None is returned where the visits would form more than that share of these
    pairs, or rows of queries would go to more balls than blocks are."""
    from tessera.operators.similarity import matrix_of, nearest_in_block, scorable

    distances, reach = METRICS[score]
    kind = dict(queries.dtypes)["id"]

    def used(df: DataFrame, side: int) -> DataFrame:
        return scorable(df, score, *(c[side] for c in (where, same) if c))

    queries, references = used(queries, 0), used(references, 1)
    references = stored(references)
    k = max(1, min(centres, math.isqrt(max(1, references.count()))))
    chosen = references.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(k).toArrow()
    if not chosen.num_rows:
        return queries.select("id", F.col("id").alias("neighbour"), F.lit(0.0).alias("sim")).limit(0)
    middle = matrix_of(chosen.column("v"))
    k = len(middle)

    def placed(df: DataFrame) -> DataFrame:
        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                d = distances(matrix_of(batch.column("v")), middle)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(d[np.arange(len(cell)), cell])], [*batch.schema.names, "cell", "away"])

        schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
        return stored(df.mapInArrow(place, f"{schema}, cell int, away double"))

    references, queries = placed(references), placed(queries)
    wide, parts = np.full(k, -np.inf), [0] * k
    for r in references.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("r")).collect():  # a row for each centre
        wide[r["cell"]], parts[r["cell"]] = r["r"], -(-r["n"] // block_rows)
    renamed = references.select(*(F.col(c).alias(f"{c}_r") for c in references.columns if c not in ("cell", "away")), "cell")
    renamed = renamed.withColumn("part", F.pmod(F.xxhash64("id_r"), _table(parts, F.col("cell"))).cast("int"))
    counts = {"formed": 0, "possible": 0}

    def met(visits: DataFrame) -> DataFrame:
        """The nearest reference of each visit (query columns, cell) in its ball; one row for each part."""
        visits = stored(visits.filter(_table(parts, F.col("cell")) > 0))
        chunks = [0] * k
        for r in visits.groupBy("cell").agg(F.count("*").alias("n")).collect():  # a row for each centre
            chunks[r["cell"]] = -(-r["n"] // block_rows)
        counts["formed"] += sum(p * c for p, c in zip(parts, chunks))
        x = visits.withColumn("chunk", F.pmod(F.xxhash64("id"), _table(chunks, F.col("cell"))).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), _table(parts, F.col("cell")) - 1)))
        visited = renamed.filter(_table(chunks, F.col("cell")) > 0)
        y = visited.withColumn("chunk", F.explode(F.sequence(F.lit(0), _table(chunks, F.col("cell")) - 1)))
        key = ["cell", "part", "chunk"]
        return stored(x.groupBy(*key).cogroup(y.groupBy(*key)).applyInArrow(lambda a, b: nearest_in_block(a, b, score, other, where, same), f"id {kind}, neighbour {kind}, sim double"))

    def best(found: DataFrame) -> DataFrame:
        g = found.groupBy("id").agg(F.min(F.struct((-F.col("sim")).alias("s"), "neighbour")).alias("n"))
        return g.select("id", F.col("n.neighbour").alias("neighbour"), (-F.col("n.s")).alias("sim"))

    own = queries.drop("away")
    first = met(own)
    left = own.join(best(first).select(F.col("id").alias("_id"), F.col("sim").alias("_sim")), F.col("id") == F.col("_id"), "left").drop("_id")

    def reached(batch: pa.RecordBatch) -> np.ndarray:
        """Which other balls could beat or equal what each query has."""
        sim = batch.column("_sim").to_numpy(zero_copy_only=False).astype(float)
        within = np.where(np.isnan(sim), np.inf, reach(np.where(np.isnan(sim), 1, sim)) + SLACK)
        could = distances(matrix_of(batch.column("v")), middle) - wide[None] <= within[:, None]
        could[np.arange(len(could)), batch.column("cell").to_numpy()] = False
        return could

    def counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(k, np.int64)
        for batch in batches:
            n += reached(batch).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k), pa.int32()), pa.array(n)], ["cell", "n"])

    def visiting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, cell = np.nonzero(reached(batch))
            columns = [c for c in batch.schema.names if c not in ("cell", "_sim")]
            for lo in range(0, len(row), VISITS):  # a batch's queries may go to all balls
                at = pa.array(row[lo : lo + VISITS])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in columns), pa.array(cell[lo : lo + VISITS], pa.int32())], [*columns, "cell"])

    if worth is not None:
        left = stored(left)
        visits = {r["cell"]: r["n"] for r in left.mapInArrow(counting, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}  # a row for each centre
        blocks = -(-queries.count() // block_rows)
        if sum(parts[c] * -(-n // block_rows) for c, n in visits.items()) > worth * sum(parts) * blocks or sum(visits.values()) > blocks * max(1, queries.count()):
            return None
    schema = ", ".join(f"`{c}` {t}" for c, t in own.dtypes if c != "cell")
    rest = met(left.mapInArrow(visiting, f"{schema}, cell int"))
    if seen is not None:
        seen |= counts | {"possible": sum(parts) * -(-queries.count() // block_rows)}
    return best(first.unionByName(rest))
