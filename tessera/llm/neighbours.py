"""Approximate nearest neighbours by inner product: inverted lists with an adaptive scan of dimensions.

Vectors are searched as directions: a product of at least b is a squared distance of at most 2 - 2 b / (|q| |x|) between the
unit vectors. These are turned by a fixed random rotation and read in blocks of dimensions: after d of D
dimensions, (D / d) times the partial distance estimates the whole one, and a candidate is abandoned if that exceeds its limit by a factor
(1 + epsilon / sqrt(d))**2, the hypothesis test that it is within the query's bound. Survivors of the last block are
scored in double precision on the original vectors. Norms are taken of scaled components, so no finite vector overflows.

Lists are a norm class (vectors whose norms are within a factor of two) and a k-means cell of directions; their number grows with the
square root of the rows, up to `lists`. They are fit on a bounded sample (`sample` vectors at most, a sixteenth of the rows); every
vector is indexed. From the size, mean and spread of all vectors of each list follows how many of a query's k nearest it should hold; a
query probes the lists with the most, until `target` of all are covered and k + 1 ids are at hand. The lists of its best sample
members, which may be clusters that their list's spread does not show, and lists of very few vectors are always probed. The k-th best of the sample is a query's first bound, and its k best are candidates too.

Lists meet their queries in cells: neighbouring small lists together, large ones in chunks of `chunk` components; a query goes to a cell
once, with the lists that it probes there. A cell's visitors are dealt out in blocks, so no task holds more than two chunks and a block, and a cell
is sent once to each block that visits it. Of equal vectors the k + 1 smallest ids
are candidates; no other can be among the k nearest.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do those of another length than most: their
products are not defined. Rows of the same id count as one candidate, with the best of their products. Fewer than k
candidates: all of them. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._shared import drop_stored, stored

BLOCK_DIMS, EPSILON = 16, 2.1
#: Share of a block's candidates above which partial distances are computed for all of them at once.
DENSE = 0.03
#: Sample rows for each list, rows from which on a list is judged by their mean and spread, cells at least.
SAMPLED, TOLD, LEAST_CELLS = 8, 4, 16


def usable(vector: Column) -> Column:
    """Neither null nor zero, with finite components only."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and norms."""
    largest = np.abs(x).max(1, initial=0)
    scaled = x / largest[:, None]
    norm = np.sqrt((scaled**2).sum(1))
    return scaled / norm[:, None], norm * largest


def norm_class(x: np.ndarray) -> np.ndarray:
    """Norms within a factor of two have one class; 1 is in the middle of its class."""
    largest = np.abs(x).max(1, initial=0)
    return np.floor(np.log2(largest) + np.log2(((x / largest[:, None]) ** 2).sum(1)) / 2 + 0.5).astype(np.int32)


def rotation(dims: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(9).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def k_means(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    rng, first, near = np.random.default_rng(5), [0], np.inf
    for _ in range(k - 1):  # each next centre by its squared distance from those before
        near = np.minimum(near, ((x - x[first[-1]]) ** 2).sum(1))
        first.append(int(np.searchsorted(np.cumsum(near), rng.random() * near.sum(), "right").clip(0, len(x) - 1)))
    centre = x[first].copy()
    for _ in range(rounds):
        own = nearest_centre(x, centre)
        n = np.bincount(own, minlength=k)
        total = np.zeros_like(centre)
        np.add.at(total, own, x)
        centre[n > 0] = total[n > 0] / n[n > 0, None]
    return centre


def nearest_centre(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return ((centre**2).sum(1)[None] - 2 * x @ centre.T).argmin(1)


_Z = np.linspace(-9, 9, 7201)
_TAIL = np.array([math.erfc(z / math.sqrt(2)) / 2 for z in _Z])


def tail(z: np.ndarray) -> np.ndarray:
    """Probability of a normal value above z."""
    return np.interp(z, _Z, _TAIL)


@dataclass
class Lists:
    """Norm classes, and centres of directions within them; then each list's size, mean and spread."""

    classes: dict[int, tuple[int, np.ndarray]]  # class: (its first list, centres)
    power: np.ndarray  # class of each list
    held: np.ndarray  # rows
    mean: np.ndarray  # in units of 2**class
    spread: np.ndarray  # by dimension; 0 where there are too few rows to tell

    @classmethod
    def fit(cls, x: np.ndarray, kinds: np.ndarray, counts: dict[int, int], lists: int) -> Lists:
        """Centres from the sample x, for classes with that many rows each."""
        classes, power, centres = {}, [], []
        total = sum(counts.values())
        for c, n in sorted(counts.items()):
            unit = units(x[kinds == c])[0]
            k = max(1, min(round(lists * n / total), len(unit) // SAMPLED))
            centre = k_means(unit, k) if k > 1 else unit.sum(0, keepdims=True) / max(1, len(unit))
            centre = centre[np.argsort(centre @ np.linalg.svd(centre - centre.mean(0))[2][0])]  # neighbours stand together
            classes[c] = (len(power), centre)
            power += [c] * k
            centres.append(centre)
        n = len(power)
        return cls(classes, np.array(power), np.zeros(n, np.int64), np.concatenate(centres), np.zeros(n))

    def __len__(self) -> int:
        return len(self.power)

    def of(self, x: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int32)
        unit = units(x)[0]
        for c in np.unique(kinds).tolist():
            first, centre = self.classes[c]
            own = kinds == c
            out[own] = first + nearest_centre(unit[own], centre)
        return out

    def sums(self, x: np.ndarray, own: np.ndarray, out: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        """Adds number, sum and sum of squares of the differences from the centres by list."""
        unit, norm = units(x)
        power = self.power[own]
        with np.errstate(all="ignore"):
            diff = unit * np.nan_to_num(np.ldexp(norm, -power), nan=1.0, posinf=1.0)[:, None] - self.mean[own]
        np.add.at(out[0], own, 1)
        np.add.at(out[1], own, diff)
        np.add.at(out[2], own, (diff**2).sum(1))

    def told(self, n: np.ndarray, total: np.ndarray, square: np.ndarray) -> Lists:
        """With the sums over all rows."""
        many = np.maximum(n, 1)[:, None]
        rest = np.maximum(0, square - (total**2).sum(1) / many[:, 0]) / (np.maximum(n - 1, 1) * total.shape[1])
        return Lists(self.classes, self.power, n, self.mean + total / many, np.where(n >= TOLD, np.sqrt(rest), 0.0))

    def expected(self, q: np.ndarray, k: int) -> np.ndarray:
        """How many of each query's k nearest each list should hold (inf: not known), q being unit vectors. Products in a list are taken
        as normal around the product with its mean; the bound is the one above which all lists hold k."""
        known = (self.spread > 0) & (self.held > 0)
        out = np.where(self.held > 0, np.inf, 0.0)[None].repeat(len(q), 0)
        if not known.any():
            return out
        scale = np.exp2(np.maximum(self.power[known] - self.power[known].max(), -1000).astype(float))
        mean, spread, n = q @ self.mean[known].T * scale, self.spread[known] * scale, self.held[known]
        low, high = (mean - 9 * spread).min(1), (mean + 9 * spread).max(1)
        for _ in range(30):
            mid = (low + high) / 2
            many = (n * tail((mid[:, None] - mean) / spread)).sum(1) > k
            low, high = np.where(many, mid, low), np.where(many, high, mid)
        out[:, known] = n * tail((low[:, None] - mean) / spread)
        return out


def cells(held: np.ndarray, chunk: int, least: int = LEAST_CELLS) -> tuple[np.ndarray, np.ndarray]:
    """First cell and number of cells of each list: lists above the chunk have several, small neighbours share one."""
    per = min(chunk, max(1, math.ceil(held.sum() / least)))
    first, n, at, size = np.zeros(len(held), np.int64), np.ones(len(held), np.int64), 0, 0
    for j, m in enumerate(held.tolist()):
        if size and (size >= per or m >= per):
            at, size = at + 1, 0
        first[j], n[j] = at, max(1, math.ceil(m / chunk))
        size += m
        if n[j] > 1:
            at, size = at + int(n[j]), 0
    return first, n


def products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of rows a[i] and b[j]; equal rows give equal values wherever they stand."""
    out = np.empty(len(i))
    for at in range(0, len(i), 16384):
        s = slice(at, at + 16384)
        out[s] = (a[i[s]] * b[j[s]]).sum(1)
    return out


def _best(i, ids, score, k):
    """Of each query i the k best of (score, id), as positions; an id counts once, with its best score."""
    order = np.lexsort((-score, ids, i))
    again = (np.diff(i[order]) == 0) & (np.diff(ids[order]) == 0)
    order = order[np.concatenate([[True], ~again])] if len(order) else order
    order = order[np.lexsort((ids[order], -score[order], i[order]))]
    first = np.searchsorted(i[order], i[order])
    return order[np.arange(len(order)) - first < k]


class Scan:
    """The k best that a block of queries finds, list by list; bounds are products and rise."""

    def __init__(self, q: np.ndarray, ids: np.ndarray, bound: np.ndarray, k: int):
        self.q, self.ids, self.k = q, ids, k
        self.turn = rotation(q.shape[1])
        unit, self.norm = units(q)
        self.turned, self.bound = unit @ self.turn, bound / self.norm
        self.found = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))

    def add(self, i: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        i, ids, score = (np.concatenate([a, b]) for a, b in zip(self.found, (i, ids, score)))
        top = _best(i, ids, score, self.k)
        self.found = i, ids, score = i[top], ids[top], score[top]
        worst = np.full(len(self.q), np.inf)
        np.minimum.at(worst, i, score)
        full = np.bincount(i, minlength=len(self.q)) >= self.k
        self.bound[full] = np.maximum(self.bound[full], worst[full] / self.norm[full])

    def run(self, asking: np.ndarray, x: np.ndarray, ids: np.ndarray, chunk: int = 512) -> None:
        """Rows `asking` of the queries against all x."""
        for at in range(0, len(x), chunk):
            part, part_ids = x[at : at + chunk], ids[at : at + chunk]
            unit, norm = units(part)
            turned = unit @ self.turn
            for begin in range(0, len(asking), 4 * chunk):
                own = asking[begin : begin + 4 * chunk]
                i, j = self.survivors(own, part_ids, turned, norm)
                if len(i):
                    self.add(own[i], part_ids[j], products(self.q, part, own[i], j))

    def survivors(self, own: np.ndarray, ids: np.ndarray, xr: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        qr, dims = self.turned[own], xr.shape[1]
        with np.errstate(all="ignore"):
            limit = 2 - 2 * np.nan_to_num(np.outer(self.bound[own], 1 / norm), nan=-1.0)
        limit += 1e-9 * (1 + np.abs(limit))
        d, near, left = 0, 0.0, (self.ids[own][:, None] != ids[None]) & (limit >= 0)
        slack = lambda d: (1 + EPSILON / math.sqrt(d)) ** 2 if d < dims else 1
        while d < dims and left.mean() > DENSE:  # as products of whole blocks while many candidates are left, then one by one
            e = min(d + BLOCK_DIMS, dims)
            near = near + (qr[:, d:e] ** 2).sum(1)[:, None] + (xr[:, d:e] ** 2).sum(1)[None] - 2 * qr[:, d:e] @ xr[:, d:e].T
            d = e
            left &= near * (dims / d) <= limit * slack(d)
        i, j = np.nonzero(left)
        near = near[i, j] if d else np.zeros(len(i))
        while d < dims and len(i):
            e = min(d + BLOCK_DIMS, dims)
            near = near + ((qr[i, d:e] - xr[j, d:e]) ** 2).sum(1)
            d = e
            ok = near * (dims / d) <= limit[i, j] * slack(d)
            i, j, near = i[ok], j[ok], near[ok]
        return i, j


def nearest(
    vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
    sample: int = 4096, lists: int = 512, target: float = 0.98, chunk: int = 1 << 22, block: int = 1 << 20,
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, its k nearest other rows. chunk and block are
    components of vectors and of queries that a task holds."""
    spark = vectors.sparkSession
    out_schema = "query_id long, rank int, vec_id long, score double"
    kind = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v")).filter(F.col("id").isNotNull() & usable(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], out_schema)
    dims = sizes["d"]
    chunk, block = max(1, chunk // dims), max(1, block // dims)
    rows = rows.filter(F.size("v") == dims)
    same = Window.partitionBy("h1", "h2").orderBy("id")
    plain = F.transform("v", lambda x: x + F.lit(0).cast("float"))  # -0.0 counts as 0.0
    # Rows of equal id and vector are one, so that what is counted below are ids.
    rows = rows.select("id", plain.cast(kind).alias("v")).withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v")).dropDuplicates(["id", "h1", "h2"])

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("kind", pa.array(norm_class(_matrix(batch.column("v"), dims)), pa.int32()))

    rows = stored(rows.mapInArrow(classed, f"id long, v {kind}, h1 long, h2 long, kind int"))
    members = rows.withColumn("nth", F.row_number().over(same)).filter(F.col("nth") <= k + 1).select("id", "v", "kind")
    members = stored(members)
    counts = {r["kind"]: r["n"] for r in members.groupBy("kind").agg(F.count("*").alias("n")).collect()}  # at most the exponents of doubles
    n_rows = sum(counts.values())
    picked = members.orderBy(F.xxhash64("id"), "id", "v").limit(min(sample, max(n_rows // 16, 4 * (k + 1)))).toArrow()
    s_ids, s_vec = picked.column("id").to_numpy(), _matrix(picked.column("v"), dims)
    s_starts = np.flatnonzero(np.concatenate([[True], s_ids[1:] != s_ids[:-1]]))  # rows of an id stand together
    untold = Lists.fit(s_vec, picked.column("kind").to_numpy(), counts, min(lists, max(1, int(math.sqrt(n_rows) / 2))))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = untold.of(_matrix(batch.column("v"), dims), batch.column("kind").to_numpy()) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(own, pa.int32())], ["id", "v", "list"])

    index = stored(members.mapInArrow(assign, f"id long, v {kind}, list int"))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, square = out = np.zeros(len(untold)), np.zeros((len(untold), dims)), np.zeros(len(untold))
        for batch in batches:
            if batch.num_rows:
                untold.sums(_matrix(batch.column("v"), dims), batch.column("list").to_numpy(), out)
        some = np.flatnonzero(n)
        values = np.column_stack([n, square, total])[some].reshape(-1)
        offsets = np.arange(len(some) + 1, dtype=np.int32) * (dims + 2)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.float64()))], ["list", "sums"])

    sums = index.mapInArrow(summed, "list int, sums array<double>").select("list", F.posexplode("sums").alias("pos", "x"))
    sums = sums.groupBy("list", "pos").agg(F.sum("x").alias("x")).toArrow()  # lists * (dimensions + 2) rows
    moments = np.zeros((len(untold), dims + 2))
    moments[sums.column("list").to_numpy(), sums.column("pos").to_numpy()] = sums.column("x").to_numpy()
    fit = untold.told(moments[:, 0].astype(np.int64), moments[:, 2:], moments[:, 1])
    held, ids_held = fit.held, np.zeros(len(fit), np.int64)
    for r in index.groupBy("id").agg(F.min("list").alias("list")).groupBy("list").agg(F.count("*").alias("n")).collect():  # an id counts in one list
        ids_held[r["list"]] = r["n"]
    first_cell, n_cells = cells(held, chunk)

    s_lists, n_best = fit.of(s_vec, picked.column("kind").to_numpy()), min(len(s_ids), max(4, math.ceil(2 * k * len(s_ids) / n_rows)))

    def bounds(q: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, list, list, np.ndarray]:
        """The k-th best product of the sample (-inf if it has fewer), the k best, and the lists of the n_best best."""
        with np.errstate(all="ignore"):
            rough = np.nan_to_num(np.where(ids[:, None] != s_ids[None], q @ s_vec.T, -np.inf), nan=np.inf, neginf=-np.inf)
        by_id = np.maximum.reduceat(rough, s_starts, axis=1)
        n = min(k, len(s_starts))
        worst = np.partition(by_id, -n, axis=1)[:, -n]
        i, j = np.nonzero(np.isfinite(rough) & (rough >= (worst - 1e-9 * (1 + np.abs(worst)))[:, None]))
        score = products(q, s_vec, i, j)
        top = _best(i, s_ids[j], score, k)
        i, near, score = i[top], s_ids[j[top]], score[top]
        ends = np.searchsorted(i, np.arange(len(q) + 1))
        out = np.full(len(q), -np.inf)
        full = np.diff(ends) >= k
        out[full] = score[ends[1:][full] - 1]
        lists = s_lists[np.argpartition(-rough, n_best - 1, axis=1)[:, :n_best]]
        return out, [near[a:b] for a, b in zip(ends, ends[1:])], [score[a:b] for a, b in zip(ends, ends[1:])], lists

    def visits(probed: np.ndarray) -> list[dict]:
        """The cells of some lists, each with those of them that it holds."""
        out: dict[int, list[int]] = {}
        for j in probed.tolist():
            for c in range(int(first_cell[j]), int(first_cell[j] + n_cells[j])):
                out.setdefault(c, []).append(j)
        return [{"cell": c, "lists": js} for c, js in out.items()]

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        visit = pa.list_(pa.struct([("cell", pa.int64()), ("lists", pa.list_(pa.int32()))]))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                q, ids = _matrix(part.column("v"), dims), part.column("id").to_numpy()
                bound, near, score, best = bounds(q, ids)
                hits = fit.expected(units(q)[0], k)
                always = ~np.isfinite(hits)
                hits[always] = 0.0
                np.put_along_axis(always, best.astype(np.int64), True, 1)
                order = np.argsort(-np.where(always, np.inf, hits), axis=1, kind="stable")
                gain = np.take_along_axis(hits, order, 1)
                covered = np.cumsum(gain, axis=1) - gain
                want = (covered < target * gain.sum(1, keepdims=True)) | np.take_along_axis(always, order, 1)
                want |= np.cumsum(ids_held[order], axis=1) - ids_held[order] < k + 1
                want &= held[order] > 0
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"), part.column("v"), pa.array(bound), pa.array([visits(np.sort(o[w])) for o, w in zip(order, want)], visit),
                        pa.array(near, pa.list_(pa.int64())), pa.array(score, pa.list_(pa.float64())),
                    ],
                    ["id", "v", "bound", "visits", "near", "score"],
                )

    asked = rows.filter(F.col("id") % every == 0).select("id", "v")
    queries = stored(asked.mapInArrow(probes, f"id long, v {kind}, bound double, visits array<struct<cell:long,lists:array<int>>>, near array<long>, score array<double>"))
    left = queries.select("id", "v", "bound", F.explode("visits").alias("visit")).select("id", "v", "bound", "visit.*")
    # A cell is sent to as many blocks as its own visitors fill, and not at all if it has none.
    blocks = stored(left.groupBy("cell").agg(F.ceil(F.count("*") / block).alias("blocks")))
    left = left.join(blocks, "cell").withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks"))).drop("blocks")
    at = lambda values: F.element_at(F.lit(values.tolist()), F.col("list") + 1)
    right = index.withColumn("cell", (at(first_cell) + F.pmod(F.xxhash64(F.lit(2), "id"), at(n_cells))).cast("long"))
    right = right.join(blocks, "cell").withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")

    def meet(asked: pa.Table, members: pa.Table) -> pa.Table:
        i, ids, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        q_ids = asked.column("id").to_numpy() if asked.num_rows else i
        if asked.num_rows and members.num_rows:
            scan = Scan(_matrix(asked.column("v"), dims), q_ids, asked.column("bound").to_numpy(), k)
            wanted = asked.column("lists").combine_chunks()
            row, named = np.repeat(np.arange(len(wanted)), wanted.value_lengths().to_numpy()), wanted.flatten().to_numpy()
            own, m_ids, x = members.column("list").to_numpy(), members.column("id").to_numpy(), _matrix(members.column("v"), dims)
            for j in np.unique(own).tolist():
                asking = row[named == j]
                if len(asking):
                    scan.run(asking, x[own == j], m_ids[own == j])
            i, ids, score = scan.found
        return pa.table({"query_id": pa.array(q_ids[i], pa.int64()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(score, pa.float64())})

    found = left.groupBy("cell", "b").cogroup(right.groupBy("cell", "b")).applyInArrow(meet, "query_id long, vec_id long, score double")
    known = queries.select(F.col("id").alias("query_id"), F.explode(F.arrays_zip("near", "score")).alias("z")).select("query_id", F.col("z.near").alias("vec_id"), F.col("z.score").alias("score"))
    # A candidate may be found in the sample and in its list.
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    merged = found.unionByName(known).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    drop_stored(rows, members)
    return merged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
