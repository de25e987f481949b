"""Similarity joins over sets, counts and dense vectors, and nearest neighbours."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.expr import col, ratio
from tessera.operators import balls, ranks
from tessera.operators.scan import Carried, Line
from tessera.sources.work import stored


def six(sim: Column | str) -> Column:
    """Six decimals; quotients of counts that end in an exact half go up in every engine."""
    return F.round(col(sim) + F.lit(1e-9), 6)


#: Block pairs from which on nearest neighbours are found by a ball cover.
MANY_BLOCKS = 64
#: What a candidate of the prefix join costs, in pairs of a block.
CANDIDATE = 8
#: Rows of the largest blocks of vectors, and cells of the tiles in which two blocks meet. A row moves once for every block that it meets, so large blocks
#: move little; a task holds two blocks and a tile.
LARGE_BLOCK, TILE = 16_384, 1 << 21
#: The share of all block pairs up to which a ball cover is used.
WORTH = 0.25


def set_pairs(items: DataFrame, key: str, item: str, least: float | None = None, top: int | None = None, block_rows: int | None = None) -> DataFrame:
    """a < b and sim, the Tanimoto similarity of their sets to six decimals, for all pairs that share an item (others have 0).

    items holds (key, item) once each. With `least`, prefix filtering: items are ordered from rare to frequent, and two sets of that
    similarity share one among their first n - ceil(least * n) + 1, so frequent items make no pairs; each candidate is then
    counted exactly. Where the prefixes' candidates would cost more than all pairs of sets in blocks, because few items are rare, and without
    `least`, blocks of sets meet (see sparse_pairs), so a frequent item costs no more than a rare one. top: only the best pairs by
    (-sim, a, b)."""
    items = stored(items.select(F.col(key).alias("id"), F.col(item).alias("_item")))
    coded = stored(items.groupBy("_item").agg(F.count("*").alias("_f")).withColumn("_c", F.monotonically_increasing_id()))
    entry = F.struct("_f", "_c")
    sets = stored(items.join(coded, "_item").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["_c"]).alias("s")))
    n = F.size("s")
    if least is not None:
        low = least - 1e-9
        prefix = F.slice("s", F.lit(1), (n - F.ceil(n * F.lit(low)) + 1).cast("int"))
        heads = sets.select(F.col("id").alias("k"), n.alias("n"), F.posexplode(prefix).alias("p", "_i"))
        f = F.col("f").cast("double")
        candidates, n_sets = heads.groupBy("_i").agg(F.count("*").alias("f")).agg(F.sum(f * (f - 1) / 2)).first()[0] or 0, sets.count()
    if least is None or candidates * CANDIDATE > n_sets * (n_sets - 1) / 2:
        rows = sets.select("id", F.col("s").alias("i"), F.array_repeat(F.lit(1.0).cast("float"), n).alias("x"))
        if least is not None:
            found = sized_pairs(rows, block_rows or 1024, least, top).withColumn("sim", six("sim")).filter(F.col("sim") >= least)
        else:
            found = sparse_pairs(rows, top, block_rows, up=1e-9)
        return found if top is None else found.orderBy(F.desc("sim"), "a", "b").limit(top)
    left, right = (heads.withColumnsRenamed({"k": k, "n": f"n{k}", "p": f"p{k}"}) for k in ("a", "b"))
    # What two sets share is at most what stands on the same side of a shared item, and it.
    most = F.least("pa", "pb") + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    enough = most * F.lit(1 + low) >= F.lit(low) * (F.col("na") + F.col("nb"))
    pairs = left.join(right, "_i").filter((F.col("a") < F.col("b")) & enough).select("a", "b").distinct()
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    c = F.size(F.array_intersect("sa", "sb"))
    sim = six(ratio(c, F.size("sa") + F.size("sb") - c))
    return both.select("a", "b", sim.alias("sim")).filter(F.col("sim") >= least)


def top_set_pairs(items: DataFrame, key: str, item: str, n: int, steps: tuple[float, ...] = (0.8, 0.5)) -> DataFrame:
    """The n most similar pairs by (-sim, a, b). Thresholds are tried from high to low; only if too few pairs reach the lowest do
    blocks of all sets meet, each giving its n best."""
    best = lambda pairs: pairs.orderBy(F.desc("sim"), "a", "b").limit(n)
    for least in steps:
        found = stored(set_pairs(items, key, item, least))
        if found.limit(n).count() == n:
            return best(found)
    return set_pairs(items, key, item, top=n)


def count_pairs(counts: DataFrame, key: str, item: str, n: str, block_rows: int | None = None, up: float | None = None) -> DataFrame:
    """a < b and sim = dot / (|a|^2 + |b|^2 - dot) of their count maps, for all pairs that share an item. up: see sparse_pairs."""
    cells = counts.select(F.col(key).alias("id"), F.col(item).alias("_i"), F.col(n).cast("double").alias("_x"))
    coded = stored(cells.select("_i").distinct().withColumn("_c", F.monotonically_increasing_id()))
    rows = cells.join(coded, "_i").groupBy("id").agg(F.collect_list(F.struct("_c", "_x")).alias("e"))
    return sparse_pairs(stored(rows.select("id", F.col("e._c").alias("i"), F.col("e._x").alias("x"))), None, block_rows, up)


#: Pairs of two blocks that are settled one by one.
FEW_PAIRS = 20_000


def _shared(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The values that both hold, and how often each does."""
    (ca, na), (cb, nb) = (np.unique(x, return_counts=True) for x in (a, b))
    both, ia, ib = np.intersect1d(ca, cb, assume_unique=True, return_indices=True)
    return both, na[ia].astype(float), nb[ib].astype(float)


def _slice(row, code, value, square, part: np.ndarray, kind) -> np.ndarray:
    """The columns `part` (sorted) of a sparse matrix, dense."""
    place = np.minimum(np.searchsorted(part, code), len(part) - 1)
    own = part[place] == code
    out = np.zeros((len(square), len(part)), kind)
    out[row[own], place[own]] = value[own]
    return out


def _rest(row, code, value, square, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sums of squares by row, row ends, columns and values of the part of a sparse matrix that lies in some columns."""
    own = np.flatnonzero(np.isin(code, columns))
    own = own[np.lexsort((code[own], row[own]))]
    ends = np.searchsorted(row[own], np.arange(len(square) + 1))
    return np.bincount(row[own], weights=value[own].astype(float) ** 2, minlength=len(square)), ends, code[own], value[own]


def _dot(a: tuple, p: int, b: tuple, q: int) -> float:
    (_, ea, ca, va), (_, eb, cb, vb) = a, b
    x, y = slice(ea[p], ea[p + 1]), slice(eb[q], eb[q + 1])
    _, i, j = np.intersect1d(ca[x], cb[y], assume_unique=True, return_indices=True)
    return float((va[x][i] * vb[y][j]).sum())


def size_blocks(rows: DataFrame, size: str, least: float, block_rows: int, block_items: int | None = None) -> DataFrame:
    """rows with their block b, in the order of their sizes, and the first and last block whose sizes are within a factor `least` of the block's.
    block_items: sizes add up to about that in a block at most, so blocks of large sets have fewer rows.
    Blocks are numbered by a place in the whole order, and what they reach by counting the blocks' ends in order: no pair of blocks is made."""
    if block_items is None:
        rows = ranks.positions(rows, [size, "id"], "_place").withColumn("b", F.floor((F.col("_place") - 1) / block_rows).cast("int")).drop("_place")
    else:  # no row weighs more than a block, so no number is left out
        weight = F.least(F.greatest(F.col(size).cast("long"), F.lit(max(1, block_items // block_rows))), F.lit(block_items)).cast("long")
        line = Line(rows, [], [size, "id"], 8).carry(_place=Carried("sum", weight)).done()
        rows = line.withColumn("b", F.floor((F.col("_place") - 1) / block_items).cast("int")).drop("_place")
    rows = stored(rows)
    ends = rows.groupBy("b").agg(F.min(size).cast("double").alias("low"), (F.max(size) / F.lit(least)).alias("high"))
    marks = ends.select("b", F.inline(F.array(F.struct(F.col("low").alias("v"), F.lit(0).alias("k")), F.struct(F.col("high").alias("v"), F.lit(1).alias("k")))))
    line = Line(marks, [], ["v", "k"], 8).carry(_lows=Carried("count", F.when(F.col("k") == 0, 1)), _highs=Carried("count", F.when(F.col("k") == 1, 1))).done()
    count = lambda c, k: F.max(F.when(F.col("k") == k, F.coalesce(c, F.lit(0)))).cast("int")
    reached = line.groupBy("b").agg(count("_highs", 0).alias("first"), (count("_lows", 1) - 1).alias("last"))
    return rows.join(reached, "b")


def sized_pairs(rows: DataFrame, block_rows: int, least: float, top: int | None = None, columns: int = 2048) -> DataFrame:
    """a < b and the Tanimoto similarity of all rows (id, i, x: columns and ones), sets, that reach `least`, to six decimals. Blocks are ranges of sizes, and
    those meet only whose sizes allow it, as products of dense slices of the columns that both have; a pair of blocks is one unit of work, and is
    bounded by its rows. top: a pair of blocks reports its best that many, and what ties with them to six decimals."""
    kind = dict(rows.dtypes)["id"]

    def meet(x: pa.Table, y: pa.Table) -> pa.Table:
        a = b = np.empty(0, np.int64)
        sim = np.empty(0)
        if x.num_rows and y.num_rows:
            sides = []
            for t, suffix in ((x, ""), (y, "_r")):
                i, v = t.column(f"i{suffix}").combine_chunks(), t.column(f"x{suffix}").combine_chunks()
                row = np.repeat(np.arange(len(i)), i.value_lengths().to_numpy())
                value = v.flatten().to_numpy()
                sides.append((row, i.flatten().to_numpy(), value, np.bincount(row, weights=value.astype(float) ** 2, minlength=len(i))))
            # Products of whole numbers are exact in single precision up to 2**24.
            whole = all((v == np.floor(v)).all() and q.max(initial=0) < 1 << 24 for _, _, v, q in sides)
            shared, n_left, n_right = _shared(sides[0][1], sides[1][1])
            shared = np.concatenate([np.sort(shared[at]) for at in np.array_split(np.argsort(-n_left * n_right, kind="stable"), range(columns, len(shared), columns))])
            dot = np.zeros((x.num_rows, y.num_rows), np.float32 if whole else np.float64)
            square = sides[0][3][:, None] + sides[1][3][None]
            reach = (least - 1e-6) / (1 + least - 1e-6) * square - 1e-6
            i = j = None
            for at in range(0, max(1, len(shared)), columns):
                part = shared[at : at + columns]
                if len(part):
                    dot += _slice(*sides[0], part, dot.dtype) @ _slice(*sides[1], part, dot.dtype).T
                rest = shared[at + columns :]
                if len(rest):  # most columns are rare: what they could add at most leaves few pairs
                    others = [_rest(*side, rest) for side in sides]
                    possible = dot + np.sqrt(others[0][0][:, None] * others[1][0][None]) >= reach
                    if np.count_nonzero(possible) <= FEW_PAIRS:
                        i, j = np.nonzero(possible)
                        dot[i, j] += [_dot(others[0], p, others[1], q) for p, q in zip(i.tolist(), j.tolist())]
                        break
            if i is None:
                i, j = np.nonzero(dot >= reach)
            else:
                ok = dot[i, j] >= reach[i, j]
                i, j = i[ok], j[ok]
            sim = dot[i, j].astype(float)
            sim = sim / (square[i, j] - sim)
            a, b, i = _halved(x, y, i, j)
            sim = sim[i]
            best = _best(sim, top)
            sim, a, b = sim[best], a[best], b[best]
        return pa.table({"a": pa.array(a, x.column("id").type), "b": pa.array(b, x.column("id").type), "sim": pa.array(sim, pa.float64())})

    blocks = size_blocks(rows.withColumn("_size", F.size("i")), "_size", least - 1e-6, block_rows)
    left = blocks.select("id", "i", "x", F.col("b").alias("bl"), F.explode(F.sequence("b", "last")).alias("br"))
    right = blocks.select(*(F.col(c).alias(f"{c}_r") for c in ("id", "i", "x")), F.col("b").alias("br"), F.explode(F.sequence("first", "b")).alias("bl"))
    return left.groupBy("bl", "br").cogroup(right.groupBy("bl", "br")).applyInArrow(meet, f"a {kind}, b {kind}, sim double")


def _best(sim: np.ndarray, top: int | None) -> slice | np.ndarray:
    """The `top` largest, and what ties with them to six decimals."""
    return slice(None) if top is None or len(sim) <= top else sim >= np.partition(sim, -top)[-top] - 1.1e-6


def six_of(x: np.ndarray, up: float) -> np.ndarray:
    """x + up to six decimals, an exact half away from zero."""
    x = (x + up) * 1e6
    low = np.floor(x)
    return (low + (x - low >= 0.5)) / 1e6


#: A column is multiplied densely where this share of the cells of two blocks or more have it on both sides; of lighter ones each common entry is added
#: by itself, so many at once.
DENSE, ADDED = 1 / 512, 1 << 19
#: Cells of a dense slice, and of a piece of pairs that are handed on.
SLICE, PIECE = 1 << 21, 1 << 19


class _Columns:
    """A block of a sparse matrix, as far as its columns are among `shared` (sorted), of which the first are dense: by row, or by column."""

    def __init__(self, row: np.ndarray, code: np.ndarray, value: np.ndarray, shared: np.ndarray, rank: np.ndarray, by_column: bool):
        place = np.minimum(np.searchsorted(shared, code), max(0, len(shared) - 1))
        own = shared[place] == code if len(shared) else np.zeros(len(code), bool)
        self.row, self.column, self.value = row[own], rank[place[own]], value[own]
        if by_column:
            order = np.argsort(self.column, kind="stable")
            self.row, self.column, self.value = self.row[order], self.column[order], self.value[order]
        self.ends = np.searchsorted(self.column, np.arange(len(shared) + 1)) if by_column else None

    def dense(self, at: slice, own: np.ndarray | slice, first_row: int, rows: int, kind) -> np.ndarray:
        out = np.zeros((rows, at.stop - at.start), kind)
        out[self.row[own] - first_row, self.column[own] - at.start] = self.value[own]
        return out


def _products(left: _Columns, right: _Columns, first: int, rows: int, n_right: int, n_dense: int, kind) -> np.ndarray:
    """The products of some rows of a block, from `first` on, with all rows of another."""
    dot = np.zeros((rows, n_right), kind)
    mine = slice(*np.searchsorted(left.row, [first, first + rows]))
    row, column, value = left.row[mine], left.column[mine], left.value[mine]
    step = max(64, SLICE // max(1, n_right))
    for a in range(0, n_dense, step):
        at = slice(a, min(n_dense, a + step))
        own = mine.start + np.flatnonzero((column >= at.start) & (column < at.stop))
        dot += left.dense(at, own, first, rows, kind) @ right.dense(at, slice(right.ends[at.start], right.ends[at.stop]), 0, n_right, kind).T
    light = np.flatnonzero(column >= n_dense)
    row, column, value = row[light] - first, column[light], value[light]
    begin, n = right.ends[column], right.ends[column + 1] - right.ends[column]
    ends = np.append(0, np.cumsum(n))
    at, flat = 0, dot.reshape(-1)
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + ADDED, "right")) - 1)
        own = np.repeat(begin[at:to] - ends[at:to], n[at:to]) + np.arange(ends[at], ends[to])
        cell = np.repeat(row[at:to] * n_right, n[at:to]) + right.row[own]
        np.add.at(flat, cell, (np.repeat(value[at:to], n[at:to]) * right.value[own]).astype(kind))
        at = to
    return dot


def sparse_pairs(rows: DataFrame, top: int | None, block_rows: int | None = None, up: float | None = None) -> DataFrame:
    """a < b and the generalised Tanimoto similarity of all rows (id, i, x: columns and values) of a sparse matrix that share a column.
    Blocks of rows meet in tiles: of the columns that both have, the frequent ones are products of dense slices, entries of the others are added one by
    one. A pair of blocks is one unit of work, and holds the blocks and a tile. top: each tile reports its best that many, and what ties with them to six
    decimals. up: similarities are given to six decimals, after this is added."""
    kind = dict(rows.dtypes)["id"]

    def each(x: pa.Table, y: pa.Table, crossed: bool) -> Iterator[pa.RecordBatch]:
        sides = []
        for t in (x, y):
            i, v = t.column("i").combine_chunks(), t.column("x").combine_chunks()
            row = np.repeat(np.arange(len(i)), i.value_lengths().to_numpy())
            value = v.flatten().to_numpy()
            sides.append((row, i.flatten().to_numpy(), value, np.bincount(row, weights=value.astype(float) ** 2, minlength=len(i))))
        # Products of whole numbers are exact in single precision up to 2**24.
        whole = all((v == np.floor(v)).all() and q.max(initial=0) < 1 << 24 for _, _, v, q in sides)
        shared, n_left, n_right = _shared(sides[0][1], sides[1][1])
        rank = np.empty(len(shared), np.int64)
        rank[np.argsort(-n_left * n_right, kind="stable")] = np.arange(len(shared))
        n_dense = int(np.count_nonzero(n_left * n_right >= DENSE * x.num_rows * y.num_rows))
        left, right = (_Columns(*side[:3], shared, rank, by_column) for side, by_column in zip(sides, (False, True)))
        ids, others = x.column("id").to_numpy(), y.column("id").to_numpy()
        step = max(1, PIECE // y.num_rows)
        for at in range(0, x.num_rows, step):
            own = ids[at : at + step]
            dot = _products(left, right, at, len(own), len(others), n_dense, np.float32 if whole else np.float64)
            i, j = np.nonzero(dot)
            a, b = own[i], others[j]
            if crossed:
                meant = np.flatnonzero(a < b)
                i, j, a, b = i[meant], j[meant], a[meant], b[meant]
            else:
                a, b = np.minimum(a, b), np.maximum(a, b)
            sim = dot[i, j].astype(float)
            sim /= sides[0][3][at + i] + sides[1][3][j] - sim
            sim = sim if up is None else six_of(sim, up)
            best = _best(sim, top)
            yield pa.RecordBatch.from_arrays([pa.array(a[best], x.column("id").type), pa.array(b[best], x.column("id").type), pa.array(sim[best], pa.float64())], ["a", "b", "sim"])

    return in_tiles(rows, rows, each, f"a {kind}, b {kind}, sim double", block_rows, True)


def matrix_of(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _l1(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    step = max(1, (1 << 21) // max(1, b.size))  # rows whose differences are held at once
    parts = [np.abs(a[at : at + step, None, :] - b[None]).sum(2) for at in range(0, len(a), step)]
    return 1 / (1 + np.concatenate(parts) / 12)


SCORES = {
    "cosine": lambda a, b: (a / np.linalg.norm(a, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T,
    "dot": lambda a, b: a @ b.T,
    "l1": _l1,
}


def large_blocks(n: int) -> int:
    """Rows of a block of a table of n rows: about sixteen blocks, until they have LARGE_BLOCK rows."""
    return max(1024, min(LARGE_BLOCK, -(-n // 16)))


def _met(left: DataFrame, right: DataFrame, block_rows: int, half: bool = False, same: tuple[str, str] | None = None):
    """Both tables in blocks of about block_rows rows, by hash of the id, each row once for every block of the other; grouped for
    a cogroup by block pair. The right columns are renamed, so that a table can meet itself; with `half` each two of its blocks meet once.
    same: blocks are of one value of these columns each, and only those of one value meet."""
    right = right.withColumnsRenamed({c: f"{c}_r" for c in right.columns})
    if same:
        n = lambda df, c, name: df.groupBy(F.col(c).alias("_g")).agg(F.ceil(F.count("*") / block_rows).cast("int").alias(name)).filter("_g IS NOT NULL")
        sizes = stored(n(left, same[0], "_nl").join(n(right, f"{same[1]}_r", "_nr"), "_g"))
        left = left.join(sizes, F.col(same[0]) == F.col("_g"))
        right = right.join(sizes.select(*(F.col(c).alias(f"{c}_r") for c in sizes.columns)), F.col(f"{same[1]}_r") == F.col("_g_r"))
        (nl, nr), (nl_r, nr_r) = ((F.col(f"_nl{side}"), F.col(f"_nl{side}" if half else f"_nr{side}")) for side in ("", "_r"))
    else:
        many = max(1, math.ceil(left.count() / block_rows))
        nl = nl_r = F.lit(many)
        nr = nr_r = F.lit(many if half else max(1, math.ceil(right.count() / block_rows)))
    left = left.withColumn("bl", F.pmod(F.xxhash64("id"), nl).cast("int")).withColumn("br", F.explode(F.sequence(F.col("bl") if half else F.lit(0), nr - 1)))
    right = right.withColumn("br", F.pmod(F.xxhash64("id_r"), nr_r).cast("int")).withColumn("bl", F.explode(F.sequence(F.lit(0), F.col("br") if half else nl_r - 1)))
    return left.groupBy(*["_g"] * bool(same), "bl", "br").cogroup(right.groupBy(*["_g_r"] * bool(same), "bl", "br"))


def in_tiles(
    left: DataFrame, right: DataFrame, each: Callable[[pa.Table, pa.Table, bool], Iterator[pa.RecordBatch]], schema: str, block_rows: int | None, half: bool = False, same: tuple[str, str] | None = None,
) -> DataFrame:
    """What `each` yields of all pairs of blocks of two tables with the same columns, piece by piece: it gets a block of both, and whether they are one. Blocks are large
    (block_rows, or large_blocks), since a row moves once for every block that it meets; half: two tables that are one, each two blocks meet once.
    same: blocks are of one value of these columns each, and only those of one value meet. Rows without id, or such a value, meet none."""
    left, right = (t.filter("id IS NOT NULL").withColumn("_g", F.col(by) if by else F.lit(0)).filter("_g IS NOT NULL") for t, by in zip((left, right), same or (None, None)))
    n_rows = [left.count()] * 2 if half else [left.count(), right.count()]
    block_rows = block_rows or large_blocks(max(n_rows))
    if same:
        counts = [t.groupBy("_g").agg(F.ceil(F.count("*") / block_rows).cast("int").alias(f"_n{k}")) for k, t in enumerate((left, right))]
        sizes = stored(counts[0].withColumn("_n1", F.col("_n0")) if half else counts[0].join(counts[1], "_g"))
        left, right = (t.join(sizes, "_g") for t in (left, right))
    else:
        left, right = (t.withColumns({f"_n{k}": F.lit(max(1, math.ceil(n / block_rows))) for k, n in enumerate(n_rows)}) for t in (left, right))
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    to = lambda n: F.sequence(F.lit(0), n - 1)
    first = left.withColumn("bl", block("_n0"))
    first = first.withColumn("br", F.explode(F.sequence("bl", F.col("_n1") - 1) if half else to(F.col("_n1"))))
    second = right.withColumn("br", block("_n1"))
    second = second.withColumn("bl", F.explode(F.when(F.col("br") > 0, to(F.col("br"))) if half else to(F.col("_n0"))))
    columns = [c for c in first.columns if c not in ("_n0", "_n1")]
    both = first.select(*columns, F.lit(False).alias("_right")).unionByName(second.select(*columns, F.lit(True).alias("_right")))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        on_right = t.column("_right")
        one = half and t.column("bl")[0].as_py() == t.column("br")[0].as_py()
        x, y = (t, t) if one else (t.filter(pc.invert(on_right)), t.filter(on_right))
        if x.num_rows and y.num_rows:
            yield from each(x, y, one)

    return both.groupBy("_g", "bl", "br").applyInArrow(meet, schema)


def _halved(x: pa.Table, y: pa.Table, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The smaller and the larger ids of pairs of two blocks of one table, and which pairs are meant: a block that meets itself has each twice."""
    a, b = x.column("id").to_numpy()[i], y.column("id_r").to_numpy()[j]
    meant = np.flatnonzero(a < b if x.column("bl")[0] == x.column("br")[0] else a != b)
    a, b = a[meant], b[meant]
    return np.minimum(a, b), np.maximum(a, b), meant


def _equal(x: pa.Table, y: pa.Table, where: tuple[str, str]) -> np.ndarray:
    """Whether a row of x and a row of y have one value of those columns."""
    return x.column(where[0]).to_numpy()[:, None] == y.column(f"{where[1]}_r").to_numpy()[None]


def dense_pairs(
    left: DataFrame, right: DataFrame, score: str = "cosine", least: float | None = None, upper: bool = False, same: tuple[str, str] | None = None, carry: tuple[str, ...] = (), block_rows: int | None = None,
    up: float | None = None,
) -> DataFrame:
    """a, b, sim of all pairs of two tables (id, v) of vectors, in tiles of large blocks: block pairs are the units of work and
    no side is broadcast. least: only pairs from it on; upper: only a < b; same = (left column, right column): only pairs of one value.
    carry: columns of both tables that go with the pairs, as a_<name> and b_<name>, so that no join has to bring them. up: scores are given to six decimals,
    after this is added."""
    kinds, half = dict(left.dtypes), upper and left is right
    names = [(c, side, side if c == "id" else f"{side}_{c}") for c in ("id", *carry) for side in "ab"]

    def each(x: pa.Table, y: pa.Table, one: bool) -> Iterator[pa.RecordBatch]:
        mine, theirs = matrix_of(x.column("v")), matrix_of(y.column("v"))
        ids, others = x.column("id").to_numpy(), y.column("id").to_numpy()
        columns = {c: (x.column(c).combine_chunks(), y.column(c).combine_chunks()) for c in ("id", *carry)}
        step = max(1, PIECE // len(theirs))
        for at in range(0, len(mine), step):
            sim, own = SCORES[score](mine[at : at + step], theirs), ids[at : at + step]
            keep = np.ones(sim.shape, bool) if least is None else sim >= least - 1e-12
            if upper and (one or not half):
                keep &= own[:, None] < others[None]
            elif half:
                keep &= own[:, None] != others[None]
            i, j = np.nonzero(keep)
            found = sim[i, j]
            found = found if up is None else six_of(found, up)
            swapped = own[i] > others[j] if half else np.zeros(len(i), bool)
            taken = {c: (a.take(pa.array(at + i)), b.take(pa.array(j))) for c, (a, b) in columns.items()}
            if swapped.any():
                taken = {c: (pc.if_else(pa.array(swapped), b, a), pc.if_else(pa.array(swapped), a, b)) for c, (a, b) in taken.items()}
            yield pa.RecordBatch.from_arrays([*(taken[c]["ab".index(side)] for c, side, _ in names), pa.array(found, pa.float64())], [*(n for _, _, n in names), "sim"])

    used = list(dict.fromkeys(["id", "v", *carry]))
    left, right = ((t.select(*used, *([F.col(by).alias("_same")] if by else [])) for t, by in ((left, same and same[0]), (right, same and same[1]))))
    fields = [f"{n} {kinds[c]}" for c, _, n in names]
    return in_tiles(left, right, each, f"{', '.join(fields)}, sim double", block_rows, half, ("_same", "_same") if same else None)


def met_tiles(left: DataFrame, right: DataFrame, each: Callable[[np.ndarray, np.ndarray, dict, dict], pa.Table], schema: str, carry: tuple[str, ...] = (), upper: bool = False, block_rows: int | None = None) -> DataFrame:
    """What `each` makes of the tiles of all pairs of two tables (id, v): it gets the cosines to nine decimals, which cells are pairs, and the columns (id and
    `carry`) of both sides as arrays, NULL as NaN, and returns rows that are summed up afterwards; so pairs are counted where they are made and never
    move. upper: two tables that are one, each two rows once."""
    half = upper and left is right

    def column(t: pa.Table, name: str) -> np.ndarray:
        return t.column(name).to_numpy()

    def meet(x: pa.Table, y: pa.Table) -> pa.Table:
        none = each(np.empty((0, 0)), np.empty((0, 0), bool), *({c: np.empty(0, np.int64 if c == "id" else float) for c in ("id", *carry)} for _ in range(2)))
        found = [none]
        if x.num_rows and y.num_rows:
            a, b = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (matrix_of(x.column("v")), matrix_of(y.column("v_r"))))
            mine, theirs = {c: column(x, c) for c in ("id", *carry)}, {c: column(y, f"{c}_r") for c in ("id", *carry)}
            crossed = upper and (not half or x.column("bl")[0] == x.column("br")[0])
            step = max(1, TILE // len(b))
            for at in range(0, len(a), step):
                own = {c: v[at : at + step] for c, v in mine.items()}
                sim = np.round(a[at : at + step] @ b.T, 9)
                found.append(each(sim, own["id"][:, None] < theirs["id"][None] if crossed else np.ones(sim.shape, bool), own, theirs))
        return pa.concat_tables(found)

    used = ["id", "v", *carry]
    return _met(left.select(*used), right.select(*used), block_rows or large_blocks(max(left.count(), right.count())), half).applyInArrow(meet, schema)


def pair_totals(df: DataFrame, value: str, block_rows: int | None = None) -> DataFrame:
    """One row: pairs, mean and max of the cosine, and mean_delta, the mean difference of `value`, of all pairs of a table (id, v, value)."""

    def totals(sim: np.ndarray, keep: np.ndarray, x: dict, y: dict) -> pa.Table:
        delta = np.abs(x[value][:, None] - y[value][None])
        known = keep & ~np.isnan(delta)
        n = int(np.count_nonzero(keep))
        row = [n, np.where(keep, sim, 0.0).sum(), np.where(keep, sim, -np.inf).max(initial=-np.inf), int(np.count_nonzero(known)), np.where(known, delta, 0.0).sum()] if n else None
        return pa.table({k: pa.array([row[i]] if row else [], t) for i, (k, t) in enumerate((("n", pa.int64()), ("s", pa.float64()), ("m", pa.float64()), ("dn", pa.int64()), ("ds", pa.float64())))})

    rows = met_tiles(df, df, totals, "n long, s double, m double, dn long, ds double", (value,), True, block_rows)
    n = F.coalesce(F.sum("n"), F.lit(0).cast("long"))
    return rows.agg(n.alias("pairs"), ratio(F.sum("s"), F.sum("n")).alias("mean"), F.max("m").alias("max"), ratio(F.sum("ds"), F.sum("dn")).alias("mean_delta"))


def pair_cells(df: DataFrame, edges: list[float], value: str, block_rows: int | None = None) -> DataFrame:
    """passed, delta, n: how many pairs of a table (id, v, value) have a cosine from edges[passed - 1] on and below the next edge, and that difference of
    `value`. Pairs below the first edge are left out."""
    bins = len(edges) + 1

    def cells(sim: np.ndarray, keep: np.ndarray, x: dict, y: dict) -> pa.Table:
        (ux, ix), (uy, iy) = (np.unique(t[value], return_inverse=True) for t in (x, y))
        code = (ix[:, None] * len(uy) + iy[None]) * bins
        for e in edges:
            code += sim >= e
        n = np.bincount(code[keep], minlength=len(ux) * len(uy) * bins).reshape(-1, bins)
        n[:, 0] = 0
        at, passed = np.nonzero(n)
        delta = np.abs(ux[at // max(1, len(uy))] - uy[at % max(1, len(uy))])
        return pa.table({"passed": pa.array(passed, pa.int32()), "delta": pa.array(delta, pa.float64(), from_pandas=True), "n": pa.array(n[at, passed], pa.int64())})

    return met_tiles(df, df, cells, "passed int, delta double, n long", (value,), True, block_rows).groupBy("passed", "delta").agg(F.sum("n").alias("n"))


def cell_statistics(cells: DataFrame, by: list[str]) -> DataFrame:
    """n, mean, median, q1, q3, iqr and counts from 1 and 2 on of delta over (delta, n): values and how often each occurs."""
    q = F.percentile("delta", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n"))
    known = F.when(F.col("delta").isNotNull(), F.col("n"))
    from_on = lambda least: F.coalesce(F.sum(F.when(F.col("delta") >= least, F.col("n"))), F.lit(0).cast("long"))
    g = cells.groupBy(*by)
    return g.agg(F.sum("n").alias("n"), ratio(F.sum(F.col("delta") * F.col("n")), F.sum(known)).alias("mean"), q[1].alias("median"), q[0].alias("q1"), q[2].alias("q3"), (q[2] - q[0]).alias("iqr"), from_on(1).alias("cliffs_1"), from_on(2).alias("cliffs_2"))


def top_deltas(df: DataFrame, value: str, least: float, k: int, block_rows: int | None = None) -> DataFrame:
    """a < b, sim (from `least` on), delta, endpoint (the value of a): candidates for the k pairs of each endpoint that come first by (-delta, -sim, a, b); each
    tile gives its own k."""

    def best(sim: np.ndarray, keep: np.ndarray, x: dict, y: dict) -> pa.Table:
        i, j = np.nonzero(keep & (sim >= least))
        p, q = x["id"][i], y["id"][j]
        own = np.where(p < q, x[value][i], y[value][j])
        delta, s = np.abs(x[value][i] - y[value][j]), sim[i, j]
        a, b = np.minimum(p, q), np.maximum(p, q)
        _, group = np.unique(own, return_inverse=True)
        order = np.lexsort((b, a, -s, -delta, group))
        group = group[order]
        order = order[np.arange(len(order)) - np.searchsorted(group, group) < k]
        floats = lambda v: pa.array(v[order].astype(float), pa.float64(), from_pandas=True)
        return pa.table({"a": pa.array(a[order], pa.int64()), "b": pa.array(b[order], pa.int64()), "sim": pa.array(s[order], pa.float64()), "delta": floats(delta), "endpoint": floats(own)})

    return met_tiles(df, df, best, "a long, b long, sim double, delta double, endpoint double", (value,), True, block_rows)


def neighbour_means(left: DataFrame, right: DataFrame, value: str, least: float, block_rows: int | None = None) -> DataFrame:
    """id, neighbours (rows of the right table with a cosine from `least` on) and p, the mean of their values weighted by the cosine. Rows of the left table
    without neighbours are left out."""

    def sums(sim: np.ndarray, keep: np.ndarray, x: dict, y: dict) -> pa.Table:
        near = sim >= least
        sim = np.where(near, sim, 0.0)
        known = ~np.isnan(y[value])
        n = near.sum(1)
        at = np.flatnonzero(n)
        top, bottom = (sim[at] @ v for v in (np.where(known, y[value], 0.0), known.astype(float))) if len(at) else (np.empty(0), np.empty(0))
        counts = (near[at] @ known.astype(np.int64)) if len(at) else np.empty(0, np.int64)
        return pa.table({"id": pa.array(x["id"][at], pa.int64()), "n": pa.array(n[at], pa.int64()), "known": pa.array(counts, pa.int64()), "top": pa.array(top, pa.float64()), "bottom": pa.array(bottom, pa.float64())})

    g = met_tiles(left, right, sums, "id long, n long, known long, top double, bottom double", (value,), False, block_rows).groupBy("id")
    return g.agg(F.sum("n").alias("neighbours"), F.when(F.sum("known") > 0, ratio(F.sum("top"), F.sum("bottom"))).alias("p"))


def group_best(left: DataFrame, right: DataFrame, score: str = "cosine", block_rows: int = 1024) -> DataFrame:
    """ga, gb, sim: of every two groups of two tables (id, v, g) the best product of their members, rounded to nine decimals. Blocks give a row for
    each two groups that meet in them, not for each two members."""
    kinds = dict(left.dtypes)["g"], dict(right.dtypes)["g"]

    def meet(x: pa.Table, y: pa.Table) -> pa.Table:
        a = b = np.empty(0, np.int64)
        found = np.empty(0)
        if x.num_rows and y.num_rows:
            sim = np.round(SCORES[score](matrix_of(x.column("v")), matrix_of(y.column("v_r"))), 9)
            (ga, ia), (gb, ib) = (np.unique(t.column(c).to_numpy(), return_inverse=True) for t, c in ((x, "g"), (y, "g_r")))
            by_row = np.maximum.reduceat(sim[np.argsort(ia, kind="stable")], np.searchsorted(np.sort(ia), np.arange(len(ga))), axis=0)
            best = np.maximum.reduceat(by_row[:, np.argsort(ib, kind="stable")], np.searchsorted(np.sort(ib), np.arange(len(gb))), axis=1)
            a, b, found = np.repeat(ga, len(gb)), np.tile(gb, len(ga)), best.reshape(-1)
        return pa.table({"ga": pa.array(a, x.column("g").type), "gb": pa.array(b, y.column("g_r").type), "sim": pa.array(found, pa.float64())})

    found = _met(left.select("id", "v", "g"), right.select("id", "v", "g"), block_rows).applyInArrow(meet, f"ga {kinds[0]}, gb {kinds[1]}, sim double")
    return found.groupBy("ga", "gb").agg(F.max("sim").alias("sim"))


def scorable(df: DataFrame, score: str, *columns: str) -> DataFrame:
    """The rows (id, v and columns) whose vectors have finite scores."""
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.abs(x))
    return df.select(*dict.fromkeys(["id", "v", *columns])).filter((length > (0 if score == "cosine" else -1)) & (length < float("inf")))


def _near_scores(score: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Scores in single precision; vectors are of length 1 for cosines."""
    if score != "l1":
        return a @ b.T
    out = np.zeros((len(a), len(b)), np.float32)
    for at in range(0, len(b), 2048):
        part, columns = out[:, at : at + 2048], np.ascontiguousarray(b[at : at + 2048].T)
        for k in range(a.shape[1]):
            part += np.abs(a[:, k, None] - columns[k][None])
    return 1 / (1 + out / 12)


def _slack(score: str, a: np.ndarray, b: np.ndarray) -> float:
    """Twice what a score in single precision may be off by, and what rounding to nine decimals ties."""
    size = 1.0 if score == "cosine" else np.linalg.norm(a, axis=1).max() * np.linalg.norm(b, axis=1).max() if score == "dot" else max(1.0, a.shape[1] * max(np.abs(a).max(), np.abs(b).max()) / 12)
    return 2 * (a.shape[1] + 8) * 2.0**-23 * size + 2e-9


def nearest_in_block(x: pa.Table, y: pa.Table, score: str, other: bool, where: tuple[str, str] | None, same: tuple[str, str] | None) -> pa.Table:
    """id, neighbour, sim: of each row of x its nearest row of y (columns with _r), ties to the smallest id, as dense_nearest asks. Scores in single
    precision tell which few pairs can be a row's best; those are scored in double precision. Where they are many (copies), all of a tile are."""
    out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    if x.num_rows and y.num_rows:
        y = y.take(pa.array(np.argsort(y.column("id_r").to_numpy(), kind="stable")))
        a, b = matrix_of(x.column("v")), matrix_of(y.column("v_r"))
        if score == "cosine":
            a, b = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (a, b))
        fine = a.astype(np.float32), b.astype(np.float32)
        slack = _slack(score, a, b)
        ids, refs = x.column("id").to_numpy(), y.column("id_r").to_numpy()
        step = max(1, min(256, TILE // len(b)))
        for at in range(0, len(a), step):
            own = x.slice(at, step)
            barred = np.zeros((own.num_rows, len(b)), bool)
            if other:
                barred |= ids[at : at + step, None] == refs[None]
            if where:
                barred |= _equal(own, y, where)
            if same:
                barred |= ~_equal(own, y, same)
            near = _near_scores(score, fine[0][at : at + step], fine[1])
            near[barred] = -np.inf
            top = near.max(1)
            could = (near >= (top - slack)[:, None]) & (top > -np.inf)[:, None]
            if np.isfinite(top[top > -np.inf]).all() and np.count_nonzero(could) <= 8 * len(near) + 1024:
                i, j = np.nonzero(could)
                p, q = a[at + i], b[j]
                sim = np.round(1 / (1 + np.abs(p - q).sum(1) / 12) if score == "l1" else np.einsum("ij,ij->i", p, q), 9)
                order = np.lexsort((j, -sim, i))
                first = order[np.flatnonzero(np.diff(i[order], prepend=-1))]
                row, best, sim = i[first], j[first], sim[first]
            else:
                sim = np.round(SCORES[score](a[at : at + step], b), 9)
                sim[barred | np.isnan(sim)] = -np.inf
                best = sim.argmax(1)
                sim = sim[np.arange(len(best)), best]
                row = np.flatnonzero(np.isfinite(sim))
                best, sim = best[row], sim[row]
            out.append((ids[at + row], refs[best], sim))
    ids, refs, found = (np.concatenate(c) for c in zip(*out))
    return pa.table({"id": pa.array(ids, x.column("id").type), "neighbour": pa.array(refs, y.column("id_r").type), "sim": pa.array(found, pa.float64())})


def dense_nearest(
    queries: DataFrame, references: DataFrame, score: str = "cosine", other: bool = False, where: tuple[str, str] | None = None, same: tuple[str, str] | None = None, block_rows: int = 1024,
) -> DataFrame:
    """id, neighbour, sim: each query's nearest reference, ties to the smallest id. other: not the query itself. where
    = (query column, reference column): only references with another value; same: only with one value. A block pair reports one row for
    each query. Where all block pairs are more than MANY_BLOCKS and the score falls with a metric, a ball cover leaves out those that cannot matter; if it
    leaves out too few (vectors without clusters), large blocks of all rows meet."""
    kind = dict(queries.dtypes)["id"]
    n, m = queries.count(), references.count()
    if score in balls.METRICS and math.ceil(n / block_rows) * math.ceil(m / block_rows) > MANY_BLOCKS:
        found = balls.ball_nearest(queries, references, score, other, where, same, block_rows=block_rows, worth=WORTH)
        if found is not None:
            return found
        block_rows = max(block_rows, large_blocks(max(n, m)))
    columns = [[c[side] for c in (where, same) if c] for side in (0, 1)]
    met = _met(scorable(queries, score, *columns[0]), scorable(references, score, *columns[1]), block_rows, same=same)
    found = met.applyInArrow(lambda x, y: nearest_in_block(x, y, score, other, where, same), f"id {kind}, neighbour {kind}, sim double")
    best = found.groupBy("id").agg(F.min(F.struct((-F.col("sim")).alias("s"), "neighbour")).alias("n"))
    return best.select("id", F.col("n.neighbour").alias("neighbour"), (-F.col("n.s")).alias("sim"))


def pack_bits(df: DataFrame, key: str, bit: str, n: int) -> DataFrame:
    """key and `words`: its bits 0..n-1, 64 to a long. df holds (key, bit), repeats included; sums of distinct powers are bits."""
    width = -(-n // 64)
    at = df.select(key, F.floor(F.col(bit) / 64).cast("int").alias("_w"), (F.col(bit) % 64).cast("int").alias("_b"))
    words = at.groupBy(key).agg(*(F.bit_or(F.when(F.col("_w") == w, F.expr("shiftleft(1L, _b)")).otherwise(F.lit(0).cast("long"))).alias(f"_w{w}") for w in range(width)))
    return words.select(key, F.array(*(f"_w{w}" for w in range(width))).alias("words"))


def packed_tanimoto(a: Column | str, b: Column | str) -> Column:
    """Similarity of two packed bit sets by population counts; two empty ones have 0."""
    count = lambda f: F.aggregate(F.zip_with(col(a), col(b), f), F.lit(0), lambda n, w: n + F.bit_count(w))
    return F.coalesce(ratio(count(lambda x, y: x.bitwiseAND(y)), count(lambda x, y: x.bitwiseOR(y))), F.lit(0.0))


def nearest_of_pairs(pairs: DataFrame, left: str, right: str, sim: str = "sim") -> DataFrame:
    """The best partner of each left id among given pairs, ties to the smallest; an aggregation, not a window."""
    best = pairs.groupBy(left).agg(F.min(F.struct((-F.col(sim)).alias("s"), right)).alias("n"))
    return best.select(left, F.col("n")[right].alias("neighbour"), (-F.col("n.s")).alias(sim))


def both_ways(pairs: DataFrame, sim: str = "sim") -> DataFrame:
    return pairs.select("a", "b", sim).unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), sim))


def threshold_stats(pairs: DataFrame, thresholds: list[float], delta: str, by: list[str] | None = None) -> DataFrame:
    """Statistics of delta over the pairs from each threshold on. Each pair is counted once for every threshold that it passes."""
    passed = F.filter(F.array(*map(F.lit, thresholds)), lambda t: F.col("sim") >= t)
    rows = pairs.withColumn("threshold", F.explode(passed))
    q = F.percentile(F.col(delta), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = rows.groupBy("threshold", *(by or []))
    return g.agg(F.count("*").alias("n"), F.avg(delta).alias("mean"), q[1].alias("median"), q[0].alias("q1"), q[2].alias("q3"), (q[2] - q[0]).alias("iqr"), F.count_if(F.col(delta) >= 1).alias("cliffs_1"), F.count_if(F.col(delta) >= 2).alias("cliffs_2"))


__all__ = ["SCORES", "both_ways", "count_pairs", "dense_nearest", "dense_pairs", "group_best", "nearest_of_pairs", "pack_bits", "packed_tanimoto", "set_pairs", "sized_pairs", "sparse_pairs", "threshold_stats", "top_set_pairs"]
