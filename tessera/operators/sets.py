"""Pairs of similar sets, of the words of documents.

A set becomes one short binary: its frequent items as 16-bit ranks, the others by their 64-bit hashes (which are proved to differ where items do). No item moves by
itself but in the pre-aggregated counts of the vocabulary. Equal sets are one; different ones meet in large blocks of like sizes, each of which
moves once for every block that it meets. In a meeting, sets that share an item among the rarest n - ceil(least * n) + 1 of both are candidates (prefix filter),
positions and bitmaps bound what these can share, and the rest is counted exactly. All pairs that reach the threshold are found.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.similarity import set_pairs, six, size_blocks
from tessera.sources.work import drop_stored, stored

#: Items that have a rank; sets of the largest blocks, and their items; cells of a tile, candidates that are looked at at once.
FREQUENT, BLOCK, ITEMS, CELLS, STEP = 1 << 16, 32_768, 1 << 22, 1 << 23, 1 << 19
#: Bits of a bitmap, and of the one that follows where it leaves pairs: a thousand items fill the first.
BITS, MORE_BITS = 1024, 8192


def packed_sets(df: DataFrame, key: str, words: str, frequent: int = FREQUENT) -> DataFrame:
    """id, n (size), rare (hashes, in order), often (ranks from rare to frequent, in order) of the sets of each id (the union, where it repeats) that are not empty;
    rows without an id are left out. words: an array of distinct texts. Stored."""
    for salt in itertools.count():
        told = F.transform(words, lambda w: F.struct(F.xxhash64(w, F.lit(salt)).alias("h"), F.hash(w).alias("k")))
        hashed = stored(df.filter(F.col(key).isNotNull()).select(F.col(key).alias("id"), told.alias("w")))  # texts are cut into words once
        rows = hashed.filter(F.size("w") > 0)
        if rows.groupBy("id").count().filter("count > 1").take(1):
            rows = rows.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("w"))).alias("w"))
        counts = stored(rows.select(F.inline("w")).groupBy("h").agg(F.count("*").alias("n"), F.min("k").alias("low"), F.max("k").alias("high")))
        if not counts.filter("low <> high").take(1):  # no two words have one hash
            break
        drop_stored(hashed)
    ranked = counts.orderBy(F.desc("n"), "h").limit(frequent).select("h").toArrow().column("h").to_numpy()
    order = np.argsort(ranked)
    known_ranks = df.sparkSession.sparkContext.broadcast((ranked[order], (len(ranked) - 1 - order).astype(np.int64)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, ranks = known_ranks.value
        for batch in batches:
            size = batch.column("h").value_lengths().to_numpy()
            h = batch.column("h").flatten().to_numpy()
            row = np.repeat(np.arange(len(size)), size)
            place = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            known = hashes[place] == h
            value = np.where(known, ranks[place], h)
            out = []
            for own, kind in ((~known, "<i8"), (known, "<u2")):
                at = np.flatnonzero(own)
                at = at[np.lexsort((value[at], row[at]))]
                ends = np.append(0, np.cumsum(np.bincount(row[at], minlength=len(size)))).astype(np.int32) * np.dtype(kind).itemsize
                out.append(pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(value[at].astype(kind).tobytes())]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(size.astype(np.int32)), *out], ["id", "n", "rare", "often"])

    out = stored(rows.select("id", F.col("w.h").alias("h")).mapInArrow(pack, f"id {dict(rows.dtypes)['id']}, n int, rare binary, often binary"))
    drop_stored(hashed)
    return out


class _Side:
    """Sets of a block: row, code and position of each item, in order; sizes, ends, bitmaps; and the heads: the items of which two sets that reach `low` share
    one. A set of n items shares at least o = low / (1 + low) * (n + m) with one of m, and m is `least_other` (the smallest set of the other block) or
    low * n at least, so its head has n - ceil(o) + 1 items: a quarter of it in a block of like sizes if `low` is 0.6."""

    def __init__(self, rare: pa.Array, often: pa.Array, n: np.ndarray, low: float, known: np.ndarray, least_other: int = 0):
        sizes = [pc.binary_length(c).to_numpy() // w for c, w in ((rare, 8), (often, 2))]
        hashes, ranks = (np.frombuffer(b"".join(c.to_pylist()), kind) for c, kind in ((rare, "<i8"), (often, "<u2")))
        row = np.concatenate([np.repeat(np.arange(len(n)), s) for s in sizes])
        code = np.concatenate([np.searchsorted(known, hashes), ranks.astype(np.int64) + len(known)]).astype(np.int32)
        order = np.argsort(row, kind="stable")
        self.n, self.row, self.code = n, row[order].astype(np.int32), code[order]
        self.ends = np.append(0, np.cumsum(n))
        self.place = (np.arange(len(self.row)) - self.ends[self.row]).astype(np.int32)
        shared = np.ceil(low / (1 + low) * (n + np.maximum(least_other, n * low)) - 1e-9).astype(np.int64)
        self.head = np.flatnonzero(self.place < (n - shared + 1)[self.row])
        self.bits, self.more_bits = self._bitmaps(BITS), None

    def _bitmaps(self, width: int) -> np.ndarray:
        parts = []
        for at in range(0, len(self.n), CELLS // width):
            rows = len(self.n[at : at + CELLS // width])
            own = slice(self.ends[at], self.ends[at + rows])
            bits = np.zeros((rows, width), bool)
            bits[self.row[own] - at, self.code[own] % width] = True
            parts.append(np.packbits(bits, axis=1).view(np.uint64))
        return np.concatenate(parts)

    def more(self) -> np.ndarray:
        if self.more_bits is None:
            self.more_bits = self._bitmaps(MORE_BITS)
        return self.more_bits


def _near(x: _Side, y: _Side, low: float, n_codes: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of x and y and how much they share, of all pairs that reach `low`."""
    by_code = y.head[np.argsort(y.code[y.head], kind="stable")]
    starts = np.searchsorted(y.code[by_code], np.arange(n_codes + 1))
    y_row, y_place = y.row[by_code], y.place[by_code]
    x_rest, y_rest, y_size = (x.n[x.row] - x.place).astype(np.int32), (y.n[y_row] - y_place).astype(np.int32), y.n[y_row].astype(np.int32)
    factor = np.float32((1 + low) / low)
    flags = np.zeros(n_codes, np.int64)
    step = max(1, CELLS // len(y.n))
    for first in range(0, len(x.n), step):
        heads = x.head[slice(*np.searchsorted(x.row[x.head], (first, first + step)))]
        many = starts[x.code[heads] + 1] - starts[x.code[heads]]
        heads, many = heads[many > 0], many[many > 0]
        mark = np.zeros((min(step, len(x.n) - first), len(y.n)), bool)
        upto = np.cumsum(many)
        at = 0
        while at < len(heads):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + STEP)))
            own, m = heads[at:to], many[at:to]
            e = np.repeat(own, m)
            q = np.arange(len(e)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(starts[x.code[own]], m)
            # What two sets share is at most what stands on the same side of a shared item, and it.
            most = np.minimum(x.place[e], y_place[q]) + np.minimum(x_rest[e], y_rest[q])
            ok = np.flatnonzero(most * factor >= x.place[e] + x_rest[e] + y_size[q] - np.float32(0.5))
            i, j = x.row[e[ok]], y_row[q[ok]]
            mark[i - first, j] = True
            at = to
        i, j = np.nonzero(mark)
        i += first
        for lo in range(0, len(i), STEP // 8):
            a, b = i[lo : lo + STEP // 8], j[lo : lo + STEP // 8]
            both = x.n[a] + y.n[b]
            for longer in (False, True):
                if longer and len(a) < 64:  # few: they are counted at once
                    break
                p, q = (x.more(), y.more()) if longer else (x.bits, y.bits)
                part = [np.bitwise_count(p[a[k : k + STEP // 64]] ^ q[b[k : k + STEP // 64]]).sum(1, dtype=np.int64) for k in range(0, len(a), STEP // 64)]
                apart = np.concatenate([np.empty(0, np.int64), *part])  # no more than the items of one of them
                ok = (both - apart) * (1 + low) >= 2 * low * both
                a, b, both = a[ok], b[ok], both[ok]
            shared = np.empty(len(a), np.int64)
            cuts = np.flatnonzero(np.diff(a, prepend=-1))
            for f, g in zip(cuts.tolist(), [*cuts[1:].tolist(), len(a)]):
                own = x.code[x.ends[a[f]] : x.ends[a[f] + 1]]
                flags[own] = 1
                shared[f:g] = [flags[y.code[y.ends[k] : y.ends[k + 1]]].sum() for k in b[f:g].tolist()]
                flags[own] = 0
            ok = shared * (1 + low) >= low * both
            yield a[ok], b[ok], shared[ok]


def _pairs(distinct: DataFrame, least: float, block_rows: int | None) -> DataFrame:
    """a < b and sim of different sets."""
    kind, low = dict(distinct.dtypes)["id"], least - 1e-6
    rows, total = distinct.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    blocks = size_blocks(distinct, "n", low, block_rows or max(1024, min(BLOCK, -(-rows // 12))), max(1 << 18, min(ITEMS, -(-total // 16))))

    def meet(x: pa.Table, y: pa.Table) -> pa.Table:
        ids = [[], []]
        sims = [np.empty(0)]
        if x.num_rows and y.num_rows:
            x, y = x.combine_chunks(), y.combine_chunks()
            columns = [[t.column(f"{c}{s}").combine_chunks() for c in ("id", "rare", "often", "n")] for t, s in ((x, ""), (y, "_r"))]
            known = np.unique(np.concatenate([np.frombuffer(b"".join(c[1].to_pylist()), "<i8") for c in columns]))
            sizes = [c[3].to_numpy().astype(np.int64) for c in columns]
            sides = [_Side(c[1], c[2], n, low, known, int(other.min())) for c, n, other in zip(columns, sizes, sizes[::-1])]
            same = x.column("bl")[0] == x.column("br")[0]
            for i, j, shared in _near(*sides, low, len(known) + FREQUENT):
                a, b = columns[0][0].take(pa.array(i)), columns[1][0].take(pa.array(j))
                meant = pc.less(a, b) if same else pc.not_equal(a, b)
                sims.append((shared / (sides[0].n[i] + sides[1].n[j] - shared))[meant.to_numpy(zero_copy_only=False)])
                a, b = a.filter(meant), b.filter(meant)
                ids[0].append(pc.min_element_wise(a, b))
                ids[1].append(pc.max_element_wise(a, b))
        a, b = (pa.chunked_array(part, x.column("id").type if x.num_rows else y.column("id_r").type) for part in ids)
        return pa.table({"a": a, "b": b, "sim": pa.array(np.concatenate(sims), pa.float64())})

    columns = ("id", "n", "rare", "often")
    left = blocks.select(*columns, F.col("b").alias("bl"), F.explode(F.sequence("b", "last")).alias("br"))
    right = blocks.select(*(F.col(c).alias(f"{c}_r") for c in columns), F.col("b").alias("br"), F.explode(F.sequence("first", "b")).alias("bl"))
    found = left.groupBy("bl", "br").cogroup(right.groupBy("bl", "br")).applyInArrow(meet, f"a {kind}, b {kind}, sim double")
    return found.withColumn("sim", six("sim")).filter(F.col("sim") >= least)


def similar_sets(df: DataFrame, key: str, words: str, least: float, links: bool = False, block_rows: int | None = None, frequent: int = FREQUENT) -> DataFrame:
    """a < b and sim, the Tanimoto similarity, of all pairs of rows (key, words: an array of distinct texts) from `least` on. links: of equal sets only the
    smallest id is paired with others, and the others are linked to it with 1: the same components and members, without all pairs of copies."""
    sets = packed_sets(df, key, words, frequent)
    same = sets.select("id", "n", F.sha2(F.concat("rare", "often"), 256).alias("_k"))
    classes = same.groupBy("n", "_k").agg(F.min("id").alias("rep"), F.count("*").alias("_m")).filter("_m > 1")
    copies = stored(same.join(classes, ["n", "_k"]).select("rep", "id"))
    if not copies.take(1):
        return _pairs(sets, least, block_rows)
    others = copies.filter("id <> rep")
    found = _pairs(sets.join(others.select("id"), "id", "left_anti"), least, block_rows)
    if links:
        return found.unionByName(others.select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("sim")))
    for c in "ab":
        found = found.join(copies.select(F.col("rep").alias(c), "id"), c, "left").withColumn(c, F.coalesce("id", c)).drop("id")
    found = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sim")
    within = copies.withColumnRenamed("id", "a").join(copies.withColumnRenamed("id", "b"), "rep").filter("a < b")
    return found.unionByName(within.select("a", "b", F.lit(1.0).alias("sim")))


def top_sets(df: DataFrame, key: str, words: str, n: int, steps: tuple[float, ...] = (0.8, 0.5)) -> DataFrame:
    """The n most similar pairs by (-sim, a, b): thresholds from high to low; only if too few pairs reach the lowest, all sets meet."""
    for least in steps:
        best = stored(similar_sets(df, key, words, least).orderBy(F.desc("sim"), "a", "b").limit(n))
        if best.count() == n:
            return best.orderBy(F.desc("sim"), "a", "b")
    return set_pairs(df.select(key, F.explode(words).alias("_w")).distinct(), key, "_w", top=n)
