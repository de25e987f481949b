"""Connected components of a threshold graph, and graphs as features: tables of nodes and edges, neighbourhood fingerprints, batches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.expr import bucket
from tessera.operators.reshape import offsets
from tessera.operators.scan import Carried, Line
from tessera.sources.work import stored

#: Edges that one task may join up: 16 MB of them.
SMALL = 1 << 20


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All of few edges (u > v) at once: every node that is not a root, and its root."""
    edges = pa.Table.from_batches(list(batches), pa.schema([("u", pa.int64()), ("v", pa.int64())]))
    nodes, place = np.unique(np.concatenate([edges.column("u").to_numpy(), edges.column("v").to_numpy()]), return_inverse=True)
    u, v = np.split(place, 2)
    root = np.arange(len(nodes))
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            break
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while not np.array_equal(root[root], root):
            root = root[root]
    child = np.flatnonzero(root != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[child]), pa.array(nodes[root[child]])], ["u", "v"])


def components(nodes: DataFrame, edges: DataFrame, node: str = "id", a: str = "a", b: str = "b", small: int = SMALL) -> DataFrame:
    """node and root, the smallest node that it reaches.

    Each round hangs every node's neighbours below the smallest that it knows, and then skips a level by looking up the
    parent's parent; edges inside a tree are dropped. The rounds grow with the logarithm of a component's diameter. No more than `small`
    edges between whole-number nodes are joined up in one task instead."""
    links = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    kind = dict(links.dtypes)["u"]
    few = kind in ("int", "bigint") and links.count() <= small
    if few:
        links = links.select(F.col("u").cast("long"), F.col("v").cast("long")).coalesce(1).mapInArrow(_joined, "u long, v long").select(F.col("u").cast(kind), F.col("v").cast(kind))
    while not few:
        state = links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if not state[0]:
            break
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = stored(both.join(least, F.col("u") == F.col("w")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        told = large.join(least, F.col("u") == F.col("w"))
        small = told.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(told.select("u", F.col("m").alias("v")))
        links = stored(small.distinct())
        if links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first() == state:
            break
    roots = links.select(F.col("u").alias(node), F.col("v").alias("root"))
    return nodes.select(node).join(roots, node, "left").withColumn("root", F.coalesce("root", node))


def path_graph(items: Column) -> tuple[Column, Column]:
    """Nodes and edges of the graph in which neighbours of an array of texts are linked: distinct items, and distinct links "a b" with a < b,
    no item being linked to itself. Featurisers number the nodes by their place; a batch lays them end to end by reshape.offsets."""
    before, after = F.slice(items, 1, F.greatest(F.size(items) - 1, F.lit(0))), F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0)))
    links = F.zip_with(before, after, lambda a, b: F.when(a != b, F.concat_ws(" ", F.least(a, b), F.greatest(a, b))))
    return F.array_distinct(items), F.array_distinct(F.filter(links, lambda x: x.isNotNull()))


def path_tables(df: DataFrame, graph: str, items: str) -> tuple[DataFrame, DataFrame]:
    """The same graphs as tables: nodes (graph, node, place: number of the distinct item by its first occurrence) and edges (graph, a, b with a < b)."""
    rows = df.select(graph, F.posexplode(items).alias("_p", "node"))
    nodes = rows.groupBy(graph, "node").agg(F.min("_p").alias("_p"))
    nodes = Line(nodes, [graph], ["_p"], 8).carry(place=Carried("sum", F.lit(1).cast("long"), own=False)).done().withColumn("place", F.coalesce("place", F.lit(0).cast("long"))).drop("_p")
    before, after = F.slice(items, 1, F.greatest(F.size(items) - 1, F.lit(0))), F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0)))
    links = F.inline(F.zip_with(before, after, lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))))
    return nodes, df.select(graph, links).filter("a <> b").distinct()


def neighbourhood_ids(nodes: DataFrame, edges: DataFrame, graph: str, label: Column, rounds: int = 2, hashed: Callable[[Column], Column] = lambda text: bucket(text, 1 << 32)) -> DataFrame:
    """graph, node, round, id: what each node's neighbourhood of radius 0 to `rounds` looks like, as a number. Round 0 hashes the node's label; every
    further one hashes the node's last number with the sum of its neighbours', which is the same in any order. Sums are pre-aggregated, so a node
    with very many neighbours meets its numbers, not its edges, in a task."""
    both = stored(edges.select(graph, F.col("a").alias("_to"), F.col("b").alias("_from")).unionByName(edges.select(graph, F.col("b").alias("_to"), F.col("a").alias("_from"))))
    now = stored(nodes.select(graph, "node", hashed(F.concat(F.lit("0|"), label.cast("string"))).alias("id")))
    out = now.withColumn("round", F.lit(0))
    for k in range(1, rounds + 1):
        sums = both.join(now.withColumnRenamed("node", "_from"), [graph, "_from"]).groupBy(graph, F.col("_to").alias("node")).agg(F.sum("id").alias("_s"))
        text = F.concat_ws("|", F.lit(k), F.col("id").cast("string"), F.coalesce("_s", F.lit(0)).cast("string"))
        now = stored(now.join(sums, [graph, "node"], "left").select(graph, "node", hashed(text).alias("id")))
        out = out.unionByName(now.withColumn("round", F.lit(k)))
    return out.select(graph, "node", "round", "id")


def folded(ids: DataFrame, graph: str, bits: int = 2048) -> DataFrame:
    """graph, bits: the numbers of its neighbourhoods modulo `bits`, in order, once each; `bits` at most."""
    return ids.select(graph, (F.col("id") % bits).cast("int").alias("_b")).distinct().groupBy(graph).agg(F.array_sort(F.collect_list("_b")).alias("bits"))


def batch_edges(nodes: DataFrame, edges: DataFrame, graph: str, batch: DataFrame, by: list[str], ranges: int = 1) -> DataFrame:
    """by, graph, src, dst: every edge in both directions, nodes numbered through each batch: the graphs of a batch (graph and by) are laid end to end in
    their order. nodes: graph, node, place."""
    sizes = nodes.groupBy(graph).agg(F.count("*").alias("_n"))
    first = offsets(batch.join(sizes, graph).select(*by, graph, "_n"), by, graph, "_n", "_first", ranges)
    a, b = (nodes.select(graph, F.col("node").alias(c), F.col("place").alias(f"_{c}")) for c in "ab")
    rows = edges.join(a, [graph, "a"]).join(b, [graph, "b"]).join(first.select(*by, graph, "_first"), graph)
    ends = [F.col("_first") + F.col(f"_{c}") for c in "ab"]
    return rows.select(*by, graph, F.inline(F.array(*(F.struct(x.alias("src"), y.alias("dst")) for x, y in (ends, ends[::-1])))))


#: Edges that a task hands on at once.
HANDED_ON = 1 << 18


def one_row_each(df: DataFrame, key: str) -> bool:
    """Whether every row has a key of its own."""
    return not df.groupBy(key).count().filter((F.col("count") > 1) | F.col(key).isNull()).take(1)


def _path(items: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct items in the order of their first occurrence, and the links of neighbours (places a < b), once each."""
    coded = items.dictionary_encode()
    place = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    low, high, n = np.minimum(place[:-1], place[1:]), np.maximum(place[:-1], place[1:]), len(coded.dictionary)
    links = np.unique((low * n + high)[low < high])
    return coded.dictionary, links // max(1, n), links % max(1, n)


def _numbers(texts: Iterable[bytes]) -> np.ndarray:
    """The first 32 bits of each text's md5, as bucket() has them."""
    return np.frombuffer(b"".join(hashlib.md5(x, usedforsecurity=False).digest()[:4] for x in texts), ">u4").astype(np.int64)


def path_bits(df: DataFrame, graph: str, items: str, rounds: int = 2, bits: int = 2048) -> DataFrame:
    """graph, bits: folded(neighbourhood_ids(...)) of the graph of each row's items (see path_tables), labelled by the items. A graph is made, and left behind,
    where its row is, so nothing moves. Rows without items are left out; the key is unique (one_row_each)."""

    def of(row: pa.Array) -> list[int]:
        nodes, a, b = _path(row)
        now = _numbers(b"0|" + w.encode() for w in nodes.to_pylist())
        found = [now]
        for k in range(1, rounds + 1):
            sums = np.zeros(len(now), np.int64)
            np.add.at(sums, a, now[b])
            np.add.at(sums, b, now[a])
            now = _numbers(f"{k}|{i}|{s}".encode() for i, s in zip(now.tolist(), sums.tolist()))
            found.append(now)
        return np.unique(np.concatenate(found) % bits).tolist()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(graph), pa.array([of(x.values) for x in batch.column(items)], pa.list_(pa.int32()))], [graph, "bits"])

    return df.select(graph, items).filter(F.size(items) > 0).mapInArrow(made, f"`{graph}` {dict(df.dtypes)[graph]}, bits array<int>")


def path_batches(df: DataFrame, graph: str, items: str, by: list[str], ranges: int = 1) -> DataFrame:
    """by, graph, src, dst: what batch_edges gives for the graphs of each row's items. Only sizes are laid end to end; a row then gets its first number and
    makes its edges. The key is unique (one_row_each)."""
    sizes = df.select(*by, graph, F.size(F.array_distinct(items)).cast("long").alias("_n")).filter("_n > 0")
    first = offsets(sizes, by, graph, "_n", "_first", ranges).select(F.col(graph).alias("_of"), "_first")
    rows = df.select(*by, graph, items).join(first, F.col(graph) == F.col("_of")).drop("_of")
    names = [*by, graph]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple[int, np.ndarray, np.ndarray]] = []
            for k, (row, start) in enumerate(zip(batch.column(items), batch.column("_first").to_pylist())):
                _, a, b = _path(row.values)
                held.append((k, np.concatenate([a, b]) + start, np.concatenate([b, a]) + start))
                if k == batch.num_rows - 1 or sum(len(x) for _, x, _ in held) > HANDED_ON:
                    at = pa.array(np.repeat([i for i, *_ in held], [len(x) for _, x, _ in held]).astype(np.int64))
                    ends = [pa.array(np.concatenate([h[side] for h in held]), pa.int64()) for side in (1, 2)]
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in names), *ends], [*names, "src", "dst"])
                    held = []

    kinds = dict(df.dtypes)
    return rows.mapInArrow(made, ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "src long, dst long"]))
