"""Similar sets by packed blocks, against all pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph, sets


@pytest.fixture(scope="module")
def words(spark):
    """Sets of 1 to 200 words, a third alike, with copies, and null and empty ones; one id occurs twice."""
    r = random.Random(6)
    rows = []
    for k in range(260):
        own = {f"w{r.randrange(60)}" for _ in range(int(1.03 ** r.randrange(0, 180)))} | ({f"h{i}" for i in range(30) if r.random() < 0.95} if k % 3 == 0 else set())
        rows.append((k, sorted(own | {"all"})))
    rows += [(300 + k, rows[3 * k % 40][1]) for k in range(25)] + [(400, None), (401, []), (None, ["all"]), (7, ["w1", "more"])]
    want = {k: set(s) for k, s in rows if k is not None and s}
    want[7] = set(rows[7][1]) | {"w1", "more"}
    return want, spark.createDataFrame(rows, "id long, w array<string>").repartition(3).cache()


@pytest.mark.parametrize("least, block_rows, frequent", [(0.6, 16, 20), (0.6, 1000, 1 << 16), (0.85, 7, 1), (1.0, 40, 30)])
def test_packed_sets_give_all_pairs(words, least, block_rows, frequent, monkeypatch):
    monkeypatch.setattr(sets, "STEP", 64)
    plain, df = words
    want = {(a, b): len(plain[a] & plain[b]) / len(plain[a] | plain[b]) for a in plain for b in plain if a < b}
    want = {p: s for p, s in want.items() if s >= least - 5e-7}
    got = sets.similar_sets(df, "id", "w", least, block_rows=block_rows, frequent=frequent).collect()
    assert len(got) == len(want) > 10 and {(r.a, r.b) for r in got} == set(want) and all(abs(r.sim - want[r.a, r.b]) < 2e-6 for r in got)


def test_long_bitmaps_and_blocks_of_few_items_leave_no_pair_out(words, monkeypatch):
    plain, df = words
    limits = sets.size_blocks
    monkeypatch.setattr(sets, "size_blocks", lambda rows, size, low, block_rows, items: limits(rows, size, low, block_rows, 700))
    used = []
    whole = sets._Side.more
    monkeypatch.setattr(sets._Side, "more", lambda side: used.append(1) or whole(side))
    packed = sets.packed_sets(df, "id", "w", 20)
    blocks = limits(packed, "n", 0.6, 100, 700).groupBy("b").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).orderBy("b").collect()
    assert [r.b for r in blocks] == list(range(len(blocks))) and len(blocks) > 8 and max(r.n for r in blocks) <= 900 and max(r.rows for r in blocks) <= 102
    want = {(a, b) for a in plain for b in plain if a < b and len(plain[a] & plain[b]) / len(plain[a] | plain[b]) >= 0.6}
    got = sets.similar_sets(df, "id", "w", 0.6, frequent=20).collect()
    assert len(got) == len(want) and {(r.a, r.b) for r in got} == want

    # In one process: most pairs fall by the bitmaps, and heads are shorter where the other block has no small sets.
    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(2)
    items = [np.unique(np.append(r.integers(0, 9000, 3000), np.arange(40))) for _ in range(60)]
    items[1] = items[0][:-50]
    n, often = np.array([len(i) for i in items]), pa.array([i.astype("<u2").tobytes() for i in items])
    rare = pa.array([b""] * 60, pa.binary())
    side, short = (sets._Side(rare, often, n, 0.6, np.empty(0, "<i8"), least) for least in (0, int(n.min())))
    assert len(short.head) < 0.7 * len(side.head)
    assert {(int(a), int(b)) for i, j, _ in sets._near(short, short, 0.6, 1 << 16) for a, b in zip(i, j) if a < b} == {(0, 1)} and used


def test_links_have_the_same_components(spark, words):
    plain, df = words
    nodes = spark.createDataFrame([(k,) for k in plain], "id long")
    roots = [{r.id: r.root for r in graph.components(nodes, sets.similar_sets(df, "id", "w", 0.6, links), "id").collect()} for links in (False, True)]
    assert roots[0] == roots[1] and len(set(roots[0].values())) < len(plain)


def test_many_copies_make_few_links(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") < 4900, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"), F.col("id").cast("string"))).alias("w"))
    assert sets.similar_sets(df, "id", "w", 0.6, links=True).count() == 4899
    assert [(r.a, r.b, r.sim) for r in sets.top_sets(df, "id", "w", 2).collect()] == [(0, 1, 1.0), (0, 2, 1.0)]


def test_graphs_of_rows_are_those_of_tables(spark, monkeypatch):
    """What is made row by row equals what joins of nodes and edges give; a row's edges are handed on in parts."""
    monkeypatch.setattr(graph, "HANDED_ON", 20)
    r = random.Random(5)
    rows = [(k, f"s{k % 3}", [f"w{r.randrange(9)}" for _ in range(r.randrange(0, 40))]) for k in range(60)] + [(60, None, ["a", "b", "a"]), (61, "s1", None), (62, "s1", ["one"])]
    df = spark.createDataFrame(rows, "g long, source string, items array<string>").repartition(3).cache()
    nodes, edges = (t.cache() for t in graph.path_tables(df.select("g", "items"), "g", "items"))
    in_order = lambda t: sorted(map(str, t.collect()))
    assert in_order(graph.path_bits(df, "g", "items").select("g", "bits")) == in_order(graph.folded(graph.neighbourhood_ids(nodes, edges, "g", F.col("node")), "g").select("g", "bits"))
    want = in_order(graph.batch_edges(nodes, edges, "g", df.select("source", "g"), ["source"]).select("source", "g", "src", "dst"))
    assert in_order(graph.path_batches(df, "g", "items", ["source"]).select("source", "g", "src", "dst")) == want and len(want) > 500
    assert graph.one_row_each(df, "g") and not graph.one_row_each(df.union(df), "g") and not graph.one_row_each(df, "source")
