"""Which blocks meet: the ball cover of nearest neighbours, and sets in blocks of like sizes."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import balls, similarity


def vectors(spark, x, ids=None):
    rows = [(int(i), v.tolist(), int(i) % 3, int(i) % 7) for i, v in zip(ids if ids is not None else range(len(x)), x)]
    return spark.createDataFrame(rows, "id long, v array<double>, g int, fold int").repartition(3).cache()


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(2)
    middle = rng.normal(size=(40, 12)) * 10
    x = np.concatenate([middle[rng.integers(0, 40, 1200)] + rng.normal(size=(1200, 12)) * 0.2, middle[:3].repeat(30, 0)])  # and copies
    return vectors(spark, x)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("score", ["cosine", "l1"])
@pytest.mark.parametrize("how", [{"other": True}, {"where": ("fold", "fold")}, {"other": True, "same": ("g", "g")}, {}], ids=str)
def test_ball_cover_is_exact(clustered, score, how):
    want = rows_of(similarity.dense_nearest(clustered, clustered, score, block_rows=2000, **how))
    assert len(want) == clustered.count()
    assert rows_of(balls.ball_nearest(clustered, clustered, score, block_rows=50, **how)) == want


def test_ball_cover_of_two_tables(spark, clustered):
    rng = np.random.default_rng(4)
    q = vectors(spark, np.concatenate([rng.normal(size=(90, 12)), np.zeros((1, 12))]), range(5000, 5091))
    got = rows_of(balls.ball_nearest(q, clustered, block_rows=40, centres=9))
    assert len(got) == 90 and got == rows_of(similarity.dense_nearest(q.filter("id < 5090"), clustered, block_rows=2000))
    assert balls.ball_nearest(q, clustered.filter("id < 0")).count() == 0 == balls.ball_nearest(q.filter("id < 0"), clustered).count()
    one = clustered.filter("id = 5")
    assert {r[1] for r in rows_of(balls.ball_nearest(q, one))} == {5} and balls.ball_nearest(one, one, other=True).count() == 0


def test_ball_cover_skips_blocks(spark, clustered):
    seen: dict = {}
    balls.ball_nearest(clustered, clustered, other=True, block_rows=20, seen=seen).count()
    assert seen["formed"] < 0.15 * seen["possible"]
    plain: dict = {}
    uniform = vectors(spark, np.random.default_rng(1).normal(size=(600, 64)))
    got = balls.ball_nearest(uniform, uniform, other=True, block_rows=20, seen=plain)
    assert rows_of(got) == rows_of(similarity.dense_nearest(uniform, uniform, other=True)) and plain["formed"] > 0.5 * plain["possible"]


def test_many_blocks_take_the_cover(clustered, monkeypatch):
    calls = []
    cover = balls.ball_nearest
    monkeypatch.setattr(balls, "ball_nearest", lambda *a, **k: calls.append(1) or cover(*a, **k))
    want = rows_of(similarity.dense_nearest(clustered, clustered, other=True, block_rows=400))
    assert not calls
    assert rows_of(similarity.dense_nearest(clustered, clustered, other=True, block_rows=100)) == want and calls


@pytest.fixture(scope="module")
def sets(spark):
    """Sets of 1 to 200 items; one item is in all of them, and a third have some thirty items in common."""
    r = random.Random(6)
    out = {}
    for k in range(300):
        n = int(1.03 ** r.randrange(0, 180))
        own = {f"w{r.randrange(60)}" for _ in range(n)} | ({f"h{i}" for i in range(30) if r.random() < 0.95} if k % 3 == 0 else set())
        out[k] = own | {"all"}
    return out, spark.createDataFrame([(k, w) for k, s in out.items() for w in s], "id long, w string").cache()


@pytest.mark.parametrize("least, block_rows", [(0.6, 16), (0.85, 7), (0.6, 1000)])
def test_sets_meet_by_size(sets, least, block_rows, monkeypatch):
    plain, items = sets
    want = {}
    for a in plain:
        for b in plain:
            if a < b and len(plain[a] & plain[b]) / len(plain[a] | plain[b]) >= least - 5e-7:
                want[a, b] = len(plain[a] & plain[b]) / len(plain[a] | plain[b])
    for candidate in (0, 1e9):  # by prefixes, and in blocks
        monkeypatch.setattr(similarity, "CANDIDATE", candidate)
        got = {(r.a, r.b): r.sim for r in similarity.set_pairs(items, "id", "w", least, block_rows=block_rows).collect()}
        assert set(got) == set(want) and all(abs(got[p] - want[p]) < 2e-6 for p in want) and len(want) > 20


def test_blocks_of_sizes(spark):
    r = random.Random(3)
    rows = spark.createDataFrame([(i, r.choice([1, 2, 3, 50, 51, 400])) for i in range(500)], "id long, n int")
    blocks = similarity.size_blocks(rows, "n", 0.6, 20)
    found = blocks.groupBy("b", "first", "last").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count("*").alias("m")).orderBy("b").collect()
    assert len(found) == 25 and all(x.m == 20 for x in found)
    formed = 0
    for x in found:
        near = [y.b for y in found if y.low <= x.high / 0.6 and x.low <= y.high / 0.6]
        assert (x.first, x.last) == (min(near), max(near)) and near == list(range(x.first, x.last + 1))
        formed += len(near)
    assert formed < 0.5 * 25 * 25


def test_uniform_vectors_leave_the_cover(spark):
    """Each query would visit nearly all balls: no rows are made for the visits, large blocks meet instead."""
    x = np.random.default_rng(7).normal(size=(900, 48))
    df = vectors(spark, np.concatenate([x, x[:40]]))
    seen: dict = {}
    assert balls.ball_nearest(df, df, other=True, block_rows=50, worth=similarity.WORTH, seen=seen) is None and not seen
    got = rows_of(similarity.dense_nearest(df, df, other=True, block_rows=50))
    unit = np.concatenate([x, x[:40]]) / np.linalg.norm(np.concatenate([x, x[:40]]), axis=1, keepdims=True)
    sim = np.round(unit @ unit.T, 9)
    np.fill_diagonal(sim, -2)
    assert [(i, j) for i, j, _ in got] == list(enumerate(sim.argmax(1).tolist()))


def test_visits_are_handed_on_in_parts(clustered, monkeypatch):
    monkeypatch.setattr(balls, "VISITS", 7)
    assert rows_of(balls.ball_nearest(clustered, clustered, other=True, block_rows=50)) == rows_of(similarity.dense_nearest(clustered, clustered, other=True, block_rows=2000))


@pytest.mark.parametrize("score", ["cosine", "l1", "dot"])
def test_tiles_of_copies_give_the_smallest_id(score):
    rng = np.random.default_rng(8)
    x = np.concatenate([np.ones((300, 5)), rng.normal(size=(40, 5)), np.ones((1, 5)) * 1e6, np.zeros((1, 5)) + 1e-30])
    ids = rng.permutation(len(x))
    table = pa.table({"id": ids, "v": x.tolist()})
    got = similarity.nearest_in_block(table, table.rename_columns(["id_r", "v_r"]), score, True, None, None)
    sim = np.round(similarity.SCORES[score](x, x), 9)
    np.fill_diagonal(sim, -np.inf)
    want = {int(i): min(int(ids[j]) for j in np.flatnonzero(row == row.max())) for i, row in zip(ids, sim)}
    assert dict(zip(got.column("id").to_pylist(), got.column("neighbour").to_pylist())) == want


def test_pairs_are_counted_where_they_meet(spark):
    rng = np.random.default_rng(9)
    x, y = rng.normal(size=(130, 6)), [None if i % 11 == 0 else float(i % 4) for i in range(130)]
    df = spark.createDataFrame([(i, v.tolist(), k) for i, (v, k) in enumerate(zip(x, y))], "id long, v array<double>, y double").cache()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    pairs = [(i, j, round(float(unit[i] @ unit[j]), 9), None if y[i] is None or y[j] is None else abs(y[i] - y[j])) for i in range(130) for j in range(i + 1, 130)]
    known = [d for *_, d in pairs if d is not None]
    for block_rows in (37, 1000):
        (got,) = similarity.pair_totals(df, "y", block_rows).collect()
        assert got.pairs == len(pairs) and got.mean == pytest.approx(np.mean([s for _, _, s, _ in pairs])) and got.max == max(s for _, _, s, _ in pairs) and got.mean_delta == pytest.approx(np.mean(known))
        edges = [-0.5, 0.0, 0.4]
        want: dict = {}
        for _, _, s, d in pairs:
            want[sum(s >= e for e in edges), d] = want.get((sum(s >= e for e in edges), d), 0) + 1
        cells = similarity.pair_cells(df, edges, "y", block_rows)
        assert {(r.passed, r.delta): r.n for r in cells.collect()} == {k: n for k, n in want.items() if k[0]}
        stats = {r.passed: r for r in similarity.cell_statistics(cells, ["passed"]).collect()}
        own = [d for _, _, s, d in pairs if s >= 0.4 and d is not None]
        assert stats[3].median == np.median(own) and stats[3].q3 == np.quantile(own, 0.75) and stats[3].mean == pytest.approx(np.mean(own)) and stats[3].cliffs_2 == sum(d >= 2 for d in own)
        first = sorted((-d, -s, i, j) for i, j, s, d in pairs if s >= 0.3 and d is not None and y[i] == 2)[:5]
        found = sorted((-r.delta, -r.sim, r.a, r.b) for r in similarity.top_deltas(df, "y", 0.3, 5, block_rows).collect() if r.endpoint == 2 and r.delta is not None)[:5]
        assert found == first


def test_neighbours_at_the_rounded_threshold(spark, tmp_path):
    """A cosine of 0.2 to nine decimals counts, though it is a little below."""
    from tessera.plans import catalog

    s = 0.2 - 3e-10
    rows = [(0, [1.0, 0.0], 0), (1, [s, float(np.sqrt(1 - s * s))], 3), (2, [1.0, 0.1], 1), (3, [0.1, 1.0], 9)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    near = 1 / np.sqrt(1.01)
    assert rows_of(catalog.QUERIES["knn_baseline"](spark, str(tmp_path))) == [(0, 2, pytest.approx((0.2 * 3 + near) / (0.2 + near), abs=1e-6))]


def shuffled(spark, work) -> int:
    """Rows that `work` shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    total = lambda: sum(stages.apply(i).shuffleWriteRecords() for stages in [store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)] for i in range(stages.size()))
    before = total()
    work()
    return total() - before


def test_pairs_move_large_blocks(spark):
    """Each row moves once for every block it meets: some sixteen, not one for each 1024 rows."""
    n = 33_000
    rows = spark.range(n).select("id", F.array(F.cos(F.col("id") * 1.0), F.sin(F.col("id") * 1.0)).alias("v"))
    found = []
    sent = shuffled(spark, lambda: found.append(similarity.dense_pairs(rows, rows, "cosine", least=1 - 1e-7, upper=True).count()))
    assert sent < 20 * n and found[0] > 0


def test_pairs_without_id(spark):
    """Rows without id are in no pair, in whatever block they are; the pairs are those of plain sets."""
    r = random.Random(1)
    plain = {k: {r.randrange(40) for _ in range(6)} for k in range(50)}
    items = spark.createDataFrame([(k, w) for k, s in plain.items() for w in s] + [(None, w) for w in range(40)], "id long, w int")
    want = {(a, b): round(len(plain[a] & plain[b]) / len(plain[a] | plain[b]) + 1e-9, 6) for a in plain for b in plain if a < b and plain[a] & plain[b]}
    for block_rows in (3, 1000):
        assert {(x.a, x.b): x.sim for x in similarity.set_pairs(items, "id", "w", block_rows=block_rows).collect()} == want


@pytest.mark.parametrize("n_dense, added", [(0, 50), (5, 1 << 19), (30, 7), (30, 1 << 19)])
def test_products_of_dense_and_light_columns(n_dense, added, monkeypatch):
    monkeypatch.setattr(similarity, "ADDED", added)
    monkeypatch.setattr(similarity, "SLICE", 1)
    rng = np.random.default_rng(5)
    x, y = (rng.integers(1, 5, (n, 30)) * (rng.random((n, 30)) < 0.3) for n in (17, 23))
    rank, shared = rng.permutation(30), np.arange(30)
    left, right = (similarity._Columns(*(at := np.nonzero(m)), m[at].astype(float), shared, rank, side) for m, side in ((x, False), (y, True)))
    got = np.concatenate([similarity._products(left, right, k, min(4, 17 - k), 23, n_dense, np.float32) for k in range(0, 17, 4)])
    assert np.array_equal(got, x @ y.T)
