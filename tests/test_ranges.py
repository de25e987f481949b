"""Running values by ranges, exact quantiles by narrowing, and pair statistics without pairs, against plain windows, numpy and all pairs."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import comparison, profile, quantile, ranks, reshape, scores, stats
from tessera.operators.scan import Carried, Line


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))


@pytest.fixture(scope="module")
def line(spark):
    """One group with nearly all rows, a few small ones, a null group, nulls among the values."""
    r = random.Random(3)
    rows = [("hot", i, r.choice([None, *range(50)]), r.random() < 0.3) for i in range(4000)]
    rows += [(f"g{k}", i, r.choice([None, 7, 8]), r.random() < 0.5) for k in range(5) for i in range(k + 1)] + [(None, i, i % 3, True) for i in range(40)]
    r.shuffle(rows)
    return spark.createDataFrame(rows, "g string, i long, v long, b boolean").repartition(3).cache()


@pytest.mark.parametrize("ranges", [2, 16])
def test_carried_over_ranges(line, ranges):
    """What 16 ranges give is what one window gives."""

    def run(n):
        first = Line(line, ["g"], ["i"], n).carry(
            s=Carried("sum", F.col("v")), before=Carried("sum", F.col("v"), own=False), low=Carried("min", F.col("v")), high=Carried("max", F.col("v"), own=False),
            n=Carried("count", F.col("v")), last=Carried("last", F.when(F.col("v") > 40, F.col("i"))), next=Carried("next", F.col("v")),
        )
        return rows_of(first.carry(top=Carried("last", F.when(F.col("v") == F.col("low"), F.col("n")))).done())

    want = run(1)
    assert len(want) == line.count() and run(ranges) == want


def test_a_line_without_groups(line):
    run = lambda n: rows_of(Line(line.select("i", "v").distinct(), [], ["i", "v"], n).carry(s=Carried("sum", F.col("v")), next=Carried("next", F.col("i"))).done())
    assert run(16) == run(1)


def test_operators_by_ranges(line):
    flag = F.col("b")
    for a, b in (
        (ranks.rank_table(line, ["g"], "v", "r"), ranks.rank_table(line, ["g"], "v", "r", 16)),
        (ranks.ecdf_gaps(line, ["g"], "v", flag), ranks.ecdf_gaps(line, ["g"], "v", flag, 16)),
        (ranks.ecdf_gaps(line, [], "v", flag), ranks.ecdf_gaps(line, [], "v", flag, 16)),
        (ranks.best_so_far(line, ["g"], "i", "v", 5), ranks.best_so_far(line, ["g"], "i", "v", 5, 16)),
        (reshape.offsets(line, ["g"], "i", "i", "at"), reshape.offsets(line, ["g"], "i", "i", "at", 16)),
        (stats.mann_whitney(line, ["g"], "v", flag), stats.mann_whitney(line, ["g"], "v", flag, 16)),
        (stats.kruskal_wallis(line, [], "v", "g"), stats.kruskal_wallis(line, [], "v", "g", 16)),
    ):
        assert rows_of(a) == rows_of(b) != []


def test_no_task_orders_the_hot_group(line):
    laid = Line(line, ["g"], ["i"], 16)
    sizes = [r.n for r in laid.rows.groupBy("_range").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 10 and max(sizes) < 1000  # of 4055 rows


@pytest.mark.parametrize("limit, splits", [(10_000, 256), (50, 8), (1, 2), (7, 4)])
def test_exact_quantiles(spark, limit, splits):
    rng = np.random.default_rng(limit)
    groups = {
        "normal": rng.normal(size=3000), "ties": rng.integers(0, 4, 2000).astype(float), "heavy": np.append(np.full(1500, 5.0), rng.random(40)), "wide": np.exp(rng.normal(0, 100, 900)),
        "one": np.array([3.0]), "two": np.array([-1.0, 2.0]), "equal": np.full(600, 1.5), "": -np.arange(500.0),
    }
    rows = [(k or None, float(x)) for k, v in groups.items() for x in v] + [("none", None), ("one", None)]
    at = (0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0)
    got = {r.k or "": r.q for r in quantile.exact_quantiles(spark.createDataFrame(rows, "k string, x double").repartition(4), ["k"], "x", at, limit, splits).collect()}
    assert set(got) == set(groups)
    for k, v in groups.items():
        assert np.allclose(got[k], np.quantile(v, at), rtol=1e-12, atol=0), k


def test_quantiles_of_a_whole_table(spark):
    x = np.random.default_rng(1).normal(size=5000)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    for limit in (100, 10_000):
        assert np.allclose(quantile.exact_quantiles(df, [], "x", (0.1, 0.9), limit).first().q, np.quantile(x, (0.1, 0.9)), rtol=1e-12)
    assert quantile.exact_quantiles(df.filter("x > 99"), [], "x", (0.5,)).count() == 0
    row = profile.stat_vector(df.filter("x > 99"), [], "x").first()
    assert row.n == 0 and row.p50 is None
    row = profile.moments(df, [], "x", {"up": 0.0}).first()
    assert row.n == 5000 and row.n_up == (x >= 0).sum() and abs(row.median - np.median(x)) < 1e-12


@pytest.mark.parametrize("ranges", [1, 8])
def test_pair_statistics(spark, ranges):
    r = random.Random(8)
    groups = {"a": [r.choice([1.5, 2.0, 9.25, None]) for _ in range(60)], "b": [1e9 + r.random() for _ in range(300)], "c": [4.0], "d": [4.0, 6.0], "e": [None, None], "f": [2.5] * 9}
    df = spark.createDataFrame([(k, x) for k, v in groups.items() for x in v], "k string, x double")
    got = {row.k: row for row in profile.pair_statistics(df, ["k"], "x", ranges).collect()}
    assert set(got) == {"a", "b", "d", "f"}
    for k, row in got.items():
        gaps = np.array([abs(p - q) for p, q in itertools.combinations([x for x in groups[k] if x is not None], 2)])
        assert row.pairs == len(gaps) and np.allclose((row.mean, row.min, row.max), (gaps.mean(), gaps.min(), gaps.max()), rtol=1e-6, atol=1e-9)
        assert row.sd is None if len(gaps) == 1 else np.isclose(row.sd, gaps.std(ddof=1), rtol=1e-5, atol=1e-7)


@pytest.mark.parametrize("ranges", [1, 16])
def test_losses_of_the_same_steps_go_along_one_line(line, ranges, monkeypatch):
    """Each as by itself, with the last of equal losses; the rows are laid out and carried once for all of them."""
    plain, laid = [], []
    for g, own in itertools.groupby(sorted(line.collect(), key=lambda r: (r.g is None, r.g or "", r.i)), key=lambda r: r.g):
        own = list(own)
        for k, loss in enumerate([lambda r: r.v, lambda r: None if r.v is None else -r.v, lambda r: None]):
            best = at = step = None
            for n, r in enumerate(own):
                if loss(r) is not None and (best is None or loss(r) <= best):
                    best, at, step = loss(r), n, r.i
                plain.append((g, r.i, k, best, step, None if at is None else n - at, None if at is None else n - at >= 5))
    carry = Line.carry
    monkeypatch.setattr(Line, "carry", lambda self, **columns: laid.append(len(columns)) or carry(self, **columns))
    rows = line.withColumns({"w": -F.col("v"), "none": F.lit(None).cast("long")})
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    assert rows_of(ranks.best_so_far_each(rows, ["g"], "i", ["v", "w", "none"], 5, ranges)) == sorted(plain, key=key)
    assert laid == [3]


@pytest.mark.parametrize("ranges", [1, 8])
def test_metrics_of_several_predictions(spark, ranges, monkeypatch):
    """What each prediction by itself gives, with ties, missing values, a constant one and a null group; the truths are laid out once for all of them."""
    r, inf = random.Random(4), float("inf")
    rows = [(r.choice(["a", "a", "a", "b", None]), r.choice([None, inf, *(k / 4 for k in range(60))]), r.choice([None, *range(9)]), r.random(), 2.5) for _ in range(1500)]
    rows = [(g, y, -1.0, 1.0 if i % 40 else None, None if p is None else float(p), q, c) for i, (g, y, p, q, c) in enumerate(rows)] + [("one", 1.0, 0.0, 1.0, 1.0, None, 3.0)]
    df = spark.createDataFrame(rows, "g string, y double, lower double, upper double, p0 double, p1 double, p2 double").repartition(3).cache()
    laid, carry = [], Line.carry
    monkeypatch.setattr(Line, "carry", lambda self, **columns: laid.append(self.by) or carry(self, **columns))
    got = scores.regression_metrics_each(df, ["g"], ["p0", "p1", "p2"], ranges=ranges)
    names = ["g", "n", "st_rae", "mae", "rmse", "spearman", "r2"]
    for k in range(3):
        want = rows_of(scores.regression_metrics(df, ["g"], predicted=f"p{k}").select(names))
        for a, b in zip(rows_of(got.filter(F.col("run") == k).select(names)), want, strict=True):
            assert a[:2] == b[:2] and [x is None for x in a] == [x is None for x in b] and [x for x in a[2:] if x is not None] == pytest.approx([x for x in b[2:] if x is not None], rel=1e-9)
    assert laid == [["g"], ["g", "run"]]


@pytest.mark.parametrize("ranges", [1, 8])
def test_complementarity_side_by_side(spark, ranges):
    """What rows of pairs give, with ties, models that lack units, and an endpoint of two units."""
    r = random.Random(5)
    units = [(i, r.choice([1, 2]), *(r.choice([None, *range(12)]) for _ in range(3))) for i in range(600)] + [(600 + i, 3, i, -i, 5) for i in range(2)]
    df = spark.createDataFrame([(i, e, *(None if x is None else x / 4 for x in own)) for i, e, *own in units], "entity long, endpoint int, m1 double, m2 double, m3 double")
    long = df.select("entity", "endpoint", F.lit(0.0).alias("y"), F.expr("stack(3, 'm1', -m1, 'm2', -m2, 'm3', -m3) AS (model, p)")).filter("p IS NOT NULL")
    names = ["a", "b", "scope", "n", "r", "rho", "mean_gap", "max_gap", "mae_a", "mae_b"]
    want = rows_of(comparison.complementarity(comparison.model_pairs(long, ["entity", "endpoint"])).select(names))
    got = rows_of(comparison.complementarity_of(df, {m: m for m in ("m3", "m1", "m2")}, ranges=ranges).select(names))
    for a, b in zip(got, want, strict=True):
        assert a[:4] == b[:4] and [x is None for x in a] == [x is None for x in b]
        assert [x for x in a[4:] if x is not None] == pytest.approx([x for x in b[4:] if x is not None], rel=1e-9, abs=1e-12)
