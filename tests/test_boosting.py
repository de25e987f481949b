"""Boosted trees of many models at once against a plain version of the same trees."""

from __future__ import annotations

import math

import numpy as np
import pytest

from tessera.operators.boosting import boosted


def lower(values, p):
    """percentile_approx of few values."""
    v = sorted(values)
    return v[max(0, math.ceil(p * len(v)) - 1)]


def plain(x, y, role, trees, depth, bins, rate, least, patience):
    """One model, node by node."""
    train, valid = role == "train", role == "valid"
    b = np.empty(x.shape, int)
    for i in range(x.shape[1]):
        known = x[train & ~np.isnan(x[:, i]), i]
        edges = sorted({lower(known, k / bins) for k in range(1, bins)})
        b[:, i] = [-1 if np.isnan(v) else sum(e < v for e in edges) for v in x[:, i]]
    f = np.full(len(y), lower(y[train], 0.5))
    best, best_loss, since = f.copy(), np.abs(y - f)[valid].mean() if valid.any() else np.inf, 0
    for _ in range(trees):
        g, node = np.sign(y - f), np.ones(len(y), int)
        for _ in range(depth):
            new = node * 2
            for k in np.unique(node[train]):
                own, found = train & (node == k), None
                for i in range(x.shape[1]):
                    for c in np.unique(b[own, i]):
                        left = own & (b[:, i] <= c)
                        right = own & (b[:, i] > c)
                        if left.sum() >= least and right.sum() >= least:
                            gain = g[left].sum() ** 2 / left.sum() + g[right].sum() ** 2 / right.sum() - g[own].sum() ** 2 / own.sum()
                            if gain > 1e-9 and (found is None or (gain, -i, -c) > found):
                                found = (gain, -i, -c)
                if found:
                    new[(node == k) & (b[:, -found[1]] > -found[2])] += 1
            node = new
        for k in np.unique(node):
            if (train & (node == k)).any():
                f = np.where(node == k, f + rate * lower((y - f)[train & (node == k)], 0.5), f)
        loss = np.abs(y - f)[valid].mean() if valid.any() else -np.inf
        if loss < best_loss or not valid.any():
            best, best_loss, since = f.copy(), loss, 0
        else:
            since += 1
        if since >= patience:
            break
    return best


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    rows = []
    for e in range(4):
        x = rng.normal(size=(160, 3))
        x[rng.random((160, 3)) < 0.05] = np.nan
        y = np.where(np.nan_to_num(x[:, e % 3]) > 0.2, 3.0, -1.0) + e + rng.normal(0, 0.3, 160) + (rng.random(160) < 0.05) * 20
        role = rng.choice(["train", "train", "train", "valid", "test"] if e < 3 else ["train", "test"], 160)
        rows.append((x, y, role))
    return rows


def frame(spark, data, folds=(0,)):
    some = lambda v: None if math.isnan(v) else float(v)
    rows = [(e, k, i, *(some(v) for v in x[i]), float(y[i]), str(role[i])) for k in folds for e, (x, y, role) in enumerate(data) for i in range(len(y))]
    return spark.createDataFrame(rows, "endpoint int, held int, i int, a double, b double, c double, y double, role string").repartition(4)


@pytest.mark.parametrize("patience", [1, 50])
def test_trees_are_the_plain_ones(spark, data, patience):
    how = {"trees": 8, "depth": 3, "bins": 8, "rate": 0.3, "least": 7, "patience": patience}
    got = {(r.endpoint, r.i): r.p for r in boosted(frame(spark, data), ["endpoint"], ["a", "b", "c"], **how).collect()}
    assert len(got) == 640
    for e, (x, y, role) in enumerate(data):
        want = plain(x, y, role, **how)
        assert np.allclose([got[e, i] for i in range(160)], want, rtol=1e-12), e
        if patience > 1:
            test = role == "test"
            assert np.abs(y - want)[test].mean() < 0.75 * np.abs(y - np.median(y[role == "train"]))[test].mean()


def test_a_level_is_one_job_for_all_models(spark, data):
    how = {"trees": 2, "depth": 2, "bins": 4}
    one, many = {}, {}
    boosted(frame(spark, data[:1]), ["endpoint"], ["a"], seen=one, **how)
    out = boosted(frame(spark, data, folds=(0, 1, 2)), ["endpoint", "held"], ["a"], seen=many, **how)
    assert one["level_jobs"] == many["level_jobs"] == 4
    by = {}
    for r in out.collect():
        by.setdefault((r.endpoint, r.i), set()).add(r.p)
    assert all(len(v) == 1 for v in by.values())  # equal models of the three folds


def test_without_training_rows(spark, data):
    df = frame(spark, data)
    assert boosted(df.filter("role <> 'train'"), ["endpoint"], ["a"], trees=2).count() == 0
    left = boosted(df.filter("endpoint < 2 OR role = 'test'"), ["endpoint"], ["a"], trees=2)
    assert {r.endpoint for r in left.select("endpoint").distinct().collect()} == {0, 1}


def test_only_the_last_trees_table_stays(spark):
    from pathlib import Path

    from pyspark.sql import functions as F

    from tessera.sources.work import work_dir

    folder = Path(work_dir(spark).removeprefix("file:")) / f"tessera-{spark.sparkContext.applicationId}"
    df = spark.range(200).select(F.lit(1).alias("k"), (F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 17 * 2.0).alias("y"), F.lit("train").alias("role"))
    before = {p.name for p in folder.glob("*")}
    out = boosted(df, ["k"], ["a"], trees=4)
    assert len({p.name for p in folder.glob("*")} - before) == 1 and out.count() == 200


def test_without_a_number_a_model_without_validation_rows_ends_by_its_training_rows(spark):
    df = spark.createDataFrame([(1, k % 2 * 1.0, k % 2 * 1.0, "train") for k in range(60)], "k int, a double, y double, role string")
    out = boosted(df, ["k"], ["a"], trees=None, rate=1.0, patience=1).collect()
    assert len(out) == 60 and all(r.p == r.y for r in out)


def test_the_query_grows_more_than_ten_trees(spark, monkeypatch):
    from tessera.plans import runs

    rng = np.random.default_rng(4)
    x, fold = rng.normal(size=(300, 4)), rng.integers(0, 5, 300)
    y = 4 * x[:, 0] + rng.normal(0, 3, 300)
    rows = [(k, 1, *map(float, x[k]), float(y[k]), float(y[k]) - 1, float(y[k]) + 1, int(fold[k])) for k in range(300)]
    df = spark.createDataFrame(rows, "entity long, endpoint int, qty double, tax double, total double, balance double, y double, lower double, upper double, fold long")
    monkeypatch.setattr(runs, "bundle", lambda t: df)
    (got,) = runs.gbt_per_endpoint(None).collect()
    errors = {10: [], 1000: []}
    for held in range(5):
        role = np.where(fold == held, "test", np.where(fold == (held + 1) % 5, "valid", "train"))
        for trees, found in errors.items():
            found.extend(np.abs(y - plain(x, y, role, trees, 3, 32, 0.2, 10, 3))[role == "test"])
    assert got["n"] == 300 and got["mae"] == pytest.approx(np.mean(errors[1000]), abs=2e-6) and got["mae"] < np.mean(errors[10]) - 0.01
