"""Known answers, identities and failures of the operators."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import expr
from tessera.operators import comparison, expectations, folds, graph, joins, profile, ranks, registry, reshape, scores, similarity, stats
from tessera.operators.expectations import ExpectationError
from tessera.sources import tables


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


# Scores


def interval_rows(spark, predicted):
    return spark.createDataFrame([(1, 4.0, 3.8, 4.2, predicted[0]), (1, 6.0, 5.8, 6.2, predicted[1]), (1, float("nan"), 1.0, 2.0, 3.0), (1, None, 1.0, 2.0, 3.0)], "e int, y double, lower double, upper double, p double")


@pytest.mark.parametrize("predicted, score", [((4.1, 5.9), 0.0), ((5.0, 5.0), 1.0), ((4.0, 5.0), 0.5)])
def test_st_rae_of_known_rows(spark, predicted, score):
    assert one(scores.st_rae(interval_rows(spark, predicted), ["e"])).st_rae == pytest.approx(score)


def test_st_rae_without_excess_is_null(spark):
    rows = spark.createDataFrame([(1, 4.0, 3.0, 5.0, 9.0)], "e int, y double, lower double, upper double, p double")
    assert one(scores.st_rae(rows, ["e"])).st_rae is None


def test_groups_of_one_have_no_metrics(spark):
    rows = interval_rows(spark, (4.1, 5.9)).limit(1)
    assert scores.regression_metrics(rows, ["e"]).count() == 0


def test_scale_is_fit_on_train_rows(spark):
    rows = spark.createDataFrame([(1, 2.0, True), (1, 4.0, True), (1, 100.0, False)], "e int, y double, train boolean")
    got = {r.y: r for r in scores.fold_safe_scale(rows, ["e"], "y", F.col("train")).collect()}
    assert got[100.0].mean == 3.0 and got[100.0].scale == 1.0 and got[100.0].z == 97.0


def test_constant_train_values_have_scale_one(spark):
    rows = spark.createDataFrame([(1, 5.0, True), (1, 5.0, True)], "e int, y double, train boolean")
    assert {r.z for r in scores.fold_safe_scale(rows, ["e"], "y", F.col("train")).collect()} == {0.0}


def test_interval_loss_falls_back_to_the_point(spark):
    rows = spark.createDataFrame([(4.0, 5.0, None, None), (4.0, 5.0, 3.0, 4.5)], "y double, p double, lower double, upper double")
    assert [r[0] for r in rows.select(scores.interval_loss("y", "p", "lower", "upper")).collect()] == [1.0, 0.25]


# Statistics against numpy


def average_ranks(x):
    x = np.asarray(x)
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9), st.integers(0, 9)), min_size=5, max_size=40))
def test_rank_statistics(spark, rows):
    df = spark.createDataFrame([(1, float(a), float(b), float(c), a > 4) for a, b, c in rows], "g int, x double, y double, z double, first boolean")
    x, y, z = (np.array(c, float) for c in zip(*rows))
    rx, ry, rz = map(average_ranks, (x, y, z))
    rho = one(stats.spearman_by(df, ["g"], "x", "y")).rho
    varied = len(set(x)) > 1 and len(set(y)) > 1
    assert rho == pytest.approx(np.corrcoef(rx, ry)[0, 1]) if varied else rho is None
    first = x > 4
    u = one(stats.mann_whitney(df, ["g"], "y", F.col("first")))
    n1 = int(first.sum())
    assert (u.n1, u.n2, u.u) == (n1, len(rows) - n1, pytest.approx(ry[first].sum() - n1 * (n1 + 1) / 2))
    if varied and len(set(z)) > 1:
        partial = one(stats.partial_spearman(df, ["g"], "x", "y", "z")).rho
        residual = lambda r: r - np.polyval(np.polyfit(rz, r, 1), rz)
        a, b = residual(rx), residual(ry)
        if a.std() > 1e-6 and b.std() > 1e-6:
            assert partial == pytest.approx(np.corrcoef(a, b)[0, 1], abs=1e-6)


def test_shift_measures(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 20, 60) / 2, rng.integers(5, 30, 80) / 2
    df = spark.createDataFrame([(1, float(v), False) for v in a] + [(1, float(v), True) for v in b], "g int, v double, second boolean")
    got = one(stats.shift(df, ["g"], "v", F.col("second")))
    points = np.unique(np.concatenate([a, b]))
    fa, fb = ((s[None] <= points[:, None]).mean(1) for s in (a, b))
    assert got.ks == pytest.approx(np.abs(fa - fb).max()) and got.w1 == pytest.approx((np.abs(fa - fb)[:-1] * np.diff(points)).sum())
    pooled = math.sqrt(((len(a) - 1) * a.var(ddof=1) + (len(b) - 1) * b.var(ddof=1)) / (len(a) + len(b) - 2))
    assert got.smd == pytest.approx((b.mean() - a.mean()) / pooled)


def test_correlation_guards(spark):
    df = spark.createDataFrame([(1, 2.0, 5.0), (1, 2.0, 6.0), (1, 2.0, 7.0), (2, 1.0, 1.0), (2, 2.0, 2.0)], "g int, x double, y double")
    assert {r.g: r.r for r in df.groupBy("g").agg(expr.pearson("x", "y").alias("r")).collect()} == {1: None, 2: None}


def test_skew_is_bias_corrected(spark):
    assert one(spark.createDataFrame([(float(v),) for v in (1, 2, 4, 10)], "v double").agg(expr.skew_g1("v").alias("s"))).s == pytest.approx(1.469, abs=1e-3)


def test_normal_p(spark):
    rows = spark.createDataFrame([(0.0,), (1.959963985,), (-2.575829304,)], "z double").select(stats.normal_p(F.col("z")).alias("p")).collect()
    assert [r.p for r in rows] == pytest.approx([1.0, 0.05, 0.01], abs=1e-6)


# Joins and checks


def test_validated_join_rejects_repeated_keys(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y")], "k int, a string")
    b = spark.createDataFrame([(1, "z")], "k int, b string")
    assert joins.validated_join(a, b, ["k"], validate="many_to_one").count() == 2
    with pytest.raises(ExpectationError, match="left keys"):
        joins.validated_join(a, b, ["k"], validate="one_to_one")
    with pytest.raises(ExpectationError, match="missing columns"):
        joins.validated_join(a, b, ["absent"])


def test_expectations_report_all(spark):
    df = spark.createDataFrame([(1, 7), (1, 2), (None, 3)], "k int, fold int")
    checks = expectations.together(expectations.unique(df, ["k"]), expectations.within(df, "fold", 0, 4), expectations.holds(df, F.col("fold") > 0, "positive"))
    with pytest.raises(ExpectationError, match=r"fold in \[0, 4\]: 1; unique: 2"):
        expectations.require(checks)


def test_errors_name_the_first_rows(spark):
    df = spark.createDataFrame([(k, 9) for k in (8, 3, 5, 1, 7, 6, 2)] + [(4, 0)], "k int, fold int")
    bad = df.filter("fold > 4")
    with pytest.raises(ExpectationError, match=r"^folds: 7, such as \[\{'k': 1, 'fold': 9\}, \{'k': 2, 'fold': 9\}, \{'k': 3.*'k': 6, 'fold': 9\}\]$"):
        expectations.require(expectations.result("folds", bad), {"folds": bad})
    twice = spark.createDataFrame([(k % 9,) for k in range(18)], "k int")
    with pytest.raises(ExpectationError, match=r"repeat, such as \[\{'k': 0\}, \{'k': 1\}, \{'k': 2\}, \{'k': 3\}, \{'k': 4\}\]"):
        joins.validated_join(df, twice, ["k"])


def test_objective_falls_back(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([(1.0, 2.0), (nan, 2.0), (None, 3.0), (-inf, 4.0), (inf, None), (nan, nan)], "a double, b double")
    assert [tuple(r) for r in df.select(*scores.objective("a", "b")).collect()] == [(1.0, 0), (2.0, 1), (3.0, 1), (4.0, 1), (inf, None), (inf, None)]


def test_external_predictions(spark, tmp_path):
    from tessera.operators import models

    long = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.25), (2, "a", 0.75)], "k int, endpoint string, y double")
    models.export_wide(long, ["k"], "endpoint", "y", ["a", "b"], str(tmp_path / "wide"))
    wide = tables.read_csv(spark, str(tmp_path / "wide"), "k int, y_a double, y_b double")
    assert {tuple(r) for r in wide.collect()} == {(1, 0.5, 0.25), (2, 0.75, None)}
    back = spark.createDataFrame([(1, 0.1), (2, 0.2), (3, 0.3)], "k int, p double")
    assert {(r.k, r.endpoint, r.p) for r in models.join_predictions(long, back, ["k"]).collect()} == {(1, "a", 0.1), (1, "b", 0.1), (2, "a", 0.2)}
    with pytest.raises(Exception, match='no prediction of .*"k":2'):
        models.join_predictions(long, back.filter("k <> 2"), ["k"]).collect()
    with pytest.raises(ExpectationError, match="repeat"):
        models.join_predictions(long, back.union(back), ["k"])


def test_blocks_of_features_and_offsets(spark):
    features, block = reshape.concat_blocks({"a": (F.array(F.lit(1), F.lit(2)), 2), "b": (F.array(F.lit(3)), 1)})
    rows = spark.range(1).select(F.posexplode(features).alias("pos", "x")).withColumn("block", block(F.col("pos"))).collect()
    assert [tuple(r) for r in rows] == [(0, 1, "a"), (1, 2, "a"), (2, 3, "b")]
    df = spark.createDataFrame([(1, 2, 5), (1, 1, 3), (2, 9, 4)], "g int, k int, n long")
    assert {(r.g, r.k): r.at for r in reshape.offsets(df, ["g"], "k", "n", "at").collect()} == {(1, 1): 0, (1, 2): 3, (2, 9): 0}


def test_constant_in_group(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 1.0 + 1e-9), (2, 1.0), (2, 2.0), (3, 1.0), (3, None)], "k int, v double")
    assert sorted(r.k for r in expectations.constant_in_group(df, ["k"], "v", atol=1e-8).collect()) == [2, 3]


def test_models_with_other_truths_are_rejected(spark):
    df = spark.createDataFrame([(1, "a", 1.0, 2.0), (1, "b", 1.5, 2.0)], "k int, model string, y double, p double")
    with pytest.raises(Exception, match="disagree"):
        comparison.model_pairs(df, ["k"]).collect()
    with pytest.raises(Exception, match="disagree"):
        comparison.model_pairs(df, ["k"], ["a", "b"]).collect()


def test_model_pairs_in_columns_and_arrays(spark):
    rows = [(k, m, float(k), k + 0.1 * n) for k in range(6) for n, m in enumerate("acb") if (k + n) % 4]
    df = spark.createDataFrame(rows, "k int, model string, y double, p double")
    got = [sorted(map(tuple, comparison.model_pairs(df, ["k"], models).select("k", "a", "b", F.round("ra", 6), F.round("rb", 6)).collect())) for models in (None, ["c", "b", "a"])]
    have = {(k, m): round(y - p, 6) for k, m, y, p in rows}
    assert got[0] == got[1] == sorted((k, a, b, have[k, a], have[k, b]) for k in range(6) for a, b in ("ab", "ac", "bc") if (k, a) in have and (k, b) in have)


def test_larger_coverage_is_the_reference(spark):
    df = spark.createDataFrame([("few", 1, 0.1), ("all", 4, 0.5), ("other", 4, 0.6)], "model string, scored int, macro double")
    assert {r.model: r.status for r in comparison.rank_models(df).collect()} == {"few": "not comparable", "all": "reference", "other": "worse"}


def test_first_source_wins(spark):
    a = spark.createDataFrame([(1, "a")], "k int, v string")
    b = spark.createDataFrame([(1, "b"), (2, "b")], "k int, v string")
    assert {(r.k, r.v, r.source) for r in joins.first_of_sources([("a", a), ("b", b)], ["k"]).collect()} == {(1, "a", "a"), (2, "b", "b")}


# Similarity and graphs


def test_prefix_filter_loses_nothing(spark):
    rng = np.random.default_rng(3)
    sets = {i: set(rng.choice(30, rng.integers(1, 12), replace=False).tolist()) for i in range(60)}
    items = spark.createDataFrame([(k, int(w)) for k, s in sets.items() for w in s], "id int, w int")
    for least in (0.5, 0.8, 1.0):
        want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least - 1e-9}
        assert {(r.a, r.b) for r in similarity.set_pairs(items, "id", "w", least).collect()} == want


def test_sparse_blocks_count_what_is_shared(spark):
    rng = np.random.default_rng(31)
    sets = {i: set(rng.choice(60, rng.integers(1, 20), replace=False).tolist()) for i in range(70)}
    items = spark.createDataFrame([(k, f"w{w}") for k, s in sets.items() for w in s], "id int, w string")
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and sets[a] & sets[b]}
    got = {(r.a, r.b): r.sim for r in similarity.set_pairs(items, "id", "w", block_rows=17).collect()}
    assert got == pytest.approx(want, abs=1e-6)
    first = sorted((-round(s, 6), a, b) for (a, b), s in want.items())[:9]
    assert [(r.a, r.b) for r in similarity.top_set_pairs(items, "id", "w", 9).collect()] == [(a, b) for _, a, b in first]
    few = [r.sim for r in similarity.top_set_pairs(items, "id", "w", 3, steps=(0.1,)).collect()]
    assert few == [r.sim for r in similarity.set_pairs(items, "id", "w", top=3, block_rows=10).collect()]
    counts = {i: {int(w): int(rng.integers(1, 5)) for w in rng.choice(40, 6, replace=False)} for i in range(30)}
    df = spark.createDataFrame([(k, w, n) for k, c in counts.items() for w, n in c.items()], "id int, w int, n int")
    dot = lambda x, y: sum(n * y.get(w, 0) for w, n in x.items())
    want = {(a, b): dot(x, y) / (dot(x, x) + dot(y, y) - dot(x, y)) for a, x in counts.items() for b, y in counts.items() if a < b and dot(x, y)}
    assert {(r.a, r.b): r.sim for r in similarity.count_pairs(df, "id", "w", "n", block_rows=8).collect()} == pytest.approx(want)


def test_blocks_carry_and_choose(spark):
    rng = np.random.default_rng(32)
    x, g = rng.standard_normal((40, 5)), rng.integers(0, 4, 40)
    df = spark.createDataFrame([(i, v.tolist(), int(k), f"n{k}") for i, (v, k) in enumerate(zip(x, g))], "id long, v array<double>, g int, name string")
    l1 = 1 / (1 + np.abs(x[:, None] - x[None]).sum(2) / 12)
    rows = similarity.dense_pairs(df, df, "l1", upper=True, same=("g", "g"), carry=("name",), block_rows=9).collect()
    assert {(r.a, r.b): (r.a_name, r.b_name) for r in rows} == {(i, j): (f"n{g[i]}", f"n{g[j]}") for i in range(40) for j in range(i + 1, 40) if g[i] == g[j]}
    assert all(r.sim == pytest.approx(l1[r.a, r.b]) for r in rows)
    cos = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
    best = {(r.ga, r.gb): r.sim for r in similarity.group_best(df, df.withColumn("g", F.col("id") % 3), block_rows=7).collect()}
    assert best == pytest.approx({(k, m): cos[g == k][:, np.arange(40) % 3 == m].max() for k in range(4) for m in range(3)}, abs=1e-9)
    near = {r.id: r.neighbour for r in similarity.dense_nearest(df, df, other=True, same=("g", "g"), block_rows=6).collect()}
    masked = np.where((g[:, None] == g[None]) & ~np.eye(40, dtype=bool), cos, -2)
    assert near == {i: int(masked[i].argmax()) for i in range(40) if masked[i].max() > -2}


def test_packed_bits(spark):
    rng = np.random.default_rng(33)
    sets = {i: set(rng.choice(130, rng.integers(1, 40), replace=False).tolist()) | {63, 64} for i in range(12)}
    packed = similarity.pack_bits(spark.createDataFrame([(k, int(b)) for k, s in sets.items() for b in [*s, 63]], "id int, bit int"), "id", "bit", 130)
    words = {r.id: r.words for r in packed.collect()}
    assert {k: {64 * i + b for i, w in enumerate(ws) for b in range(64) if w >> b & 1} for k, ws in words.items()} == sets
    pair = packed.alias("x").join(packed.alias("y"), F.col("y.id") == F.col("x.id") + 1).select("x.id", similarity.packed_tanimoto("x.words", "y.words").alias("s"))
    assert {r.id: r.s for r in pair.collect()} == pytest.approx({k: len(sets[k] & sets[k + 1]) / len(sets[k] | sets[k + 1]) for k in range(11)})
    empty = spark.createDataFrame([([0], [0])], "a array<long>, b array<long>")
    assert one(empty.select(similarity.packed_tanimoto("a", "b").alias("s"))).s == 0.0


def test_positions_of_ranges(spark):
    rng = np.random.default_rng(34)
    rows = [(int(k), None if v > 90 else int(v)) for k, v in enumerate(rng.integers(0, 100, 500))]
    df = spark.createDataFrame(rows, "k int, v int").repartition(7)
    got = [r.k for r in ranks.positions(df, ["v", "k"], "place").orderBy("place").collect()]
    assert got == [k for k, _ in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0]))]
    assert [r.place for r in ranks.positions(df, ["v", "k"], "place").orderBy("place").collect()] == list(range(1, 501))


def test_blocks_find_the_nearest(spark):
    x = np.random.default_rng(4).standard_normal((50, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = unit @ unit.T
    np.fill_diagonal(sim, -2)
    got = {r.id: r.neighbour for r in similarity.dense_nearest(df, df, other=True, block_rows=7).collect()}
    assert got == dict(enumerate(sim.argmax(1).tolist()))
    assert similarity.dense_pairs(df, df, upper=True, block_rows=9).count() == 50 * 49 // 2


@pytest.mark.parametrize("small", [0, 1000])
def test_components_refine_with_the_threshold(spark, small):
    nodes = spark.range(30)
    edges = [(i, i + 1, 0.5 + 0.02 * i) for i in range(20)] + [(25, 26, 0.9)]
    df = spark.createDataFrame(edges, "a long, b long, sim double")
    low, high = ({r.id: r.root for r in graph.components(nodes, df.filter(F.col("sim") >= t), small=small).collect()} for t in (0.5, 0.7))
    assert low == {i: 0 if i <= 20 else 25 if i in (25, 26) else i for i in range(30)}
    assert all(low[a] == low[b] for a in high for b in high if high[a] == high[b])


def test_path_graph(spark):
    rows = [["b", "a", "b", "b", "c"], ["x"], []]
    df = spark.createDataFrame([(w,) for w in rows], "w array<string>")
    assert [tuple(r) for r in df.select(*graph.path_graph(F.col("w"))).collect()] == [(["b", "a", "c"], ["a b", "b c"]), (["x"], []), ([], [])]


def test_folds_are_even_and_keep_groups(spark):
    df = spark.range(103).withColumn("grp", F.col("id") % 17)
    sizes = [r["count"] for r in folds.k_fold(df, "id").groupBy("fold").count().collect()]
    assert sorted(sizes) == [20, 20, 21, 21, 21]
    grouped = folds.group_k_fold(df, "grp")
    assert grouped.groupBy("grp").agg(F.countDistinct("fold").alias("n")).filter("n > 1").count() == 0
    assert [r.role for r in spark.createDataFrame([(0, 1), (1, 1), (1, 2)], "a int, b int").select(folds.nested_role("a", "b", 0).alias("role")).collect()] == ["test", "validation", "train"]


# Registry and ensembles


def test_upsert_keeps_the_first_time_and_is_idempotent(spark):
    old = spark.createDataFrame([("r1", "a", 1, 0.65), ("r9", "a", 1, 0.9)], "run string, endpoint string, first_seen int, score double")
    new = spark.createDataFrame([("r1", "a", 5, 0.6), ("r2", "a", 5, 0.7)], old.schema)
    once = registry.upsert(old, new, ["run", "endpoint"])
    twice = registry.upsert(once, new, ["run", "endpoint"])
    want = {("r1", "a", 1, 0.6), ("r2", "a", 5, 0.7), ("r9", "a", 1, 0.9)}
    assert {tuple(r) for r in once.collect()} == want == {tuple(r) for r in twice.collect()}


def test_older_tables_are_padded(spark):
    old = spark.createDataFrame([("r1", 1)], "run string, first_seen int")
    new = spark.createDataFrame([("r2", 2, 0.5)], "run string, first_seen int, score double")
    assert {(r.run, r.score) for r in registry.upsert(old, new, ["run"]).collect()} == {("r1", None), ("r2", 0.5)}


def test_upsert_by_run_drops_endpoints_that_are_gone(spark):
    schema = "run string, endpoint string, first_seen int, score double"
    old = spark.createDataFrame([("r1", None, 1, 0.65), ("r1", "gone", 1, 0.7), ("r9", None, 1, 0.9), (None, "a", 2, 0.1), (None, "b", 2, 0.2)], schema)
    new = spark.createDataFrame([("r1", None, 5, 0.6), ("r1", "new", 5, 0.5), (None, "a", 6, 0.3)], schema)
    once = registry.upsert(old, new, ["run", "endpoint"], "run")
    want = {("r1", None, 1, 0.6), ("r1", "new", 5, 0.5), ("r9", None, 1, 0.9), (None, "a", 2, 0.3)}
    assert {tuple(r) for r in once.collect()} == want and once.count() == 4
    assert {tuple(r) for r in registry.upsert(once, new, ["run", "endpoint"], "run").collect()} == want
    by_key = registry.upsert(old, new, ["run", "endpoint"])
    assert {tuple(r) for r in by_key.collect()} == want | {("r1", "gone", 1, 0.7), (None, "b", 2, 0.2)} and by_key.count() == 6


def test_versioned_table(spark, tmp_path):
    path = str(tmp_path / "t")
    assert registry.read_table(spark, path) is None
    for n in (3, 5, 7):
        registry.replace_table(spark.range(n), path)
    assert registry.read_table(spark, path).count() == 7 and len(list((tmp_path / "t").glob("version-*"))) == 2


def test_failed_writes_and_reads_leave_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    registry.replace_table(spark.range(5), path)
    with pytest.raises(Exception, match="no luck"):
        registry.update_table(spark, path, lambda old: old.withColumn("x", F.raise_error(F.lit("no luck")).cast("int")))
    assert registry.read_table(spark, path).count() == 5
    for part in (tmp_path / "t").glob("version-0*/part-*"):
        part.write_bytes(b"not a table")
    with pytest.raises(Exception):
        registry.update_table(spark, path, lambda old: spark.range(1) if old is None else old.filter("id > 1"))
    assert {f.read_bytes() for f in (tmp_path / "t").glob("version-000000000000-*/part-*")} == {b"not a table"}


def test_writers_at_once_lose_nothing(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "t")
    add = lambda k: registry.update_table(spark, path, lambda old: spark.range(k, k + 1) if old is None else old.union(spark.range(k, k + 1)), keep=8)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(add, range(6)))
    assert sorted(r.id for r in registry.read_table(spark, path).collect()) == list(range(6))
    assert sorted(f.name for f in (tmp_path / "t").glob("commit-*")) == [f"commit-{k:012d}" for k in range(6)] and not list((tmp_path / "t").glob("_draft*"))


def test_the_second_writer_of_a_version_is_refused(spark, tmp_path):
    path = str(tmp_path / "t")
    registry.replace_table(spark.range(1), path)
    number, old = registry.read_version(spark, path)
    registry.replace_table(spark.range(2), path, base=number)
    with pytest.raises(registry.Conflict):  # it read version 0, and 1 is there
        registry.replace_table(old.union(spark.range(9, 10)), path, base=number)
    assert registry.read_table(spark, path).count() == 2 and len(list((tmp_path / "t").glob("version-*"))) == 2
    for n in (3, 4, 5):
        registry.replace_table(spark.range(n), path)
    with pytest.raises(registry.Conflict):  # also when the folders of these versions are long gone
        registry.replace_table(spark.range(9), path, base=number)


def test_a_killed_writer_keeps_nobody_waiting(spark, tmp_path):
    """A process that dies between writing its rows and committing them; the next writer goes on at once, from the committed rows."""
    import subprocess
    import sys

    path = str(tmp_path / "t")
    registry.replace_table(spark.range(3), path)
    code = f"""
import os, signal
from pyspark.sql import SparkSession
from tessera.operators import registry
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
registry._put_if_absent = lambda *a: os.kill(os.getpid(), signal.SIGKILL)
registry.update_table(spark, {path!r}, lambda old: old.union(spark.range(50, 60)))
"""
    assert subprocess.run([sys.executable, "-c", code], timeout=200, capture_output=True).returncode == -9
    assert len(list((tmp_path / "t").glob("version-*"))) == 2 and registry.read_table(spark, path).count() == 3
    registry.update_table(spark, path, lambda old: old.union(spark.range(100, 101)))
    assert sorted(r.id for r in registry.read_table(spark, path).collect()) == [0, 1, 2, 100]


def test_late_records_do_not_win(spark):
    schema = "run string, endpoint string, first_seen int, refreshed int, score double"
    old = spark.createDataFrame([("r1", "a", 5, 9, 0.9), ("r2", "a", 5, 5, 0.5), (None, "a", 4, 4, 0.4)], schema)
    new = spark.createDataFrame([("r1", "a", 3, 3, 0.3), ("r2", "a", 6, 6, 0.6), ("r3", "a", 1, 1, 0.1), (None, "a", 4, 3, 0.3)], schema)
    want = {("r1", "a", 3, 9, 0.9), ("r2", "a", 5, 6, 0.6), ("r3", "a", 1, 1, 0.1), (None, "a", 4, 4, 0.4)}
    for run in (None, "run"):
        once = registry.upsert(old, new, ["run", "endpoint"], run, order="refreshed")
        assert {tuple(r) for r in once.collect()} == want and once.count() == 4
        assert {tuple(r) for r in registry.upsert(once, new, ["run", "endpoint"], run, order="refreshed").collect()} | {("r1", "a", 3, 9, 0.9)} == want


def test_cv_columns_after_a_refresh(spark):
    rows = [("m", "s", k, 0.5 + k / 10) for k in range(4)] + [("m", "s", 1, None), ("n", None, 0, 0.2), ("n", None, 0, 0.4), ("o", "s", 0, None)]
    df = spark.createDataFrame(rows, "model string, seed string, fold int, score double")
    got = {(r.model, r.cv_n, round(r.cv_mean, 9) if r.cv_mean else None, r.cv_folds) for r in registry.with_cv(registry.with_cv(df, ["model", "seed"], "score"), ["model", "seed"], "score").collect()}
    assert got == {("m", 4, 0.65, 4), ("n", 2, 0.3, 1), ("o", 0, None, 0)}


def test_ensemble_of_equal_members_is_the_member(spark):
    df = spark.createDataFrame([(k, m, float(k)) for k in range(4) for m in "ab"], "k int, model string, p double")
    assert all(r.p == r.k and r.members == 2 for r in registry.ensemble_mean(df, ["k"]).collect())


def test_sources_of_other_coverage_are_rejected(spark):
    a, b = spark.createDataFrame([(1, 0.5), (2, 0.5)], "k int, p double"), spark.createDataFrame([(1, 0.7)], "k int, p double")
    with pytest.raises(ExpectationError, match="other keys"):
        registry.merge_sources({"a": a, "b": b}, ["k"], "p")


def test_bootstrap_is_repeatable_and_tells_better_from_worse(spark):
    df = spark.createDataFrame([("m", k % 5, k // 5, -0.1 - 0.01 * (k % 4)) for k in range(15)], "model string, fold int, seed int, delta double")
    first, second = (one(comparison.bootstrap_ci(df, ["model"], "delta", ["fold", "seed"], 200)) for _ in range(2))
    assert first == second and first.low <= first.mean <= first.high < 0


def test_cluster_bootstrap(spark):
    rng = np.random.default_rng(5)
    rows = [(i, e, y := float(rng.normal()), y - 0.1, y + 0.1, y + float(rng.normal()) * 0.2, y + float(rng.normal())) for i in range(40) for e in range(1, 5)]
    df = spark.createDataFrame(rows, "entity long, endpoint int, y double, lower double, upper double, good double, bad double")
    got = one(comparison.cluster_bootstrap(df, "entity", "good", "bad", 60))
    assert got.replicates == 60 and got.low < got.high < 0


# Expressions, profiles, reshaping, sources


def test_stable_seed_is_little_endian(spark):
    names = ["a", "compound 17", "ß"]
    want = [(int.from_bytes(hashlib.sha256(n.encode()).digest()[:4], "little") & 0x7FFFFFFF) or 1 for n in names]
    assert [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(expr.stable_seed("n")).collect()] == want


def test_clip_keeps_null(spark):
    assert [r[0] for r in spark.createDataFrame([(None,), (9.0,), (-1.0,)], "x double").select(expr.clip("x", 0.0, 5.0)).collect()] == [None, 5.0, 0.0]


def test_nan_is_null(spark):
    df = expr.nan_to_null(spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "x double, k int"))
    assert [r.x for r in df.orderBy("k").collect()] == [None, 2.0]


@pytest.mark.parametrize("direct, other, label", [(5.0, 5.4, "positive"), (5.0, 5.2, "negative"), (3.0, 4.4, "positive"), (3.0, 3.5, "negative"), (3.0, 4.1, "excluded"), (4.0, 9.0, None), (None, 5.0, None)])
def test_two_arm_labels(spark, direct, other, label):
    assert one(spark.createDataFrame([(direct, other)], "a double, b double").select(profile.two_arm_label("a", "b").alias("l"))).l == label


def test_average_ranks(spark):
    df = spark.createDataFrame([(1, v) for v in (5.0, 5.0, 7.0, None)], "g int, v double")
    assert sorted((r.v, r.rank) for r in ranks.average_rank(df, ["g"], "v", "rank").collect() if r.v) == [(5.0, 1.5), (5.0, 1.5), (7.0, 3.0)]


def test_ranges_give_the_same_ranks(spark):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(None if k % 9 == 0 else k % 2, k, None if k % 13 == 0 else float(v)) for k, v in enumerate(rng.integers(0, 40, 300))], "g int, k int, v double")
    for by in (["g"], []):
        got = [{tuple(r) for r in ranks.average_rank(df, by, "v", "rank", n).select("g", "k", "v", "rank").collect()} for n in (1, 7)]
        assert got[0] == got[1]


def test_pivot_and_back(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (2, "a", 3.0)], "k int, name string, value double")
    wide = reshape.pivot_values(df, ["k"], "name", "value", ["a", "b"])
    assert {tuple(r) for r in reshape.unpivot_values(wide, ["k"], ["a", "b"]).collect()} == {tuple(r) for r in df.collect()}


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(2, float("nan")), (1, 1.5)], "k int, x double")
    tables.write_sorted_csv(df, str(tmp_path / "t"), ["k"])
    back = tables.read_csv(spark, str(tmp_path / "t"), "k int, x double")
    assert [tuple(r) for r in back.orderBy("k").collect()] == [(1, 1.5), (2, None)]
    with pytest.raises(ExpectationError):
        tables.write_sorted_csv(df, str(tmp_path / "u"), ["absent"])
    for name in ("r1/predictions.csv", "r1/metadata.json", "r2/metadata.json"):
        tables.write_json_atomic({"b": 1, "a": [2]}, str(tmp_path / "runs" / name))
    found = {r.run_dir.rsplit("/", 1)[1]: (r.has_predictions, r.has_metadata) for r in tables.discover_runs(spark, str(tmp_path / "runs")).collect()}
    assert found == {"r1": (True, True), "r2": (False, True)}
    assert tables.read_json_objects(spark, str(tmp_path / "runs/r2/metadata.json"), "a array<int>, b int").first().b == 1
    content = (tmp_path / "runs/r2/metadata.json").read_bytes()
    assert one(tables.file_provenance(spark, str(tmp_path / "runs/r2"))).sha256 == hashlib.sha256(content).hexdigest()
    tables.append_events(df, str(tmp_path / "log"))
    tables.append_events(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4


def test_cache_is_rebuilt_for_other_settings(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(len(built))

    path = str(tmp_path / "cache")
    assert [tables.cached(spark, path, {"radius": r}, build).count() for r in (2, 2, 3, 2)] == [1, 1, 2, 1]

    def fails():
        return spark.range(9).withColumn("x", F.raise_error(F.lit("no luck")).cast("int"))

    with pytest.raises(Exception, match="no luck"):
        tables.cached(spark, path, {"radius": 4}, fails)
    assert [tables.cached(spark, path, {"radius": r}, build).count() for r in (2, 4, 4)] == [1, 3, 3]


def test_work_folder(spark, monkeypatch):
    from tessera.sources import work

    assert work.work_dir(spark).endswith("shared")

    class Session:
        conf = {"spark.sql.warehouse.dir": "/w"}

        def __init__(self, master):
            self.sparkContext = type("Context", (), {"master": master})

    assert work.work_dir(Session("local[4]")) == "/w/_work" == work.work_dir(Session("local"))
    for master in ("local-cluster[3,2,1024]", "yarn", "spark://host:7077"):
        with pytest.raises(ValueError):
            work.work_dir(Session(master))


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("model: {depth: 3}\nseed: 1\n")
    assert tables.load_config(str(tmp_path / "c.yaml"), {"model.depth": "5", "loss.kind": "interval"}) == {"model": {"depth": 5}, "seed": 1, "loss": {"kind": "interval"}}
    with pytest.raises(ValueError):
        tables.load_config(str(tmp_path / "c.yaml"), {"seed.x": "1"})


# Streaming


def test_stream_of_runs(spark, tmp_path):
    from tessera.streaming.runs import watch_runs

    schema = "run string, refreshed long, score double"
    source, table, checkpoint = (str(tmp_path / n) for n in ("in", "table", "checkpoint"))
    for batch in ([("a", 1, 0.5), ("a", 2, 0.4), ("b", 1, 0.9)], [("a", 3, 0.3), ("c", 3, 0.1)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").json(source)
        watch_runs(spark, source, schema, table, checkpoint, ["run"]).awaitTermination()
    got = {(r.run, r.first_seen, r.score) for r in registry.read_table(spark, table).collect()}
    assert got == {("a", 1, 0.3), ("b", 1, 0.9), ("c", 3, 0.1)}
    for part in (tmp_path / "table").glob("version-*/part-*"):  # a registry that can't be read is not replaced
        part.write_bytes(b"not a table")
    versions = set((tmp_path / "table").glob("version-*"))
    spark.createDataFrame([("d", 9, 0.1)], schema).coalesce(1).write.mode("append").json(source)
    with pytest.raises(Exception):
        watch_runs(spark, source, schema, table, checkpoint, ["run"]).awaitTermination()
    assert set((tmp_path / "table").glob("version-*")) == versions


def test_windowed_counts(spark, tmp_path):
    from tessera.streaming.runs import event_counts

    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(str(tmp_path / "events"))
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    stream = event_counts(spark, str(tmp_path / "events"), schema)
    stream.writeStream.format("memory").queryName("windowed").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("windowed").agg(F.sum("n")).first()[0] == spark.read.parquet(str(tmp_path / "events")).count()


def test_records_out_of_order(spark, tmp_path):
    from tessera.streaming.runs import watch_runs

    schema = "run string, refreshed long, score double"
    source, table, checkpoint = (str(tmp_path / n) for n in ("in", "table", "checkpoint"))
    for batch in ([("a", 9, 0.9), ("b", 1, 0.1)], [("a", 3, 0.3), ("b", 2, 0.2)], [("a", 1, 0.1)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").json(source)
        watch_runs(spark, source, schema, table, checkpoint, ["run"]).awaitTermination()
    assert {(r.run, r.first_seen, r.refreshed, r.score) for r in registry.read_table(spark, table).collect()} == {("a", 1, 9, 0.9), ("b", 1, 2, 0.2)}


def test_runs_become_stale_by_timer(spark, tmp_path):
    from tessera.streaming.runs import watch_status

    source, table, checkpoint = (str(tmp_path / n) for n in ("in", "table", "checkpoint"))
    read = spark.readStream.schema("run string, ts timestamp, complete boolean")

    def feed(*rows):
        spark.createDataFrame(list(rows), "run string, ts string, complete boolean").coalesce(1).write.mode("append").json(source)
        watch_status(read.json(source), table, checkpoint, limit_ms=3_600_000).awaitTermination()
        return {r.run: (r.status, str(r.first_seen)[11:16], str(r.refreshed)[11:16]) for r in registry.read_table(spark, table).collect()}

    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        day = "2024-01-01 "
        now = feed(("a", day + "10:00:00", False), ("b", day + "10:05:00", True), ("c", day + "10:10:00", False))
        assert now == {"a": ("running", "10:00", "10:00"), "b": ("completed", "10:05", "10:05"), "c": ("running", "10:10", "10:10")}
        now = feed(("c", day + "10:59:00", False), ("b", day + "10:04:00", False))  # the second one is late: b stays complete
        assert now["b"] == ("completed", "10:04", "10:05") and now["c"] == ("running", "10:10", "10:59")
        now = feed(("d", day + "11:30:00", False))  # the watermark passes 11:00
        now = feed(("e", day + "11:31:00", True))
        assert now["a"] == ("stale", "10:00", "10:00") and now["b"][0] == "completed" and now["c"][0] == "running" and now["d"][0] == "running"
        assert feed(("a", day + "11:40:00", True))["a"] == ("completed", "10:00", "11:40")
    finally:
        spark.conf.set(provider, before)
    with pytest.raises(ValueError):
        watch_status(read.json(source), table, checkpoint + "2", limit_ms=1)


def test_p_values_of_counts_whose_product_is_beyond_a_long(spark):
    df = spark.createDataFrame([(12e12 + 1e10, 4_000_000, 6_000_000)], "u double, n1 long, n2 long")
    z = 1e10 / math.sqrt(4e6 * 6e6 * (1e7 + 1) / 12)
    assert one(df.select(stats.mann_whitney_p(F.col("u"), F.col("n1"), F.col("n2")).alias("p"))).p == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-5)
