"""Every query with SQL gives the same rows as the SQL; those without are compared with plain Python."""

from __future__ import annotations

import hashlib
import math
import struct
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash

from tessera.plans import base, catalog, runs

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for t in TABLES:
        out.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return out


def text(value) -> str:
    if value is None or isinstance(value, float) and math.isnan(value):
        return "~"
    return f"[{','.join(map(text, value))}]" if isinstance(value, (list, tuple)) else repr(value) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(f'{chr(34)}{c}{chr(34)}' for c in columns)} FROM ({catalog.SQL[name]})")
    assert sorted(want.columns) == columns and len(con.sql(f"SELECT * FROM ({catalog.SQL[name]})").columns) == len(columns)
    assert sorted(map(text, map(tuple, df.select(*columns).collect()))) == sorted(map(text, want.fetchall()))


# Queries without SQL, each against a version in plain Python.


def rows_of(spark, name):
    return [r.asDict() for r in catalog.QUERIES[name](spark, SF).collect()]


def test_all_without_sql_are_tested():
    assert set(catalog.QUERIES) - set(catalog.SQL) == {"batch_inference", "cluster_bootstrap", "file_provenance", "gbt_per_endpoint", "p_values"}


def test_file_provenance(spark):
    raw = Path(f"{SF}/region.parquet").read_bytes()
    assert rows_of(spark, "file_provenance") == [{"name": "region.parquet", "bytes": len(raw), "sha256": hashlib.sha256(raw).hexdigest()}]


def test_p_values(spark, con):
    long = con.sql(base.with_ctes("SELECT endpoint, y, qty, tax FROM long_")).df()
    got = {r["endpoint"]: r for r in rows_of(spark, "p_values")}
    assert set(got) == set(long.endpoint)
    for e, own in long.groupby("endpoint"):
        n, r = len(own), np.corrcoef(own.y, own.qty)[0, 1]
        rank, first = own.tax.rank().to_numpy(), (own.y >= 5).to_numpy()
        n1, n2 = int(first.sum()), int((~first).sum())
        u = rank[first].sum() - n1 * (n1 + 1) / 2
        assert got[e]["r"] == pytest.approx(r, abs=1e-6) and got[e]["u"] == pytest.approx(u)
        two_sided = lambda z: math.erfc(abs(z) / math.sqrt(2))
        # Fisher's transformation and the normal limit of U, without corrections: what large groups agree with.
        assert got[e]["p_r"] == pytest.approx(two_sided(math.atanh(r) * math.sqrt(n - 3)), abs=0.01)
        assert got[e]["p_u"] == pytest.approx(two_sided((u - n1 * n2 / 2) / math.sqrt(n1 * n2 * (n + 1) / 12)), abs=0.01)


def test_cluster_bootstrap(spark, con):
    rows = con.sql(base.with_ctes("SELECT entity, endpoint, y, lower, upper, avg(p) FILTER (WHERE model = 'm2') AS a, avg(p) FILTER (WHERE model = 'm3') AS b FROM pred_ GROUP BY ALL")).df()
    mean = rows.groupby("endpoint").y.transform("mean")
    entities, code = np.unique(rows.entity, return_inverse=True)
    cumulated = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(11)])
    deltas = []
    for rep in range(200):
        hashes = [xxhash.xxh64_intdigest(struct.pack("<i", rep), xxhash.xxh64_intdigest(struct.pack("<q", int(e)), xxhash.xxh64_intdigest(struct.pack("<i", 42), 42))) for e in entities]
        u = np.array([((h & (1 << 53) - 1) + 0.5) / (1 << 53) for h in hashes])
        w = (u[:, None] >= cumulated).sum(1)[code]
        by = []
        for e in sorted(rows.endpoint.unique()):
            own = rows.endpoint.to_numpy() == e
            weights, r = w[own], rows[own]
            mean = (weights * r.y).sum() / weights.sum()
            loss = lambda p: (weights * (np.maximum(p - r.upper, 0) + np.maximum(r.lower - p, 0))).sum()  # noqa: B023, E731
            by.append((loss(r.a) - loss(r.b)) / loss(mean))
        deltas.append(np.mean(by))
    (got,) = rows_of(spark, "cluster_bootstrap")
    want = {"replicates": 200, "mean": np.mean(deltas), "low": np.quantile(deltas, 0.025), "high": np.quantile(deltas, 0.975)}
    assert got == pytest.approx(want, abs=2e-6)


def plain_boosted(rows, features, **how):
    from tests.test_boosting import plain

    return plain(rows[features].to_numpy(float), rows.y.to_numpy(), rows.role.to_numpy(), **({"depth": 3, "rate": 0.2, "least": 10, "patience": 5, "bins": 16} | how))


def test_batch_inference(spark):
    whole = runs.bundle(base.Fixtures(spark, SF)).toPandas()
    whole["role"] = np.where(whole.fold == 1, "test", "train")
    got = {(r["entity"], r["endpoint"]): r["p"] for r in rows_of(spark, "batch_inference")}
    assert set(whole.endpoint) == {1, 2, 3, 4} and set(got) == set(zip(whole.entity[whole.fold == 1], whole.endpoint[whole.fold == 1]))
    for e, own in whole.groupby("endpoint"):
        want = plain_boosted(own, ["qty", "tax"], trees=3)
        assert all(abs(got[i, e] - p) < 2e-6 for i, p, f in zip(own.entity, want, own.fold) if f == 1)


def test_gbt_per_endpoint(spark):
    whole = runs.bundle(base.Fixtures(spark, SF)).toPandas()
    got = {r["endpoint"]: r for r in rows_of(spark, "gbt_per_endpoint")}
    assert set(got) == {1, 2, 3, 4}
    for e, own in whole.groupby("endpoint"):
        errors = []
        for held in range(5):
            rows = own.assign(role=np.where(own.fold == held, "test", np.where(own.fold == (held + 1) % 5, "valid", "train")))
            p = plain_boosted(rows, ["qty", "tax", "total", "balance"], trees=10, bins=32, patience=3)
            errors.append((rows.y - p)[rows.role == "test"])
        error = pd.concat(errors)
        assert got[e]["n"] == len(own) and got[e]["mae"] == pytest.approx(error.abs().mean(), abs=2e-6) and got[e]["rmse"] == pytest.approx(math.sqrt((error**2).mean()), abs=2e-6)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 4
    assert set(entry.oracle_sql()) <= set(entry.queries())
