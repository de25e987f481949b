from __future__ import annotations

import pytest

from tessera.sources import reports


def test_markdown(spark):
    df = spark.createDataFrame([("a|b", 1.23456, 1200), (None, float("nan"), None)], "name string, x double, n int")
    assert reports.markdown(df) == "| name | x | n |\n| --- | --- | --- |\n| a\\|b | 1.235 | 1,200 |\n| NA | NA | NA |"
    with pytest.raises(ValueError):
        reports.markdown(spark.range(5), limit=4)


def test_same_in_order(spark):
    a = spark.createDataFrame([(0, "x", 1), (1, "y", 2)], "o int, name string, seed int")
    b = spark.createDataFrame([(0, "y", 2), (1, "x", 1)], a.schema)
    assert reports.same_in_order(a, a, "o") and not reports.same_in_order(a, b, "o")


def test_changed_files(spark):
    a = spark.createDataFrame([("f", "1"), ("g", "2"), ("h", "3")], "name string, sha256 string")
    b = spark.createDataFrame([("f", "1"), ("g", "9"), ("i", "3")], a.schema)
    assert {tuple(r) for r in reports.changed_files(a, b).collect()} == {("g", "changed"), ("h", "missing"), ("i", "new")}


def test_gates(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t"))
    t, u = str(tmp_path / "t"), str(tmp_path / "u")
    assert reports.incomplete_tables(spark, {t: (["id"], 3)}) == []
    assert len(reports.incomplete_tables(spark, {t: (["id", "x"], 1), u: ([], 1)})) == 2
    assert reports.incomplete_tables(spark, {t: (["id"], 4)}) == [f"{t}: fewer than 4 rows"]
    (tmp_path / "COMPLETED").touch()
    assert reports.marker_problems(str(tmp_path)) == ["COMPLETED without metadata.json", "COMPLETED without predictions.csv"]
    assert reports.preflight([u], [str(tmp_path)], {"a": {"b": 1}}, ["a.b", "a.c"]) == [f"{u}: missing", "a.c: not set"]


def test_preflight_of_data_and_checkpoint(spark, tmp_path):
    from tessera.operators import expectations

    spark.range(3).write.parquet(str(tmp_path / "model"))
    folds = spark.createDataFrame([(1, 0), (2, 7)], "k int, fold int")
    checks = expectations.together(expectations.unique(folds, ["k"]), expectations.within(folds, "fold", 0, 4, "folds"))
    assert reports.preflight([], [], {}, [], checks, {str(tmp_path / "model"): (["id"], 3)}) == ["folds: 1 rows"]
    problems = reports.preflight([], [], {}, [], None, {str(tmp_path / "model"): (["state"], 1), str(tmp_path / "none"): ([], 0)})
    assert [p.split(": ")[1] for p in problems] == ["no state", "cannot be read"]


def test_outputs_by_hash(spark, tmp_path):
    from tessera.sources.tables import file_provenance, write_atomic

    write_atomic(b"one", str(tmp_path / "out" / "a.txt"))
    write_atomic(b"two", str(tmp_path / "out" / "b.txt"))
    recorded = spark.createDataFrame(file_provenance(spark, str(tmp_path / "out")).collect())
    assert reports.output_problems(spark, {}, str(tmp_path / "out"), recorded) == []
    write_atomic(b"2", str(tmp_path / "out" / "b.txt"))
    (tmp_path / "out" / "a.txt").unlink()
    assert reports.output_problems(spark, {str(tmp_path / "t"): ([], 0)}, str(tmp_path / "out"), recorded) == [f"{tmp_path / 't'}: cannot be read", "a.txt: missing", "b.txt: changed"]


def test_findings_by_priority(spark):
    cell = spark.createDataFrame([("n = 3",)], "x string")
    rows = reports.findings(("b", cell, "then", "High"), ("a", cell, "then", "High"), ("z", cell, "so", "Critical")).collect()
    assert [tuple(r) for r in rows] == [("z", "n = 3", "so", "Critical"), ("a", "n = 3", "then", "High"), ("b", "n = 3", "then", "High")]
    with pytest.raises(ValueError):
        reports.findings(("b", cell, "then", "Urgent"))
