"""Prediction rows of run folders with their metadata."""

from __future__ import annotations

import gzip
import json

import pytest
from pyspark.sql import functions as F

from tessera.sources.runs import read_runs, run_metadata

ROWS, META = "entity long, endpoint string, p double", "seed int, model string"


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    """Twelve runs in nested folders, one without metadata, one with predictions and metadata in .gz, one without predictions, one named oddly."""
    at = tmp_path_factory.mktemp("runs")
    for k in range(12):
        folder = at / f"exp {k % 3}+a%" / f"run{k}"
        folder.mkdir(parents=True)
        text = "entity,endpoint,p\n" + "".join(f"{i},e{i % 2},{'nan' if i == 3 else k + i / 10}\n" for i in range(5))
        meta = json.dumps({"seed": k % 4, "model": f"m{k}", "more": [1, 2]}, indent=1)
        if k == 5:
            (folder / "predictions.csv.gz").write_bytes(gzip.compress(text.encode()))
            (folder / "metadata.json.gz").write_bytes(gzip.compress(meta.encode()))
        elif k != 7:
            (folder / "predictions.csv").write_text(text)
        if k not in (4, 5):
            (folder / "metadata.json").write_text(meta)
        (folder / "notes.csv").write_text("x\n1\n")
    return at


def test_rows_meet_their_metadata(spark, root):
    rows = read_runs(spark, str(root), ROWS, META).collect()
    assert len(rows) == 11 * 5
    for r in rows:
        k = int(r.run_dir.rsplit("run", 1)[1])
        assert r.run_dir.endswith(f"/exp {k % 3}+a%/run{k}") and r.endpoint == f"e{r.entity % 2}"
        assert r.p is None if r.entity == 3 else r.p == pytest.approx(k + r.entity / 10)
        assert r.metadata is None if k == 4 else tuple(r.metadata) == (k % 4, f"m{k}")
    assert run_metadata(spark, str(root), META).count() == 11


def test_a_condition_reads_fewer_files(spark, root):
    everything, some = read_runs(spark, str(root), ROWS, META), read_runs(spark, str(root), ROWS, META, F.col("seed") == 1)
    names = lambda df: {f for f in df.inputFiles() if "predictions" in f}
    assert len(names(everything)) == 11 and len(names(some)) == 3  # runs 1, 5 (.gz) and 9
    assert {r.metadata.seed for r in some.collect()} == {1} and some.count() == 15
    assert read_runs(spark, str(root), ROWS, META, F.col("seed") == 99).count() == 0


def test_two_metadata_files_are_an_error(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "predictions.csv").write_text("entity,endpoint,p\n1,e,0.5\n")
    (tmp_path / "a" / "metadata.json").write_text("{}")
    (tmp_path / "a" / "metadata.json.gz").write_bytes(gzip.compress(b"{}"))
    with pytest.raises(Exception, match="several metadata files"):
        read_runs(spark, str(tmp_path), ROWS, META).collect()
