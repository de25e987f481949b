"""Large meetings: what moves grows with the rows, and nothing is lost."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import simhash
from tessera.llm.components import components
from tests.llm.test_operators import brute_components

ALL = (1 << 64) - 1


def test_three_bits_leave_three_parts():
    rng = np.random.default_rng(0)
    for mask in simhash.masks():
        own = simhash.splits(mask)
        assert len(own) == 20 and all(m & mask == mask for m in own)
        free = [b for b in range(64) if not mask >> b & 1]
        for _ in range(50):
            x = sum(1 << int(b) for b in rng.choice(free, int(rng.integers(0, 4)), replace=False))
            assert any(x & m & ALL == 0 for m in own)


def test_a_large_meeting_moves_linearly(spark):
    rng = np.random.default_rng(9)
    block = (1 << 26) - 1
    fp = (rng.integers(0, 1 << 63, 6000, dtype=np.uint64) & ~np.uint64(block)) | np.uint64(12345)  # all agree in two blocks
    fp[1:400:2] = fp[0:400:2] ^ (np.uint64(1) << rng.integers(30, 60, 200).astype(np.uint64))
    df = spark.createDataFrame([(int(x),) for x in np.unique(fp).astype(np.int64)], "fp long").cache()
    n = df.count()
    assert simhash.link_rows(df, 64).count() < 35 * n  # ten keys, one of them split in twenty; pairs of chunks would move 94 * n for that key alone
    found = {(r.node & ALL, r.root & ALL) for r in components(simhash.links(df, 64)).collect()}
    want = {tuple(sorted((int(a), int(b)))[::-1]) for a, b in zip(fp[0:400:2], fp[1:400:2])}
    assert {frozenset(p) for p in found} == {frozenset(p) for p in want}


def brute_classes(texts, width=5, least=0.8):
    sets = []
    for t in texts:
        words = t.split()
        sets.append({" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))})
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= least:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


@pytest.fixture(scope="module")
def variants():
    """A page in 240 variants, some of them too far from all others, two more pages, and texts of their own."""
    rng = np.random.default_rng(5)
    out = []
    for n, edits in ((240, 6), (30, 2), (30, 14)):
        page = [f"w{int(x)}" for x in rng.integers(0, 5000, 240)]
        for _ in range(n):
            words = list(page)
            for at in rng.integers(0, 240, rng.integers(0, edits)):
                words[at] = f"x{int(rng.integers(0, 10**9))}"
            out.append(" ".join(words))
    return out + [" ".join(f"y{int(x)}" for x in rng.integers(0, 10**6, 50)) for _ in range(40)]


@pytest.mark.parametrize("most", [16, 1024])
def test_classes_of_large_meetings(spark, variants, most):
    docs = spark.createDataFrame(list(enumerate(variants)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs, most=most).collect()}
    want = brute_classes(variants)
    assert [got[i] for i in range(len(variants))] == want and len(set(want)) > 45


def test_joined_meetings_move_no_more(spark, variants, monkeypatch):
    """Chunks first, then one row for each root; all pairs of chunks only where roots are apart."""
    moved = []
    dealt = simhash._dealt
    monkeypatch.setattr(simhash, "_dealt", lambda *a: moved.append((a[2], (out := dealt(*a)).count())) or out)
    copies = variants[:1] * 0 + [f"{variants[0]} end{i}" for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(copies)), "doc_id long, text string")
    assert {r.component_id for r in simhash.near_copies(docs, most=16).collect()} == {0}
    first = moved[0][1]
    assert first <= 400 * simhash.BANDS and all(n < 0.3 * first for turn, n in moved if turn > 0)


def test_hubs_are_dealt_out(spark, variants, monkeypatch):
    monkeypatch.setattr(simhash, "HUB", 7)
    texts = variants[:60]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(3, texts[3])], "doc_id long, text string")
    text = F.col("text").cast("binary")
    read = docs.select("doc_id", text.alias("text"), F.xxhash64(text, F.lit(1)).alias("t1"), F.xxhash64(text, F.lit(2)).alias("t2"))
    nodes = read.dropDuplicates(["t1"]).select(F.col("doc_id").alias("node"), "t1", "t2", F.col("doc_id").alias("first"))
    ids = [r.node for r in nodes.select("node").collect()]
    pairs = [(ids[0], j) for j in ids[1:]] + [(a, a + 1) for a in ids[1:-1] if a + 1 in ids]
    pairs = sorted({(min(p), max(p)) for p in pairs})
    for few in (0, 10**6):
        monkeypatch.setattr(simhash, "FEW_ASKS", few)
        got = simhash._similar(spark.createDataFrame(pairs, "u long, v long"), nodes, read, 5, 0.8).collect()
        assert sorted((r.u, r.v) for r in got) == pairs
        for r in got:
            a, b = ({" ".join(w[i : i + 5]) for i in range(len(w) - 4)} for w in (texts[r.u].split(), texts[r.v].split()))
            assert r.sim == pytest.approx(len(a & b) / len(a | b), abs=1e-12) and r.ok == (r.sim >= 0.8 - 1e-12)
