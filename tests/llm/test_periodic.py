"""Periodic runs against all pairs of places, and the registered query against a plain version of its contract."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest

from tessera.llm import periodic, queries


def brute_runs(words, least=6, repeats=4):
    """(start, end, smallest period) of every maximal stretch, by comparing all words q apart for every q."""
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    x, found = np.array([number[w] for w in words], np.int64), {}
    for q in range(1, len(x) // repeats + 1):
        edge = np.diff(np.concatenate([[0], (x[q:] == x[:-q]).astype(np.int8), [0]]))
        for s, e in zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) + q).tolist()):
            if e - s >= max(least, repeats * q):
                found.setdefault((s, e), q)
    return sorted(((s, e, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def patchwork(rng):
    parts = [np.tile(rng.integers(0, rng.integers(2, 7), rng.integers(1, 9)), rng.integers(1, 8))[: rng.integers(1, 60)] for _ in range(rng.integers(0, 6))]
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


@pytest.mark.parametrize("least, repeats", [(6, 4), (2, 3), (9, 3), (4, 5), (30, 4)])
def test_runs_are_all_runs(least, repeats):
    rng, n = np.random.default_rng(least), 0
    for _ in range(400):
        docs = [patchwork(rng) for _ in range(rng.integers(1, 5))]
        bounds = np.append(0, np.cumsum([len(d) for d in docs]))
        got = [tuple(r) for r in periodic.find_runs(np.concatenate(docs).astype(np.int64), bounds, least, repeats).tolist()]
        want = [(s + bounds[k], e + bounds[k], q) for k, d in enumerate(docs) for s, e, q in brute_runs(d.tolist(), least, repeats)]
        assert got == sorted(want, key=lambda r: (r[0], r[2])), docs
        n += len(got)
    assert n > 50


def test_the_mask_keeps_runs_and_little_else():
    assert periodic.gram_width() == 5 and periodic.gram_width(30, 4) == 17 and periodic.gram_width(2, 3) == 2
    rng = np.random.default_rng(1)
    words = np.concatenate([np.arange(5000), np.tile(np.arange(7) + 9000, 4), np.arange(5000, 9000), [1, 2, 3, 4, 5, 6], rng.permutation(9000) + 10000])
    found = periodic.segments(words, np.array([0, len(words)]), 5, 6)
    assert found.tolist() == [[1, 7], [5000, 5028], [9028, 9034]]
    assert periodic.find_runs(words, np.array([0, len(words)])).tolist() == [[5000, 5028, 7]]
    # Another document's grams are not this one's.
    assert len(periodic.segments(words, np.array([0, 9020, len(words)]), 5, 6)) < 3


def test_one_long_run_is_not_quadratic():
    words = np.tile(np.arange(3), 200_000)
    assert periodic.find_runs(words, np.array([0, len(words)])).tolist() == [[0, 600_000, 3]]


def plain(doc, text):
    """What the contract asks of one document."""
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n, h = len(words), zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = [(s, e - s, q) for s, e, q in brute_runs(words)]
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    s, m, q = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc, len(runs), s, m, q, m and 1000 * m // q, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)), n)


def test_query(spark, tmp_path):
    rng = np.random.default_rng(3)
    letters = np.array(["é", "中文", "b", "c\x1c", "d e", "ff"])
    texts = [" ".join(letters[patchwork(rng) % 6]) for _ in range(150)]
    texts += [None, "", " \t\n\x0b\x0c\r", "a", "a " * 6, "\na\ta\x0ba\x0ca\ra a a", "x y " * 3, "x y " * 4, " ".join(map(str, range(3000))) * 4, ("lorem ipsum " * 50 + "dolor\n") * 30]
    rows = [(i, t, "z", 1) for i, t in enumerate(texts * 3)] + [(None, texts[3], "z", 1), (7, texts[7], "z", 1), (7, texts[7], "z", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, runs string, g int").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(got, key=key) == sorted((plain(d, t) for d, t, *_ in rows), key=key)
    assert sum(zlib.crc32(str(d).encode()) % 10 == 0 for d, *_ in rows) > 20
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert periodic.periodic_runs(empty).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(empty, repeats=2)
    out = periodic.periodic_runs(spark.createDataFrame([("id", "a b a b a b a b c")], "doc_id string, text string")).first()
    assert (out.doc_id, out.collapsed, [tuple(r) for r in out.runs]) == ("id", "a b c", [(0, 8, 2)])
