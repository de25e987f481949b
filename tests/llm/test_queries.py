"""The registered queries as they are, on a folder of tables with nulls, ties, repeated rows, a long text and columns of clashing
names, each against a plain version of its contract."""

from __future__ import annotations

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

from tessera.llm import line_dedup, queries, secrets
from tests.llm.test_operators import TEXTS, brute_components, brute_fingerprint, brute_repeats, brute_spans, brute_targets, ids_of, library, scalar_audio  # noqa: F401

LONG = 2_400_000


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    words = ["alpha", "beta", "the", "und", "der", "le", "la", "nicht", "mit", "avec", "with", "and"]
    long = " ".join(f"{r.choice(words)}{r.randrange(1000)}" for _ in range(LONG // 8))
    texts = [*TEXTS, long, *("common line\n" + " ".join(r.choices(words, k=90)) + f"\nline {i % 3}" for i in range(30))]
    return [(i, t, ("en", "fr", None)[i % 3], (None, *(f"s{k}" for k in range(14)))[i % 15]) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, rows):
    at = tmp_path_factory.mktemp("tables")
    clash = "doc_id long, text string, lang string, source string, n_chars int, h1 string, fp string, kind int, spans string, score string, row int, marks int, lang_pred string, held_out int, size int, taken int, pos int, visits int"
    again = [*rows, rows[4], rows[15]]
    spark.createDataFrame([(*x, len(x[1] or ""), "h", "f", 1, "s", "c", 2, 3, "l", 4, 5, 6, 7, 8) for x in again], clash).repartition(3).write.parquet(str(at / "documents.parquet"))
    rng = np.random.default_rng(8)
    x = rng.standard_normal((130, 8)).tolist()
    x[7] = x[9] = x[11]
    vectors = [(i, v, "n", 1.0, 0) for i, v in enumerate(x)] + [(3, x[3], "n", 1.0, 0), (200, None, "n", 1.0, 0), (220, [0.0] * 8, "n", 1.0, 0), (240, [float("nan")] * 8, "n", 1.0, 0)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, near string, score double, rank int").write.parquet(str(at / "embeddings.parquet"))
    return str(at)


def read(spark, folder, name) -> pd.DataFrame:
    out = queries.QUERIES[name](spark, folder).toPandas()
    return out.sort_values(list(out.columns[:1])).reset_index(drop=True)


def once(out: pd.DataFrame, rows) -> dict:
    """doc_id to row; repeated rows must be equal."""
    assert sorted(out.doc_id) == sorted([r[0] for r in rows] + [4, 15])
    found = {}
    for row in out.itertuples(index=False):
        assert found.setdefault(row.doc_id, row) == row
    return found


def test_suffix_dedup(spark, folder, rows):
    got = once(read(spark, folder, "op1_suffix_dedup"), rows)
    short = [r for r in rows if len(r[1] or "") < 100_000]
    for (doc, text, *_), (spans, kept) in zip(short, brute_repeats([r[1] for r in short])):
        n = len((text or "").encode())
        assert tuple(got[doc]) == (doc, n, n - len(kept), len(spans), sha(kept))
    long = rows[13]
    assert tuple(got[13]) == (13, len(long[1]), 0, 0, sha(long[1].encode()))  # nothing repeats in it


def test_source_mixing(spark, folder, rows):
    out = read(spark, folder, "op2_source_mixing")
    size = {r[0]: len((r[1] or "").encode().translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b" " * 5)).split(b" ")) for r in rows}
    size = {k: sum(1 for w in (rows[k][1] or "").encode().translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b" " * 5)).split(b" ") if w) for k in size}
    sizes: dict = {}
    for r in [*rows, rows[4], rows[15]]:
        sizes[r[3]] = sizes.get(r[3], 0) + size[r[0]]
    want = brute_targets(sizes)
    assert (out["size"] == out.doc_id.map(size)).all() and (out.taken <= 2 * out["size"]).all()
    for source, own in out.groupby(out.doc_id.map(lambda d: rows[d][3] or "~")):
        key = None if source == "~" else source
        assert (own.source_size == sizes[key]).all() and own.target.iloc[0] == pytest.approx(want[key]) and abs(own.taken.sum() - want[key]) <= 0.5
    again = read(spark, folder, "op2_source_mixing")
    assert sorted(zip(out.doc_id, out.taken)) == sorted(zip(again.doc_id, again.taken))


def test_language_id(spark, folder, rows):
    out = read(spark, folder, "op3_language_id")
    assert (out.held_out == [zlib.crc32(str(d).encode()) % 4 == 2 for d in out.doc_id]).all() and out.score.between(0, 1).all()
    letters = {r[0]: any(c.isalpha() for c in r[1] or "") for r in rows}
    assert ((out.lang_pred == "und") == ~out.doc_id.map(letters)).all() and set(out.lang_pred) <= {"en", "fr", "und"}
    assert once(out, rows)


def test_telephony_audio(spark, folder, rows):
    got = once(read(spark, folder, "op4_telephony_audio"), rows)
    for doc, text, *_ in rows:
        raw = (text or "").encode()
        if len(raw) > 100_000:
            assert got[doc].payload_bytes % 576 == 0 and got[doc].payload_sha256 == sha(raw + b"\xff" * (-len(raw) % 576))
            continue
        payload, tag, media, pcm, feature = scalar_audio(raw)
        assert tuple(got[doc]) == (doc, len(raw), len(payload), sha(payload), zlib.crc32(payload[-32:]), len(media), sha(media), feature, tag, len(pcm), sha(pcm))


def test_line_dedup(spark, folder, rows):
    out = read(spark, folder, "op5_line_dedup")
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"]))
    want = {r[0]: r for r in con.sql(line_dedup.SQL).fetchall()}
    assert {k: tuple(v) for k, v in once(out, rows).items()} == want and out.n_removed.sum() > 20


def test_token_counts(spark, folder, rows, library):  # noqa: F811
    for doc, r in once(read(spark, folder, "op6_token_counts"), rows).items():
        text = rows[doc][1] or ""
        n = len(ids_of(library, text))
        assert tuple(r) == (doc, len(text.encode()), n, n > 512)


def test_secret_scans(spark, folder, rows):
    for doc, r in once(read(spark, folder, "op7_secret_scans"), rows).items():
        spans = brute_spans(rows[doc][1] or "")
        name = lambda s: f"{secrets.RULES[s[1]].kind}:{s[0]}:{s[2]}"
        base = [s for s in spans if s[1] < 3]
        assert tuple(r) == (doc, *(sum(s[1] == k for s in spans) for k in range(3)), sha(",".join(map(name, base)).encode()), ",".join(map(name, spans)))


def test_best_fit_packing(spark, folder, rows, library):  # noqa: F811
    out = queries.QUERIES["op8_best_fit_packing"](spark, folder).toPandas().sort_values(["sequence_id", "offset"])
    end = out.offset + out.length
    assert (end.groupby(out.sequence_id).shift().fillna(0) == out.offset).all() and end.max() <= 2048
    for doc, own in out.groupby("doc_id"):
        ids = np.array([*ids_of(library, rows[doc][1]), 0], "<u4")
        first = len(ids) % 2048 or 2048
        starts = [0, *range(first, len(ids), 2048)]
        want = [(k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)]))]
        times = 2 if doc in (4, 15) else 1
        assert sorted(zip(own.piece, own.start, own.length, own.ids_crc32)) == sorted(want * times)
    assert out.sequence_id.nunique() <= -(-out.length.sum() // 2048) + 1


def test_neighbours(spark, folder):
    out = queries.QUERIES["op9_adaptive_neighbours"](spark, folder).toPandas().sort_values(["query_id", "rank"])
    table = pd.read_parquet(f"{folder}/embeddings.parquet").dropna(subset=["embedding"]).drop_duplicates("vec_id").set_index("vec_id").embedding
    table = {i: np.array(v, float) for i, v in table.items() if np.isfinite(np.array(v, float)).all() and np.any(v)}
    found = total = 0
    assert set(out.query_id) == {i for i in table if i % 20 == 0}
    for q, own in out.groupby("query_id"):
        want = sorted(((-float((table[q] * v).sum()), i) for i, v in table.items() if i != q))[:20]
        assert own["rank"].tolist() == list(range(1, 21)) and own.score.is_monotonic_decreasing
        assert all(s == (table[q] * table[i]).sum() for i, s in zip(own.vec_id, own.score))
        found, total = found + len({i for _, i in want} & set(own.vec_id)), total + 20
    assert found >= 0.95 * total


def test_simhash(spark, folder, rows):
    got = once(read(spark, folder, "op10_simhash_near_dedup"), rows)
    fps = [brute_fingerprint(r[1]) for r in rows if len(r[1] or "") < 100_000]
    ids = [r[0] for r in rows if len(r[1] or "") < 100_000]
    for doc, fp, root in zip(ids, fps, brute_components(fps)):
        assert tuple(got[doc]) == (doc, f"{fp:016x}", ids[root])


def test_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {"pipeline", *queries.QUERIES} <= names and len(queries.QUERIES) >= 13
