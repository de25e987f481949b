"""The stages on their own inputs, each against a brute-force version of what it decides."""

from __future__ import annotations

import hashlib
import re

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import line_dedup, simhash
from tests.llm.test_operators import brute_targets, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, docs, SF)
        done.write.parquet(str(at / name))
        out.append((docs, done := spark.read.parquet(str(at / name))))
        docs = done
    return out


def test_all_but_the_last_keep_the_columns(stages):
    assert len(stages) == 5
    for before, after in stages[:-1]:
        assert after.columns == before.columns and after.count() > 0


def test_language_rejects_texts_without_letters_only(spark, stages):
    before, after = stages[0]
    assert {r.doc_id for r in before.collect() if re.search(r"[^\W\d_]", r.text or "")} == {r.doc_id for r in after.collect()}
    odd = spark.createDataFrame([(1, "12 !", "en", "s", 4), (2, None, None, "s", 0), (3, before.first().text, None, "s", 9)], before.schema)
    assert [r.doc_id for r in corpus_pipeline.identify_language(spark, before.unionByName(odd), SF).filter("doc_id <= 3 AND source = 's'").collect()] == [3]


def test_language_keeps_letters_that_tell_nothing(spark):
    schema = "doc_id long, text string, lang string"
    alphabets = {"a": "abc", "b": "def", "c": "ghi", "d": "jkl", "e": "mno"}
    texts = [(10 * k + n, f"{x} {x[::-1]} {x * 2}", lang) for n, (lang, x) in enumerate(alphabets.items()) for k in range(40)]
    odd = [(1001, "xyz xyz", None), (1002, "12 !", None), (1003, None, None)]
    kept = lambda rows: {r.doc_id for r in corpus_pipeline.identify_language(spark, spark.createDataFrame(rows, schema), SF).collect()}
    assert kept(texts + odd) == {d for d, _, _ in texts} | {1001}  # each language has a fifth
    assert kept([(d, t, None) for d, t, _ in texts + odd]) == {d for d, _, _ in texts} | {1001}


def test_lines_against_sql(stages):
    before, after = stages[1]
    con = duckdb.connect()
    con.register("documents", before.toPandas())
    want = {r[0]: r[3] for r in con.sql(line_dedup.SQL).fetchall()}
    empty = hashlib.sha256(b"").hexdigest()
    got = {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in after.collect()}
    assert {d: h for d, h in want.items() if h != empty} == got
    assert all(r.n_chars == len(r.text) for r in after.collect())


def shingles(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute_classes(texts, similarity=0.8):
    """The first of each component of the links, by all pairs."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if len(x & y) >= (similarity - 1e-12) * len(x | y):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def test_near_copies_leave_one(stages):
    before, after = stages[2]
    rows = sorted((r.doc_id, r.text) for r in before.collect())
    assert sorted(r.doc_id for r in after.collect()) == sorted({rows[k][0] for k in brute_classes([t for _, t in rows])})


@pytest.mark.parametrize("most", [8, 1024])
def test_near_copies_of_edited_texts(spark, most):
    rng = np.random.default_rng(21)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", " \n", "one", "ONE", "one two three four", "one  two three\tfour"]
    for n in (6, 9, 30, 60, 150, 400):
        for _ in range(3):
            own = rng.choice(words, n).tolist()
            for edits in (0, 0, 1, 1, 2, 3, n // 40, n // 20):  # chains, of similarities around the limit
                copy = list(own)
                for _ in range(edits):
                    copy[int(rng.integers(n))] = str(rng.choice(words))
                texts.append(" ".join(copy))
                if edits == 1:
                    own = copy
    common = " ".join(rng.choice(words, 40))  # a passage of many, which makes no copies
    texts += [common + " " + " ".join(rng.choice(words, 60)) for _ in range(60)]
    docs = spark.createDataFrame([(2 * i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, fp string, node int")
    got = {r.doc_id // 2: r.component_id // 2 for r in simhash.near_copies(docs.unionByName(docs.limit(20)), most=most).collect()}
    want = brute_classes(texts)
    wrong = [i for i in range(len(texts)) if got[i] != want[i]]
    assert not wrong and len(set(want)) < 0.75 * len(texts)


def test_near_copies_of_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(None, text), (7, text + " end"), (None, "other words here"), (9, None)], "doc_id long, text string")
    assert sorted((str(r.doc_id), str(r.component_id)) for r in simhash.near_copies(docs).collect()) == [("7", "7"), ("9", "9"), ("None", "7"), ("None", "None")]


def test_mix_comes_near_its_targets(stages):
    before, after = stages[3]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    sizes, taken, largest = {}, {}, {}
    for r in before.collect():
        n = size(r.text)
        sizes[r.source] = sizes.get(r.source, 0) + n
        largest[r.source] = max(largest.get(r.source, 0), n)
    times = {}
    for r in after.collect():
        taken[r.source] = taken.get(r.source, 0) + size(r.text)
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    for source, target in brute_targets(sizes).items():
        assert abs(taken.get(source, 0) - target) <= largest[source] / 2 + 1
    assert max(times.values()) <= 2


def test_packs_every_document(stages):
    before, after = stages[4]
    rows = after.toPandas().sort_values(["sequence_id", "offset"])
    end = rows.offset + rows.length
    assert set(rows.doc_id) == {r.doc_id for r in before.collect()} and end.max() <= 2048
    assert (end.groupby(rows.sequence_id).shift().fillna(0) == rows.offset).all()
    assert len(rows[rows.start == 0]) == before.count()


def test_run_applies_the_stages(spark, stages):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select(columns).collect())) == sorted(map(tuple, stages[-1][1].select(columns).collect()))


def test_odd_tables(spark):
    for texts in (None, []):
        docs = table(spark) if texts is None else spark.createDataFrame([], table(spark).schema)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SF)
            if k < 4:
                assert out.columns == docs.columns
                docs = spark.createDataFrame(out.collect(), out.schema)
            else:
                out.collect()
