"""Texts with runs of over a million blanks or letters: counts, ids and pieces are the library's."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from tessera.llm import packing, tokens
from tessera.llm.queries import vocabulary

N = 1_200_000
RUNS = [" ", "\n", "\t", " \n", "　", "a", "."]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


@pytest.mark.parametrize("run", RUNS)
def test_long_runs(run, library):
    run *= (N if run in " \n" else 200_000) // len(run)
    for text in (run, "x" + run + "y z"):
        want = library.encode(text, add_special_tokens=False).ids
        assert tokens.counter(vocabulary())([text, "a b"]) == [len(want), 2]
        got, other = tokens.id_encoder(vocabulary())([text, "a b"])
        assert np.array_equal(np.frombuffer(got, "<u4"), want) and len(other) == 8
    assert all(len(x) <= tokens.LONG for x in tokens.counter(vocabulary()).known)


@pytest.mark.parametrize("n", [tokens.LONG - 1, tokens.LONG, tokens.LONG + 1])
def test_both_sides_of_the_bound(n, library):
    for text in ("x" + " " * n + "y", "\n" * n, "a" * n):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(tokens.id_encoder(vocabulary())([text])[0], "<u4").tolist() == want
        assert tokens.counter(vocabulary())([text]) == [len(want)]


def test_long_runs_in_tables(spark, library):
    texts = ["x" + c * N + "y" for c in " \n\t"] + [" " * N]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = {r.doc_id: r for r in tokens.token_counts(docs, vocabulary()).collect()}
    rows = packing.best_fit_packing(docs, vocabulary()).collect()
    for i, text in enumerate(texts):
        ids = library.encode(text, add_special_tokens=False).ids
        assert (counts[i].n_tokens, counts[i].n_bytes, counts[i].over_limit) == (len(ids), len(text), True)
        ids = np.array([*ids, 0], "<u4")
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert sum(r.length for r in own) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
