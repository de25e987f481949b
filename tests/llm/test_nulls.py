"""Null ids, and ids beyond the integers that floats hold."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.llm import audio, language, line_dedup, mixing, packing, secrets, simhash, suffix_dedup, tokens
from tessera.llm.queries import vocabulary

BIG = (1 << 60) + 1
TEXTS = ["one two three four five " * 12, "one two three four five " * 12, None, "", "secret: abcdefghijklmnop", "x " * 3000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None if i in (1, 4) else BIG + i, t, None if i % 2 else "en", None if i % 3 else "src") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").cache()


@pytest.mark.parametrize(
    "operator",
    [
        lambda d: audio.telephony(d),
        lambda d: tokens.token_counts(d, vocabulary()),
        lambda d: secrets.secret_spans(d),
        lambda d: packing.best_fit_packing(d, vocabulary()),
        lambda d: mixing.mix_documents(d),
        lambda d: line_dedup.dedup_lines(d),
        lambda d: simhash.near_duplicates(d),
        lambda d: language.held_out_predictions(d),
        lambda d: suffix_dedup.remove_repeats(d),
    ],
    ids="audio tokens secrets packing mixing lines simhash language repeats".split(),
)
def test_ids_are_kept(docs, operator):
    got = [r.doc_id for r in operator(docs).select("doc_id").collect()]
    assert set(got) == {BIG, BIG + 2, BIG + 3, BIG + 5, None} and sum(i is None for i in got) == 2


def test_null_ids_come_first_in_repeats(docs):
    rows = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs).filter(F.coalesce("doc_id", F.lit(-1)) < BIG + 1).collect()}
    assert bytes(rows[BIG].kept) == b"" and rows[BIG].n_bytes == len(TEXTS[0])


def test_component_of_a_null_id_takes_the_smallest_known_one(docs):
    rows = [r for r in simhash.near_duplicates(docs).collect() if r.component_id == BIG]
    assert {r.doc_id for r in rows} >= {BIG, None}
