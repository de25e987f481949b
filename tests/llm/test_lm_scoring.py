"""The attention model against plain loops, its gradients against differences, the word counts against a Counter, and held-out texts."""

from __future__ import annotations

import collections
import math
import re
import time
import zlib

import numpy as np
import pytest

from tessera.llm import attention, lm_scoring, queries
from tessera.llm.queries import vocabulary

LOWER = {i: i + 32 for i in range(65, 91)}


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(0)
    counts = np.zeros(3000)
    counts[:2500] = rng.integers(0, 50, 2500) * (np.arange(2500) < 1500)
    cls = attention.layout(counts)
    weights, new = attention.first_weights(rng.integers(0, 9, (attention.CLASSES, attention.CLASSES)).astype(float))
    cls = new[cls]
    weights["mix"] = rng.normal(0, 0.3, weights["mix"].shape).astype(np.float32)
    return attention.Model(cls, attention.shares(counts, cls), weights)


def plain_score(model, ids):
    """Token by token, in double precision."""
    w = {k: v.astype(float) for k, v in model.weights.items()}
    row = [0] * (attention.SEEN + 1) + list(ids) + [0]
    classes, total, p = [model.cls[i] for i in row], 0.0, attention.PLACES
    for t in range(attention.SEEN + 1, len(row)):
        begin = (t - attention.SEEN - 1) // attention.STEP * attention.STEP
        e = np.array([w["embed"][c] + w["place"][i] for i, c in enumerate(classes[begin:t])])
        a = np.exp([e[-1] @ w["query"] @ (x @ w["key"]) for x in e])
        h = e[-1] + sum(s * (x @ w["value"]) for s, x in zip(a / a.sum(), e)) @ w["mix"]
        g, place = divmod(classes[t], p)
        outer = h @ w["cluster"] + w["cluster_bias"]
        inner = w["inside"][g * p : (g + 1) * p] @ h + w["inside_bias"][g * p : (g + 1) * p]
        total += outer[g] - np.log(np.exp(outer).sum()) + inner[place] - np.log(np.exp(inner).sum()) + model.within[row[t]]
    return total


def test_scores_are_those_of_plain_loops(model):
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 3000, n) for n in (0, 1, 2, 31, 32, 33, 63, 64, 200, 7)]
    got = attention.score_texts(model, texts, 0)
    assert np.allclose(got, [plain_score(model, t) for t in texts], rtol=1e-5)
    many = [texts[i % 10] for i in range(1500)]  # several blocks
    assert np.allclose(attention.score_texts(model, many, 0), np.tile(got, 150), rtol=1e-5)


def test_probabilities_add_up_to_one(model):
    ids = np.arange(40) % 7
    base = plain_score(model, ids[:0])
    total = 0.0
    for c in range(attention.CLASSES):  # all classes behind one state
        own = np.flatnonzero(model.cls == c)
        assert abs(np.exp(model.within[own]).sum() - 1) < 1e-9 or not len(own)
    h = np.random.default_rng(2).normal(size=(1, attention.WIDTH)).astype(np.float32)
    total = np.exp(attention.log_probabilities(model.weights, h.repeat(attention.CLASSES, 0), np.arange(attention.CLASSES), attention.Room())).sum()
    assert abs(total - 1) < 1e-4 and base < 0
    huge = attention.log_probabilities(model.weights, h.repeat(attention.CLASSES, 0) * 1e4, np.arange(attention.CLASSES), attention.Room())
    assert np.isfinite(huge).all() and abs(np.exp(huge.astype(float)).sum() - 1) < 1e-3


def test_gradients(model):
    rng = np.random.default_rng(4)
    w = {k: v.astype(float) for k, v in model.weights.items()}
    x = rng.integers(0, attention.CLASSES, (3, attention.WINDOW))
    y = rng.integers(0, attention.CLASSES, x.shape)
    y[2, 20:] = attention.NONE
    _, g = attention.gradients(w, x, y)
    for name in w:
        at = {"embed": (x[0, 5], 3), "inside": (y[0, 5], 3), "inside_bias": (y[0, 5],)}.get(name, tuple(rng.integers(0, s) for s in w[name].shape))
        side = []
        for step in (1e-5, -2e-5):
            w[name][at] += step
            side.append(attention.gradients(w, x, y)[0])
        w[name][at] += 1e-5
        assert g[name][at] == pytest.approx((side[0] - side[1]) / 2e-5, rel=1e-4, abs=1e-8), name


def test_training_lowers_the_loss(model):
    rng = np.random.default_rng(5)
    row = np.tile(rng.integers(0, 40, 9), 400)  # a period that only attention can follow from its start
    windows = np.concatenate([attention.training_windows(np.arange(3000), row[k : k + 300], 0) for k in range(200)])
    after = attention.train(model.weights, windows, 0.01)
    x, y = windows[:50, :-1].astype(np.int64), windows[:50, 1:].astype(np.int64)
    x[x == attention.NONE] = 0
    assert attention.gradients(after, x, y)[0] < 0.8 * attention.gradients(model.weights, x, y)[0]
    again = attention.unpacked(attention.packed(after), after)
    assert set(again) == set(after) and all(np.array_equal(again[k], after[k]) for k in after)


def test_training_costs_few_times_what_scoring_does(model):
    """A window's gradients and step, by what telling its tokens costs."""
    texts = [np.random.default_rng(k).integers(0, 3000, 319) for k in range(128)]
    windows = np.concatenate([attention.training_windows(model.cls, t, 0) for t in texts])

    def least(work):
        took = []
        for _ in range(8):
            began = time.thread_time()
            work()
            took.append(time.thread_time() - began)
        return min(took)

    assert least(lambda: attention.train(model.weights, windows, 0.01, 128)) < 4 * least(lambda: attention.score_texts(model, texts, 0))


def test_gradients_of_large_attention_and_logits(model):
    """Where exponentials would overflow, and where no place counts."""
    rng = np.random.default_rng(9)
    w = {k: v.astype(float) * (40 if k in ("query", "key") else 1) + (800 if k.endswith("bias") else 0) for k, v in model.weights.items()}
    x, y = rng.integers(0, attention.CLASSES, (2, 3, attention.WINDOW))
    loss, g = attention.gradients(w, x, y)
    assert np.isfinite(loss) and all(np.isfinite(v).all() for v in g.values())
    h = w["embed"][x] + w["place"]
    a = (h @ w["query"]) @ (h @ w["key"]).transpose(0, 2, 1)
    a = np.where(np.tril(np.ones((attention.WINDOW, attention.WINDOW))) > 0, a, -np.inf)
    a = np.exp(a - a.max(-1, keepdims=True))
    h = (h + a / a.sum(-1, keepdims=True) @ (h @ w["value"]) @ w["mix"]).reshape(-1, attention.WIDTH).astype(float)
    assert loss == pytest.approx(-attention.log_probabilities(w, h, y.reshape(-1), attention.Room(float)).mean(), rel=1e-5)
    nothing, g = attention.gradients(w, x, np.full_like(y, attention.NONE))
    assert nothing == 0 and not any(v.any() for v in g.values())


def test_windows_cover_each_token_once():
    for n in (0, 1, 31, 32, 33, 100):
        ids = np.arange(1, n + 1)
        found = attention.training_windows(np.arange(3000), ids, 0)
        scored = found[:, attention.SEEN + 1 :]
        assert scored[scored != attention.NONE].tolist() == [*ids.tolist(), 0]


def test_words_of_wide_blanks():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary())
    words = ["\xa0" * k for k in range(1, 41)]  # in any order some have one token with the next
    coder = lm_scoring.Words(vocabulary(), "<u2", (np.empty(0, np.int64), np.empty(0)))
    ids, split, _, _ = coder([" ".join(words).encode()])
    assert len(split[0]) == len(coder.ids) == 40
    assert np.frombuffer(ids[0], "<u2").tolist() == library.encode(" ".join(words), add_special_tokens=False).ids


def test_ids_by_words_are_the_librarys():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary())
    rng = np.random.default_rng(6)
    parts = ["a", "word", "don't", "Éa", "中文", "12x", "!?", " ", "  ", "\n", "\n\n", "\t", "　", " ", "हिन्दी", "\x1c", "<|endoftext|>"]
    texts = ["", " ", "\n", "a\n", "\n\na  b", *("".join(rng.choice(parts, rng.integers(1, 30))) for _ in range(400)), *(" ".join(rng.choice(parts[:7], 20)) for _ in range(100))]
    for kind in ("<u2", "<u4"):
        coder = lm_scoring.Words(vocabulary(), kind, (np.empty(0, np.int64), np.empty(0)))
        ids, split, known, logs = coder([t.encode() for t in texts])
        for t, got in zip(texts, ids):
            assert np.frombuffer(got, kind).tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)
        assert len(known) == sum(map(len, split)) and not known.any()
    assert sum(coder._lines(t.encode())[0] is not None for t in texts) > 100


def test_every_window_trains(spark):
    """Corpora with the same counts of classes and of their pairs, but other windows, give other models, and no window is left out."""

    def learned(*texts):
        rows = spark.createDataFrame([(np.array(t, "<u2").tobytes(),) for t in texts], "ids binary")
        return lm_scoring.learn(rows, 50, "<u2"), rows

    for a, b, c in ((1, 2, 3), (4, 5, 6), (7, 8, 9)):
        (one, _), (other, _) = learned([a, b, a, c, a]), learned([a, c, a, b, a])
        assert np.array_equal(one.cls, other.cls) and not np.array_equal(one.weights["mix"], other.weights["mix"])
    texts = [np.random.default_rng(k).integers(1, 50, 90) for k in range(40)]
    model, rows = learned(*texts, texts[0])
    windows = lm_scoring.windows_of(rows, model, "<u2", 0)
    want = {w.tobytes() for t in texts for w in attention.training_windows(model.cls, t, 0)}
    found = [bytes(r.window) for r in windows.collect()]
    assert len(found) == len(want) == 120 and set(found) == want


def test_remembered_words_are_bounded(monkeypatch):
    monkeypatch.setattr(lm_scoring, "REMEMBERED", 50)
    coder = lm_scoring.Words(vocabulary(), "<u2", (np.empty(0, np.int64), np.empty(0)))
    fresh = lm_scoring.Words(vocabulary(), "<u2", (np.empty(0, np.int64), np.empty(0)))
    for k in range(30):
        text = [" ".join(f"w{(k * 7 + i) % 90}" for i in range(20)).encode()]
        monkeypatch.setattr(lm_scoring, "REMEMBERED", 50)
        got = coder(text)[0]
        monkeypatch.setattr(lm_scoring, "REMEMBERED", 10_000)
        assert got == fresh(text)[0] and len(coder.number) <= 70


def plain_base(rows):
    """doc_id to n_tokens, n_known, N, base score."""
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    count, n_docs = collections.Counter(), 0
    for d, t in rows:
        if not held(d):
            count.update(words_of(t))
            n_docs += 1
    n, v = sum(count.values()) + n_docs, len(count) + (n_docs > 0)
    size = math.log10(n + 0.5 * (v + 1))
    for d, t in rows:
        words = words_of(t)
        yield d, held(d), len(words) + 1, sum(count[w] > 0 for w in words) + (n_docs > 0), n, sum(math.log10(count[w] + 0.5) - size for w in words) + math.log10(n_docs + 0.5) - size


@pytest.mark.parametrize("common", [3, 1 << 21])
def test_base_scores(spark, common):
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(["The", "the", "é", "zz", *(f"w{i}" for i in range(300))], rng.integers(0, 80))) for _ in range(60)]
    rows = [*enumerate(texts), (60, None), (61, ""), (62, " \n\t "), (None, "the end"), (5, texts[5]), (63, "long " * 50_000), (64, "x" * 200_000)]
    docs = spark.createDataFrame([(d, t, 1, "c", 0.5) for d, t in rows], "doc_id long, text string, row int, word string, score double").repartition(3)
    got = lm_scoring.score_documents(docs, vocabulary(), common=common).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    for r, want in zip(sorted(got, key=key), sorted(plain_base(rows), key=key), strict=True):
        assert tuple(r)[:5] == want[:5] and r.base_score == pytest.approx(want[5], rel=1e-9) and math.isfinite(r.score) and r.score < 0


def test_edges(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lm_scoring.score_documents(docs, vocabulary()).count() == 0
    only = [d for d in range(100) if zlib.crc32(str(d).encode()) % 5 == 1][:3]  # nothing to learn from
    rows = lm_scoring.score_documents(spark.createDataFrame([(d, "a b") for d in only], "doc_id long, text string"), vocabulary()).collect()
    assert all((r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (True, 3, 0, 0) and r.base_score == pytest.approx(0) and math.isfinite(r.score) for r in rows)


def test_query(spark):
    """On held-out documents the model is far better than counts of subwords, and knows nothing of them; reruns agree."""
    out = queries.op12_lm_scoring(spark, "/root/testdata/sf0.01").toPandas().set_index("doc_id")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").toPandas()
    for d, held, n, known, total, base in plain_base(list(docs.itertuples(index=False))):
        r = out.loc[d]
        assert (bool(r.held_out), r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total) and r.base_score == pytest.approx(base, rel=1e-9)
    held = out[out.held_out]
    coder = lm_scoring.Words(vocabulary(), "<u2", (np.empty(0, np.int64), np.empty(0)))
    ids = dict(zip(docs.doc_id, coder([t.translate(LOWER).encode() for t in docs.text])[0]))
    ids = {d: np.append(np.frombuffer(x, "<u2"), 0) for d, x in ids.items()}
    counts = sum(np.bincount(ids[d], minlength=1 << 16) for d in out.index[~out.held_out]) + 0.5
    unigram = sum(np.log10(counts[ids[d]] / counts.sum()).sum() for d in held.index)
    assert held.score.sum() > 0.86 * unigram and (held.n_subwords == [len(ids[d]) for d in held.index]).all()
    again = queries.op12_lm_scoring(spark, "/root/testdata/sf0.01").toPandas().set_index("doc_id")
    assert np.allclose(again.score.reindex(out.index), out.score, rtol=1e-4)
