"""Scores of documents by a causal self-attention model over subword ids (attention), and by the counts of their words.

What is learned comes from the training documents (crc32 of the id modulo 5 is not 1), all of them: counts of subwords, which make the classes;
counts of class pairs, from which the model's weights start; counts of words. Then windows train it: every distinct window of classes, once (copies
teach once), dealt out by hash to replicas of `replica` windows. A replica trains from the common weights on its windows; the mean of the
replicas' weights, taken in a tree, is the start of the next round, on the other windows. Weights don't depend on how Spark deals the rows out.

Scoring is one pass: overlapping windows, each token once, with at least attention.SEEN tokens before it. Whole texts are scored.

Words are counted exactly. Those with a share of 1 / `common` or more (hence `common` words at most) are looked up in each task, by 64-bit hash;
the other ones of a text are joined with the counts by themselves.

Null text: empty, its end is scored. Null id: not held out, learned from. Repeated rows count and are scored each. An empty table gives no rows;
without training documents all subwords of a class are alike. Extra columns are ignored. A very long text's ids and words are held at once.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import attention
from tessera.llm._shared import chunks, doc_id_type, drop_stored, id_text, stored
from tessera.llm.tokens import UNSAFE, begins_with_blank, id_encoder, vocabulary_size

#: Distinct words that a task counts before it hands them on, and whose ids it remembers; bytes of text whose words are looked up at once.
COUNTED, REMEMBERED, LOOKED_UP = 300_000, 400_000, 1 << 20
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 1, F.lit(False))


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word (bytes, A-Z in lower case), c (how often). Stored."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def handed_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for part in chunks(batch):
                for text in part.column("text").to_pylist():
                    seen.update((text or b"").translate(_LOWER).split())
                if len(seen) > COUNTED:
                    yield handed_on()
        if seen:
            yield handed_on()

    return stored(id_text(docs, id_col, text_col).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c")))


class Words:
    """What a task knows of words: the ids that each gives behind a space, whether it is common, and its log10(c + 0.5).

    The split of byte-level vocabularies cuts wherever a blank follows another character, so a text whose blanks are single spaces and line feeds has
    the ids of its words with what stands before each. Other texts, and those with blanks beyond ASCII or strings of added tokens, are encoded
    whole."""

    _BLANK = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")

    def __init__(self, tokenizer: str, kind: str, common: tuple[np.ndarray, np.ndarray]):
        self.encoder, self.kind = id_encoder(tokenizer), kind
        self.hashes, self.logs = common
        self.added = [t.encode() for t in self.encoder.rest.added]
        if self.encoder.ranked is not None:
            self.blank = begins_with_blank(tokenizer)
        self.number: dict[bytes, int] = {}
        self.ids: list[bytes] = []
        self.led: dict[bytes, bytes] = {}

    def _encoded(self, texts: list[bytes]) -> list[bytes]:
        found = self.encoder([t.decode("utf-8", "replace") for t in texts])
        return [np.frombuffer(x, "<u4").astype(self.kind).tobytes() for x in found] if self.kind != "<u4" else found

    def _learn(self, words: list[bytes], leads: set[bytes]) -> list[int]:
        """The numbers of the words; those that are new are looked up and encoded."""
        at = list(map(self.number.get, words))
        new = {w for w, i in zip(words, at) if i is None}
        if len(self.number) + len(new) > REMEMBERED:
            self.number, self.ids, new = {}, [], set(words)
        if len(self.led) > REMEMBERED:
            self.led = {}
        if not self.number:
            self.log, self.known = np.empty(0), np.empty(0, bool)
        new = list(new)
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
        h = np.fromiter(map(functools.partial(xxhash.xxh64_intdigest, seed=42), new), np.uint64, len(new)).view(np.int64)
        place = np.minimum(np.searchsorted(self.hashes, h), max(0, len(self.hashes) - 1))
        known = self.hashes[place] == h if len(self.hashes) else np.zeros(len(h), bool)
        self.log = np.append(self.log, np.where(known, self.logs[place], 0.0) if len(self.hashes) else np.zeros(len(h)))
        self.known = np.append(self.known, known)
        if self.encoder.ranked is not None:
            # Side by side, blanks beyond ASCII at the ends of words would run together with the space between them.
            odd = [w for w in new if not w.isascii() and (UNSAFE.search(w.decode("utf-8", "replace")) or self._BLANK.search(w))]
            other = dict(zip(odd, self._encoded([b" " + w for w in odd])))
            plain = iter(self._plain([w for w in new if w not in other] if odd else new))
            self.ids += [other[w] if w in other else next(plain) for w in new] if odd else plain
            leads = list(leads.difference(self.led))
            self.led.update(zip(leads, self._encoded(leads)))
        return list(map(self.number.__getitem__, words)) if new else at

    def _plain(self, words: list[bytes]) -> list[bytes]:
        """The ids of all at once: a token begins with a blank just where a word begins."""
        if not words:
            return []
        found = self.encoder.ranked(b"".join(b" " + w for w in words).decode("utf-8", "replace"), disallowed_special=())
        raw, size = found.astype(self.kind).tobytes(), int(self.kind[-1])
        ends = [*(np.flatnonzero(self.blank[found]) * size).tolist(), len(raw)]
        return [raw[a:b] for a, b in zip(ends, ends[1:])]

    def _lines(self, text: bytes) -> tuple[list | None, list[bytes]]:
        """What leads each line (the line feeds before it, and its first word) and how many words it has, None if the text must be encoded whole; and
        its words."""
        if self.encoder.ranked is None or any(t in text for t in self.added) or (not text.isascii() and self._BLANK.search(text)):
            return None, text.split()
        out, all_of, feeds = [], [], -1
        for line in text.split(b"\n"):
            feeds += 1
            if line:
                words = line.split()
                if b" ".join(words) != line:
                    return None, text.split()
                out.append((b"\n" * feeds + words[0], len(words)))
                all_of += words
                feeds = 0
        if feeds > 0:
            out.append((b"\n" * feeds, 0))
        return out, all_of

    def __call__(self, texts: list[bytes]) -> tuple[list[bytes], Sequence[list[bytes]], np.ndarray, np.ndarray]:
        """Ids and words of each text, and of all words whether they are common, and their logs."""
        lines, split = zip(*map(self._lines, texts)) if texts else ((), ())
        at = self._learn(list(itertools.chain.from_iterable(split)), {lead for x in lines for lead, _ in x or ()})
        whole = iter(self._encoded([t for t, x in zip(texts, lines) if x is None]))
        ids, led, own, k = [], self.led.__getitem__, self.ids, 0
        for words, found in zip(split, lines):
            if found is None:
                ids.append(next(whole))
            else:
                parts, j = [], k
                for lead, n in found:
                    parts.append(led(lead))
                    parts += [own[i] for i in at[j + 1 : j + n]]
                    j += n
                ids.append(b"".join(parts))
            k += len(words)
        at = np.array(at, np.int64)
        return ids, split, self.known[at], self.log[at]


def encoded(docs: DataFrame, tokenizer: str, common: tuple[np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, row (a number of its own), ids (subwords of the text with A-Z in lower case, as unsigned 32-bit integers, or 16-bit ones where
    they suffice), n_tokens (words and end), n_common and log_common (number of common words, and sum of log10(c + 0.5)), rare (the other
    words). common: hashes, in order, and log10(c + 0.5). Stored."""
    told = docs.sparkSession.sparkContext.broadcast(common)
    kind = "<u2" if vocabulary_size(tokenizer) <= 1 << 16 else "<u4"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(tokenizer, kind, told.value)
        for batch in batches:
            for part in chunks(batch, limit=LOOKED_UP):
                ids, split, known, log = words([(t or b"").translate(_LOWER) for t in part.column("text").to_pylist()])
                to = np.append(0, np.cumsum([len(x) for x in split]))
                count = np.append(0, np.cumsum(known))
                flat = list(itertools.compress(itertools.chain.from_iterable(split), (~known).tolist()))
                rare = pa.ListArray.from_arrays(pa.array((to - count[to]).astype(np.int32)), pa.array(flat, pa.binary()))
                columns = [
                    part.column("doc_id"), part.column("held_out"), pa.array(ids, pa.binary()), pa.array(np.diff(to) + 1), pa.array(np.diff(count[to])),
                    pa.array(np.add.reduceat(np.append(log, 0.0), to[:-1]) * (np.diff(to) > 0)), rare,
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "ids", "n_tokens", "n_common", "log_common", "rare"])

    schema = f"doc_id {doc_id_type(docs, id_col)}, held_out boolean, ids binary, n_tokens long, n_common long, log_common double, rare array<binary>"
    rows = id_text(docs, id_col, text_col, held_out(id_col).alias("held_out")).mapInArrow(encode, schema)
    return stored(rows.withColumn("row", F.monotonically_increasing_id()))


def _ids(batch: pa.RecordBatch, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in batch.column("ids").to_pylist()]


def _tallied(rows: DataFrame, size: int, codes) -> np.ndarray:
    """How often each number below `size` is among codes(batch); tasks hand on a row a number."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size, np.int64)
        for batch in batches:
            for part in chunks(batch, "ids"):
                n += np.bincount(codes(part), minlength=size)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["code", "n"])

    found = rows.select("ids").mapInArrow(tally, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size)
    out[found.column("code").to_numpy()] = found.column("n").to_numpy()
    return out


def _ended(ids: list[np.ndarray], end_id: int) -> np.ndarray:
    """All ids, each text's behind an end token, and an end token."""
    return np.concatenate([part for x in ids for part in ((end_id,), x)] + [(end_id,)]).astype(np.int64)


def _pairs(cls: np.ndarray, ids: list[np.ndarray], end_id: int) -> np.ndarray:
    row = cls[_ended(ids, end_id)]
    return row[:-1] * attention.CLASSES + row[1:]


_WEIGHTS = np.random.default_rng(5).integers(1, 1 << 62, attention.WINDOW + 1, dtype=np.uint64) | np.uint64(1)


def windows_of(rows: DataFrame, model: attention.Model, kind: str, end_id: int) -> DataFrame:
    """window (classes), key (its hash), of all windows, equal ones once. Stored."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "ids"):
                found = np.concatenate([attention.training_windows(model.cls, x, end_id) for x in _ids(part, kind)])
                key = ((found.astype(np.uint64) + np.uint64(1)) * _WEIGHTS).sum(1, dtype=np.uint64)
                key ^= key >> np.uint64(31)
                key *= np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
                raw = [w.tobytes() for w in found]
                yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary()), pa.array(key.view(np.int64))], ["window", "key"])

    return stored(rows.select("ids").mapInArrow(cut, "window binary, key long").distinct())


def _mean(weights: DataFrame, fan_in: int = 32) -> bytes:
    """The mean of weights (number, n, weights), of `fan_in` at a time."""

    def mean(part: pa.Table) -> pa.Table:
        n = part.column("n").to_numpy().astype(float)
        order = np.argsort(part.column("number").to_numpy())
        all_of = np.stack([np.frombuffer(x, "<f4") for x in part.column("weights").to_pylist()])
        one = (all_of[order].astype(float) * (n[order] / n.sum())[:, None]).sum(0).astype("<f4").tobytes()
        return pa.table({"number": pa.array([int(part.column("group")[0].as_py())], pa.int64()), "n": pa.array([int(n.sum())], pa.int64()), "weights": pa.array([one], pa.binary())})

    while weights.count() > 1:
        weights = stored(weights.withColumn("group", F.floor(F.col("number") / fan_in)).groupBy("group").applyInArrow(mean, "number long, n long, weights binary"))
    return bytes(weights.first().weights)


def learn(rows: DataFrame, vocabulary: int, kind: str, end_id: int = 0, rounds: int = 2, replica: int = 32_768, rate: float = 0.01) -> attention.Model:
    """The model of training rows (ids)."""
    counts = _tallied(rows, vocabulary, lambda part: _ended(_ids(part, kind), end_id)[1:])  # a text's start is no token, its end is one
    cls = attention.layout(counts)
    bigrams = _tallied(rows, attention.CLASSES**2, lambda part: _pairs(cls, _ids(part, kind), end_id)).reshape(attention.CLASSES, attention.CLASSES)
    weights, new = attention.first_weights(bigrams)
    cls = new[cls]
    model = attention.Model(cls, attention.shares(counts, cls), weights)
    windows = windows_of(rows, model, kind, end_id)
    n = windows.count()
    replicas = max(1, math.ceil(n / rounds / replica))
    for k in range(rounds if n else 0):
        start, now = model.weights, rate / 3**k

        def train(part: pa.Table) -> pa.Table:
            part = part.take(pc.sort_indices(part, sort_keys=[("key", "ascending"), ("window", "ascending")]))
            found = np.stack([np.frombuffer(x, "<u2") for x in part.column("window").to_pylist()])
            out = attention.packed(attention.train(start, found, now, min(128, max(32, len(found) // 256))))
            return pa.table({"number": pa.array([part.column("number")[0].as_py()], pa.int64()), "n": pa.array([len(found)], pa.int64()), "weights": pa.array([out], pa.binary())})

        own = windows.filter(F.pmod("key", F.lit(rounds)) == k).withColumn("number", F.pmod(F.floor(F.col("key") / rounds), F.lit(replicas)))
        trained = stored(own.groupBy("number").applyInArrow(train, "number long, n long, weights binary"))
        if trained.take(1):
            model.weights = attention.unpacked(_mean(trained), model.weights)
    drop_stored(windows)
    return model


def score_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, common: int = 1 << 21, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """doc_id, held_out, n_tokens (words and the end), n_known (of them in training documents), train_tokens, base_score (log10, by word counts), score
    (log10, by the model), n_subwords (with the end)."""
    kind, size = ("<u2" if vocabulary_size(tokenizer) <= 1 << 16 else "<u4"), vocabulary_size(tokenizer)
    learned = docs.filter(~held_out(id_col))
    words = word_counts(learned, id_col, text_col)
    n_docs = learned.select(id_col).count()
    n, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n, distinct = n + n_docs, distinct + (n_docs > 0)
    often = words.filter(F.col("c") * common >= n).select(F.xxhash64("word").alias("h"), F.log10(F.col("c") + 0.5).alias("log_c")).orderBy("h").toArrow()
    rows = encoded(docs, tokenizer, (often.column("h").to_numpy(), often.column("log_c").to_numpy()), id_col, text_col)
    model = learn(rows.filter("NOT held_out"), size, kind, end_id, **how)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = ["doc_id", "held_out", "row", "n_tokens", "n_common", "log_common"]
        for batch in batches:
            for part in chunks(batch, "ids"):
                ids = _ids(part, kind)
                logs = attention.score_texts(model, ids, end_id) / math.log(10)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(logs), pa.array([len(x) + 1 for x in ids], pa.int64())], [*kept, "score", "n_subwords"])

    schema = f"doc_id {doc_id_type(docs, id_col)}, held_out boolean, row long, n_tokens long, n_common long, log_common double, score double, n_subwords long"
    scored = rows.select("doc_id", "held_out", "row", "n_tokens", "n_common", "log_common", "ids").mapInArrow(score, schema)
    rare = rows.select("row", F.explode("rare").alias("word")).join(words.filter(F.col("c") * common < n), "word", "left")
    rare = rare.groupBy(F.col("row").alias("_row")).agg(F.count("c").alias("n_rare"), F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("log_rare"))
    scored = scored.join(rare, F.col("row") == F.col("_row"), "left")
    logs = F.col("log_common") + F.coalesce("log_rare", F.lit(0.0)) + F.lit(math.log10(n_docs + 0.5)) - F.col("n_tokens") * F.lit(math.log10(n + 0.5 * (distinct + 1)))
    known = F.col("n_common") + F.coalesce("n_rare", F.lit(0)) + F.lit(int(n_docs > 0))
    return scored.select("doc_id", "held_out", "n_tokens", known.cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), logs.alias("base_score"), "score", "n_subwords")
