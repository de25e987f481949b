"""Removal of repeated byte strings by prefix-free parsing.

A byte goes if a string of K bytes that covers it also starts earlier in the corpus: in a document with a smaller id,
or earlier in the same one. Strings lie within documents and are judged on the input.

Parse. The trigger of a K-byte string is the first smallest rolling hash among its windows, so equal strings have equal
triggers. Neighbouring starts with one trigger form a phrase, whose text runs to the end of its last string. Phrases
with the same bytes around the trigger form a class: an earlier occurrence of a string can only lie in a phrase of its own class.
Dictionary. Occurrences are sorted by class, phrase and place in the corpus. Of a phrase that occurs again, all
but the first occurrence go whole. A class with one phrase needs no more.
Suffix order. The first occurrences of the phrases of other classes come together, class by class; the truncated
suffix array of their texts (prefix doubling up to K bytes) ranks every start, and with the order of the parse tells the first of equal strings
from the later ones. Classes of more than `most` phrases are not brought together: their strings are compared by 128-bit
hashes in a pre-aggregated minimum.

No key gathers all occurrences of a common passage. A task sends an occurrence of a phrase once for each chunk of text at
most, and not at all if it remembers an earlier one. Classes with several phrases in a sample of `sample` documents
(those around the ends of common passages) are dealt out by phrase, not by class, and count as large; the strings of
large classes are merged by chunk before they are sent. The sample decides where rows go, never what is found.

Texts shorter than K bytes lose nothing. Null text: empty. Documents are in order of their ids, null before all others, and of
a hash of their texts where ids repeat; rows of one id and one text are one document, and lose the same. Very long texts
are parsed in pieces of PIECE bytes that share K - 1 bytes. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import bound_batches, chunks, stored

K, GRAM, SPLIT = 100, 8, 42
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))
_NO_ID = -(1 << 63)
PROBE, SPREAD, GONE, ASKED, SPELT, COLD, HOT = range(7)
#: Bytes of a long text that are parsed at once, and repeated phrases that a task remembers.
PIECE, REMEMBERED = 2 << 20, 100_000
#: Phrases in the sample that make a class large; strings that a task merges at once; phrases that a task of the last sort takes.
SEVERAL, STRINGS, TASK_PHRASES = 8, 100_000, 20_000
#: Where a document stands, and a place in it.
DOC = ["doc", "r"]
PLACE = [*DOC, "at"]


def parse(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Phrases of documents that stand one after another in data (ends: where each ends): first and last start, begin and
    end of the bytes that name the class. Phrases are cut where the trigger changes sides, so that a class is named
    by the bytes that all its strings hold."""
    n = len(data)
    room = np.ones(max(0, n - K + 1), bool)  # starts whose string ends within the document
    for e in ends[:-1].tolist():
        room[max(0, e - K + 1) : e] = False
    start = np.flatnonzero(room)
    if not len(start):
        return (start,) * 4
    gram = np.lib.stride_tricks.as_strided(data, (n - GRAM + 1, GRAM), (1, 1))
    h = np.ascontiguousarray(gram).view("<u8")[:, 0] * _MIX[0]
    h ^= h >> np.uint64(29)
    h *= _MIX[1]
    low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    window, width = K - GRAM + 1, 1
    while width * 2 <= window:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < window:
        low = np.minimum(low[: len(low) - (window - width)], low[window - width :])
    trigger = (low[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    left = trigger - start > SPLIT
    new = np.flatnonzero((np.diff(trigger) != 0) | np.diff(left) | (np.diff(start) != 1)) + 1
    begin = np.concatenate([[0], new])
    t, s = trigger[begin], left[begin]
    return start[begin], start[np.concatenate([new - 1, [len(start) - 1]])], np.where(s, t - SPLIT - 1, t), np.where(s, t + GRAM, t + K - SPLIT)


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


_ROWS = "kind int, c long, w long, doc long, r long, at long, n long"
_TEXTS = f"{_ROWS}, text binary"


def _rows(kind: int, c, w, doc, r, at, n) -> pa.RecordBatch:
    """A row for each doc; c and w may be 0 for all."""
    c, w = (np.zeros(len(doc), np.int64) if x is None else x for x in (c, w))
    columns = [pa.array(np.full(len(doc), kind, np.int32)), *(pa.array(x, pa.int64()) for x in (c, w, doc, r, at, n))]
    return pa.RecordBatch.from_arrays(columns, ["kind", "c", "w", *PLACE, "n"])


def _marks(doc: np.ndarray, r: np.ndarray, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """GONE rows; what touches is joined."""
    order = np.lexsort((at, r, doc))
    doc, r, at, end = doc[order], r[order], at[order], (at + n)[order]
    other = np.concatenate([[False], (np.diff(doc) != 0) | (np.diff(r) != 0)]) if len(doc) else np.zeros(0, bool)
    reach = np.maximum.accumulate(end + (np.cumsum(other) << 40)) & ((1 << 40) - 1)
    new = np.ones(len(doc), bool)
    new[1:] = other[1:] | (at[1:] > reach[:-1])
    begin = np.flatnonzero(new)
    stop = reach[np.append(begin[1:] - 1, len(doc) - 1)]
    return _rows(GONE, None, None, doc[new], r[new], at[new], stop - at[new])


def _leads(c, w, doc, r, at) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by key and place, whether a row there begins a key, and where its key begins."""
    order = np.lexsort((at, r, doc, w, c))
    new = np.ones(len(c), bool)
    new[1:] = (np.diff(c[order]) != 0) | (np.diff(w[order]) != 0)
    return order, new, np.flatnonzero(new)[np.cumsum(new) - 1]


class Remembered:
    """Places of phrases that a task has met more than once: what stands later than one of them need not be sent."""

    def __init__(self, most: int = REMEMBERED):
        self.most, self.place, self.keys = most, {}, np.empty(0, np.int64)

    def later(self, c, w, doc, r, at, repeats) -> np.ndarray:
        """Whether each phrase (distinct ones) is later than its remembered place; remembers those with repeats."""
        out = np.zeros(len(c), bool)
        for i in np.flatnonzero(np.isin(w, self.keys)).tolist():
            key, place = (int(c[i]), int(w[i])), (int(doc[i]), int(r[i]), int(at[i]))
            known = self.place.get(key)
            if known is not None:
                out[i] = place > known
                self.place[key] = min(place, known)
        fresh = np.flatnonzero(repeats & ~out).tolist()
        if fresh:
            if len(self.place) + len(fresh) > self.most:
                self.place = {}
            for i in fresh[: self.most]:
                self.place.setdefault((int(c[i]), int(w[i])), (int(doc[i]), int(r[i]), int(at[i])))
            self.keys = np.fromiter((k[1] for k in self.place), np.int64, len(self.place))
        return out


def pieces(texts: list[bytes], limit: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Rows, offsets and bytes of the texts in blocks of about `limit` bytes; each string starts in one piece."""
    rows, offsets, parts, size = [], [], [], 0
    for row, text in enumerate(texts):
        for a in range(0, max(1, len(text) - K + 1), limit):
            part = text[a : a + limit + K - 1]
            if size and size + len(part) > limit:
                yield rows, offsets, parts
                rows, offsets, parts, size = [], [], [], 0
            rows.append(row)
            offsets.append(a)
            parts.append(part)
            size += len(part)
    if parts:
        yield rows, offsets, parts


def phrases(batches: Iterator[pa.RecordBatch], large: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """A PROBE for each distinct phrase of a chunk, or SPREAD if its class is one of the large ones; GONE for its other occurrences."""
    import xxhash

    digest, memory = xxhash.xxh3_64_intdigest, Remembered()
    for batch in batches:
        for part in chunks(batch, limit=PIECE):
            docs, hashes = part.column("doc").to_numpy(), part.column("r").to_numpy()
            for row, offset, texts in pieces([b or b"" for b in part.column("text").to_pylist()], PIECE):
                data = b"".join(texts)
                ends = np.cumsum([len(t) for t in texts])
                first, last, a, b = parse(np.frombuffer(data, np.uint8), ends)
                if not len(first):
                    continue
                c = _signed([digest(data[x:y]) for x, y in zip(a.tolist(), b.tolist())])
                w = _signed([digest(data[x:y]) for x, y in zip(first.tolist(), (last + K).tolist())])
                of = np.searchsorted(ends, first, "right")
                own = np.array(row)[of]
                at = first - (ends[of] - np.diff(ends, prepend=0)[of]) + np.array(offset)[of]
                doc, r, n = docs[own], hashes[own], last - first + 1
                order, new, lead = _leads(c, w, doc, r, at)
                c, w, doc, r, at, n = (x[order] for x in (c, w, doc, r, at, n))
                repeats = np.diff(np.append(np.flatnonzero(new), len(c))) > 1
                late = np.zeros(len(c), bool)
                late[new] = memory.later(c[new], w[new], doc[new], r[new], at[new], repeats)
                spread = np.zeros(len(c), bool) if large is None else np.isin(c, large)
                for kind, sent in ((PROBE, new & ~late & ~spread), (SPREAD, new & ~late & spread)):
                    if sent.any():
                        yield _rows(kind, *(x[sent] for x in (c, w, doc, r, at, n)))
                gone = late | (doc != doc[lead]) | (r != r[lead]) | (at != at[lead])
                if gone.any():
                    yield _marks(doc[gone], r[gone], at[gone], n[gone] + K - 1)


def large_classes(rows: DataFrame, sample: int) -> np.ndarray:
    """Classes with SEVERAL distinct phrases or more in a sample of about `sample` documents: no more than its phrases / SEVERAL."""
    n = rows.count()
    picked = rows if n <= sample else rows.filter(F.pmod(F.xxhash64(F.lit(5), *DOC), F.lit(1 << 30)) < int(sample / n * (1 << 30)))
    found = picked.select(*DOC, "text").mapInArrow(phrases, _ROWS).filter(F.col("kind") == PROBE).select("c", "w").distinct()
    return np.sort(found.groupBy("c").agg(F.count("*").alias("n")).filter(F.col("n") >= SEVERAL).select("c").toArrow().column("c").to_numpy())


def dictionary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From PROBE and SPREAD rows by (kind, c, w, doc, r, at): GONE for later occurrences of a phrase; SPELT for the first one of a
    SPREAD phrase, and ASKED for the first ones of classes with several PROBE phrases. Holds a row between batches. GONE rows
    pass."""
    last = None  # the first of the phrase of the row before, and whether it still has to be asked
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        if (kind == GONE).any():
            yield batch.filter(pa.array(kind == GONE))
        rows = [batch.column(x).to_numpy()[kind != GONE] for x in ("kind", "c", "w", *PLACE, "n")]
        if not len(rows[0]):
            continue
        if last is not None:
            rows = [np.concatenate([[x], y]) for x, y in zip(last[0], rows)]
        kind, c, w, doc, r, at, n = rows
        new_class = np.ones(len(c), bool)
        new_class[1:] = (np.diff(c) != 0) | (np.diff(kind) != 0)
        new = new_class.copy()
        new[1:] |= np.diff(w) != 0
        begin = np.flatnonzero(new)
        first = begin[np.cumsum(new) - 1]
        gone = (doc != doc[first]) | (r != r[first]) | (at != at[first])
        if gone.any():
            yield _marks(doc[gone], r[gone], at[gone], n[gone] + K - 1)
        follows = ~new_class[begin]  # another phrase of the class stands before
        several = follows | np.append(follows[1:], False)
        open_ = np.ones(len(begin), bool)
        open_[0] = last is None or last[1]
        spelt = open_ & (kind[begin] == SPREAD)
        asked = open_ & (kind[begin] == PROBE) & several
        for name, chosen in ((SPELT, spelt), (ASKED, asked)):
            if chosen.any():
                at_ = begin[chosen]
                yield _rows(name, c[at_], None, doc[at_], r[at_], at[at_], n[at_])
        end = begin[-1]
        last = [x[end] for x in rows], bool(open_[-1] and not spelt[-1] and not asked[-1])


def suffix_ranks(data: np.ndarray, depth: int = K) -> np.ndarray:
    """Order of the suffixes by their first `depth` bytes (equal ones have equal ranks), by prefix doubling; the data
    must go on for `depth` bytes after the last start of interest, what stands beyond counts as zeros."""
    padded = np.concatenate([data, np.zeros(2 * depth, np.uint8)])
    word = np.ascontiguousarray(np.lib.stride_tricks.as_strided(padded, (len(data) + depth, 8), (1, 1))).view(">u8")[:, 0].astype(np.uint64)
    rank = np.unique(word, return_inverse=True)[1].astype(np.int64)
    known = 8
    while known < depth:
        step = min(known, depth - known)
        pair = rank[:-step] * (int(rank.max()) + 1) + rank[step:]
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        known += step
    return rank[: len(data)]


def later_strings(c, doc, r, at, n, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, r, start) of the strings that also start earlier in their class: those that are not the first of their suffix rank in
    the order of the parse. Phrases come by c, doc, r, at."""
    rank = suffix_ranks(np.frombuffer(b"".join(texts), np.uint8))
    base = np.cumsum([0, *map(len, texts)])[:-1]
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    group = np.repeat(np.cumsum(np.concatenate([[0], c[1:] != c[:-1]])), n)
    rank = rank[np.repeat(base, n) + within]
    doc, r, start = np.repeat(doc, n), np.repeat(r, n), np.repeat(at, n) + within
    key = group * (int(rank.max(initial=0)) + 1) + rank
    order = np.argsort(key, kind="stable")
    new = np.ones(len(key), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    lead = np.empty(len(key), np.int64)
    lead[order] = order[new][np.cumsum(new) - 1]
    gone = (doc != doc[lead]) | (r != r[lead]) | (start != start[lead])
    return doc[gone], r[gone], start[gone]


def _classes(batches: Iterator[pa.RecordBatch], limit: int = 1 << 21) -> Iterator[tuple]:
    """Phrases of whole classes, of about `limit` bytes at once."""
    held: list[pa.RecordBatch] = []
    size = 0

    def columns(batch):
        return (*(batch.column(x).to_numpy() for x in ("c", *PLACE, "n")), batch.column("text").to_pylist())

    for batch in batches:
        if not batch.num_rows:
            continue
        c = batch.column("c").to_numpy()
        if size >= limit:
            same = int(np.searchsorted(c, held[-1].column("c")[-1].as_py(), "right")) if c[0] == held[-1].column("c")[-1].as_py() else 0
            held.append(batch.slice(0, same))
            if same < batch.num_rows:
                yield columns(pa.Table.from_batches(held).combine_chunks())
                held, size, batch = [], 0, batch.slice(same)
            else:
                batch = batch.slice(same)
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
    if held:
        yield columns(pa.Table.from_batches(held).combine_chunks())


def suffix_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for c, doc, r, at, n, texts in _classes(batches):
        doc, r, start = later_strings(c, doc, r, at, n, texts)
        if len(doc):
            yield _marks(doc, r, start, np.full(len(doc), K))


def _with_text(rows: pa.RecordBatch, texts: list | None = None) -> pa.RecordBatch:
    return rows.append_column("text", pa.array([None] * rows.num_rows if texts is None else texts, pa.binary()))


def _spelt(hot: list[tuple]) -> Iterator[pa.RecordBatch]:
    """HOT rows of strings (h, doc, r, at), equal ones merged, and GONE for the others."""
    h, *place = zip(*hot)
    c, w = _signed([x >> 64 for x in h]), _signed([x & (1 << 64) - 1 for x in h])
    doc, r, at = (np.array(x, np.int64) for x in place)
    order, new, lead = _leads(c, w, doc, r, at)
    c, w, doc, r, at = (x[order] for x in (c, w, doc, r, at))
    yield _with_text(_rows(HOT, *(x[new] for x in (c, w, doc, r, at)), np.full(new.sum(), K)))
    gone = (doc != doc[lead]) | (r != r[lead]) | (at != at[lead])
    if gone.any():
        yield _with_text(_marks(doc[gone], r[gone], at[gone], np.full(gone.sum(), K)))


def ask_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """COLD rows with the texts of the phrases that `asked` names; of those in hot classes, a HOT row with its hashes for each
    string of STRINGS, and GONE for its other occurrences."""
    import xxhash

    digest, hot = xxhash.xxh3_128_intdigest, []
    for batch in batches:
        for part in chunks(batch, limit=PIECE):
            cold, texts = [], []
            for text, doc, r, asked in zip(*(part.column(x).to_pylist() for x in ("text", *DOC, "asked"))):
                for p in asked:
                    a, n = p["at"], p["n"]
                    if p["hot"]:
                        hot += [(digest(text[i : i + K]), doc, r, i) for i in range(a, a + n)]
                        if len(hot) >= STRINGS:
                            yield from _spelt(hot)
                            hot = []
                    else:
                        cold.append((p["c"], 0, doc, r, a, n))
                        texts.append(text[a : a + n + K - 1])
            if cold:
                yield _with_text(_rows(COLD, *(np.array(x, np.int64) for x in zip(*cold))), texts)
    if hot:
        yield from _spelt(hot)


def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text without its marked bytes, and the spans that went."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        for part in chunks(batch):
            kept, spans, sizes = [], [], []
            for text, marks in zip(part.column("text").to_pylist(), part.column("marks").to_pylist()):
                text = text or b""
                gone: list[list[int]] = []
                for a, b in sorted((m["at"], m["at"] + m["n"]) for m in marks or ()):
                    if gone and a <= gone[-1][1]:
                        gone[-1][1] = max(b, gone[-1][1])
                    else:
                        gone.append([a, b])
                edges = [0, *itertools.chain.from_iterable(gone), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
                spans.append([{"start": a, "end": b} for a, b in gone])
                sizes.append(len(text))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])


def remove_repeats(docs: DataFrame, most: int = 1000, sample: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (maximal runs of bytes that went) and kept (the bytes that are left) of every row."""
    bound_batches(docs.sparkSession)
    text = F.col(text_col).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("doc"), F.xxhash64(text).alias("r"), text.alias("text"))
    large = large_classes(rows, sample)
    found = rows.select(*DOC, "text").mapInArrow(lambda batches: phrases(batches, large), _ROWS)
    # GONE rows have no phrase; they are spread by their place.
    key = F.when(F.col("kind") == PROBE, F.col("c")).when(F.col("kind") == SPREAD, F.xxhash64("c", "w")).otherwise(F.xxhash64(*PLACE))
    found = stored(found.repartition(key).sortWithinPartitions("kind", "c", "w", *PLACE).mapInArrow(dictionary, _ROWS))

    asked = found.filter(F.col("kind").isin(ASKED, SPELT))
    members = found.filter(F.col("kind") == ASKED).groupBy("c").agg(F.count("*").alias("members")).filter(F.col("members") > most)
    asked = asked.join(stored(members.select("c", F.lit(True).alias("many"))), "c", "left").withColumn("hot", F.col("many").isNotNull() | (F.col("kind") == SPELT))
    asked = asked.groupBy(*DOC).agg(F.collect_list(F.struct("c", "at", "n", "hot")).alias("asked"))
    texts = stored(rows.select(*DOC, "text").join(asked, DOC).mapInArrow(ask_texts, _TEXTS))
    cold = texts.filter(F.col("kind") == COLD).select("c", *PLACE, "n", "text")
    cold = cold.repartition(max(8, cold.count() // TASK_PHRASES), "c").sortWithinPartitions("c", *PLACE).mapInArrow(suffix_order, _ROWS)
    strings = texts.filter(F.col("kind") == HOT).select("c", "w", *PLACE)
    earliest = strings.groupBy("c", "w").agg(F.min(F.struct(*PLACE)).alias("first"))
    again = strings.join(earliest, ["c", "w"]).filter(F.col("first") < F.struct(*PLACE))

    marks = [df.filter(F.col("kind") == GONE).select(*PLACE, "n") for df in (found, texts, cold)] + [again.select(*PLACE, F.lit(K).cast("long").alias("n"))]
    marks = reduce(DataFrame.unionByName, marks).groupBy(*DOC).agg(F.collect_list(F.struct("at", "n")).alias("marks"))
    return rows.join(marks, DOC, "left").select("doc_id", "text", "marks").mapInArrow(cut_out, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
