"""Periodic runs of words within documents.

A run is a stretch of words with smallest period q (words q apart are the same), of at least `least` words and `repeats` periods, that no
neighbouring word extends. All k-grams that start in such a run occur again in it, q words on or back, where k is what two shifted copies
of the shortest run still share (5 words for 6 words and 4 periods). So words outside the k-grams that a document repeats cannot join a
run: k-grams are compared by hash (equal grams have equal hashes; a collision only leaves a segment more), and what is left are maximal
stretches of repeated k-grams, in which every run lies whole.

Only there works the divide and conquer of Main and Lorentz, on all segments of a batch at once, level by level: a run crosses the middle
of some node that holds it, with two of its periods (1.5, if `repeats` is 3) on one side. For each middle and period, two comparisons of words refuse nearly all;
the others are extended to both sides by names of the stretches of 1, 2, 4, ... words (equal names are equal words, not hashes), so runs
are exact.

Words are what stands between spaces and the characters 9 to 13. Null and empty texts: no words, no runs, empty text. Ties and repeated rows:
each row is its own document. Null ids stay. An empty table gives no rows. Extra columns are ignored. Very long texts are split into words in one
task, which takes some 100 bytes a word, and 8 more for each doubling of the longest segment for words of segments; texts before and behind are
handled on their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import chunks, doc_id_type, id_text

LEAST, REPEATS = 6, 4
RUN = "struct<start: long, length: long, period: long>"
_ARROW_RUN = [("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]


def gram_width(least: int = LEAST, repeats: int = REPEATS) -> int:
    """The largest k for which each k-gram of a run occurs twice in it: runs of period q have max(least, repeats * q) words at least, and the
    k-grams of their first and last length - q words must cover all."""
    return max(1, min(max(least, repeats * q) - 2 * q + 1 for q in range(1, least + 1)))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def segments(words: np.ndarray, bounds: np.ndarray, k: int, least: int) -> np.ndarray:
    """(begin, end) of the stretches of k-grams that their document repeats, of `least` words or more. words: numbers, by document from bounds[d]
    to bounds[d + 1]."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty((0, 2), np.int64)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    hashed, gram = _mixed(words), _mixed(doc[:n])
    for j in range(k):
        gram = gram * np.uint64(0x94D049BB133111EB) + hashed[j : j + n]
    whole = doc[:n] == doc[k - 1 :]
    order = np.sort(gram[whole])
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return np.empty((0, 2), np.int64)
    at = np.flatnonzero(whole & (twice[np.minimum(np.searchsorted(twice, gram), len(twice) - 1)] == gram))
    apart = (np.diff(at) > 1) | (np.diff(doc[at]) > 0)
    begin, end = at[np.append(True, apart)], at[np.append(apart, True)] + k
    return np.stack([begin, end], 1)[end - begin >= least]


class Names:
    """Stretches of 1, 2, 4, ... words by number; equal numbers are equal words."""

    def __init__(self, words: np.ndarray, longest: int):
        self.by_level = [np.unique(words, return_inverse=True)[1].astype(np.int32)]
        while 2 << (len(self.by_level) - 1) <= longest:
            half, last = 1 << (len(self.by_level) - 1), self.by_level[-1]
            pair = last[:-half].astype(np.int64) * (len(words) + 1) + last[half:]
            self.by_level.append(np.unique(pair, return_inverse=True)[1].astype(np.int32))

    def forward(self, a: np.ndarray, b: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How many words from a (before b) on are those from b on, before `end`."""
        length = np.zeros(len(a), np.int64)
        for level in range(len(self.by_level) - 1, -1, -1):
            fits = np.flatnonzero(b + length + (1 << level) <= end)
            same = fits[self.by_level[level][(a + length)[fits]] == self.by_level[level][(b + length)[fits]]]
            length[same] += 1 << level
        return length

    def backward(self, a: np.ndarray, b: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """How many words up to a (before b) are those up to b, from `begin` on."""
        length = np.zeros(len(a), np.int64)
        for level in range(len(self.by_level) - 1, -1, -1):
            step = 1 << level
            fits = np.flatnonzero(a - length - step + 1 >= begin)
            same = fits[self.by_level[level][(a - length - step + 1)[fits]] == self.by_level[level][(b - length - step + 1)[fits]]]
            length[same] += step
        return length


def runs_of_segments(words: np.ndarray, begin: np.ndarray, end: np.ndarray, least: int = LEAST, repeats: int = REPEATS) -> np.ndarray:
    """(start, end, period) of the runs in the segments, in order. Segments stand one behind the other in words."""
    if not len(begin):
        return np.empty((0, 3), np.int64)
    names, found = Names(words, int((end - begin).max())), []
    segment, low, high = np.arange(len(begin)), begin, end
    while len(segment):
        middle = (low + high) // 2
        periods = (high - low) // repeats
        node = np.repeat(np.arange(len(segment)), periods)
        q = np.arange(len(node)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
        m, first, last = middle[node], begin[segment[node]], end[segment[node]]
        right = (m + q < last) & (words[np.minimum(m + q, len(words) - 1)] == words[m]) & (words[m + q - 1] == words[m - 1])
        left = (m - 1 - q >= first) & (words[np.maximum(m - 1 - q, 0)] == words[m - 1]) & (words[m - q] == words[m])
        for side, shift in ((right, 0), (left, 1)):
            p, m2 = q[side], m[side]
            a = m2 - p * shift  # the stretches that are compared begin at a and a + p
            start = a - names.backward(a - 1, a - 1 + p, first[side])
            stop = a + p + names.forward(a, a + p, last[side])
            long = stop - start >= np.maximum(least, repeats * p)
            found.append(np.stack([start, stop, p], 1)[long])
        low, high = np.concatenate([low, middle]), np.concatenate([middle, high])
        segment = np.concatenate([segment, segment])
        wide = high - low >= max(least, repeats)
        segment, low, high = segment[wide], low[wide], high[wide]
    found = np.concatenate(found)
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    fresh = np.append(True, (np.diff(found[:, :2], axis=0) != 0).any(1)) if len(found) else np.empty(0, bool)  # the smallest period of equal stretches
    return found[fresh]


def find_runs(words: np.ndarray, bounds: np.ndarray, least: int = LEAST, repeats: int = REPEATS) -> np.ndarray:
    """(start, end, period) of all runs of all documents, places among all words, by start and period."""
    own = segments(words, bounds, gram_width(least, repeats), least)
    size = own[:, 1] - own[:, 0]
    to = np.cumsum(size)
    shift = own[:, 0] - (to - size)
    place = np.arange(int(size.sum())) + np.repeat(shift, size)
    runs = runs_of_segments(words[place], to - size, to, least, repeats)
    runs[:, :2] += shift[np.searchsorted(to, runs[:, 0], "right")][:, None]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _handled(texts: list[bytes | None], least: int, repeats: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """n_words, runs, collapsed of each text."""
    split = [(t or b"").split() for t in texts]
    counts = np.array([len(s) for s in split], np.int64)
    bounds = np.append(0, np.cumsum(counts))
    number: dict[bytes, int] = {}
    words = np.empty(bounds[-1], np.int64)
    for s, a in zip(split, bounds.tolist()):
        words[a : a + len(s)] = np.fromiter(map(number.setdefault, s, range(a, a + len(s))), np.int64, len(s))
    del number
    runs = find_runs(words, bounds, least, repeats)
    doc = np.searchsorted(bounds, runs[:, 0], "right") - 1
    deep = np.zeros(len(words) + 1, np.int64)
    np.add.at(deep, runs[:, 0] + runs[:, 2], 1)
    np.add.at(deep, runs[:, 1], -1)
    gone, dropping = np.cumsum(deep) > 0, set(doc.tolist())
    kept = []
    for d, s in enumerate(split):
        if d in dropping:
            s = [s[i] for i in np.flatnonzero(~gone[bounds[d] : bounds[d + 1]]).tolist()]
        kept.append(b" ".join(s))
    values = (runs[:, 0] - bounds[doc], runs[:, 1] - runs[:, 0], runs[:, 2])
    spans = pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in values], [k for k, _ in _ARROW_RUN])
    offsets = np.append(0, np.cumsum(np.bincount(doc, minlength=len(texts)))).astype(np.int32)
    return pa.array(counts), pa.ListArray.from_arrays(pa.array(offsets), spans), pa.array(kept, pa.binary())


def periodic_runs(docs: DataFrame, least: int = LEAST, repeats: int = REPEATS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length and period in words, by start and period), collapsed: the words, but for those that some run has
    behind its first period, joined by single spaces. One row per row; nothing is shuffled."""
    if least < 2 or repeats < 3:
        raise ValueError("a run has two words and three periods at least: one side of the middle then has more than one period")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                n, runs, kept = _handled(part.column("text").to_pylist(), least, repeats)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), n, runs, kept], ["doc_id", "n_words", "runs", "collapsed"])

    out = id_text(docs, id_col, text_col).mapInArrow(find, f"doc_id {doc_id_type(docs, id_col)}, n_words long, runs array<{RUN}>, collapsed binary")
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))
