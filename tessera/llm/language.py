"""Language identification as inference over mixtures of languages.

A document is a mixture of languages, each a distribution over n-grams (byte trigrams of the lower-cased text, with
all that is no letter as a space). Expectation-maximisation estimates the languages' proportions, until no likelihood of a batch rises
by more than TOLERANCE or for `rounds` rounds. The set of languages is chosen by penalised likelihood: every language alone, and
from all languages down to two, where the one with the smallest proportion goes each time; the set with the highest likelihood, less a
penalty for each language, is taken. The largest proportion names the language.

The n-gram likelihoods are learned from a bounded sample of labelled documents, `per_language` of each language on
average, chosen by a hash of the id; the n-grams are the `features` ones that tell languages apart best. The model's size
is languages * features and does not grow with the input; every document is predicted from its whole text.

Null texts and texts without letters: `und`, score 0. Texts with letters but no known n-gram: the most frequent
language, with its share as score. No labelled document: `und` for all. Null ids are never learned from. Ties go to the language
whose code comes first; repeated rows stay and are predicted alike. An empty table gives no rows. Very long texts are counted in
pieces of COUNTED_BYTES that share two bytes. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm._shared import bound_batches, chunks, give_back, id_text

UND = "und"
#: What a prediction rests on.
NOTHING, LETTERS, MIXTURE = "nothing", "letters", "mixture"
#: Trigrams overlap, so a count is worth a third of an independent one.
WORTH = 1 / 3
#: Bytes of text that are counted at once: what a text's counts take is many times its size.
COUNTED_BYTES = 1 << 19
#: Rises of a log-likelihood below this end the rounds; a set is given up if even this slack would not make it the best.
TOLERANCE, SLACK = 0.01, 1.0


@dataclass
class Model:
    languages: list[str]
    share: np.ndarray  # of the labelled documents
    codes: np.ndarray  # of the features, sorted
    log_p: np.ndarray  # features by languages

    def table(self) -> np.ndarray:
        """Feature number of each trigram code, from 1; 0: none."""
        if len(self.codes) >= 1 << 16:
            raise ValueError("a model has 65,535 n-grams at most")
        out = np.zeros(1 << 24, np.uint16)
        out[self.codes] = np.arange(1, len(self.codes) + 1)
        return out


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def _letters() -> np.ndarray:
    out = np.full(256, 32, np.uint8)
    out[97:123] = np.arange(97, 123)
    out[128:] = np.arange(128, 256)
    return out


def _codes(data: np.ndarray) -> np.ndarray:
    code = data[:-2].astype(np.uint32)
    code <<= 8
    code |= data[1:-1]
    code <<= 8
    code |= data[2:]
    return code


def trigram_codes(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The codes of all trigrams of the texts and the number of the text of each, in blocks of about COUNTED_BYTES; two spaces
    part the texts, and stand around them."""
    letters, held, size = _letters(), [], 0

    def block() -> tuple[np.ndarray, np.ndarray]:
        code = _codes(letters[np.frombuffer(b"  ".join([b"", *(raw for _, raw in held), b""]), np.uint8)])
        return code, np.repeat([k for k, _ in held], [len(raw) + 2 for _, raw in held])

    for k, text in enumerate(texts):
        raw = text.lower().encode("utf-8", "replace")
        if held and size + len(raw) > COUNTED_BYTES:
            yield block()
            held, size = [], 0
        if len(raw) <= COUNTED_BYTES:
            held.append((k, raw))
            size += len(raw) + 2
            continue
        data = np.frombuffer(b"  " + raw + b"  ", np.uint8)
        for at in range(0, len(data) - 2, COUNTED_BYTES):
            code = _codes(letters[data[at : at + COUNTED_BYTES + 2]])
            yield code, np.full(len(code), k)
    if held:
        yield block()


def _texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [b.decode("utf-8", "replace") if isinstance(b, bytes) else b or "" for b in batch.column(column).to_pylist()]


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", per_language: int = 2000, features: int = 8000) -> Model | None:
    """docs holds the rows that may be learned from; None if no row has both text and language."""
    bound_batches(docs.sparkSession)
    labelled = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")
    )
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not counts:
        return None
    languages = sorted(counts)
    number = {lang: k for k, lang in enumerate(languages)}
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    rate = F.element_at(F.create_map(*(F.lit(x) for lang in languages for x in (lang, min(1.0, per_language / counts[lang])))), F.col("lang"))
    sample = labelled.filter(draw < rate).select("lang", F.col("text").cast("binary").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, limit=COUNTED_BYTES):
                lang = np.array([number[x] for x in part.column("lang").to_pylist()])
                for code, of in trigram_codes(_texts(part)):
                    key, n = np.unique(lang[of].astype(np.int64) << 24 | code, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array((key >> 24).astype(np.int32)), pa.array((key & 0xFFFFFF).astype(np.int32)), pa.array(n.astype(np.int64))], ["k", "code", "n"])
        give_back()

    grams = sample.mapInArrow(count, "k int, code int, n long").filter(F.col("code") != 0x202020).groupBy("k", "code").agg(F.sum("n").alias("n"))
    by_code = grams.groupBy("code").agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("by"), F.sum("n").alias("n"))
    total = {r["k"]: r["n"] for r in grams.groupBy("k").agg(F.sum("n").alias("n")).collect()}
    p = [F.coalesce(F.try_element_at("by", F.lit(k)), F.lit(0)) / float(total.get(k, 1)) for k in range(len(languages))]
    mean = sum(p[1:], p[0]) / len(languages)
    tells = sum((F.when(x > 0, x * F.log(x / mean)).otherwise(0.0) for x in p), F.lit(0.0))
    # Of equal weight, the frequent ones: with a single language nothing tells apart.
    best = by_code.select("code", "by", "n", tells.alias("tells")).orderBy(F.desc("tells"), F.desc("n"), "code").limit(features).collect()
    best = sorted(best, key=lambda r: r["code"])
    n = np.array([[r["by"].get(k, 0) for k in range(len(languages))] for r in best], float).reshape(len(best), len(languages))
    prob = (n + 0.5) / (n.sum(0) + 0.5 * max(1, len(best)))
    share = np.array([counts[x] for x in languages], float)
    return Model(languages, share / share.sum(), np.array([r["code"] for r in best], np.int64), np.log(prob).astype(np.float32))


def _em(c, p, doc, starts, theta, rounds):
    """Proportions by document, and their log-likelihood."""
    like = np.full(len(starts), -np.inf)
    for k in range(rounds + 1):
        r = theta[doc] * p
        s = np.maximum(r.sum(1), np.float32(1e-30))
        before, like = like, np.add.reduceat(c * np.log(s), starts)
        if k == rounds or not (like - before > TOLERANCE).any():
            return theta, like
        r *= (c / s)[:, None]
        new = np.add.reduceat(r, starts, axis=0)
        theta = new / np.maximum(new.sum(1, keepdims=True), 1e-30)


def proportions(model: Model, doc: np.ndarray, feature: np.ndarray, n: np.ndarray, penalty: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents that occur in doc, their proportions); doc is sorted, n are the counts of its features."""
    docs, starts = np.unique(doc, return_index=True)
    n_lang = len(model.languages)
    c = (n * WORTH).astype(np.float32)
    log_p = model.log_p[feature]
    alone = np.add.reduceat(c[:, None] * log_p, starts, axis=0)
    best = alone.argmax(1)
    out = np.eye(n_lang, dtype=np.float32)[best]
    if n_lang == 1:
        return docs, out
    cost = penalty + 0.5 * np.log(np.maximum(np.add.reduceat(c, starts), 1.0))
    score = alone.max(1) - cost  # of the best set so far
    lengths = np.diff(np.append(starts, len(doc)))
    at = np.repeat(np.arange(len(docs)), lengths)
    p = np.exp(log_p)
    theta, like = _em(c, p, at, starts, np.full((len(docs), n_lang), 1 / n_lang, np.float32), rounds)
    # No set of two or more is likelier than all languages (but for what EM has not climbed yet), so the others are settled with one.
    open_ = like - 2 * cost + SLACK > score
    active = np.ones((len(docs), n_lang), bool)
    size = n_lang
    while True:
        better = open_ & (like - size * cost > score)
        out[better], score[better] = theta[better], (like - size * cost)[better]
        if size == 2 or not open_.any():
            return docs, out
        size -= 1
        least = np.where(active, theta, np.inf).argmin(1)
        active[np.arange(len(docs)), least] = False
        keep = open_[at]
        sub = np.flatnonzero(open_)
        sub_starts = np.concatenate([[0], np.cumsum(lengths[sub])[:-1]])
        begin = np.where(active, np.maximum(theta, 1e-3), 0)[sub].astype(np.float32)
        begin /= begin.sum(1, keepdims=True)
        t, like_sub = _em(c[keep], p[keep], np.repeat(np.arange(len(sub)), lengths[sub]), sub_starts, begin, rounds)
        theta[sub], like[sub] = t, like_sub


def has_letters(text: str) -> bool:
    return any(map(str.isalpha, text))


def identify_texts(model: Model, table: np.ndarray, texts: list[str], penalty: float, rounds: int, block: int = 128) -> tuple[list[str], list[float]]:
    return _identified(model, table, texts, penalty, rounds, block)[:2]


def _identified(model: Model, table: np.ndarray, texts: list[str], penalty: float, rounds: int, block: int = 128) -> tuple[list[str], list[float], list[str]]:
    n_feat, names = len(model.codes), model.languages
    default = int(model.share.argmax())
    basis = [LETTERS if has_letters(t) else NOTHING for t in texts]
    lang = [names[default] if b == LETTERS else UND for b in basis]
    score = [float(model.share[default]) if x != UND else 0.0 for x in lang]
    keys, counts = [], []
    for code, of in trigram_codes(texts):
        feature = table[code]
        hits = np.flatnonzero(feature)
        feature, doc = feature[hits].astype(np.int64) - 1, of[hits]
        for first in np.unique(doc // block).tolist():
            a, b = np.searchsorted(doc, [first * block, (first + 1) * block])
            n = np.bincount((doc[a:b] - first * block) * n_feat + feature[a:b])
            at = np.flatnonzero(n)
            keys.append(at + first * block * n_feat)
            counts.append(n[at])
    if keys:
        key, n = np.concatenate(keys), np.concatenate(counts)
        if (np.diff(key) <= 0).any():  # a long text's pieces come together
            key, own = np.unique(key, return_inverse=True)
            n = np.bincount(own, weights=n)
        docs, theta = proportions(model, key // n_feat, key % n_feat, n, penalty, rounds)
        best = theta.argmax(1)
        for d, k, s in zip(docs.tolist(), best.tolist(), theta[np.arange(len(docs)), best].tolist()):
            if lang[d] != UND:
                lang[d], score[d], basis[d] = names[k], min(1.0, max(0.0, s)), MIXTURE
    return lang, score, basis


def identify(docs: DataFrame, model: Model | None, penalty: float = 6.0, rounds: int = 20, text_col: str = "text", basis_col: str | None = None) -> DataFrame:
    """All columns of docs, with lang_pred and score (in place of columns of that name), and in basis_col, if given, what
    they rest on: NOTHING (no letters), LETTERS (but no model or no known n-gram) or MIXTURE."""
    bound_batches(docs.sparkSession)
    n_out = 3 if basis_col else 2
    kept = docs.drop("lang_pred", "score")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table() if model else None
        for batch in batches:
            for part in chunks(batch, text_col, COUNTED_BYTES):
                texts = _texts(part, text_col)
                if model:
                    lang, score, basis = _identified(model, table, texts, penalty, rounds)
                else:
                    lang, score, basis = [UND] * len(texts), [0.0] * len(texts), [LETTERS if has_letters(t) else NOTHING for t in texts]
                out = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(basis, pa.string())][:n_out]
                yield pa.RecordBatch.from_arrays([*part.columns, *out], [*part.schema.names, *["lang_pred", "score", basis_col][:n_out]])
                give_back()

    more = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField(basis_col or "", T.StringType())][:n_out]
    schema = T.StructType([*kept.schema.fields, *more])
    return kept.mapInArrow(predict, schema)


def held_out_predictions(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", **how) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the documents that are not held out."""
    model = train(docs.filter(fold_of(F.col(id_col)) != 2), lang_col, text_col, id_col)
    out = identify(id_text(docs, id_col, text_col), model, **how)
    return out.select("doc_id", F.coalesce(fold_of(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
