"""Token counts by the whole-token shortcut.

Most pre-tokens of a text are single tokens of the vocabulary. Which vocabulary strings encode alone as
one token is proved once per process, by encoding every one of them; pre-tokens among these need a dictionary lookup
only. The others go to the tokenizer's merges, once per distinct pre-token and chunk, and a bounded dictionary keeps
their results.

The shortcut holds for tokenizers whose only pre-tokenizer is the byte-level split without a prefix space and without
a normaliser. Of their texts, the stretches around characters outside BLOCKS (where the split's character classes may depend on the
Unicode version), up to the next place where any split cuts, are encoded by the library, and texts with strings of added tokens
whole; so are all texts for other tokenizers. Results are the library's in every case.

Nulls and empty texts: 0 tokens. Ties and repeated rows: equal texts have equal counts, all rows stay. Very long texts are split
where no pre-token can span; a pre-token of any length (a run of millions of blanks) is merged as one piece, without the split's
backtracking, and not remembered. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import chunks, doc_id_type, give_back, id_text

# Code blocks whose characters have had their classes for long (Latin, Greek, Cyrillic, punctuation, currencies, kana, Han,
# Hangul, full width, pictographs), and the split of byte-level vocabularies.
BLOCKS = (
    (0x0, 0x24F), (0x370, 0x3FF), (0x400, 0x52F), (0x2000, 0x205F), (0x20A0, 0x20BD), (0x3000, 0x303F), (0x3041, 0x30FF), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3),
    (0xFF01, 0xFF5E), (0x1F300, 0x1F5FF), (0x1F600, 0x1F64F),
)
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _class(belongs: Callable[[str], bool]) -> str:
    """The characters of BLOCKS that belong, as ranges of a regex class."""
    out = []
    for low, high in BLOCKS:
        for own, run in itertools.groupby(range(low, high + 1), lambda c: belongs(unicodedata.category(chr(c)))):
            run = list(run)
            if own:
                out.append(f"\\U{run[0]:08x}-\\U{run[-1]:08x}")
    return "".join(out)


_LETTERS, _NUMBERS = _class(lambda k: k[0] == "L"), _class(lambda k: k[0] == "N")
UNSAFE = re.compile(f"[^{_class(lambda k: k != 'Cn')}]")
SPLIT = re.compile(
    f" ?[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[{_NUMBERS}]+| ?[^{_SPACES}{_LETTERS}{_NUMBERS}]+"
    f"|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"
)
#: A pre-token can't span from a visible character to a space before another one.
_SEAM = re.compile("[!-~](?= [!-~])")
#: Distinct pre-tokens that a process remembers, and characters split at once.
REMEMBERED, SEGMENT = 300_000, 1 << 20
#: Vocabulary strings that are encoded at once: the library's encodings take far more room than the ids that are kept.
PROVED = 1024
#: Pre-tokens beyond this length are not remembered; runs of blanks beyond it would exhaust the stack of the ranked vocabulary's split.
LONG = 10_000
_BLANKS = re.compile(f"[{_SPACES}]{{{LONG}}}")


def segments(text: str) -> Iterator[str]:
    """The text in pieces of about SEGMENT characters, cut where the split cuts anyway."""
    at = 0
    while len(text) - at > SEGMENT:
        m = _SEAM.search(text, at + SEGMENT)
        if m is None:
            break
        yield text[at : m.end()]
        at = m.end()
    yield text[at:] if at else text


def pre_tokens(text: str) -> list[str]:
    """The split of the text; stretches around unsafe characters, from seam to seam, are not split."""
    found = UNSAFE.search(text)
    if found is None:
        return SPLIT.findall(text)
    out, at = [], 0
    while found:
        end = _SEAM.search(text, found.end())
        end = end.end() if end else len(text)
        begin = at
        for m in _SEAM.finditer(text, at, found.start() + 2):  # the last seam before; its lookahead must be seen
            if m.end() <= found.start():
                begin = m.end()
        out += SPLIT.findall(text, at, begin) if begin > at else []
        out.append(text[begin:end])
        at = end
        found = UNSAFE.search(text, at)
    return out + SPLIT.findall(text, at)


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def merges_alone(string: bytes, rank: dict[tuple[bytes, bytes], int]) -> bool:
    """Whether merging by the listed pairs, the lowest rank first, makes the bytes of a string one token."""
    parts = [string[i : i + 1] for i in range(len(string))]
    while len(parts) > 1:
        best, at = min((rank.get(pair, len(rank)), i) for i, pair in enumerate(zip(parts, parts[1:])))
        if best == len(rank):
            return False
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return True


@functools.lru_cache(maxsize=4)
def ranked(path: str):
    """The vocabulary as ranks, with its split and without any (a text is one pre-token), if its ids rank its merges and every merged string,
    alone, becomes one token by the listed pairs; else None. It then gives the library's ids for texts whose split is the same everywhere
    (not UNSAFE, no added tokens).

    Proof: where two neighbours make a string t of the vocabulary, no merge has crossed t's ends, so what happened within t is what
    happens to t alone, which ends with t; hence the two are t's listed pair, and merging by strings is merging by pairs."""
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)["model"]
    vocab, byte = spec["vocab"], _byte_of()
    pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["merges"]]
    if not set("".join(vocab)) <= set(byte) or any(vocab.get(a + b) != 256 + k for k, (a, b) in enumerate(pairs)):
        return None
    raw = {s: bytes(byte[c] for c in s) for s in vocab}
    rank = {(raw[a], raw[b]): k for k, (a, b) in enumerate(pairs)}
    merged = [raw[a] + raw[b] for a, b in pairs]
    library = Tokenizer.from_file(path)

    def proved(at: int) -> bool:
        part = merged[at : at + PROVED]
        alone = library.encode_batch_fast([m.decode("utf-8", "replace") for m in part], add_special_tokens=False)
        # Strings that are no text, or that the split would cut, are merged here.
        return all(got.ids == [256 + k] or merges_alone(m, rank) for k, (m, got) in enumerate(zip(part, alone), at))

    if not all(map(proved, range(0, len(merged), PROVED))):
        return None
    ranks = {r: vocab[s] for s, r in raw.items() if vocab[s] < 256 + len(pairs)}
    del spec, vocab, pairs, raw
    give_back()
    return tuple(tiktoken.Encoding("ranked", pat_str=split, mergeable_ranks=ranks, special_tokens={}) for split in (PATTERN, "(?s).+"))


class Encoder:
    """value(ids) of whole texts, one value per text; `join` combines the values of pre-tokens."""

    def __init__(self, path: str, value: Callable, join: Callable[[Iterable], object]):
        self.value, self.join, self.known = value, join, {}
        self.library, self.direct, self.special, self.added = None, True, None, []
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: model.encode(texts, num_threads=1)
            return
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.encode = lambda texts: [x.ids for x in library.encode_batch_fast(texts, add_special_tokens=False)]
        spec = json.loads(library.to_str())
        split = spec.get("pre_tokenizer") or {}
        self.direct = not (
            split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
            and not spec.get("normalizer") and not spec.get("truncation") and not spec.get("padding")
        )
        if self.direct:
            return
        self.added = [t["content"] for t in spec.get("added_tokens", []) if t["content"]]
        self.special = re.compile("|".join(map(re.escape, self.added))) if self.added else None
        self.known = self.base = self.whole_tokens(library)
        ranks = ranked(path)
        del spec
        give_back()
        self.merge = (lambda parts: map(ranks[1].encode_ordinary, parts)) if ranks else self.encode

    def whole_tokens(self, library) -> dict:
        """Vocabulary strings that encode alone as one token: each is encoded, nothing is assumed."""
        ids = sorted(library.get_vocab(with_added_tokens=False).values())
        out = {}
        for at in range(0, len(ids), PROVED):
            part = ids[at : at + PROVED]
            strings = [library.decode([i], skip_special_tokens=False) for i in part]
            out |= {s: self.value([i]) for i, s, got in zip(part, strings, self.encode(strings)) if got == [i] and not UNSAFE.search(s)}
        return out

    def __call__(self, texts: list[str]) -> list:
        out: list = [None] * len(texts)
        direct, parts = [], {}
        for k, text in enumerate(texts):
            if self.direct or (self.special and self.special.search(text)):
                direct.append(k)
            elif len(text) <= SEGMENT:
                parts[k] = pre_tokens(text)
            else:
                out[k] = self.join([self._joined([pre_tokens(s)])[0] for s in segments(text)])
        for k, v in zip(parts, self._joined(list(parts.values()))):
            out[k] = v
        for k, ids in zip(direct, self.encode([texts[k] for k in direct]) if direct else []):
            out[k] = self.value(ids)
        return out

    def _joined(self, texts: list[list[str]]) -> list:
        found = set().union(*texts)
        rest = found.difference(self.known)
        if rest:
            if len(self.known) + len(rest) > REMEMBERED + len(self.base):
                self.known, rest = self.base, found.difference(self.base)
            if self.known is self.base:
                self.known = dict(self.base)
            odd = [x for x in rest if UNSAFE.search(x)]
            rest = list(rest.difference(odd))
            self.known.update(zip(rest, map(self.value, self.merge(rest))))
            self.known.update(zip(odd, map(self.value, self.encode(odd))) if odd else ())
        get = self.known.__getitem__
        out = [self.join(map(get, t)) for t in texts]
        for x in [x for x in rest if len(x) > LONG] if rest else ():
            del self.known[x]
        return out


def _bytes(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


class IdEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers, segment by segment. Where the vocabulary's ids rank its merges, and
    the segment is one whose split is the same everywhere and holds no very long run of blanks, the same vocabulary as ranks encodes;
    else its pre-tokens are merged one by one, or the library encodes."""

    def __init__(self, path: str):
        self.rest, self.ranked = Encoder(path, _bytes, b"".join), None
        if self.rest.direct:
            return
        ranks = ranked(path)
        self.ranked = ranks and ranks[0].encode_to_numpy

    def _segment(self, text: str) -> bytes:
        if UNSAFE.search(text) or (len(text) > LONG and _BLANKS.search(text)):
            return self.rest([text])[0]
        return self.ranked(text, disallowed_special=()).astype("<u4").tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        if self.ranked is None:
            return self.rest(texts)
        special = self.rest.special
        odd = [k for k, t in enumerate(texts) if special and special.search(t)]
        other = dict(zip(odd, self.rest([texts[k] for k in odd]))) if odd else {}
        return [other[k] if k in other else b"".join(map(self._segment, segments(t))) for k, t in enumerate(texts)]


@functools.lru_cache(maxsize=4)
def counter(path: str) -> Encoder:
    return Encoder(path, len, sum)


@functools.lru_cache(maxsize=4)
def id_encoder(path: str) -> IdEncoder:
    return IdEncoder(path)


@functools.lru_cache(maxsize=4)
def vocabulary_size(path: str) -> int:
    """One more than the largest id."""
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path).vocab_size()
    from tokenizers import Tokenizer

    return 1 + max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values())


@functools.lru_cache(maxsize=4)
def begins_with_blank(path: str) -> np.ndarray:
    """By id, whether a token of a byte-level vocabulary begins with a space."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    out = np.zeros(1 + max(vocab.values()), bool)
    out[[i for s, i in vocab.items() if s[:1] == chr(256 + 32)]] = True
    return out


def texts_of(batch: pa.RecordBatch) -> list[str]:
    return [b.decode("utf-8", "replace") if b else "" for b in batch.column("text").to_pylist()]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens) of every row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = counter(tokenizer)
        for batch in batches:
            for part in chunks(batch):
                n = encoder(texts_of(part))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("n_bytes")
    out = id_text(docs, id_col, text_col, size).mapInArrow(count, f"doc_id {doc_id_type(docs, id_col)}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
