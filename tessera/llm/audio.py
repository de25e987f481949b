"""Telephony audio columns.

A payload of bytes is stored in a RIFF file of one of three telephony formats: 8-bit mu-law or A-law samples, or blocks of
4-bit ADPCM. The bytes are the format's units, so the form is lossless. The payload's checksum deals out the formats, so
equal payloads have equal files. Read back, samples are expanded by the law's lookup table, or ADPCM blocks are decoded by
numpy with one step per sample position over all blocks at once; the 8 kHz PCM is resampled by two with integer
weights and stored beside the file. The features are those of the resampled PCM, and the mean size of the payload read as
ADPCM. All arithmetic is integer, so equal payloads give equal bytes.

Null and empty texts are one block of padding. Very long texts are one file, decoded SLICE blocks at once. Ties and repeated
rows: equal texts give equal values, all rows stay. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tessera.llm._shared import chunks, doc_id_type, id_text

RATE = 8000
BLOCK = 576
#: Blocks that are decoded at once.
SLICE = 4096
# Format tags of the RIFF container; step sizes and index moves of IMA ADPCM.
MU_LAW, A_LAW, ADPCM = 7, 6, 17
INDEX_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107,
    118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963,
    1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894,
    6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794,
    32767,
], np.int32)


def mu_law_table() -> np.ndarray:
    """16-bit PCM of each mu-law byte, by the law's segments."""
    b = ~np.arange(256) & 255
    size = (((b & 15) << 3) + 132 << (b >> 4 & 7)) - 132
    return np.where(b & 128, -size, size).astype(np.int16)


def a_law_table() -> np.ndarray:
    """16-bit PCM of each A-law byte."""
    b = np.arange(256) ^ 0x55
    segment, low = b >> 4 & 7, ((b & 15) << 4) + 8
    size = np.where(segment > 0, low + 256 << np.maximum(segment - 1, 0), low)
    return np.where(b & 128, size, -size).astype(np.int16)


TABLES = {MU_LAW: mu_law_table(), A_LAW: a_law_table()}


def format_of(payload: bytes, formats: tuple[int, ...] = (MU_LAW, A_LAW, ADPCM)) -> int:
    return formats[zlib.crc32(payload) % len(formats)]


def to_riff(data: bytes, tag: int = MU_LAW, rate: int = RATE, block: int = BLOCK) -> bytes:
    """data: 8-bit samples, or whole ADPCM blocks."""
    if tag == ADPCM:
        n = 2 * (block - 4) + 1  # samples of a block
        fmt = struct.pack("<4sIHHIIHHHH", b"fmt ", 20, tag, 1, rate, rate * block // n, block, 4, 2, n)
        samples = len(data) // block * n
    else:
        fmt, samples = struct.pack("<4sIHHIIHHH", b"fmt ", 18, tag, 1, rate, rate, 1, 8, 0), len(data)
    fact = struct.pack("<4sII", b"fact", 4, samples)
    body = b"WAVE" + fmt + fact + struct.pack("<4sI", b"data", len(data)) + data + b"\0" * (len(data) & 1)
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def from_riff(media: bytes) -> tuple[int, int, bytes]:
    """Format tag, rate and sample bytes of a stored file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF sound file")
    at, tag, rate = 12, None, None
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", media, at + 8)
        elif name == b"data":
            if tag is None or at + 8 + size > len(media):
                raise ValueError("the sound file is cut short")
            return tag, rate, media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("the sound file has no samples")


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """PCM of IMA ADPCM blocks, a row of bytes each: predictor (2 bytes), step index, one byte unused, then two
    samples a byte, low half first. A step index beyond the table counts as its end."""
    n, width = blocks.shape
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32)
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((2 * (width - 4) + 1, n), np.int16)
    out[0] = value
    for k in range(width - 4):
        for half in (0, 1):
            code = codes[k] & 15 if half == 0 else codes[k] >> 4
            step = STEPS[index]
            size = code & 7
            change = (2 * size.astype(np.int32) + 1) * step >> 3
            value += np.where(code & 8, -change, change)
            np.clip(value, -32768, 32767, out=value)
            index += INDEX_MOVES[size]
            np.clip(index, 0, len(STEPS) - 1, out=index)
            out[1 + 2 * k + half] = value
    return out.T


def resample_half(pcm: np.ndarray) -> np.ndarray:
    """Half the rate: weights 1, 2, 1 over neighbours (the ends repeat), every second sample. int16 in and out."""
    if not len(pcm):
        return pcm.astype(np.int16)
    x = np.concatenate([pcm[:1], pcm, pcm[-1:]]).astype(np.int32)
    return ((x[:-2:2] + 2 * x[1:-1:2] + x[2::2] + 2) >> 2).astype(np.int16)


def payload_of(text: bytes | None, block: int = BLOCK) -> bytes:
    text = text or b""
    return text + b"\xff" * (-len(text) % block or (0 if text else block))


def features(pcm: np.ndarray, size: int, n: int) -> str:
    """Peak, energy and zero crossings of the resampled PCM, and the mean size of the n samples of the ADPCM reading."""
    peak = energy = crossings = 0
    for at in range(0, len(pcm), 1 << 20):
        part = pcm[at : at + (1 << 20) + 1].astype(np.int64)
        crossings += int(np.count_nonzero((part[1:] < 0) != (part[:-1] < 0)))
        part = part[: 1 << 20]
        peak, energy = max(peak, int(np.abs(part).max())), energy + int((part * part).sum())
    return f"peak={peak};energy={energy};crossings={crossings};adpcm={size // max(1, n)}"


def decoded(files: list[tuple[int, int, bytes]], block: int = BLOCK) -> Iterator[tuple[np.ndarray, int, int]]:
    """Of each file its resampled PCM, and the sum and number of the absolute samples of its bytes read as ADPCM."""
    blocks = np.frombuffer(b"".join(f[2] for f in files), np.uint8).reshape(-1, block)
    sums, pcm, n = np.empty(len(blocks), np.int64), {}, 2 * (block - 4) + 1
    ends = np.cumsum([len(f[2]) // block for f in files])
    is_adpcm = np.repeat([f[0] == ADPCM for f in files], np.diff(ends, prepend=0))
    for at in range(0, len(blocks), SLICE):
        part = decode_adpcm(blocks[at : at + SLICE])
        sums[at : at + SLICE] = np.abs(part.astype(np.int32)).sum(1)
        pcm[at] = np.ascontiguousarray(part[is_adpcm[at : at + SLICE]])  # what an ADPCM file's PCM needs
    wide = np.concatenate(list(pcm.values())) if pcm else np.empty((0, n), np.int16)
    place = np.cumsum(is_adpcm) - is_adpcm
    for (tag, _, data), begin, end in zip(files, np.concatenate([[0], ends]).tolist(), ends.tolist()):
        if tag == ADPCM:
            samples = wide[place[begin] : place[begin] + end - begin].reshape(-1)
        else:
            samples = TABLES[tag][np.frombuffer(data, np.uint8)]
        yield resample_half(samples), int(sums[begin:end].sum()), (end - begin) * n


def telephony(docs: DataFrame, block: int = BLOCK, formats: tuple[int, ...] = (MU_LAW, A_LAW, ADPCM), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, format (tag), media (the stored file), payload (its bytes, read back), pcm (4 kHz, 16 bits) and feature
    of every row. formats are dealt out by the payload's checksum."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                media = [to_riff(p, format_of(p, formats), block=block) for p in (payload_of(t, block) for t in part.column("text").to_pylist())]
                size = pc.fill_null(pc.binary_length(part.column("text")), 0).cast(pa.int64())
                files = [from_riff(m) for m in media]
                pcm, feature = [], []
                for samples, total, n in decoded(files, block):
                    feature.append(features(samples, total, n))
                    pcm.append(samples.astype("<i2").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), size, pa.array([f[0] for f in files], pa.int32()), pa.array(media, pa.binary()),
                        pa.array([f[2] for f in files], pa.binary()), pa.array(pcm, pa.binary()), pa.array(feature),
                    ],
                    ["doc_id", "n_bytes", "format", "media", "payload", "pcm", "feature"],
                )

    schema = f"doc_id {doc_id_type(docs, id_col)}, n_bytes long, format int, media binary, payload binary, pcm binary, feature string"
    return id_text(docs, id_col, text_col).mapInArrow(store, schema)
