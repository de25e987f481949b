"""Best-fit packing of token sequences, hierarchically.

Documents are encoded once; only the lengths and checksums of their pieces are kept and dealt out. Leaves of a bounded
number of pieces pack best-fit decreasing; bins that are full but for `slack` tokens are final. The underfull bins of
`fan_in` neighbouring nodes meet in one node of the next round and are packed there as items, and so on; the last
round emits all. Rounds stop when one node is left, or after `max_rounds`, so that no task ever holds more than
leaf_rows * fan_in**(max_rounds - 1) pieces; a node that is left alone wastes a bin at most.

Null and empty texts are one end token. Repeated rows are packed as often as they occur; items of one size are placed in the order of
their numbers. Very long texts are encoded in segments (where the split cuts anyway) and cut into pieces; a text's ids are held at once. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import chunks, doc_id_type, give_back, id_text, stored
from tessera.llm.tokens import id_encoder, texts_of

_PIECE = "piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: pieces of the capacity, the first one may be shorter."""
    first = n % capacity or capacity
    return [(0, min(n, first)), *((a, capacity) for a in range(first, n, capacity))]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every document; `slot` numbers the pieces of a task, to tell repeated rows apart."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, slot = id_encoder(tokenizer), 0
        for batch in batches:
            for part in chunks(batch):
                rows, at = [], []
                for k, ids in enumerate(encoder(texts_of(part))):
                    ids = memoryview(ids + end)
                    for j, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                        rows.append((j, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), slot))
                        at.append(k)
                        slot += 1
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "slot"],
                )
        give_back()

    return id_text(docs, id_col, text_col).mapInArrow(encode, f"doc_id {doc_id_type(docs, id_col)}, {_PIECE}, slot long")


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size; sizes come in the order in which they are to be placed."""
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by room left
    rooms, n = 0, 0  # bit r: some bin has room r
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for k, size in enumerate(sizes.tolist()):
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms ^= 1 << room
        else:
            b, room, n = n, capacity, n + 1
        bins[k], offsets[k] = b, capacity - room
        room -= size
        if room:
            open_bins[room].append(b)
            rooms |= 1 << room
    return bins, offsets


def pack(items: DataFrame, capacity: int = 2048, slack: int = 8, leaf_rows: int = 4096, fan_in: int = 8, max_rounds: int = 4) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces (doc_id, piece, start, length, ids_crc32, slot).
    No length may exceed the capacity."""
    kind = doc_id_type(items)
    nodes = max(1, math.ceil(items.count() / leaf_rows))
    rounds = min(max_rounds, 1 + math.ceil(math.log(nodes, fan_in) - 1e-9)) if nodes > 1 else 1
    left = items.select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.col("slot").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.col("length").alias("fill"),
        F.pmod(F.xxhash64("doc_id", "piece", "slot"), F.lit(nodes)).alias("node"),
    )
    schema = f"doc_id {kind}, {_PIECE}, sequence_id long, offset long, fill long, node long"
    out = None
    for level in range(rounds):  # stored() runs a round before the next begins
        last = level == rounds - 1

        def place(rows: pa.Table) -> pa.Table:
            by = [("fill", "descending"), *((c, "ascending") for c in ("sequence_id", "doc_id", "offset", "piece"))]
            rows = rows.combine_chunks().take(pc.sort_indices(rows, sort_keys=by))
            fill, node = rows.column("fill").to_numpy(), rows.column("node").to_numpy()
            if level == 0:
                new = np.ones(len(fill), bool)
            else:
                new = np.diff(rows.column("sequence_id").to_numpy(), prepend=-1) != 0
            item = np.cumsum(new) - 1
            bins, offsets = best_fit(fill[new], capacity)
            out = {
                "sequence_id": (level << 58) + (node << 30) + bins[item],
                "offset": rows.column("offset").to_numpy() + offsets[item],
                "fill": np.bincount(bins, weights=fill[new]).astype(np.int64)[bins][item],
            }
            for name, values in out.items():
                rows = rows.set_column(rows.schema.get_field_index(name), name, pa.array(values, pa.int64()))
            return rows

        packed = stored(left.groupBy("node").applyInArrow(place, schema))
        done = packed if last else packed.filter(F.col("fill") >= capacity - slack)
        out = done if out is None else out.unionByName(done)
        left = packed.filter(F.col("fill") < capacity - slack).withColumn("node", F.floor(F.col("node") / fan_in))
    return out.drop("fill", "node")


def best_fit_packing(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(stored(pieces(docs, tokenizer, capacity, end_id, id_col, text_col)), capacity, **how)
