"""SimHash near-duplicates by pivot distance tables.

Distinct fingerprints meet where two of five bit blocks agree, which any two within three bits do. For every meeting
the table of distances to PIVOTS reference fingerprints is computed. The order by the first column makes the pairs: only those within
three there are ever formed; then pairs whose distances to some other reference differ by more than three are discarded (the triangle
inequality: none of them can link), one reference after another, and the survivors are verified. A meeting reports links
that span its groups, not all pairs; meetings of more than `most` fingerprints are split by further bits, and what is larger still dealt out by
pairs of chunks, so no task holds more than two chunks of one. Components of the links, with the fingerprint as node, give the classes.

near_copies() links texts by the Jaccard similarity of their shingles instead, for radii at which no blocks of bits agree.
Distinct texts meet where a band of minimum shingle hashes agrees (BANDS bands of ROWS: a pair of similarity 0.8 misses all of them
in 2 of 1000 cases). In a meeting, pairs with some column of the pivot table or the fingerprints more than WIDE bits apart are discarded,
and those whose minimum hashes, a byte of each, agree far too seldom. Of the rest the likeliest propose links that span the meeting; in later
rounds each text proposes its likeliest pairs, four times as many each time. Every proposal is verified by the exact similarity of both texts.
Rounds go on, without pairs that links join already or that were refused, until nothing is left to propose.

Texts: A-Z lower-cased, words separated by space and \\t to \\r, shingles of `width` words joined by a space, repeats
included; fewer words: the whole sequence; null, empty and blank texts: fingerprint zero, linked like any other. Repeated rows
and equal texts have equal fingerprints. Very long texts are hashed in pieces. Null ids stay; a component of
null ids only has a null id. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import chunks, doc_id_type, drop_stored, id_text, stored
from tessera.llm.components import components

SEED, RADIUS, PIVOTS = 42, 3, 16
BANDS, ROWS, WIDE = 16, 5, 22
#: Minimum hashes of a text, the first of which make the bands; how far an estimate may fall short of the similarity (3.6 standard errors of
#: so many); pairs that a text proposes in a meeting of the second round.
HASHES, SHORT, LIKELIEST = 256, 0.09, 4
#: Sets to compare that are broadcast, 48 bytes each; and pairs of a hub that are compared in one place.
FEW_ASKS, HUB = 200_000, 1024
_WIDTHS = (13, 13, 13, 13, 12)
_SHINGLES_AT_ONCE = 1 << 15


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masks() -> list[int]:
    """For each two of the five blocks, the mask of their bits, as signed longs."""
    ends = list(itertools.accumulate(_WIDTHS))
    blocks = [((1 << w) - 1) << (e - w) for w, e in zip(_WIDTHS, ends)]
    return [_signed(a | b) for a, b in itertools.combinations(blocks, 2)]


def references() -> np.ndarray:
    """Fixed pseudo-random reference fingerprints (multiples of the golden ratio, mixed)."""
    x = np.arange(1, PIVOTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: bytes | None, width: int) -> Iterator[np.ndarray]:
    """XXH64 of all shingles, repeats included, in pieces; none for texts without words."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(width, len(words))
    digest, n = xxhash.xxh64_intdigest, len(words) - k + 1
    for a in range(0, n, _SHINGLES_AT_ONCE):
        z = min(n, a + _SHINGLES_AT_ONCE)
        yield np.array([digest(line[s:e], SEED) for s, e in zip(starts[a:z].tolist(), ends[a + k - 1 : z + k - 1].tolist())], "<u8")


class Fingerprint:
    """Counts of set bits over the pieces of a text."""

    def __init__(self):
        self.bits, self.n = np.zeros(64, np.int64), 0

    def add(self, h: np.ndarray) -> None:
        self.bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        self.n += len(h)

    def value(self) -> int:
        return int(np.packbits(2 * self.bits > self.n, bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, width: int = 3) -> int:
    out = Fingerprint()
    for h in shingle_hashes(text, width):
        out.add(h)
    return out.value()


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                fp = np.array([fingerprint(t, width) for t in part.column("text").to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return id_text(docs, id_col, text_col).mapInArrow(hashed, f"doc_id {doc_id_type(docs, id_col)}, fp long")


def spanning_links(group: np.ndarray, fp: np.ndarray, seen: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, root) that span the linked fingerprints of each group.

    A group stands in the order of its distances to the first reference, and only rows within RADIUS of each other there become
    pairs; the other references' columns discard pairs one after another. seen: is given the pairs of all groups, of the windows, after
    the table, and the links."""
    refs = references()
    table = np.bitwise_count(fp[:, None] ^ refs[None, :]).astype(np.int8)
    order = np.lexsort((table[:, 0], group))
    group, fp, table = group[order], fp[order], table[order]
    n = len(fp)
    root = np.arange(n)
    begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    number = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, n)))
    key = number * 1024 + table[:, 0]
    reach = np.searchsorted(key, key + RADIUS, "right") - np.arange(n)  # rows of the window from here on
    counts = dict.fromkeys(("pairs", "near", "left", "links"), 0)
    size = np.diff(np.append(begin, n))
    counts["pairs"], counts["near"] = int((size * (size - 1) // 2).sum()), int((reach - 1).sum())
    left = np.flatnonzero(reach > 1)
    step = 1
    while len(left):
        i, j = left, left + step
        ok = root[i] != root[j]
        i, j = i[ok], j[ok]
        for p in range(1, PIVOTS):
            ok = np.abs(table[i, p] - table[j, p]) <= RADIUS
            i, j = i[ok], j[ok]
        counts["left"] += len(i)
        ok = np.bitwise_count(fp[i] ^ fp[j]) <= RADIUS
        i, j = i[ok], j[ok]
        counts["links"] += len(i)
        while len(i):
            a, b = root[i], root[j]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root = up
            ok = root[i] != root[j]
            i, j = i[ok], j[ok]
        step += 1
        left = left[reach[left] > step]
    if seen is not None:
        seen.update(counts)
    child = np.flatnonzero(root != np.arange(n))
    return fp[child], fp[root[child]]


def splits(mask: int) -> list[int]:
    """Masks under which fingerprints that agree under `mask` meet again: of six parts of the other bits, any three. Within three bits of each other,
    two fingerprints agree in three parts at least."""
    free = [b for b in range(64) if not mask >> b & 1]
    parts = [sum(1 << b for b in part.tolist()) for part in np.array_split(free, 6)]
    return [_signed((mask & (1 << 64) - 1) | a | b | c) for a, b, c in itertools.combinations(parts, 3)]


def link_rows(distinct: DataFrame, most: int) -> DataFrame:
    """g, fp: the meetings of distinct fingerprints (column fp). Meetings of more than `most` are split by further bits, into twenty meetings for
    each fingerprint in which few others agree; only what is still larger is dealt out by pairs of chunks."""
    keys = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks()))))
    rows = distinct.select("fp", keys.alias("k")).select("fp", "k.*")
    large = stored(rows.groupBy("t", "key").agg(F.count("*").alias("n")).filter(F.col("n") > most)).select("t", "key", F.lit(True).alias("large"))
    further = F.element_at(F.array(*(F.array(*map(F.lit, splits(m))) for m in masks())), F.col("t") + 1)
    whole = F.array(F.struct(F.lit(-1).alias("s"), F.col("key")))
    parts = F.transform(further, lambda m, i: F.struct(i.alias("s"), F.col("fp").bitwiseAND(m).alias("key")))
    rows = rows.join(large, ["t", "key"], "left").select("fp", "t", F.explode(F.when(F.col("large"), parts).otherwise(whole)).alias("k")).select("fp", "t", "k.*")
    keys = ["t", "s", "key"]
    larger = stored(rows.filter("s >= 0").groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > most))
    n_chunks = F.ceil(F.coalesce(F.col("n"), F.lit(1)) / most).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    rows = rows.join(larger, keys, "left").withColumn("chunks", n_chunks).withColumn("own", own)
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(F.least(c, F.col("own")).alias("a"), F.greatest(c, F.col("own")).alias("b")))
    return rows.select("fp", F.explode(pairs).alias("p"), *keys).select(F.xxhash64(*keys, "p.a", "p.b").alias("g"), "fp")


def links(distinct: DataFrame, most: int = 2048) -> DataFrame:
    """u, v: links that span every set of distinct fingerprints (column fp) within RADIUS bits of one another."""
    rows = link_rows(distinct, most)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_g, held_f = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                g = np.concatenate([held_g, batch.column("g").to_numpy()])
                f = np.concatenate([held_f, batch.column("fp").to_numpy().view(np.uint64)])
                cut = np.searchsorted(g, g[-1]) if len(g) else 0
                held_g, held_f = g[cut:], f[cut:]  # the last group may go on
                g, f = g[:cut], f[:cut]
            else:
                g, f = held_g, held_f
            if len(g):
                u, v = spanning_links(g, f)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    return rows.repartition("g").sortWithinPartitions("g").mapInArrow(verify, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id that links reach) of every row."""
    rows = stored(fingerprints(docs, width, id_col, text_col))
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = components(links(distinct.select("fp")))
    rooted = distinct.join(found, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = stored(rooted.join(least, "root").select(F.col("fp").alias("_fp"), "component_id"))
    return rows.join(classes, F.col("fp") == F.col("_fp"), "left").select("doc_id", "fp", "component_id")


def _mixers() -> tuple[np.ndarray, np.ndarray]:
    """Factors (odd) and terms of the hash functions of the bands."""
    rng = np.random.default_rng(10)
    return tuple(rng.integers(0, 1 << 64, HASHES, np.uint64, endpoint=False) | np.uint64(odd) for odd in (1, 0))


def band_keys(least: np.ndarray) -> list[int]:
    """A key for each band of minimum hashes."""
    import xxhash

    return [_signed(xxhash.xxh3_64_intdigest(band.tobytes(), k)) for k, band in enumerate(least[: BANDS * ROWS].reshape(BANDS, ROWS))]


def signatures(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """doc_id, t1, t2, fp, band keys, and a byte of each minimum hash; texts without words have the key 0 only."""
    factor, term = _mixers()
    for batch in batches:
        for part in chunks(batch):
            fps, keys, sketches = [], [], []
            for text in part.column("text").to_pylist():
                out, least = Fingerprint(), np.full(HASHES, np.iinfo(np.uint64).max)
                for h in shingle_hashes(text, width):
                    out.add(h)
                    for at in range(0, len(h), 1024):
                        np.minimum(least, (h[at : at + 1024, None] * factor + term).min(0), out=least)
                fps.append(out.value())
                keys.append(band_keys(least) if out.n else [0])
                sketches.append((least >> np.uint64(7) & np.uint64(255)).astype(np.uint8).tobytes())
            fps = np.array(fps, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ("doc_id", "t1", "t2")), pa.array(fps), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], ["doc_id", "t1", "t2", "fp", "keys", "sketch"]
            )


def pair_key(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """A hash of each pair of nodes u < v."""
    x = u.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + v.view(np.uint64)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def proposals(group, node, fp, sketch, root, refused, similarity: float, most: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes, within WIDE bits and not estimated far below the similarity, of each group (sorted); nodes with one root are joined
    already, refused holds the sorted keys of pairs that aren't links. most: each node's likeliest so many; None: likely ones that span
    the group."""
    by = np.lexsort((root, group))
    group, node, fp, sketch, root = group[by], node[by], fp[by], sketch[by], root[by]
    n = len(fp)
    table = np.bitwise_count(fp[:, None] ^ references()[None, :]).astype(np.int8)
    new = np.concatenate([[True], np.diff(group) != 0])
    starts = np.flatnonzero(new)
    end = np.append(starts[1:], n)[np.cumsum(new) - 1]
    lead = new | np.concatenate([[True], np.diff(root) != 0])
    own = np.flatnonzero(lead)[np.cumsum(lead) - 1]  # the first row of a group with each root stands for it
    out = []
    for least in (0.95, 0.87, similarity - SHORT) if most is None else (similarity - SHORT,):
        left, step = np.flatnonzero(end - np.arange(n) > 1), 1
        while len(left):
            i, j = left, left + step
            ok = own[i] != own[j]
            i, j = i[ok], j[ok]
            for p in range(PIVOTS):
                ok = np.abs(table[i, p] - table[j, p]) <= WIDE
                i, j = i[ok], j[ok]
            ok = np.bitwise_count(fp[i] ^ fp[j]) <= WIDE
            i, j = i[ok], j[ok]
            alike = (sketch[i] == sketch[j]).mean(1)
            alike = (alike - 1 / 256) / (1 - 1 / 256)
            ok = alike >= least
            i, j, alike = i[ok], j[ok], alike[ok]
            if len(i) and len(refused):
                key = pair_key(np.minimum(node[i], node[j]), np.maximum(node[i], node[j]))
                ok = refused[np.minimum(np.searchsorted(refused, key), len(refused) - 1)] != key
                i, j, alike = i[ok], j[ok], alike[ok]
            if len(i):
                out.append((i, j, alike))
            while most is None and len(i):
                a, b = own[i], own[j]
                np.minimum.at(own, np.maximum(a, b), np.minimum(a, b))
                while not np.array_equal(own[own], own):
                    own = own[own]
                ok = own[i] != own[j]
                i, j = i[ok], j[ok]
            step += 1
            left = left[end[left] - left > step]
            if step & (step - 1) == 0 and len(left):  # groups that are one already need no more
                several = np.maximum.reduceat(own, starts) != starts
                left = left[several[np.searchsorted(starts, left, "right") - 1]]
    i, j, alike = (np.concatenate([x[k] for x in out]) if out else np.empty(0, np.int64) for k in range(3))
    if most is not None:
        a, pair = np.concatenate([i, j]), np.tile(np.arange(len(i)), 2)
        order = np.lexsort((-alike[pair], a))
        a, pair = a[order], pair[order]
        chosen = np.unique(pair[np.arange(len(a)) - np.searchsorted(a, a) < most])
        i, j = i[chosen], j[chosen]
    return node[i], node[j]


def _meetings(nodes: DataFrame, most: int) -> DataFrame:
    """node, t, key, chunks, own, fp, sketch of all nodes that share a key with another one; own: the node's chunk in a meeting of several."""
    thin = nodes.select("node", F.posexplode("keys").alias("t", "key"))
    large = thin.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1")  # a key of one text is no meeting
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    rows = stored(thin.join(large.hint("merge"), ["t", "key"]).withColumn("chunks", F.ceil(F.col("n") / most).cast("int")).withColumn("own", own).drop("n"))
    # Tables of known size, so that the nodes' sketches move only where they have to.
    met = stored(nodes.join(stored(rows.select("node").distinct()), "node", "left_semi").select("node", "fp", "sketch"))
    out = stored(rows.join(met, "node"))
    drop_stored(rows, met)
    return out


def _paired(rows: DataFrame) -> DataFrame:
    """g for each chunk that a row's own one meets; the rows move once for each."""
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(F.least(c, F.col("own")).alias("a"), F.greatest(c, F.col("own")).alias("b")))
    return rows.withColumn("p", F.explode(pairs)).withColumn("g", F.xxhash64("t", "key", "p.a", "p.b")).drop("p")


def _dealt(meetings: DataFrame, known: DataFrame | None, turn: int, most: int) -> DataFrame:
    """g, node, fp, sketch, root of the meetings that are not joined up yet. Meetings of several chunks go in turns: first each chunk by itself, then
    what stands for each root that is left, and only then, where roots are still apart, all of their chunks with each other; so a large
    group of copies moves once or twice, not once for each chunk."""
    rows = meetings.withColumn("root", F.col("node")) if known is None else meetings.join(known, "node", "left").withColumn("root", F.coalesce("root", "node"))
    if turn == 0:
        return rows.withColumn("g", F.xxhash64("t", "key", "own")).select("g", "node", "fp", "sketch", "root")
    apart = rows.groupBy("t", "key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.max("chunks").alias("c")).filter("a <> b")
    apart = stored(apart.select("t", "key"))
    rows = rows.join(apart, ["t", "key"], "left_semi")
    if turn > 1:
        return _paired(rows).select("g", "node", "fp", "sketch", "root")
    one = rows.filter("chunks > 1").groupBy("t", "key", "root").agg(F.min(F.struct("node", "fp", "sketch")).alias("r")).select("t", "key", "root", "r.*")
    n = one.groupBy("t", "key").agg(F.ceil(F.count("*") / most).cast("int").alias("chunks"))
    one = one.join(n, ["t", "key"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    return _paired(rows.filter("chunks = 1").unionByName(one)).select("g", "node", "fp", "sketch", "root")


def _proposed(meetings: DataFrame, known: DataFrame | None, refused: DataFrame | None, similarity: float, turn: int, most: int) -> DataFrame:
    """u < v: what all meetings propose. known: node, root; refused: u, v."""
    rows = _dealt(meetings, known, turn, most)
    empty = F.array().cast("array<long>")
    if refused is not None:
        partners = stored(refused.groupBy(F.col("u").alias("node")).agg(F.collect_list("v").alias("no")))
        rows = rows.join(partners, "node", "left").withColumn("no", F.coalesce("no", empty))
    else:
        rows = rows.withColumn("no", empty)

    def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held = None
        for batch in batches:
            if batch.num_rows:
                held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
                g = held.column("g").to_numpy()
                cut = int(np.searchsorted(g, g[-1]))  # the last group may go on
                if cut:
                    yield held.slice(0, cut)
                    held = held.slice(cut)
        if held is not None:
            yield held

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches):
            g, node, fp, root = (rows.column(c).to_numpy() for c in ("g", "node", "fp", "root"))
            sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(len(g), -1)
            no = rows.column("no").combine_chunks()
            partner = no.flatten().to_numpy()
            keys = np.unique(pair_key(np.repeat(node, no.value_lengths().to_numpy()), partner)) if len(partner) else np.empty(0, np.uint64)
            u, v = proposals(g, node, fp.view(np.uint64), sketch, root, keys, similarity, None if turn == 0 else LIKELIEST << 2 * (turn - 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])

    return rows.repartition("g").sortWithinPartitions("g").mapInArrow(meet, "u long, v long").distinct()


def _similar(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """u, v, the Jaccard similarity of their texts' shingles, and ok, whether it suffices; texts: doc_id, t1, t2, text.

    Of a pair, the node with more pairs is the hub. Hubs' pairs are dealt out in chunks of HUB; a leaf's shingles go to each of its hubs, a hub's
    once to each of its chunks, straight from the texts: no text and no set is stored, and no pair carries two sets."""
    degree = pairs.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("n"))
    both = pairs.join(degree.select(F.col("node").alias("u"), F.col("n").alias("nu")), "u").join(degree.select(F.col("node").alias("v"), F.col("n").alias("nv")), "v")
    first = F.col("nu") >= F.col("nv")
    both = both.select(F.when(first, F.col("u")).otherwise(F.col("v")).alias("hub"), F.when(first, F.col("v")).otherwise(F.col("u")).alias("leaf"), F.greatest("nu", "nv").alias("n"))
    both = stored(both.select("hub", "leaf", F.pmod(F.xxhash64("leaf"), F.ceil(F.col("n") / HUB)).alias("chunk")))
    none = F.lit(-1).cast("long")
    asks = both.select(F.col("leaf").alias("node"), "hub", "chunk", "leaf").unionByName(both.select(F.col("hub").alias("node"), "hub", "chunk", none.alias("leaf")).distinct())
    asks = stored(asks.join(nodes.select("node", "t1", "t2", F.col("first").alias("_first")), "node").drop("node"))
    if asks.count() <= FEW_ASKS:  # then the texts need not be shuffled
        asks = F.broadcast(asks)
    found = texts.join(asks, ["t1", "t2"]).filter(F.col("doc_id").eqNullSafe(F.col("_first"))).select("hub", "chunk", "leaf", "text")

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = own = None
        for batch in batches:
            for part in chunks(batch):
                sets = []
                for text in part.column("text").to_pylist():  # a text's asks follow one another
                    if own is None or text != last:
                        last, own = text, np.unique(np.concatenate([np.empty(0, "<u8"), *shingle_hashes(text, width)])).tobytes()
                    sets.append(own)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("hub", "chunk", "leaf")), pa.array(sets, pa.binary())], ["hub", "chunk", "leaf", "s"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, x = None, None
        for batch in batches:
            found = []
            for hub, chunk, leaf, s in zip(*(batch.column(c).to_pylist() for c in ("hub", "chunk", "leaf")), batch.column("s")):
                y = np.frombuffer(s.as_buffer(), "<u8")
                if leaf == -1:
                    at, x = (hub, chunk), y.copy()
                elif at == (hub, chunk):  # the hub's set comes first
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    found.append((min(hub, leaf), max(hub, leaf), shared / max(1, len(x) + len(y) - shared) if len(x) or len(y) else 1.0))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found) if found else ((), (), ()), (pa.int64(), pa.int64(), pa.float64()))], ["u", "v", "sim"])

    key = ["hub", "chunk"]
    sets = found.mapInArrow(shingles, "hub long, chunk long, leaf long, s binary").repartition(*key).sortWithinPartitions(*key, "leaf")
    rows = sets.mapInArrow(compare, "u long, v long, sim double").dropDuplicates(["u", "v"])  # rows may repeat
    return rows.withColumn("ok", F.col("sim") >= similarity - 1e-12)


def near_copies(docs: DataFrame, width: int = 5, similarity: float = 0.8, most: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id that links reach) of every row; texts link from that Jaccard similarity of their
    distinct shingles on. Texts without words are one class."""
    text = F.col(text_col).cast("binary")
    hashes = [F.xxhash64(F.coalesce(text, F.lit(b"")), F.lit(k)).alias(f"t{k}") for k in (1, 2)]
    kind = doc_id_type(docs, id_col)
    read = id_text(docs, id_col, text_col, *hashes)  # no task holds more than a batch of texts
    rows = stored(read.mapInArrow(lambda batches: signatures(batches, width), f"doc_id {kind}, t1 long, t2 long, fp long, keys array<long>, sketch binary"))
    nodes = rows.groupBy("t1", "t2").agg(F.min("doc_id").alias("first"), F.min(F.struct("fp", "keys", "sketch")).alias("k"))
    nodes = stored(nodes.select(F.monotonically_increasing_id().alias("node"), "t1", "t2", "first", "k.*"))
    checked = known = None
    meetings = _meetings(nodes, most)
    dealt = bool(meetings.filter("chunks > 1").take(1))
    for turn in itertools.count():
        asked = stored(_proposed(meetings, known, None if checked is None else checked.filter("NOT ok"), similarity, turn, most))
        if not asked.take(1):
            if dealt and turn < 2:
                continue
            break
        new = stored(_similar(asked, nodes, read, width, similarity))
        checked = new if checked is None else stored(checked.unionByName(new))
        known = stored(components(checked.filter("ok").select("u", "v")))
    rooted = nodes.select("node", "t1", "t2", "first")
    rooted = rooted.withColumn("root", F.col("node")) if known is None else rooted.join(known, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = stored(rooted.join(least, "root").select("t1", "t2", "component_id"))
    return rows.join(classes, ["t1", "t2"]).select("doc_id", "fp", "component_id")
