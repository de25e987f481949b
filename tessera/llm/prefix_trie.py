"""The prefix tree of conversations.

A conversation is a sequence of turns (role and text). A prefix's digest is its depth and the exclusive or of two 64-bit hashes of each of its
turns, salted by the place; the smallest conversation that has a prefix owns its node. Whoever owns a node owns all deeper ones of its path,
so a conversation's first owned depth is found by binary search: joins of one batch of probes against the table of digests and their
smallest conversations, `bits` halvings a join. The nodes from there on are the conversation's chain; a chain hangs from the owner
of the node above its first one. Numbers of leaves and savings are added up over chains, bottom-up by pointer jumping (a logarithmic number
of rounds whatever the height), then along each chain from its end.

Nothing is held by conversation: places come from a sort by ranges, and running values along a conversation are taken by segments of SEGMENT
turns, then over segments. Key counts are pre-aggregated; joins by conversation can be split by the adaptive skew join.

Turns are ordered by `order_col` (null first), then role, then text, null ones as empty. Turns that repeat stay, each in its place. Rows without a
conversation's id belong to none and are left out. An empty table gives no nodes. Extra columns are ignored. Very long texts are hashed and
counted, never moved but for the sort.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._shared import drop_stored, stored

#: Turns of a conversation, or nodes of a chain, that are ordered together.
SEGMENT = 256


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def numbered_turns(turns: DataFrame, id_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, pos (from 1), h1 and h2 (hashes of role and text), chars (code points of the text) of every turn. Stored."""
    rows = turns.select(F.col(id_col).cast("long").alias("conv_id"), F.col(order_col).alias("turn"), _text(role_col).alias("role"), _text(text_col).alias("text")).filter("conv_id IS NOT NULL")
    by = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    rows = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    rows = stored(rows.select("conv_id", "at", F.xxhash64(F.lit(1), "role", "text").alias("h1"), F.xxhash64(F.lit(2), "text", "role").alias("h2"), F.length("text").cast("long").alias("chars")))
    part = F.shiftright("at", 33)
    counts = rows.groupBy("conv_id", part.alias("part")).agg(F.count("*").alias("n"), F.min("at").alias("low"))  # a row for each conversation and task
    below = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("conv_id", "part", "low", F.coalesce(F.sum("n").over(below), F.lit(0)).alias("start"))
    placed = rows.withColumn("part", part).join(counts, ["conv_id", "part"])
    out = stored(placed.select("conv_id", (F.col("start") + F.col("at") - F.col("low") + 1).alias("pos"), "h1", "h2", "chars"))
    drop_stored(rows)
    return out


def running(rows: DataFrame, key: str, place: str, values: dict[str, str], how: str, back: bool = False, segment: int = SEGMENT) -> DataFrame:
    """Adds running values (new name: column) along `place` within `key`, the own row included; how: sum or bit_xor; back: from the last place
    on. Segments of places are ordered on their own, then the segments' totals."""
    agg = getattr(F, how)
    add = (lambda a, b: a.bitwiseXOR(b)) if how == "bit_xor" else (lambda a, b: a + b)
    order = F.col(place).desc() if back else F.col(place)
    rows = rows.withColumn("_seg", F.floor(F.col(place) / segment))
    totals = rows.groupBy(key, "_seg").agg(*(agg(c).alias(f"_all_{new}") for new, c in values.items()))
    before = Window.partitionBy(key).orderBy(F.col("_seg").desc() if back else F.col("_seg")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col(key).alias("_key"), F.col("_seg").alias("_of"), *(F.coalesce(agg(f"_all_{new}").over(before), F.lit(0)).alias(f"_all_{new}") for new in values))
    inside = Window.partitionBy(key, "_seg").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    kept = [c for c in rows.columns if c != "_seg" and c not in values]
    rows = rows.select(*kept, "_seg", *(agg(c).over(inside).alias(f"_in_{new}") for new, c in values.items()))
    rows = rows.join(totals, (F.col(key) == F.col("_key")) & (F.col("_seg") == F.col("_of")))
    return rows.select(*kept, *(add(F.col(f"_in_{new}"), F.col(f"_all_{new}")).alias(new) for new in values))


def prefix_paths(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, depth, p1, p2 (digest of the prefix), chars (of its last text) for every prefix of every conversation of convs (conv_id), the
    empty one included. Stored."""
    salted = turns.select("conv_id", F.col("pos").alias("depth"), "chars", *(F.xxhash64("pos", h).alias(h) for h in ("h1", "h2")))
    paths = running(salted, "conv_id", "depth", {"p1": "h1", "p2": "h2"}, "bit_xor").select("conv_id", "depth", "p1", "p2", "chars")
    zero = F.lit(0).cast("long")
    return stored(paths.unionByName(convs.select("conv_id", *(zero.alias(c) for c in ("depth", "p1", "p2", "chars")))))


def first_owned(paths: DataFrame, minima: DataFrame, lengths: DataFrame, bits: int = 4) -> DataFrame:
    """conv_id, len, first (the first depth whose node the conversation owns, len + 1 if none), up (the owner of the node above, null for the root's).
    lengths: conv_id, len. minima: depth, p1, p2, owner. Stored."""

    def owners(probes: DataFrame) -> DataFrame:
        return probes.join(paths.select("conv_id", "depth", "p1", "p2"), ["conv_id", "depth"]).join(minima.select("depth", "p1", "p2", "owner"), ["depth", "p1", "p2"])

    open_ = stored(lengths.select("conv_id", "len", F.lit(0).cast("long").alias("low"), (F.col("len") + 1).alias("high")))
    done = None
    while True:
        found = open_.filter("low = high").select("conv_id", "len", F.col("low").alias("first"))
        done = found if done is None else done.unionByName(found)
        left = open_.filter("low < high")
        if not left.take(1):
            break
        # The depths that `bits` halvings of the bracket may ask for; those not owned come first.
        step = F.greatest(F.lit(1), F.ceil((F.col("high") - F.col("low")) / (1 << bits)))
        asked = F.when(F.col("low") + step < F.col("high"), F.sequence(F.col("low") + step, F.col("high") - 1, step)).otherwise(F.array())
        probes = left.withColumn("depth", F.explode(F.array_union(F.array("low"), asked)))
        seen = owners(probes).groupBy("conv_id", "len", "low", "high").agg(
            F.max(F.when(F.col("owner") != F.col("conv_id"), F.col("depth"))).alias("no"), F.min(F.when(F.col("owner") == F.col("conv_id"), F.col("depth"))).alias("yes")
        )
        open_ = stored(seen.select("conv_id", "len", F.coalesce(F.col("no") + 1, "low").alias("low"), F.coalesce("yes", "high").alias("high")))
    done = stored(done)
    ups = owners(done.filter("first > 0").select("conv_id", (F.col("first") - 1).alias("depth"))).select("conv_id", F.col("owner").alias("up"))
    return stored(done.join(ups, "conv_id", "left"))


def subtree_sums(chains: DataFrame, values: list[str]) -> DataFrame:
    """conv_id, up and the values, each added up over the chain and all chains below it (up: the chain above, or null). Stored."""
    now = stored(chains.select("conv_id", "up", F.col("up").alias("to"), *values))
    while now.filter("to IS NOT NULL").take(1):
        sent = now.filter("to IS NOT NULL").groupBy(F.col("to").alias("_at")).agg(*(F.sum(v).alias(f"_{v}") for v in values))
        next_ = now.filter("to IS NOT NULL").select(F.col("conv_id").alias("_by"), F.col("to").alias("_to"))
        above = now.select(F.col("conv_id").alias("_to"), F.col("to").alias("_next"))
        next_ = next_.join(above, "_to").select("_by", "_next")
        new = now.join(sent, F.col("conv_id") == F.col("_at"), "left").join(next_, F.col("conv_id") == F.col("_by"), "left")
        new = stored(new.select("conv_id", "up", F.col("_next").alias("to"), *((F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values)))
        drop_stored(now)
        now = new
    return now.drop("to")


def prefix_trie(turns: DataFrame, convs: DataFrame, bits: int = 4) -> tuple[DataFrame, DataFrame]:
    """The nodes (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens), and for each conversation the node that it ends in
    (member, conv_id, depth). turns: as numbered_turns gives them; convs: conv_id, once each, turnless ones included."""
    paths = prefix_paths(turns, convs)
    nodes = stored(paths.groupBy("depth", "p1", "p2").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.max("chars").alias("chars")))
    lengths = stored(paths.groupBy("conv_id").agg(F.max("depth").alias("len")))
    found = first_owned(paths, nodes, lengths, bits)
    drop_stored(paths, lengths)
    chains = found.filter("first <= len")
    ends = found.select(F.col("conv_id").alias("member"), F.when(F.col("first") <= F.col("len"), F.col("conv_id")).otherwise(F.col("up")).alias("conv_id"), F.col("len").alias("depth"))

    hung = chains.filter("up IS NOT NULL").select(F.col("up").alias("owner"), (F.col("first") - 1).alias("depth"), F.col("conv_id").alias("below"))
    n_hung = hung.groupBy("owner", "depth").agg(F.count("*").alias("n_hung"))
    own = chains.select(F.col("conv_id").alias("owner"), "first", "len", "up")
    rows = nodes.select("owner", "depth", "n_convs", "chars").join(n_hung, ["owner", "depth"], "left").join(own, "owner")
    n_children = F.coalesce("n_hung", F.lit(0)) + F.when(F.col("depth") < F.col("len"), 1).otherwise(0)
    rows = stored(
        rows.select(
            "owner", "depth", "n_convs", n_children.cast("long").alias("n_children"), F.when(n_children == 0, 1).otherwise(0).cast("long").alias("leaves"),
            ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"), F.when(F.col("depth") > F.col("first"), F.col("owner")).otherwise(F.col("up")).alias("parent_conv_id"),
        )
    )
    totals = rows.groupBy(F.col("owner").alias("conv_id")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    totals = subtree_sums(totals.join(chains.select("conv_id", "up"), "conv_id"), ["leaves", "saved"])
    below = hung.join(totals.select(F.col("conv_id").alias("below"), "leaves", "saved"), "below").groupBy("owner", "depth")
    below = below.agg(F.sum("leaves").alias("leaves_below"), F.sum("saved").alias("saved_below"))
    rows = rows.join(below, ["owner", "depth"], "left")
    rows = rows.withColumns({v: F.col(v) + F.coalesce(f"{v}_below", F.lit(0)) for v in ("leaves", "saved")})
    rows = running(rows, "owner", "depth", {"n_leaves": "leaves", "saved_tokens": "saved"}, "sum", back=True)
    return rows.select(F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"), ends


#: Numbers that one piece of a list holds.
PIECE = 4096


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (conv_id, depth, member) as comma-joined pieces (conv_id, depth, first, list)."""
    key, held = None, []

    def piece() -> pa.RecordBatch:
        values = ([key[0]], [key[1]], [held[0]], [",".join(map(str, held))])
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["conv_id", "depth", "first", "list"])

    for batch in batches:
        for conv, depth, member in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "depth", "member"))):
            if held and (key != (conv, depth) or len(held) == PIECE):
                yield piece()
                held = []
            key = (conv, depth)
            held.append(member)
    if held:
        yield piece()


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces as (conv_id, depth, sha256), one list after the other; no list is held whole."""
    key, state = None, None

    def one() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([state.hexdigest()])], ["conv_id", "depth", "sha256"])

    for batch in batches:
        for conv, depth, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "depth", "list"))):
            if key == (conv, depth):
                state.update(b",")
            else:
                if key is not None:
                    yield one()
                key, state = (conv, depth), hashlib.sha256()
            state.update(text.encode())
    if key is not None:
        yield one()


def list_hashes(ends: DataFrame) -> DataFrame:
    """conv_id, depth, sha256 (hex) of the members in order, comma-joined. Members are put together in pieces by ranges; a node's pieces are
    hashed one after the other, as SHA-256 asks, and never held together."""
    by = ["conv_id", "depth", "member"]
    pieces = ends.select(*by).repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_pieces, "conv_id long, depth long, first long, list string")
    return pieces.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first").mapInArrow(_hashes, "conv_id long, depth long, sha256 string")


#: What op13 returns, from whole prefixes and sums over all descendants.
SQL = """
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
         lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
numbered AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (SELECT conv_id, count(*) AS n FROM numbered GROUP BY conv_id),
convs AS (
  SELECT c.conv_id, c.conv_id - c.conv_id % 100 AS base,
         xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(c.conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
             lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) % 6 AS h
  FROM sizes c, crc),
rebuilt AS (
  SELECT c.conv_id, t.pos, t.role, t.text FROM convs c JOIN numbered t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL
  SELECT c.conv_id, least(c.h, coalesce(s.n, 0)) + t.pos - c.h, t.role, t.text
  FROM convs c JOIN numbered t ON t.conv_id = c.conv_id AND t.pos > c.h LEFT JOIN sizes s ON s.conv_id = c.base),
paths AS (
  SELECT conv_id, pos AS depth, length(text) AS chars,
         string_agg(md5(length(role)::VARCHAR || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY pos) AS key
  FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
nodes AS (SELECT depth, key, min(conv_id) AS owner, count(*) AS n_convs, max(chars) AS chars FROM paths GROUP BY depth, key),
children AS (SELECT depth - 1 AS depth, left(key, 32 * (depth - 1)::INT) AS key, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1, 2),
full_nodes AS (SELECT x.*, coalesce(c.n, 0) AS n_children FROM nodes x LEFT JOIN children c ON c.depth = x.depth AND c.key = x.key),
sums AS (
  SELECT p.depth, p.key, count(*) FILTER (WHERE x.n_children = 0) AS n_leaves, sum((x.n_convs - 1) * x.chars) AS saved
  FROM full_nodes x JOIN paths p ON p.conv_id = x.owner AND p.depth <= x.depth GROUP BY 1, 2),
ends AS (
  SELECT key, depth, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS hash
  FROM (SELECT *, max(depth) OVER (PARTITION BY conv_id) AS len FROM paths) WHERE depth = len GROUP BY key, depth)
SELECT x.owner AS conv_id, x.depth::BIGINT AS depth, u.owner AS parent_conv_id, x.n_convs, x.n_children, s.n_leaves, s.saved::BIGINT AS saved_tokens, coalesce(e.hash, sha256('')) AS ends_sha256
FROM full_nodes x JOIN sums s ON s.depth = x.depth AND s.key = x.key
LEFT JOIN nodes u ON u.depth = x.depth - 1 AND u.key = left(x.key, 32 * (x.depth - 1)::INT)
LEFT JOIN ends e ON e.depth = x.depth AND e.key = x.key
"""
