"""The prefix tree against a plain one, with nulls, ties, repeated turns, missing first conversations, deep chains and long conversations."""

from __future__ import annotations

import hashlib
import random
import zlib

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.llm import prefix_trie, queries


def plain_rebuilt(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [(r, t) for _, _, r, t in sorted(ts)] for c, ts in convs.items()}
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in convs}
    return {c: convs.get(c - c % 100, [])[: h[c]] + convs[c][h[c] :] for c in convs}


def plain_trie(convs):
    """(conv_id, depth) -> parent, n_convs, n_children, n_leaves, saved, hash of ends, by descent from the root."""
    out = {}

    def walk(prefix, members, parent):
        ends = sorted(c for c in members if len(convs[c]) == len(prefix))
        below = {}
        for c in members:
            if len(convs[c]) > len(prefix):
                below.setdefault(convs[c][len(prefix)], []).append(c)
        own, leaves, saved = min(members), 0 if below else 1, (len(members) - 1) * (len(prefix[-1][1]) if prefix else 0)
        for turn, group in below.items():
            more = walk([*prefix, turn], group, own)
            leaves, saved = leaves + more[0], saved + more[1]
        out[own, len(prefix)] = (parent, len(members), len(below), leaves, saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest())
        return leaves, saved

    if convs:
        walk([], sorted(convs), None)
    return out


def random_rows(seed, n=160):
    r = random.Random(seed)
    rows = []
    for c in [*range(n), *range(300, 330), 1000, 100_000]:
        if c in (100, 107):
            continue
        for t in range(r.choice([1, 1, 2, 3, 6, 9])):
            rows.append((c, r.choice([t, t, t, None]), r.choice(["user", "assistant", None]), r.choice(["hi", "", None, "é中", "x" * 40])))
    rows += [(0, t, "user", f"turn {t}") for t in range(900)] + [(55, t, "user", "hi") for t in range(6)]
    rows += [(None, 0, "user", "nobody's"), rows[0], rows[1], rows[1]]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def found(df):
    return {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_query_and_sql(spark, tmp_path, seed, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    rows = random_rows(seed)
    clash = spark.createDataFrame([(*x, 1, "h", 2) for x in rows], SCHEMA + ", depth int, h1 string, pos int")
    clash.repartition(5).write.parquet(str(tmp_path / "conversations.parquet"))
    want = plain_trie(plain_rebuilt(rows))
    out = queries.op13_prefix_trie(spark, str(tmp_path))
    assert found(out) == want and out.count() == len(want) > 300
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    columns = out.columns
    got = con.sql(prefix_trie.SQL).df()[columns].astype(object)
    got = {(c, d): (None if pd.isna(p) else p, *rest) for c, d, p, *rest in got.itertuples(index=False)}
    assert got == want


@pytest.mark.parametrize("bits", [1, 2, 4])
def test_deep_nest_of_chains(spark, bits):
    """Every conversation leaves the one before it a turn deeper: as many chains above one another as conversations."""
    convs = {c: [("u", "s")] * 0 + [("u", f"t{i}") for i in range(c)] + [("u", f"own {c}")] * 3 for c in range(40)}
    rows = [(c, t, *turn) for c, ts in convs.items() for t, turn in enumerate(ts)]
    turns = prefix_trie.numbered_turns(spark.createDataFrame(rows, SCHEMA))
    nodes, ends = prefix_trie.prefix_trie(turns, turns.select("conv_id").distinct(), bits)
    nodes = nodes.join(prefix_trie.list_hashes(ends), ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("sha256", F.sha2(F.lit(""), 256)))
    assert found(nodes) == plain_trie(convs)


def test_copies_and_empty_tables(spark):
    rows = [(c, t, "u", f"{t}") for c in range(50) for t in range(4)]
    turns = prefix_trie.numbered_turns(spark.createDataFrame(rows, SCHEMA))
    nodes, ends = prefix_trie.prefix_trie(turns, spark.range(60).select(F.col("id").alias("conv_id")))
    rows = {(r.conv_id, r.depth): r for r in nodes.collect()}
    assert set(rows) == {(0, d) for d in range(5)} and rows[0, 0].n_convs == 60 and rows[0, 4].n_leaves == 1 and rows[0, 2].saved_tokens == 3 * 49
    assert {(r.conv_id, r.depth): r.n for r in ends.groupBy("conv_id", "depth").agg(F.count("*").alias("n")).collect()} == {(0, 4): 50, (0, 0): 10}
    none = prefix_trie.numbered_turns(spark.createDataFrame([], SCHEMA))
    nodes, ends = prefix_trie.prefix_trie(none, none.select("conv_id"))
    assert nodes.count() == 0 and prefix_trie.list_hashes(ends).count() == 0


@pytest.mark.parametrize("segment", [1, 3, 1000])
@pytest.mark.parametrize("back", [False, True])
def test_running_values(spark, segment, back):
    r = random.Random(4)
    rows = [(k, p, r.randrange(100)) for k in range(4) for p in range(r.randrange(1, 40))]
    got = prefix_trie.running(spark.createDataFrame(rows, "k long, p long, v long"), "k", "p", {"s": "v"}, "sum", back, segment)
    for x in got.collect():
        assert x.s == sum(v for k, p, v in rows if k == x.k and (p >= x.p if back else p <= x.p))
