"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree; DataFrame operations only.

Every source's documents fall into blocks by hash, at most `most_blocks` of them, so that what follows is small however
large a source is; a shard is at least `shard_blocks` blocks, and there are 2**most_levels shards at most. Both bounds are parameters:
raise them for sources beyond most_blocks * block_words words, where blocks grow instead. A source whose target is f times its size gives floor(f) whole passes over its blocks and a last
pass over the first blocks of a permutation, up to the target; the block in which the target falls gives its documents
in hashed order, the last one in part. The numbers of blocks drawn, one per source, are then split among the output shards:
a node of the tree passes a multivariate-hypergeometric share of its vector to its left child, half of its blocks in
all, and the rest to its right child, so the shards together take exactly what each source gives. A shard takes the next blocks of each source's permutation,
which keeps shards disjoint within a pass, and orders their documents by a hash: the local shuffle.

A hypergeometric number is drawn exactly, but for a tail beyond ten standard deviations, as the largest of the
logarithms of its probabilities plus hashed Gumbel noise, in one pass over its range. All randomness is hashed from
the seed, so reruns agree.

Null source: a source of its own, the last one. Null text: no words. Texts without words are never taken. Rows that repeat
count each. Ties in a hash are ordered by id and size. Very long texts are documents like others: one block holds them, and the last one
taken may be taken in part. The sources themselves, a row each, are ordered in one task: they are few. An empty table gives no rows.
Columns of any name are kept in `row`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._shared import stored

WORDS = r"[^\x20\x09-\x0D]+"

def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


@dataclass(frozen=True)
class Plan:
    #: source, ix (rank), source_size, target, passes, n_blocks
    sources: DataFrame
    #: ix, block, last (words of the block that the last pass takes), words, shards (one per pass that takes it)
    blocks: DataFrame
    seed: int


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, ix, source_size, target from (source, source_size), a row for each source.

    Weights repeat over the sources in code point order, null last. A source's ratio is its limit by its weight; the
    common level L solves sum(min(weight * L, limit)) = budget, and is found by the sums over smaller ratios."""
    all_rows, in_order = Window.partitionBy(), Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.col("ix") % len(weights)) + 1).cast("int"))
    rows = sizes.withColumn("ix", F.row_number().over(in_order) - 1).withColumn("w", weight).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    below = Window.orderBy(F.col("limit") / F.col("w"), "ix").rowsBetween(Window.unboundedPreceding, -1)
    budget = F.sum(F.col("source_size").cast("double")).over(all_rows) * F.lit(float(share))
    level = F.try_divide(budget - F.coalesce(F.sum("limit").over(below), F.lit(0.0)), F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(below), F.lit(0.0)))
    rows = rows.withColumn("level", level)
    open_ = F.when(F.col("limit") / F.col("w") >= F.col("level"), F.struct((F.col("limit") / F.col("w")).alias("r"), "ix", "level"))
    rows = rows.withColumn("common", F.min(open_).over(all_rows)["level"])
    return rows.select("source", "ix", "source_size", F.least(F.col("limit"), F.coalesce(F.col("common") * F.col("w"), F.col("limit"))).alias("target"))


def _left_share(seed: int) -> Column:
    """For a node (node, quotas, total): the numbers of blocks that go left, in the quotas' order.

    d.N blocks are still to be shared out, d.K of them from this source, and d.m are still to go left."""
    mean = "d.m * d.K / greatest(d.N, 1)"
    width = "10 * sqrt(greatest(0, d.m * d.K / greatest(d.N, 1) * (1 - d.K / greatest(d.N, 1)) * (d.N - d.m) / greatest(d.N - 1, 1))) + 3"
    span = f"""transform(array(named_struct('N', cast(s.pop as double), 'K', cast(q as double), 'm', cast(s.take as double))), d -> named_struct('N', d.N, 'K', d.K, 'm', d.m,
        'lo', cast(greatest(0, d.m - (d.N - d.K), floor({mean} - ({width}))) as bigint), 'hi', cast(least(d.m, d.K, ceil({mean} + {width})) as bigint)))[0]"""
    uniform = f"(shiftrightunsigned(xxhash64({seed}, node, size(s.out), k), 11) + 0.5D) / {1 << 53}D"
    score = f"g.w - ln(-ln({uniform}))"
    step = "if(k < d.hi, ln((d.K - k) * (d.m - k) / ((k + 1.0D) * (d.N - d.K - d.m + k + 1.0D))), 0.0D)"
    draw = f"""aggregate(sequence(d.lo, d.hi), named_struct('w', 0.0D, 'best', cast('-Infinity' as double), 'k', d.lo),
        (g, k) -> named_struct('w', g.w + {step}, 'best', greatest(g.best, {score}), 'k', if({score} > g.best, k, g.k)), g -> g.k)"""
    one = f"transform(array({span}), d -> {draw})[0]"
    return F.expr(f"""aggregate(quotas, named_struct('pop', total, 'take', total - total div 2, 'out', cast(array() as array<bigint>)),
        (s, q) -> transform(array({one}), x -> named_struct('pop', s.pop - q, 'take', s.take - x, 'out', concat(s.out, array(x))))[0], s -> s.out)""")


def split_tree(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """shard, quotas for 2**levels shards, from one row with `quotas`, an array of block numbers by source."""
    total = F.aggregate("quotas", F.lit(0).cast("long"), lambda a, q: a + q)
    nodes = quotas.select(F.lit(0).cast("long").alias("node"), "quotas")
    for level in range(levels):
        at = nodes.withColumn("total", total).withColumn("left", _left_share(seed * 64 + level))
        rest = F.zip_with("quotas", "left", lambda q, x: q - x)
        nodes = at.select(F.explode(F.array(F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("quotas")), F.struct((F.col("node") * 2 + 1).alias("node"), rest.alias("quotas")))).alias("n")).select("n.*")
    return nodes.withColumnRenamed("node", "shard")


def block_of(doc_id: Column, size: Column, n_blocks: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), doc_id, size), n_blocks)


def make_plan(thin: DataFrame, block_words: int = 16_384, shard_blocks: int = 64, seed: int = 1, most_blocks: int = 65_536, most_levels: int = 12) -> Plan:
    """What each block gives, and to which shards; thin: doc_id, source, size."""
    sources = targets(thin.groupBy("source").agg(F.sum("size").alias("source_size")))
    want = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(want / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    n_blocks = F.least(F.lit(most_blocks), F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words))).cast("long")
    sources = stored(sources.withColumn("passes", passes).withColumn("rest", want - passes * F.col("source_size")).withColumn("n_blocks", n_blocks))

    placed = thin.join(sources.select("source", "ix", "n_blocks"), thin["source"].eqNullSafe(sources["source"])).select("ix", block_of(F.col("doc_id"), F.col("size"), F.col("n_blocks"), seed).alias("block"), "size")
    blocks = placed.groupBy("ix", "block").agg(F.sum("size").alias("words")).join(sources.select("ix", "passes", "rest"), "ix")
    order = Window.partitionBy("ix").orderBy(F.xxhash64(F.lit(seed), F.lit("last"), "ix", "block"), "block").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("words").over(order), F.lit(0))
    blocks = stored(blocks.withColumn("last", F.least(F.col("words"), F.greatest(F.lit(0), F.col("rest") - before))))

    in_pass = F.filter(F.sequence(F.lit(0), F.col("passes")), lambda p: (p < F.col("passes")) | (F.col("last") > 0))
    name = F.when(F.col("pass") < F.col("passes"), F.col("pass").cast("string")).otherwise("last")
    draws = blocks.select("ix", "block", "passes", F.explode(in_pass).alias("pass")).withColumn("perm", F.xxhash64(F.lit(seed), name, "ix", "block"))
    draws = stored(draws.withColumn("j", F.row_number().over(Window.partitionBy("ix").orderBy("pass", "perm", "block"))).select("ix", "block", "pass", "j"))
    n = draws.count()
    levels = min(most_levels, max(0, math.floor(math.log2(n / shard_blocks)))) if n else 0

    per_source = draws.groupBy("ix").agg(F.count("*").alias("n"))
    row = per_source.agg(F.array_sort(F.collect_list(F.struct("ix", "n"))).alias("by"))
    shards = split_tree(row.select(F.transform("by", lambda b: b["n"]).alias("quotas"), "by"), levels, seed)
    shards = shards.select("shard", F.posexplode("quotas").alias("pos", "n"))
    ranks = row.select(F.posexplode(F.transform("by", lambda b: b["ix"])).alias("pos", "ix"))
    shards = stored(shards.join(ranks, "pos").select("shard", "ix", "n"))
    start = F.coalesce(F.sum("n").over(Window.partitionBy("ix").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slots = shards.withColumn("start", start).filter("n > 0").select("ix", "shard", F.explode(F.sequence(F.col("start") + 1, F.col("start") + F.col("n"))).alias("j"))
    of_block = draws.join(slots, ["ix", "j"]).groupBy("ix", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("pass", "shard"))), lambda d: d["shard"]).alias("shards"))
    return Plan(sources, stored(blocks.join(of_block, ["ix", "block"], "left").select("ix", "block", "words", "last", "shards")), seed)


def mix(docs: DataFrame, plan: Plan, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None) -> DataFrame:
    """row (all columns of docs), size, source_size, target, taken, shards (one for each pass that takes the row), place
    (the order of a shard's documents)."""
    size = words_in(F.col("text")) if size is None else size
    src, blk = plan.sources.withColumnRenamed("source", "_source"), plan.blocks
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("_id"), F.col(source_col).alias("_from"), size.alias("size"))
    rows = rows.join(src, F.col("_from").eqNullSafe(F.col("_source")), "left").withColumn("block", block_of(F.col("_id"), F.col("size"), F.col("n_blocks"), plan.seed))
    rows = rows.join(blk, ["ix", "block"], "left")
    cut = (F.col("last") > 0) & (F.col("last") < F.col("words"))
    order = Window.partitionBy("ix", "block").orderBy(F.xxhash64(F.lit(plan.seed), F.lit("cut"), "_id"), "_id", "size", F.xxhash64("row")).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("size").over(order), F.lit(0))
    in_part = rows.filter(cut).withColumn("once", F.least(F.col("size"), F.greatest(F.lit(0), F.col("last") - before)))
    whole = rows.filter(~cut | cut.isNull()).withColumn("once", F.when(F.col("last") > 0, F.col("size")).otherwise(0))
    out = whole.unionByName(in_part)
    taken = (F.coalesce(F.col("passes"), F.lit(0)) * F.col("size") + F.col("once")).cast("long")
    return out.select("row", "size", "source_size", "target", taken.alias("taken"), "shards", F.xxhash64(F.lit(plan.seed), F.lit("place"), "_id").alias("place"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **how) -> DataFrame:
    """The mix of a whole table, without its texts: doc_id, source, size, source_size, target, taken, shards, place."""
    thin = stored(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words_in(F.col(text_col)).alias("size")))
    out = mix(thin, make_plan(thin, **how), size=F.col("size"))
    return out.select("row.doc_id", "row.source", "size", "source_size", "target", "taken", "shards", "place")
