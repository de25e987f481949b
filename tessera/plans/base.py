"""The registry of named queries, and the fixtures that bind the driver's tables to what operators expect.

Fixtures exist twice, as DataFrames and as SQL, with the same definitions. Prices are divided by a prime, so that the six
decimals to which results are rounded never end in an exact half; means that tie are rounded far below that.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.expr import bucket
from tessera.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

ENDPOINTS = (1, 2, 3, 4)
MODELS = ("m1", "m2", "m3")
SEEDS = (1, 2, 3)
RUNS = [(m, s) for m in MODELS for s in SEEDS]


def sql_bucket(text: str, n: int) -> str:
    return f"(('0x' || substr(md5(CAST({text} AS VARCHAR)), 1, 8))::BIGINT % {n})"


#: Common table expressions; each may name earlier ones.
CTES = {
    "long_": """SELECT l_orderkey AS entity, l_linenumber AS endpoint, avg(l_extendedprice) / 9973 AS y,
        min(l_extendedprice * (1 - l_discount)) / 9973 AS lower, max(l_extendedprice * (1 + l_tax)) / 9973 AS upper,
        stddev_samp(l_extendedprice) / 9973 AS sd, round(avg(l_quantity), 9) AS qty, round(avg(l_tax), 9) + 0.0 AS tax
        FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1, 2""",
    "wide_": "SELECT entity, " + ", ".join(f"max(CASE WHEN endpoint = {e} THEN y END) AS y{e}" for e in ENDPOINTS) + " FROM long_ GROUP BY 1",
    "props_": """SELECT o_orderkey AS entity, o_custkey AS grp, o_orderstatus AS status, o_orderpriority AS priority, o_totalprice AS total, c_acctbal AS balance,
        c_nationkey AS nation, c_mktsegment AS segment FROM orders JOIN customer ON o_custkey = c_custkey""",
    "folds_": f"SELECT o_orderkey AS entity, {sql_bucket('o_orderkey', 5)} AS random_fold, {sql_bucket('o_custkey', 5)} AS group_fold FROM orders",
    "means_": "SELECT endpoint, avg(y) AS mean_y FROM long_ GROUP BY 1",
    "pred_": "SELECT l.entity, l.endpoint, f.random_fold AS fold, m.model, s.seed, l.y, l.lower, l.upper, l.sd, CASE m.model WHEN 'm1' THEN mean_y "
    f"WHEN 'm2' THEN l.y + ({sql_bucket("concat(l.entity, '|', l.endpoint, '|', s.seed)", 2001)} - 1000) / CAST(1999 AS DOUBLE) "
    "ELSE l.qty / 5 + s.seed / CAST(100 AS DOUBLE) END AS p FROM long_ l JOIN folds_ f ON l.entity = f.entity JOIN means_ ON l.endpoint = means_.endpoint "
    "CROSS JOIN (VALUES ('m1'), ('m2'), ('m3')) m(model) CROSS JOIN (VALUES (1), (2), (3)) s(seed)",
    "vec_": "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings",
    "toks_": """SELECT DISTINCT doc_id, w FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS w FROM documents) WHERE w <> ''""",
    "sims_": """SELECT a.doc_id AS a, b.doc_id AS b, round(count(*) / CAST(min(sa.n) + min(sb.n) - count(*) AS DOUBLE) + 1e-9, 6) AS sim FROM toks_ a JOIN toks_ b ON a.w = b.w AND a.doc_id < b.doc_id
        JOIN (SELECT doc_id, count(*) AS n FROM toks_ GROUP BY 1) sa ON sa.doc_id = a.doc_id JOIN (SELECT doc_id, count(*) AS n FROM toks_ GROUP BY 1) sb ON sb.doc_id = b.doc_id GROUP BY 1, 2""",
}


def with_ctes(sql: str) -> str:
    """Puts the common table expressions that the SQL names before it."""
    needed: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}(?![a-z0-9])", text):
                needed.add(name)
                todo.append(CTES[name])
    head = ", ".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in CTES if n in needed)
    if not head:
        return sql.strip()
    body = sql.strip()
    if body[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {head}, {body[14:]}"
    return f"WITH {head}, {body[4:]}" if body[:5].upper() == "WITH " else f"WITH {head} {body}"


def _predicted(model: str, seed: Column) -> Column:
    noise = (bucket(F.concat_ws("|", "entity", "endpoint", seed), 2001) - 1000) / F.lit(1999.0)
    return {"m1": F.col("mean_y"), "m2": F.col("y") + noise, "m3": F.col("qty") / 5 + seed / F.lit(100.0)}[model]


def run_columns(run: str = "run") -> list[Column]:
    """model and seed of the run with that number."""
    of = F.array(*(F.struct(F.lit(m).alias("model"), F.lit(s).alias("seed")) for m, s in RUNS))
    return [F.element_at(of, F.col(run) + 1)[c].alias(c) for c in ("model", "seed")]


class Fixtures(Tables):
    """The tables, and their bindings (the names of CTES without the last underscore)."""

    @property
    def long(self) -> DataFrame:
        keys = self.lineitem.filter(F.col("l_linenumber") <= 4).groupBy(F.col("l_orderkey").alias("entity"), F.col("l_linenumber").alias("endpoint"))
        return keys.agg(
            (F.avg("l_extendedprice") / 9973).alias("y"),
            (F.min(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / 9973).alias("lower"),
            (F.max(F.col("l_extendedprice") * (1 + F.col("l_tax"))) / 9973).alias("upper"),
            (F.stddev_samp("l_extendedprice") / 9973).alias("sd"),
            F.round(F.avg("l_quantity"), 9).alias("qty"),
            (F.round(F.avg("l_tax"), 9) + F.lit(0.0)).alias("tax"),
        )

    @property
    def wide(self) -> DataFrame:
        """The long table's y by endpoint, in one shuffle: conditional means by entity instead of a pivot of means."""
        rows = self.lineitem.filter(F.col("l_linenumber") <= 4).groupBy(F.col("l_orderkey").alias("entity"))
        return rows.agg(*((F.avg(F.when(F.col("l_linenumber") == e, F.col("l_extendedprice"))) / 9973).alias(f"y{e}") for e in ENDPOINTS))

    @property
    def props(self) -> DataFrame:
        joined = self.orders.join(self.customer, F.col("o_custkey") == F.col("c_custkey"))
        return joined.select(
            F.col("o_orderkey").alias("entity"), F.col("o_custkey").alias("grp"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"),
            F.col("o_totalprice").alias("total"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"),
        )

    @property
    def folds(self) -> DataFrame:
        return self.orders.select(F.col("o_orderkey").alias("entity"), bucket("o_orderkey", 5).alias("random_fold"), bucket("o_custkey", 5).alias("group_fold"))

    @property
    def pred(self) -> DataFrame:
        rows = self._joined.withColumn("model", F.explode(F.array(*map(F.lit, MODELS)))).withColumn("seed", F.explode(F.array(*map(F.lit, SEEDS))))
        p = F.when(F.col("model") == "m1", _predicted("m1", F.col("seed"))).when(F.col("model") == "m2", _predicted("m2", F.col("seed"))).otherwise(_predicted("m3", F.col("seed")))
        return rows.select("entity", "endpoint", F.col("random_fold").alias("fold"), "model", "seed", "y", "lower", "upper", "sd", p.alias("p"))

    @property
    def _joined(self) -> DataFrame:
        long = self.long
        means = long.groupBy("endpoint").agg(F.avg("y").alias("mean_y"))
        return long.join(self.folds, "entity").join(means, "endpoint")

    @property
    def units(self) -> DataFrame:
        """pred with a row for each measurement: the prediction of run k (RUNS) is p<k>."""
        p = [_predicted(m, F.lit(s)).alias(f"p{k}") for k, (m, s) in enumerate(RUNS)]
        return self._joined.select("entity", "endpoint", F.col("random_fold").alias("fold"), "y", "lower", "upper", "sd", *p)

    @property
    def vec(self) -> DataFrame:
        return self.embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))

    @property
    def ranges(self) -> int:
        """Ranges by which ranks of the measurements are dealt out: one for each GB of the table, by the planner's estimate."""
        size = int(str(self.raw("lineitem")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        return 1 + size // (1 << 30)

    @property
    def segments(self) -> int:
        """Ranges of the lines along which ranks, distributions and offsets run."""
        return 8 * self.ranges

    @property
    def word_sets(self) -> DataFrame:
        """doc_id, and its distinct words as an array w."""
        from tessera.functions.expr import words

        return self.documents.select("doc_id", words("text").alias("w"))

    @property
    def toks(self) -> DataFrame:
        from tessera.functions.expr import words

        return self.documents.select("doc_id", F.explode(words("text")).alias("w"))


def query(sql: str | None = None, name: str | None = None):
    """Registers build(fixtures) as a query, with its SQL."""

    def register(build: Callable[[Fixtures], DataFrame]):
        key = name or build.__name__
        if key in QUERIES:
            raise ValueError(f"two queries named {key}")
        QUERIES[key] = lambda spark, sf_dir: build(Fixtures(spark, sf_dir))
        if sql:
            SQL[key] = with_ctes(sql)
        return build

    return register
