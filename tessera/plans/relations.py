"""Joins, set operations, sorts and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.expr import close, identity_levels, r6
from tessera.operators import expectations, joins, reshape, sets
from tessera.operators.scan import Carried, Line
from tessera.plans.base import ENDPOINTS, Fixtures, query
from tessera.sources.work import stored


@query("SELECT l.entity, l.endpoint, round(l.y, 6) + 0.0 AS y, c.n AS n, f.random_fold AS fold, p.grp FROM long_ l JOIN (SELECT l_orderkey AS entity, l_linenumber AS endpoint, count(*) AS n FROM lineitem GROUP BY 1, 2) c ON c.entity = l.entity AND c.endpoint = l.endpoint JOIN folds_ f ON l.entity = f.entity JOIN props_ p ON p.entity = l.entity")
def join_inner_validated(t: Fixtures) -> DataFrame:
    keys = ["entity", "endpoint"]
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("entity"), F.col("l_linenumber").alias("endpoint")).agg(F.count("*").alias("n"))
    out = joins.validated_join(t.long.select(*keys, r6("y").alias("y")), lines, keys, "inner", "one_to_one")
    about = joins.validated_join(t.folds.select("entity", F.col("random_fold").alias("fold")), t.props.select("entity", "grp"), ["entity"], "inner", "one_to_one")
    return joins.validated_join(out, about, ["entity"], "inner", "many_to_one")


@query("SELECT o_orderkey AS entity, round(y1, 6) + 0.0 AS y1, round(y2, 6) + 0.0 AS y2 FROM orders LEFT JOIN wide_ ON o_orderkey = entity")
def join_left_sparse(t: Fixtures) -> DataFrame:
    rows = t.orders.select(F.col("o_orderkey").alias("entity"))
    return joins.validated_join(rows, t.wide.select("entity", r6("y1").alias("y1"), r6("y2").alias("y2")), ["entity"], "left", "one_to_one")


@query("SELECT o_orderkey, o_custkey, c_mktsegment, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def join_many_to_one(t: Fixtures) -> DataFrame:
    customers = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", F.col("c_nationkey").alias("n_nationkey"))
    out = joins.validated_join(t.orders.select("o_orderkey", "o_custkey"), customers, ["o_custkey"], "left")
    return joins.validated_join(out, t.nation.select("n_nationkey", "n_name"), ["n_nationkey"], "left").drop("n_nationkey")


@query("""WITH a AS (SELECT DISTINCT o_custkey AS id, 1 AS l FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS id, 1 AS r FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT coalesce(a.id, b.id) AS id, CASE WHEN l IS NULL THEN 'right_only' WHEN r IS NULL THEN 'left_only' ELSE 'both' END AS side FROM a FULL OUTER JOIN b ON a.id = b.id""")
def reconcile_full_outer(t: Fixtures) -> DataFrame:
    o = t.orders
    a = o.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id")).distinct()
    b = o.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("id")).distinct()
    return joins.reconcile(a, b, ["id"])


_LEVELS = {
    "raw": "text",
    "trimmed": "trim(text)",
    "lowered": "lower(trim(text))",
    "collapsed": "regexp_replace(lower(trim(text)), '[ \\t\\n\\r]+', ' ', 'g')",
    "bare": "regexp_replace(regexp_replace(lower(trim(text)), '[ \\t\\n\\r]+', ' ', 'g'), '[^a-z0-9 ]', '', 'g')",
}


@query(
    " UNION ALL ".join(
        f"SELECT '{n}' AS level, (SELECT count(*) FROM (SELECT DISTINCT {e} AS k FROM documents WHERE lang = 'en')) AS n_left, "
        f"(SELECT count(*) FROM (SELECT DISTINCT {e} AS k FROM documents WHERE lang <> 'en')) AS n_right, "
        f"(SELECT count(*) FROM (SELECT {e} AS k FROM documents WHERE lang = 'en' INTERSECT SELECT {e} FROM documents WHERE lang <> 'en')) AS shared"
        for n, e in _LEVELS.items()
    )
)
def cross_split_overlap(t: Fixtures) -> DataFrame:
    # One pass: hashes of all levels, one aggregation over (level, identity), one over levels.
    levels = F.explode(F.array(*(F.struct(F.lit(n).alias("level"), F.sha2(c, 256).alias("k")) for n, c in identity_levels("text").items())))
    rows = t.documents.select((F.col("lang") == "en").cast("int").alias("left"), levels.alias("e")).select("left", "e.*")
    sides = rows.groupBy("level", "k").agg(F.max("left").alias("l"), F.max(1 - F.col("left")).alias("r"))
    return sides.groupBy("level").agg(F.count_if(F.col("l") == 1).alias("n_left"), F.count_if(F.col("r") == 1).alias("n_right"), F.count_if((F.col("l") == 1) & (F.col("r") == 1)).alias("shared"))


@query("""WITH a AS (SELECT l_orderkey AS entity, sum(l_extendedprice) AS total FROM lineitem GROUP BY 1)
SELECT count(*) AS n, count(*) FILTER (WHERE abs(total - o_totalprice) <= 0.01 + 1e-5 * abs(o_totalprice)) AS agree, round(max(abs(total - o_totalprice)), 6) + 0.0 AS max_gap, round(avg(abs(total - o_totalprice)), 6) + 0.0 AS mean_gap
FROM a JOIN orders ON entity = o_orderkey""")
def cross_file_agreement(t: Fixtures) -> DataFrame:
    a = t.lineitem.groupBy(F.col("l_orderkey").alias("entity")).agg(F.sum("l_extendedprice").alias("total_file"))
    both = a.join(t.orders.select(F.col("o_orderkey").alias("entity"), F.col("o_totalprice").alias("total_table")), "entity")
    gap = F.abs(F.col("total_file") - F.col("total_table"))
    return both.agg(F.count("*").alias("n"), F.count_if(close(F.col("total_file"), F.col("total_table"), 0.01)).alias("agree"), r6(F.max(gap)).alias("max_gap"), r6(F.avg(gap)).alias("mean_gap"))


@query("SELECT s_suppkey, s_name, coalesce(n_name, 'unknown') AS nation FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON s_nationkey = n_nationkey")
def lookup_map(t: Fixtures) -> DataFrame:
    table = t.nation.filter("n_regionkey <> 2").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("nation"))
    return joins.lookup(t.supplier, table, "s_nationkey", "nation", F.lit("unknown")).select("s_suppkey", "s_name", "nation")


@query("""SELECT c.c_custkey AS ordinal, c.c_name AS name, e.e AS endpoint, coalesce(x.n, 0) AS n FROM customer c CROSS JOIN (VALUES (1), (2), (3), (4)) e(e)
LEFT JOIN (SELECT o_custkey, endpoint, count(*) AS n FROM long_ JOIN orders ON entity = o_orderkey GROUP BY 1, 2) x ON x.o_custkey = c.c_custkey AND x.endpoint = e.e""")
def expected_key_coverage(t: Fixtures) -> DataFrame:
    expected = t.customer.select(F.col("c_custkey").alias("ordinal"), F.col("c_name").alias("name"), F.explode(F.array(*map(F.lit, ENDPOINTS))).alias("endpoint"))
    seen = t.long.select("entity", "endpoint").join(t.orders.select(F.col("o_orderkey").alias("entity"), F.col("o_custkey").alias("ordinal")), "entity").groupBy("ordinal", "endpoint").agg(F.count("*").alias("n"))
    return expected.join(seen, ["ordinal", "endpoint"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


@query("""SELECT a.c AS source, b.c AS segment, d.c AS kind, concat_ws('_', a.c, b.c, d.c) AS run, CAST(row_number() OVER (ORDER BY a.c, b.c, d.c) - 1 AS BIGINT) AS job
FROM (SELECT DISTINCT source AS c FROM documents WHERE source IS NOT NULL) a, (SELECT DISTINCT c_mktsegment AS c FROM customer WHERE c_mktsegment IS NOT NULL) b, (SELECT DISTINCT event_type AS c FROM events WHERE event_type IS NOT NULL) d""")
def grid_expansion(t: Fixtures) -> DataFrame:
    return grid({"source": t.documents.select("source"), "segment": t.customer.select("c_mktsegment"), "kind": t.events.select("event_type")})


def grid(axes: dict[str, DataFrame]) -> DataFrame:
    """All combinations of the distinct values of tables of one column, numbered as an array job is decoded: by division and modulo of the job
    number. Values are numbered, not rows; a job finds its value of each axis by an equal join on its place there."""
    places, total = {}, 1
    for name, values in axes.items():
        values = values.toDF(name).filter(F.col(name).isNotNull()).distinct()
        places[name] = stored(Line(values, [], [name], 8).carry(_n=Carried("count", F.col(name), own=False)).done().withColumn("_at", F.coalesce("_n", F.lit(0)).cast("long")).drop("_n"))
        total *= places[name].count()
    out, below = next(iter(places.values())).sparkSession.range(total).withColumnRenamed("id", "job"), total
    for name, values in places.items():
        n = max(1, values.count())
        below //= n
        out = out.withColumn("_at", F.floor(F.col("job") / max(1, below)) % n).join(values, "_at").drop("_at")
    return out.select(*axes, F.concat_ws("_", *axes).alias("run"), "job")


@query("""SELECT l.l_orderkey, l.l_linenumber, l.n AS lines, round(e.total, 6) + 0.0 AS ext_total FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2) l
LEFT JOIN (SELECT l_orderkey AS k1, l_linenumber AS k2, max(l_extendedprice) / 7 AS total FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2) e ON l.l_orderkey = e.k1 AND l.l_linenumber = e.k2""")
def join_composite_key(t: Fixtures) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber"]
    rows = t.lineitem.groupBy(*keys).agg(F.count("*").alias("lines"))
    external = t.lineitem.filter("l_returnflag = 'A'").groupBy(F.col("l_orderkey").alias("k1"), F.col("l_linenumber").alias("k2")).agg(r6(F.max("l_extendedprice") / 7).alias("total"))
    external = external.withColumnsRenamed({"k1": "l_orderkey", "k2": "l_linenumber", "total": "ext_total"})
    return joins.validated_join(rows, external, keys, "left", "one_to_one", check=False)  # both sides are grouped by the key


# Sets


@query("""WITH top AS (SELECT a, b FROM sims_ WHERE sim >= 0.6), m AS (SELECT a AS doc_id FROM top UNION SELECT b FROM top)
SELECT d.doc_id, m.doc_id IS NOT NULL AS member FROM documents d LEFT JOIN m ON d.doc_id = m.doc_id""")
def pair_members(t: Fixtures) -> DataFrame:
    top = sets.similar_sets(t.word_sets, "doc_id", "w", 0.6, links=True)
    members = top.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct().withColumn("member", F.lit(True))
    return t.documents.select("doc_id").join(members, "doc_id", "left").withColumn("member", F.coalesce("member", F.lit(False)))


@query("""WITH a AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_totalprice > 400000), b AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'P')
SELECT id, 'left' AS side FROM (SELECT id FROM a EXCEPT SELECT id FROM b) UNION ALL SELECT id, 'right' FROM (SELECT id FROM b EXCEPT SELECT id FROM a)""")
def key_set_difference(t: Fixtures) -> DataFrame:
    a = t.orders.filter("o_totalprice > 400000").select(F.col("o_custkey").alias("id"))
    b = t.orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id"))
    return expectations.key_difference(a, b, ["id"])


# Top-k


@query("""SELECT endpoint, CAST(rank AS INTEGER) AS rank, entity, round(delta, 6) + 0.0 AS delta FROM (SELECT endpoint, entity, upper - lower AS delta, row_number() OVER (PARTITION BY endpoint ORDER BY upper - lower DESC, entity) AS rank FROM long_) WHERE rank <= 20""")
def top_errors_per_group(t: Fixtures) -> DataFrame:
    rows = t.long.select("endpoint", "entity", (F.col("upper") - F.col("lower")).alias("delta"))
    rank = F.row_number().over(Window.partitionBy("endpoint").orderBy(F.desc("delta"), "entity"))
    return rows.withColumn("rank", rank).filter("rank <= 20").withColumn("delta", r6("delta"))


@query("SELECT a, b, sim FROM sims_ ORDER BY sim DESC, a, b LIMIT 50")
def topk_pairs(t: Fixtures) -> DataFrame:
    return sets.top_sets(t.word_sets, "doc_id", "w", 50)


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal) DESC, c_custkey LIMIT 4")
def topk_abs(t: Fixtures) -> DataFrame:
    return t.customer.select("c_custkey", "c_acctbal").orderBy(F.desc(F.abs("c_acctbal")), "c_custkey").limit(4)


@query("""SELECT event_type, user_id, n, CAST(rank AS INTEGER) AS rank FROM (SELECT event_type, user_id, count(*) AS n, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, user_id) AS rank FROM events GROUP BY 1, 2) WHERE rank <= 3""")
def top_users_per_type(t: Fixtures) -> DataFrame:
    counts = t.events.groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("n"), "user_id"))
    return counts.withColumn("rank", rank).filter("rank <= 3")


@query("SELECT CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS INTEGER) AS code, p_type, count(*) AS n FROM part GROUP BY p_type")
def dense_codes(t: Fixtures) -> DataFrame:
    return reshape.index_names(t.part.groupBy("p_type").agg(F.count("*").alias("n")), "p_type", "code")
