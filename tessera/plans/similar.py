"""Similarity joins, nearest neighbours, components, folds and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.expr import bucket, r6, rounded
from tessera.operators import folds, graph, profile, ranks, reshape, sets, similarity, stats
from tessera.plans.base import Fixtures, query, sql_bucket
from tessera.plans.profiles import _SQL_VECTOR
from tessera.plans.scans import t_counts
from tessera.plans.statistics import sql_pearson
from tessera.sources.work import stored

_COS = "round(list_cosine_similarity({a}.v, {b}.v), 9)"
#: Nearest neighbours as CTE text: queries vec_id % 5 = 0, references the others; and within the whole set.
_NN = f"""nn AS (SELECT q.vec_id AS id, arg_min(r.vec_id, (-{_COS.format(a='q', b='r')}, r.vec_id)) AS neighbour, max({_COS.format(a='q', b='r')}) AS sim FROM vec_ q, vec_ r WHERE q.vec_id % 5 = 0 AND r.vec_id % 5 <> 0 GROUP BY 1)"""
_NW = f"""nw AS (SELECT q.vec_id AS id, arg_min(r.vec_id, (-{_COS.format(a='q', b='r')}, r.vec_id)) AS neighbour, max({_COS.format(a='q', b='r')}) AS sim FROM vec_ q, vec_ r WHERE q.vec_id <> r.vec_id GROUP BY 1)"""
_L1 = "round(1 / (1 + list_sum(list_transform(range(1, 65), lambda i: abs({a}.v[i] - {b}.v[i]))) / 12), 9)"


def vectors(t: Fixtures) -> DataFrame:
    return t.vec.select(F.col("vec_id").alias("id"), "v", "label")


def halves(t: Fixtures | DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries and references, of the fixtures or of a table of vectors."""
    v = t if isinstance(t, DataFrame) else vectors(t)
    return v.filter("id % 5 = 0"), v.filter("id % 5 <> 0")


def labelled(t: Fixtures) -> DataFrame:
    return vectors(t).withColumn("label", F.col("label").cast("double"))


_PAIRS = f"vp AS (SELECT p.vec_id AS a, q.vec_id AS b, {_COS.format(a='p', b='q')} AS sim, CAST(abs(p.label - q.label) AS DOUBLE) AS delta FROM vec_ p JOIN vec_ q ON p.vec_id < q.vec_id)"


@query("SELECT a, b, sim FROM sims_")
def tanimoto_sets(t: Fixtures) -> DataFrame:
    return similarity.set_pairs(t.toks, "doc_id", "w")


@query("SELECT a, b, sim FROM sims_ WHERE sim >= 0.6")
def similarity_edges(t: Fixtures) -> DataFrame:
    return sets.similar_sets(t.word_sets, "doc_id", "w", 0.6)


@query("""WITH c AS (SELECT o_custkey AS id, p_brand AS name, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), q AS (SELECT id, sum(n * n) AS q FROM c GROUP BY 1),
d AS (SELECT x.id AS a, y.id AS b, sum(x.n * y.n) AS dot FROM c x JOIN c y ON x.name = y.name AND x.id < y.id GROUP BY 1, 2)
SELECT a, b, round(CAST(dot AS DOUBLE) / (qa.q + qb.q - dot), 6) + 0.0 AS sim FROM d JOIN q qa ON qa.id = a JOIN q qb ON qb.id = b""")
def tanimoto_counts(t: Fixtures) -> DataFrame:
    return similarity.count_pairs(t_counts(t), "id", "name", "n", up=0.0)


@query(f"SELECT q.vec_id AS a, r.vec_id AS b, {_L1.format(a='q', b='r').replace(', 9)', ', 6)')} + 0.0 AS sim FROM vec_ q JOIN vec_ r ON q.vec_id < r.vec_id AND q.label = r.label")
def l1_score(t: Fixtures) -> DataFrame:
    v = vectors(t)
    return similarity.dense_pairs(v, v, "l1", upper=True, same=("label", "label"), up=0.0)


@query(f"WITH {_PAIRS} SELECT count(*) AS pairs, (SELECT count(*) * (count(*) - 1) // 2 FROM vec_) AS expected, round(avg(sim), 6) + 0.0 AS mean, round(max(sim), 6) + 0.0 AS max, round(avg(delta), 6) + 0.0 AS mean_delta FROM vp")
def all_pairs_stats(t: Fixtures) -> DataFrame:
    n = t.vec.agg((F.count("*") * (F.count("*") - 1) / 2).cast("long").alias("expected"))
    g = similarity.pair_totals(labelled(t), "label")
    return rounded(g.join(F.broadcast(n)).select("pairs", "expected", "mean", "max", "mean_delta"))  # one row each


@query(f"WITH {_NN} SELECT id, neighbour, round(sim, 6) + 0.0 AS sim FROM nn")
def nn_cross(t: Fixtures) -> DataFrame:
    return rounded(similarity.dense_nearest(*halves(t)))


@query(f"WITH {_NW} SELECT id, neighbour, round(sim, 6) + 0.0 AS sim FROM nw")
def nn_within(t: Fixtures) -> DataFrame:
    v = vectors(t)
    return rounded(similarity.dense_nearest(v, v, other=True))


_AT = [k / 10 for k in range(1, 10)]


@query(f"WITH {_NN} SELECT {_SQL_VECTOR.format(v='sim')}, " + ", ".join(f"round(avg(CASE WHEN sim >= {a} THEN 1 ELSE 0 END), 6) + 0.0 AS at_{round(10 * a)}" for a in _AT) + " FROM nn")
def nn_threshold_fractions(t: Fixtures) -> DataFrame:
    nn = similarity.dense_nearest(*halves(t))
    return rounded(profile.stat_vector(nn.select("sim"), [], "sim", *(F.avg((F.col("sim") >= a).cast("int")).alias(f"at_{round(10 * a)}") for a in _AT)))


@query(f"""WITH {_PAIRS} SELECT t.t AS threshold, count(*) AS n, round(avg(delta), 6) + 0.0 AS mean, round(median(delta), 6) + 0.0 AS median, round(quantile_cont(delta, 0.25), 6) + 0.0 AS q1, round(quantile_cont(delta, 0.75), 6) + 0.0 AS q3,
round(quantile_cont(delta, 0.75) - quantile_cont(delta, 0.25), 6) + 0.0 AS iqr, count(*) FILTER (WHERE delta >= 1) AS cliffs_1, count(*) FILTER (WHERE delta >= 2) AS cliffs_2 FROM vp, (VALUES (0.1::DOUBLE), (0.2), (0.3), (0.4)) t(t) WHERE sim >= t.t GROUP BY 1""")
def cliff_thresholds(t: Fixtures) -> DataFrame:
    at = [0.1, 0.2, 0.3, 0.4]
    cells = similarity.pair_cells(labelled(t), at, "label")
    passed = cells.withColumn("threshold", F.explode(F.slice(F.array(*map(F.lit, at)), F.lit(1), F.col("passed"))))
    return rounded(similarity.cell_statistics(passed, ["threshold"]))


_BINS = [-1.0, 0.0, 0.1, 0.2, 0.3, 0.4, 1.000001]


@query(f"""WITH {_PAIRS}, b AS (SELECT * FROM (VALUES """ + ", ".join(f"('{k}', {a}::DOUBLE, {b}::DOUBLE)" for k, (a, b) in enumerate(zip(_BINS, _BINS[1:]))) + """) b(bin, low, high))
SELECT b.bin, count(vp.a) AS n, round(avg(delta), 6) + 0.0 AS mean, round(median(delta), 6) + 0.0 AS median FROM b LEFT JOIN vp ON sim >= low AND sim < high GROUP BY 1""")
def binned_pair_stats(t: Fixtures) -> DataFrame:
    labels = [str(k) for k in range(len(_BINS) - 1)]
    cells = similarity.pair_cells(labelled(t), _BINS, "label").filter(F.col("passed") < len(_BINS)).withColumn("bin", (F.col("passed") - 1).cast("string"))
    stats_ = similarity.cell_statistics(cells, ["bin"]).select("bin", "n", "mean", "median")
    bins = t.spark.range(len(labels)).select(F.col("id").cast("string").alias("bin"))
    return rounded(bins.join(stats_, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long")))


@query(f"WITH {_PAIRS}, r AS (SELECT *, abs(p.label - 0) AS e, row_number() OVER (PARTITION BY p.label ORDER BY delta DESC, sim DESC, a, b) AS rank FROM vp JOIN vec_ p ON p.vec_id = a WHERE sim >= 0.25) SELECT label AS endpoint, CAST(rank AS INTEGER) AS rank, a, b, round(sim, 6) + 0.0 AS sim, delta FROM r WHERE rank <= 10")
def top_cliff_pairs(t: Fixtures) -> DataFrame:
    rows = similarity.top_deltas(labelled(t), "label", 0.25, 10).withColumn("endpoint", F.col("endpoint").cast("int"))
    rank = F.row_number().over(Window.partitionBy("endpoint").orderBy(F.desc("delta"), F.desc("sim"), "a", "b"))
    return rows.withColumn("rank", rank).filter("rank <= 10").select("endpoint", "rank", "a", "b", r6("sim").alias("sim"), "delta")


_SECOND = f"n2 AS (SELECT q.vec_id AS id, arg_min(r.vec_id, (-{_L1.format(a='q', b='r')}, r.vec_id)) AS neighbour, max({_L1.format(a='q', b='r')}) AS sim FROM vec_ q, vec_ r WHERE q.vec_id % 5 = 0 AND r.vec_id % 5 <> 0 GROUP BY 1)"


def two_representations(t: Fixtures) -> DataFrame:
    """Nearest neighbours by two scores, side by side."""
    q, r = halves(t)
    a, b = similarity.dense_nearest(q, r), similarity.dense_nearest(q, r, "l1")
    return a.join(b.withColumnsRenamed({"neighbour": "neighbour_2", "sim": "sim_2"}), "id")


@query(f"WITH {_NN}, {_SECOND}, k AS (SELECT nn.neighbour = n2.neighbour AS same, rank() OVER (ORDER BY nn.sim) + (count(*) OVER (PARTITION BY nn.sim) - 1) / CAST(2 AS DOUBLE) AS a, rank() OVER (ORDER BY n2.sim) + (count(*) OVER (PARTITION BY n2.sim) - 1) / CAST(2 AS DOUBLE) AS b FROM nn JOIN n2 ON nn.id = n2.id) SELECT count(*) AS n, round(avg(CASE WHEN same THEN 1 ELSE 0 END), 6) + 0.0 AS same_neighbour, {sql_pearson('a', 'b')} AS rho FROM k")
def representation_agreement(t: Fixtures) -> DataFrame:
    rows = two_representations(t)
    rho = stats.spearman_by(rows, [], "sim", "sim_2")
    same = rows.agg(r6(F.avg((F.col("neighbour") == F.col("neighbour_2")).cast("int"))).alias("same_neighbour"))
    return rounded(rho.join(F.broadcast(same)).select("n", "same_neighbour", "rho"))  # one row each


@query(f"WITH {_NN}, {_SECOND} SELECT nn.id, nn.neighbour, n2.neighbour AS neighbour_2, {_L1.format(a='q', b='x').replace(', 9)', ', 6)')} + 0.0 AS first_in_second, {_COS.format(a='q', b='y').replace(', 9)', ', 6)')} + 0.0 AS second_in_first, nn.neighbour = n2.neighbour AS same FROM nn JOIN n2 ON nn.id = n2.id JOIN vec_ q ON q.vec_id = nn.id JOIN vec_ x ON x.vec_id = nn.neighbour JOIN vec_ y ON y.vec_id = n2.neighbour")
def cross_representation_lookup(t: Fixtures) -> DataFrame:
    v = vectors(t).select("id", "v")
    rows = two_representations(t).join(v, "id").join(v.withColumnsRenamed({"id": "neighbour", "v": "x"}), "neighbour").join(v.withColumnsRenamed({"id": "neighbour_2", "v": "y"}), "neighbour_2")
    total = lambda a, f: F.aggregate(a, F.lit(0.0), f)
    l1 = total(F.zip_with("v", "x", lambda a, b: F.abs(a - b)), lambda s, d: s + d)
    norm = lambda c: F.sqrt(total(c, lambda s, d: s + d * d))
    cos = total(F.zip_with("v", "y", lambda a, b: a * b), lambda s, d: s + d) / (norm("v") * norm("y"))
    return rounded(rows.select("id", "neighbour", "neighbour_2", (1 / (1 + l1 / 12)).alias("first_in_second"), cos.alias("second_in_first"), (F.col("neighbour") == F.col("neighbour_2")).alias("same")))


@query(f"""WITH {_NN}, {_SECOND}, s AS (SELECT 'cosine' AS representation, sim FROM nn UNION ALL SELECT 'l1', sim FROM n2) SELECT representation, count(*) AS n, round(avg(sim), 6) + 0.0 AS mean, round(median(sim), 6) + 0.0 AS median, round(quantile_cont(sim, 0.05), 6) + 0.0 AS p05, round(quantile_cont(sim, 0.95), 6) + 0.0 AS p95, round(min(sim), 6) + 0.0 AS min, round(max(sim), 6) + 0.0 AS max FROM s GROUP BY 1""")
def nn_score_summary(t: Fixtures) -> DataFrame:
    rows = two_representations(t).select(F.col("sim").alias("cosine"), F.col("sim_2").alias("l1"))
    long = reshape.unpivot_values(rows, [], ["cosine", "l1"], "representation", "sim")
    return rounded(long.groupBy("representation").agg(F.count("*").alias("n"), F.avg("sim").alias("mean"), F.median("sim").alias("median"), *profile.quantiles("sim", (0.05, 0.95)), F.min("sim").alias("min"), F.max("sim").alias("max")))


@query(f"""WITH {_NN}, i AS (SELECT q.vec_id AS id, max({_COS.format(a='q', b='r')}) AS internal FROM vec_ q, vec_ r WHERE q.vec_id % 5 = 0 AND r.vec_id % 5 = 0 AND q.vec_id <> r.vec_id GROUP BY 1),
v AS (SELECT r.vec_id AS ref, max({_COS.format(a='q', b='r')}) AS sim FROM vec_ q, vec_ r WHERE q.vec_id % 5 = 0 AND r.vec_id % 5 <> 0 GROUP BY 1)
SELECT count(*) AS n, round(avg(CASE WHEN internal > sim THEN 1 ELSE 0 END), 6) + 0.0 AS internal_closer, (SELECT round(avg(sim), 6) + 0.0 FROM v) AS reverse_mean FROM nn JOIN i ON nn.id = i.id""")
def internal_vs_external_nn(t: Fixtures) -> DataFrame:
    q, r = halves(t)
    cross = similarity.dense_nearest(q, r)
    within = similarity.dense_nearest(q, q, other=True).select("id", F.col("sim").alias("internal"))
    back = similarity.dense_nearest(r, q).agg(r6(F.avg("sim")).alias("reverse_mean"))
    g = cross.join(within, "id").agg(F.count("*").alias("n"), r6(F.avg((F.col("internal") > F.col("sim")).cast("int"))).alias("internal_closer"))
    return g.join(F.broadcast(back))  # one row each


@query("""WITH b AS (SELECT doc_id, count(DISTINCT """ + sql_bucket("w", 256) + """) AS bits FROM toks_ GROUP BY 1) SELECT count(*) AS n, round(avg(bits), 6) + 0.0 AS mean_bits, count(*) FILTER (WHERE bits >= 0.3 * 256) AS saturated_30, count(*) FILTER (WHERE bits >= 0.9 * 256) AS saturated_90, max(bits) AS max_bits FROM b""")
def saturation(t: Fixtures) -> DataFrame:
    bits = t.toks.select("doc_id", bucket("w", 256).alias("bit")).distinct().groupBy("doc_id").agg(F.count("*").alias("bits"))
    return bits.agg(F.count("*").alias("n"), r6(F.avg("bits")).alias("mean_bits"), F.count_if(F.col("bits") >= 0.3 * 256).alias("saturated_30"), F.count_if(F.col("bits") >= 0.9 * 256).alias("saturated_90"), F.max("bits").alias("max_bits"))


@query(f"""WITH b AS (SELECT DISTINCT doc_id, {sql_bucket("w", 2048)} AS bit FROM toks_), n AS (SELECT doc_id, count(*) AS n FROM b GROUP BY 1), c AS (SELECT x.doc_id AS a, count(*) AS c FROM b x JOIN b y ON y.doc_id = x.doc_id + 1 AND x.bit = y.bit GROUP BY 1)
SELECT x.doc_id AS a, y.doc_id AS b, round(coalesce(c, 0) / CAST(x.n + y.n - coalesce(c, 0) AS DOUBLE) + 1e-9, 6) AS sim FROM n x JOIN n y ON y.doc_id = x.doc_id + 1 LEFT JOIN c ON c.a = x.doc_id""")
def packed_tanimoto(t: Fixtures) -> DataFrame:
    """Each document and the next one, as packed bits."""
    packed = similarity.pack_bits(t.toks.select("doc_id", bucket("w", 2048).alias("bit")), "doc_id", "bit", 2048)
    left, right = packed.select(F.col("doc_id").alias("a"), F.col("words").alias("x")), packed.select(F.col("doc_id").alias("b"), F.col("words").alias("y"))
    return left.join(right, F.col("b") == F.col("a") + 1).select("a", "b", similarity.six(similarity.packed_tanimoto("x", "y")).alias("sim"))


_REACH = "WITH RECURSIVE e AS (SELECT a AS u, b AS v FROM sims_ WHERE sim >= {t} UNION ALL SELECT b, a FROM sims_ WHERE sim >= {t}), r AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u), c AS (SELECT u AS doc_id, min(v) AS root FROM r GROUP BY 1)"


@query(_REACH.format(t=0.6) + " SELECT doc_id, root, CAST(dense_rank() OVER (ORDER BY root) - 1 AS INTEGER) AS component FROM c")
def components(t: Fixtures) -> DataFrame:
    found = graph.components(t.documents.select("doc_id"), sets.similar_sets(t.word_sets, "doc_id", "w", 0.6, links=True), "doc_id")
    return reshape.index_names(found, "root", "component").select("doc_id", "root", "component")


@query(" UNION ALL ".join(f"SELECT * FROM ({_REACH.format(t=x).replace('WITH RECURSIVE ', 'WITH RECURSIVE ')}, g AS (SELECT root, count(*) AS n FROM c GROUP BY 1) SELECT CAST({x} AS DOUBLE) AS threshold, count(*) AS components, count(*) FILTER (WHERE n = 1) AS singletons, round(count(*) FILTER (WHERE n = 1) / CAST(count(*) AS DOUBLE), 6) + 0.0 AS singleton_fraction, max(n) AS largest, round(median(n), 6) + 0.0 AS median FROM g)" for x in (0.5, 0.6)))
def component_summary(t: Fixtures) -> DataFrame:
    edges = stored(sets.similar_sets(t.word_sets, "doc_id", "w", 0.5, links=True))  # both thresholds read it
    out = []
    for x in (0.5, 0.6):
        sizes = graph.components(t.documents.select("doc_id"), edges.filter(F.col("sim") >= x), "doc_id").groupBy("root").agg(F.count("*").alias("n"))
        out.append(profile.size_summary(sizes, "components").select(F.lit(x).alias("threshold"), "*"))
    return rounded(out[0].unionByName(out[1]))


_KFOLD = """WITH h AS (SELECT {k} AS k, row_number() OVER (ORDER BY {b}, {k}) - 1 AS r, count(*) OVER () AS n FROM {t}), f AS (SELECT k, CAST(CASE WHEN r < (n % 5) * (n // 5 + 1) THEN r // (n // 5 + 1) ELSE n % 5 + (r - (n % 5) * (n // 5 + 1)) // (n // 5) END AS INTEGER) AS fold FROM h)"""


@query(_KFOLD.format(k="o_orderkey", b=sql_bucket("o_orderkey", 1 << 32), t="orders") + " SELECT k AS entity, fold FROM f")
def kfold_hash(t: Fixtures) -> DataFrame:
    return folds.k_fold(t.orders.select(F.col("o_orderkey").alias("entity")), "entity")


@query(_KFOLD.format(k="o_custkey", b=sql_bucket("o_custkey", 1 << 32), t="(SELECT DISTINCT o_custkey FROM orders)") + " SELECT o_orderkey AS entity, o_custkey AS grp, fold FROM orders JOIN f ON k = o_custkey")
def group_fold_hash(t: Fixtures) -> DataFrame:
    return folds.group_k_fold(t.orders.select(F.col("o_orderkey").alias("entity"), F.col("o_custkey").alias("grp")), "grp").select("entity", "grp", "fold")


@query("""WITH s AS (SELECT o_custkey AS grp, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT grp, n, row_number() OVER (ORDER BY n DESC, grp) - 1 AS i FROM s), f AS (SELECT n, CAST(CASE WHEN (i // 5) % 2 = 0 THEN i % 5 ELSE 4 - i % 5 END AS INTEGER) AS fold FROM r) SELECT fold, count(*) AS groups, CAST(sum(n) AS BIGINT) AS n FROM f GROUP BY 1""")
def balanced_group_folds(t: Fixtures) -> DataFrame:
    rows = folds.balanced_group_folds(t.orders.select(F.col("o_custkey").alias("grp")), "grp")
    per_group = rows.groupBy("grp", "fold").agg(F.count("*").alias("n"))
    return per_group.groupBy("fold").agg(F.count("*").alias("groups"), F.sum("n").alias("n"))


_VF = sql_bucket("{x}.vec_id", 5)


@query(f"""WITH f AS (SELECT vec_id, label, v, {_VF.format(x='vec_')} AS fold FROM vec_), n AS (SELECT q.vec_id AS id, q.fold, q.label, arg_min(r.vec_id, (-{_COS.format(a='q', b='r')}, r.vec_id)) AS neighbour, max({_COS.format(a='q', b='r')}) AS sim, max(CASE WHEN q.label = r.label THEN 1 ELSE 0 END) = 1 AS seen_group FROM f q JOIN f r ON q.fold <> r.fold GROUP BY 1, 2, 3)
SELECT id, fold, neighbour, round(sim, 6) + 0.0 AS sim, seen_group, CASE WHEN sim >= 0.4 THEN 'high' WHEN sim >= 0.3 THEN 'moderate' ELSE 'low' END AS regime FROM n""")
def applicability_domain(t: Fixtures) -> DataFrame:
    # One pass over the pairs serves all folds: a query's references are those of the other folds.
    v = vectors(t).withColumn("fold", bucket("id", 5))
    nn = similarity.dense_nearest(v, v, where=("fold", "fold"))
    by_label = v.groupBy("label").agg(F.collect_set("fold").alias("in_folds"))
    rows = v.select("id", "fold", "label").join(nn, "id").join(by_label, "label")
    seen = F.size(F.array_except("in_folds", F.array("fold"))) > 0
    regime = F.when(F.col("sim") >= 0.4, "high").when(F.col("sim") >= 0.3, "moderate").otherwise("low")
    return rows.select("id", "fold", "neighbour", r6("sim").alias("sim"), seen.alias("seen_group"), regime.alias("regime"))


@query(f"""WITH n AS (SELECT q.label AS endpoint, q.vec_id AS id, max({_COS.format(a='q', b='r')}) AS sim FROM vec_ q JOIN vec_ r ON q.label = r.label AND q.vec_id <> r.vec_id GROUP BY 1, 2) SELECT endpoint, {_SQL_VECTOR.format(v='sim')}, round(avg(CASE WHEN sim >= 0.3 THEN 1 ELSE 0 END), 6) + 0.0 AS at_3 FROM n GROUP BY 1""")
def endpoint_coverage(t: Fixtures) -> DataFrame:
    v = vectors(t)
    best = similarity.dense_nearest(v, v, other=True, same=("label", "label")).join(v.select("id", F.col("label").alias("endpoint")), "id")
    return rounded(profile.stat_vector(best.select("endpoint", "sim"), ["endpoint"], "sim", F.avg((F.col("sim") >= 0.3).cast("int")).alias("at_3")))


@query(f"WITH {_NN}, b AS (SELECT *, CASE WHEN sim >= 0.4 THEN 'high' WHEN sim >= 0.35 THEN 'moderate' ELSE 'low' END AS band FROM nn) SELECT band, id FROM b QUALIFY row_number() OVER (PARTITION BY band ORDER BY ('0x' || substr(md5(id || 'sample'), 1, 8))::BIGINT, id) <= 8")
def stratified_sample(t: Fixtures) -> DataFrame:
    nn = similarity.dense_nearest(*halves(t))
    band = F.when(F.col("sim") >= 0.4, "high").when(F.col("sim") >= 0.35, "moderate").otherwise("low")
    return folds.stratified_sample(nn.select(band.alias("band"), "id"), "band", "id", 8)


@query("""WITH p AS (SELECT a.o_custkey AS grp, abs(a.o_totalprice - b.o_totalprice) AS d FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey) SELECT grp, count(*) AS pairs, round(avg(d), 6) + 0.0 AS mean, round(coalesce(stddev_samp(d), 0), 6) + 0.0 AS sd, round(min(d), 6) + 0.0 AS min, round(max(d), 6) + 0.0 AS max FROM p GROUP BY 1""")
def within_group_pairs(t: Fixtures) -> DataFrame:
    rows = t.orders.select(F.col("o_custkey").alias("grp"), F.col("o_totalprice").alias("x"))
    return rounded(profile.pair_statistics(rows, ["grp"], "x", t.segments).withColumn("sd", F.coalesce("sd", F.lit(0.0))))


@query(f"""WITH o AS (SELECT vec_id, v, row_number() OVER (ORDER BY vec_id) - 1 AS o, count(*) OVER () AS n FROM vec_), d AS (SELECT r.r AS id, {sql_bucket("concat(r.r, 'a')", 1 << 32)} AS ha, {sql_bucket("concat(r.r, 'b')", 1 << 32)} AS hb FROM range(0, 2000) r(r))
SELECT d.id, x.vec_id AS a, y.vec_id AS b, round(list_inner_product(x.v, y.v), 6) + 0.0 AS sim FROM d JOIN o x ON x.o = d.ha % x.n JOIN o y ON y.o = d.hb % y.n WHERE x.o <> y.o""")
def sampled_pairs(t: Fixtures) -> DataFrame:
    """2,000 pairs at fixed-seed hashed ordinals, and their cosines; a pair of equal ordinals is left out."""
    n = t.vec.agg(F.count("*").alias("n"))
    ids = ranks.positions(t.vec.select("vec_id", "v"), ["vec_id"], "o").withColumn("o", F.col("o") - 1)
    draws = t.spark.range(2000).join(F.broadcast(n)).select("id", (bucket("id", 1 << 32, "a") % F.col("n")).alias("oa"), (bucket("id", 1 << 32, "b") % F.col("n")).alias("ob")).filter("oa <> ob")
    rows = draws.join(ids.select(F.col("o").alias("oa"), F.col("vec_id").alias("a"), F.col("v").alias("va")), "oa").join(ids.select(F.col("o").alias("ob"), F.col("vec_id").alias("b"), F.col("v").alias("vb")), "ob")
    dot = F.aggregate(F.zip_with("va", "vb", lambda x, y: x * y), F.lit(0.0), lambda s, d: s + d)
    return rows.select("id", "a", "b", r6(dot).alias("sim"))


@query(f"""WITH q AS (SELECT label * 10 + vec_id % 7 AS instance, vec_id, v FROM vec_ WHERE vec_id % 5 = 0), r AS (SELECT label * 10 + vec_id % 3 AS reference, vec_id, v FROM vec_ WHERE vec_id % 5 <> 0), s AS (SELECT instance, reference, max({_COS.format(a='q', b='r')}) AS sim FROM q, r GROUP BY 1, 2)
SELECT instance, arg_min(reference, (-sim, -reference)) AS neighbour, round(max(sim), 6) + 0.0 AS sim FROM s GROUP BY 1""")
def multi_instance_nn(t: Fixtures) -> DataFrame:
    q, r = halves(t)
    best = similarity.group_best(q.withColumn("g", F.col("label") * 10 + F.col("id") % 7), r.withColumn("g", F.col("label") * 10 + F.col("id") % 3))
    best = best.withColumnsRenamed({"ga": "instance", "gb": "reference"})
    # Ties go to the largest reference here.
    g = best.groupBy("instance").agg(F.max(F.struct("sim", "reference")).alias("n"))
    return rounded(g.select("instance", F.col("n.reference").alias("neighbour"), F.col("n.sim").alias("sim")))


@query(f"""WITH k AS (SELECT q.vec_id AS id, r.label, {_COS.format(a='q', b='r')} AS sim, r.vec_id AS rid FROM vec_ q, vec_ r WHERE q.vec_id % 5 = 0 AND r.vec_id % 5 <> 0 AND {_COS.format(a='q', b='r')} >= 0.2) SELECT id, count(*) AS neighbours, round(sum(sim * label) / sum(sim), 6) + 0.0 AS p FROM k GROUP BY 1""")
def knn_baseline(t: Fixtures) -> DataFrame:
    q, r = halves(labelled(t))
    return rounded(similarity.neighbour_means(q, r, "label", 0.2))
