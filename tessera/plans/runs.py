"""Expectations, identity and features, bundles, ensembles, registry, and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.expr import bucket, finite, identity_levels, r6, ratio, rounded, words
from tessera.operators import expectations, folds, graph, registry, reshape, scores
from tessera.operators.boosting import boosted
from tessera.plans.base import ENDPOINTS, Fixtures, query, sql_bucket
from tessera.plans.relations import _LEVELS
from tessera.plans.statistics import _EXCESS, _FOLD_SCORES
from tessera.sources.work import stored

# Expectations


@query("""SELECT 'random_fold' AS "check", count(*) FILTER (WHERE random_fold IS NULL OR random_fold NOT BETWEEN 0 AND 4) AS violations FROM folds_ UNION ALL SELECT 'group_fold', count(*) FILTER (WHERE group_fold IS NULL OR group_fold NOT BETWEEN 0 AND 4) FROM folds_
UNION ALL SELECT 'unique', count(*) FROM (SELECT entity FROM folds_ GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'small', count(*) FILTER (WHERE random_fold > 2) FROM folds_""")
def fold_domain_check(t: Fixtures) -> DataFrame:
    f = t.folds
    return expectations.together(
        expectations.within(f, "random_fold", 0, 4, "random_fold"), expectations.within(f, "group_fold", 0, 4, "group_fold"), expectations.unique(f, ["entity"]), expectations.within(f, "random_fold", 0, 2, "small")
    )


@query("SELECT entity, CASE WHEN random_fold = 2 THEN 'validation' ELSE 'train' END AS role FROM folds_")
def split_roles(t: Fixtures) -> DataFrame:
    return t.folds.select("entity", folds.role("random_fold", 2).alias("role"))


@query("SELECT entity, CASE WHEN random_fold = 4 THEN 'test' WHEN group_fold = 0 THEN 'validation' ELSE 'train' END AS role, CAST((random_fold + 1) % 5 AS BIGINT) AS inner_fold FROM folds_")
def nested_split_roles(t: Fixtures) -> DataFrame:
    return t.folds.select("entity", folds.nested_role("random_fold", "group_fold", 4).alias("role"), ((F.col("random_fold") + 1) % 5).alias("inner_fold"))


_SPLIT = "d AS (SELECT *, {b} = 0 AS test FROM documents)".format(b=sql_bucket("doc_id", 5))


@query(f"WITH {_SPLIT} " + " UNION ALL ".join(f"""SELECT '{n}' AS "check", count(*) AS violations FROM (SELECT {e} AS k FROM d WHERE test INTERSECT SELECT {e} FROM d WHERE NOT test)""" for n, e in {"doc_id": "CAST(doc_id AS VARCHAR)", **_LEVELS, "source": "source"}.items()))
def leakage_checks(t: Fixtures) -> DataFrame:
    levels = {"doc_id": F.col("doc_id").cast("string"), **identity_levels("text"), "source": F.col("source")}
    keys = F.explode(F.array(*(F.struct(F.lit(n).alias("check"), F.sha2(c, 256).alias("k")) for n, c in levels.items())))
    rows = t.documents.select((bucket("doc_id", 5) == 0).alias("test"), keys.alias("e")).select("test", "e.*")
    both = rows.groupBy("check", "k").agg(F.bool_or("test").alias("a"), F.bool_or(~F.col("test")).alias("b"))
    return both.groupBy("check").agg(F.count_if(F.col("a") & F.col("b")).alias("violations"))


@query("""SELECT 'repeated' AS "check", count(*) AS violations FROM (SELECT entity, endpoint, model, seed FROM pred_ GROUP BY 1, 2, 3, 4 HAVING count(*) > 1) UNION ALL SELECT 'not finite', count(*) FROM pred_ WHERE p IS NULL OR isinf(p)
UNION ALL SELECT 'coverage', count(*) FROM (SELECT entity, endpoint FROM long_ EXCEPT SELECT entity, endpoint FROM pred_) UNION ALL SELECT 'tasks', count(*) FROM pred_ WHERE endpoint NOT IN (1, 2, 3, 4) UNION ALL SELECT 'scale', count(*) FROM pred_ WHERE p < 0""")
def prediction_integrity(t: Fixtures) -> DataFrame:
    p = t.pred
    return expectations.together(
        expectations.unique(p, ["entity", "endpoint", "model", "seed"], "repeated"),
        expectations.holds(p, finite("p"), "not finite"),
        expectations.same_keys(t.long, p, ["entity", "endpoint"], "coverage"),
        expectations.holds(p, F.col("endpoint").isin(*ENDPOINTS), "tasks"),
        expectations.holds(p, F.col("p") >= 0, "scale"),
    )


@query("SELECT page_id, CASE WHEN trim(coalesce(url, '')) = '' THEN 'no url' WHEN NOT contains(lower(html), '</html>') THEN 'cut short' ELSE 'ok' END AS outcome, strlen(html) AS bytes FROM pages")
def featurization_audit(t: Fixtures) -> DataFrame:
    outcome = F.when(F.trim(F.coalesce("url", F.lit(""))) == "", "no url").when(~F.lower("html").contains("</html>"), "cut short").otherwise("ok")
    return t.pages.select("page_id", outcome.alias("outcome"), F.octet_length("html").cast("long").alias("bytes"))


@query("SELECT o_orderkey AS ordinal, coalesce(round(y1, 6) + 0.0, 5.0) AS e1, coalesce(round(y2, 6) + 0.0, 5.0) AS e2, coalesce(round(y3, 6) + 0.0, 5.0) AS e3, coalesce(round(y4, 6) + 0.0, 5.0) AS e4 FROM orders LEFT JOIN wide_ ON entity = o_orderkey")
def submission_wide(t: Fixtures) -> DataFrame:
    template = t.orders.select(F.col("o_orderkey").alias("entity"))
    out = template.join(t.wide, "entity", "left").select(F.col("entity").alias("ordinal"), *(F.coalesce(r6(f"y{e}"), F.lit(5.0)).alias(f"e{e}") for e in ENDPOINTS))
    return expectations.require_columns(out, ["ordinal", "e1", "e2", "e3", "e4"], exactly=True)


@query("""SELECT 'unique' AS "check", count(*) AS violations FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'same keys', count(*) FILTER (WHERE o_orderkey IS NULL) FROM orders
UNION ALL SELECT 'e' || e || ' finite', count(*) FILTER (WHERE y IS NULL OR isinf(y)) FROM (SELECT e.e, coalesce(CASE e.e WHEN 1 THEN y1 WHEN 2 THEN y2 WHEN 3 THEN y3 ELSE y4 END, 5) AS y FROM orders LEFT JOIN wide_ ON entity = o_orderkey CROSS JOIN range(1, 5) e(e)) GROUP BY e""")
def submission_roundtrip(t: Fixtures) -> DataFrame:
    """Written, read back and checked: the checks' violations."""
    from tessera.sources.work import stored

    out = submission_wide(t)
    back = stored(out)
    return expectations.together(
        expectations.unique(back, ["ordinal"]),
        expectations.same_keys(out, back, ["ordinal"]),
        *(expectations.holds(back, finite(f"e{e}"), f"e{e} finite") for e in ENDPOINTS),
    )


@query("""WITH r AS (SELECT user_id AS run, count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS metrics, max(ts) AS last FROM events GROUP BY 1), x AS (SELECT *, max(last) OVER () AS now FROM r)
SELECT run, CASE WHEN n >= 60 AND metrics >= 12 THEN 'completed' WHEN n >= 60 THEN 'missing metrics' WHEN date_diff('second', last, now) > 3600 THEN 'stale' ELSE 'incomplete' END AS status FROM x""")
def run_status(t: Fixtures) -> DataFrame:
    runs = t.events.groupBy(F.col("user_id").alias("run")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("metrics"), F.max("ts").alias("last"))
    now = t.events.agg(F.max("ts").alias("now"))
    age = F.timestamp_diff("SECOND", F.col("last"), F.col("now"))
    return runs.join(F.broadcast(now)).select("run", registry.status(F.col("n") >= 60, F.col("metrics") >= 12, age, 3600).alias("status"))  # one row


@query("WITH p AS (SELECT * FROM pred_ WHERE NOT (seed = 2 AND entity % 50 = 0)) SELECT seed, count(*) AS n, (SELECT count(*) FROM (SELECT DISTINCT entity, endpoint, model FROM p)) - count(DISTINCT (entity, endpoint, model)) AS missing FROM p GROUP BY 1")
def seed_coverage(t: Fixtures) -> DataFrame:
    return registry.seed_coverage(t.pred.filter("NOT (seed = 2 AND entity % 50 = 0)"), ["entity", "endpoint", "model"])


@query("SELECT 'documents' AS source, doc_id AS id, CASE WHEN n_chars < 50 THEN 'short' ELSE 'no spaces' END AS problem FROM documents WHERE n_chars < 50 OR NOT contains(text, ' ') UNION ALL SELECT 'pages', page_id, 'no title' FROM pages WHERE NOT contains(lower(html), '<title')")
def problem_rows(t: Fixtures) -> DataFrame:
    d = t.documents.filter((F.col("n_chars") < 50) | ~F.col("text").contains(" ")).select(F.lit("documents").alias("source"), F.col("doc_id").alias("id"), F.when(F.col("n_chars") < 50, "short").otherwise("no spaces").alias("problem"))
    return d.unionByName(t.pages.filter(~F.lower("html").contains("<title")).select(F.lit("pages").alias("source"), F.col("page_id").alias("id"), F.lit("no title").alias("problem")))


@query("SELECT user_id % 120 AS file, count(DISTINCT (user_id % 2, user_id % 3 = 0 AND event_type = 'click')) AS identities, count(DISTINCT (user_id % 2, user_id % 3 = 0 AND event_type = 'click')) = 1 AS single FROM events GROUP BY 1")
def single_identity(t: Fixtures) -> DataFrame:
    identity = F.struct((F.col("user_id") % 2).alias("a"), ((F.col("user_id") % 3 == 0) & (F.col("event_type") == "click")).alias("b"))
    g = t.events.groupBy((F.col("user_id") % 120).alias("file")).agg(F.count_distinct(identity).alias("identities"))
    return g.withColumn("single", F.col("identities") == 1)


@query("WITH r AS (SELECT user_id AS run, list(value) FILTER (WHERE event_type = 'purchase' AND user_id % 5 <> 0) AS ms FROM events GROUP BY 1) SELECT run, m.m AS metric FROM r LEFT JOIN LATERAL (SELECT unnest(r.ms) AS m) m ON true")
def outer_explode_metrics(t: Fixtures) -> DataFrame:
    # A join to the list of runs, so that no run's metrics are gathered in one row.
    metrics = t.events.filter("event_type = 'purchase' AND user_id % 5 <> 0").select(F.col("user_id").alias("run"), F.col("value").alias("metric"))
    return t.events.select(F.col("user_id").alias("run")).distinct().join(metrics, "run", "left")


@query("""SELECT 'orders' AS source, o_orderkey AS id, concat('customer ', o_custkey) AS detail FROM (SELECT * FROM orders WHERE o_custkey IS NULL OR o_totalprice > 400000 ORDER BY o_orderkey LIMIT 5)
UNION ALL SELECT 'labels', doc_id, concat('quality ', quality) FROM (SELECT * FROM labels WHERE toxic = 1 ORDER BY doc_id LIMIT 5)""")
def violation_examples(t: Fixtures) -> DataFrame:
    """The first five rows that violate a check, as a message names them."""
    orders = expectations.examples(t.orders.filter("o_custkey IS NULL OR o_totalprice > 400000"), ["o_orderkey"])
    labels = expectations.examples(t.labels.filter("toxic = 1"), ["doc_id"])
    return orders.select(F.lit("orders").alias("source"), F.col("o_orderkey").alias("id"), F.concat(F.lit("customer "), "o_custkey").alias("detail")).unionByName(
        labels.select(F.lit("labels").alias("source"), F.col("doc_id").alias("id"), F.concat(F.lit("quality "), "quality").alias("detail"))
    )


# Identity and features


@query("SELECT doc_id, " + ", ".join(f"sha256({e}) AS {n}" for n, e in _LEVELS.items()) + ", CASE WHEN trim(text) = '' THEN 'empty' ELSE 'ok' END AS outcome FROM documents")
def identity_normalize(t: Fixtures) -> DataFrame:
    levels = [F.sha2(c, 256).alias(n) for n, c in identity_levels("text").items()]
    return t.documents.select("doc_id", *levels, F.when(F.trim("text") == "", "empty").otherwise("ok").alias("outcome"))


@query("SELECT doc_id, coalesce(nullif(regexp_extract(lower(text), '^([a-z]+)', 1), ''), '<NONE>') AS grp FROM documents")
def group_key(t: Fixtures) -> DataFrame:
    return t.documents.select("doc_id", F.coalesce(F.nullif(F.regexp_extract(F.lower("text"), "^([a-z]+)", 1), F.lit("")), F.lit("<NONE>")).alias("grp"))


@query("SELECT doc_id, length(text) AS n_chars, length(text) - length(replace(text, ' ', '')) AS n_spaces, length(text) - length(replace(text, chr(10), '')) AS n_breaks, len(string_split(text, '.')) - 1 AS n_stops, round((length(text) - length(replace(text, ' ', ''))) / CAST(nullif(length(text), 0) AS DOUBLE), 6) + 0.0 AS space_fraction, strlen(text) - length(text) AS n_wide FROM documents")
def row_descriptors(t: Fixtures) -> DataFrame:
    length = lambda c: F.length(c).cast("long")
    less = lambda s: length(F.col("text")) - length(F.replace("text", F.lit(s), F.lit("")))
    n = length(F.col("text"))
    return t.documents.select("doc_id", n.alias("n_chars"), less(" ").alias("n_spaces"), less("\n").alias("n_breaks"), less(".").alias("n_stops"), r6(ratio(less(" "), n)).alias("space_fraction"), (F.octet_length("text") - n).alias("n_wide"))


@query("SELECT DISTINCT doc_id, " + sql_bucket("w", 2048) + " AS bit FROM toks_")
def hashed_bits(t: Fixtures) -> DataFrame:
    return t.documents.select("doc_id", F.explode(F.array_distinct(F.transform(words("text"), lambda w: bucket(w, 2048)))).alias("bit"))


@query("""WITH w AS (SELECT doc_id, source, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents), g AS (SELECT doc_id, source, len(list_distinct(w)) AS n_nodes,
len(list_distinct(list_filter(list_transform(range(1, len(w)), lambda i: CASE WHEN w[i] <> w[i + 1] THEN least(w[i], w[i + 1]) || ' ' || greatest(w[i], w[i + 1]) END), lambda x: x IS NOT NULL))) AS n_edges FROM w)
SELECT doc_id, n_nodes, 2 * n_edges AS n_edges, CAST(coalesce(sum(n_nodes) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_node FROM g""")
def graph_features(t: Fixtures) -> DataFrame:
    """Each document as the graph of its neighbouring words (edges count in both directions), and where its nodes begin in its source's batch."""
    items = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: w != "")
    nodes, edges = graph.path_graph(F.col("items"))
    rows = t.documents.select("doc_id", "source", items.alias("items")).select("doc_id", "source", F.size(nodes).cast("long").alias("n_nodes"), (2 * F.size(edges)).cast("long").alias("n_edges"))
    return reshape.offsets(rows, ["source"], "doc_id", "n_nodes", "first_node", t.segments).select("doc_id", "n_nodes", "n_edges", "first_node")


_H = "('0x' || substr(md5({0}), 1, 8))::BIGINT"
_GRAPHS = """q AS (SELECT doc_id, source, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents),
x AS (SELECT doc_id, source, unnest(w) AS node, unnest(range(len(w))) AS p FROM q),
n AS (SELECT doc_id, source, node, row_number() OVER (PARTITION BY doc_id ORDER BY min(p)) - 1 AS place FROM x GROUP BY 1, 2, 3),
e AS (SELECT DISTINCT a.doc_id, least(a.node, b.node) AS a, greatest(a.node, b.node) AS b FROM x a JOIN x b ON a.doc_id = b.doc_id AND b.p = a.p + 1 WHERE a.node <> b.node),
d AS (SELECT doc_id, a AS t, b AS f FROM e UNION ALL SELECT doc_id, b, a FROM e)"""


def _word_rows(t: Fixtures) -> DataFrame:
    return t.documents.select("doc_id", "source", F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: w != "").alias("items"))


def _word_graphs(t: Fixtures) -> tuple[DataFrame, DataFrame]:
    return graph.path_tables(_word_rows(t).select("doc_id", "items"), "doc_id", "items")


@query(f"""WITH {_GRAPHS}, r0 AS (SELECT doc_id, node, {_H.format("'0|' || node")} AS id FROM n),
r1 AS (SELECT r.doc_id, r.node, {_H.format("'1|' || r.id || '|' || coalesce(s.s, 0)")} AS id FROM r0 r LEFT JOIN (SELECT d.doc_id, d.t, CAST(sum(id) AS BIGINT) AS s FROM d JOIN r0 ON r0.doc_id = d.doc_id AND r0.node = d.f GROUP BY 1, 2) s ON s.doc_id = r.doc_id AND s.t = r.node),
r2 AS (SELECT r.doc_id, r.node, {_H.format("'2|' || r.id || '|' || coalesce(s.s, 0)")} AS id FROM r1 r LEFT JOIN (SELECT d.doc_id, d.t, CAST(sum(id) AS BIGINT) AS s FROM d JOIN r1 ON r1.doc_id = d.doc_id AND r1.node = d.f GROUP BY 1, 2) s ON s.doc_id = r.doc_id AND s.t = r.node),
b AS (SELECT DISTINCT doc_id, id % 2048 AS b FROM (SELECT doc_id, id FROM r0 UNION ALL SELECT doc_id, id FROM r1 UNION ALL SELECT doc_id, id FROM r2))
SELECT doc_id, count(*) AS n_bits, string_agg(b::VARCHAR, ',' ORDER BY b) AS bits FROM b GROUP BY 1""")
def neighbourhood_fingerprints(t: Fixtures) -> DataFrame:
    """Each document's word graph as 2,048 bits: the neighbourhoods of its words up to radius 2."""
    if graph.one_row_each(t.documents.select("doc_id"), "doc_id"):
        found = graph.path_bits(_word_rows(t), "doc_id", "items")
    else:
        nodes, edges = _word_graphs(t)
        found = graph.folded(graph.neighbourhood_ids(nodes, edges, "doc_id", F.col("node")), "doc_id")
    return found.select("doc_id", F.size("bits").cast("long").alias("n_bits"), F.array_join(F.transform("bits", lambda b: b.cast("string")), ",").alias("bits"))


@query(f"""WITH {_GRAPHS}, z AS (SELECT source, doc_id, count(*) AS n FROM n GROUP BY 1, 2), o AS (SELECT source, doc_id, CAST(coalesce(sum(n) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM z)
SELECT o.source, d.doc_id, o.first + a.place AS src, o.first + b.place AS dst FROM d JOIN n a ON a.doc_id = d.doc_id AND a.node = d.t JOIN n b ON b.doc_id = d.doc_id AND b.node = d.f JOIN o ON o.doc_id = d.doc_id""")
def graph_batches(t: Fixtures) -> DataFrame:
    """The edges of all word graphs, numbered through their source's batch."""
    if graph.one_row_each(t.documents.select("doc_id"), "doc_id"):
        return graph.path_batches(_word_rows(t), "doc_id", "items", ["source"], t.segments)
    nodes, edges = _word_graphs(t)
    nodes = stored(nodes)
    return graph.batch_edges(nodes, edges, "doc_id", t.documents.select("source", "doc_id"), ["source"], t.segments)



# Bundles


@query("SELECT f.entity, CASE WHEN random_fold = 0 THEN 'validation' ELSE 'train' END AS role, round(y1, 6) + 0.0 AS y1, round(y2, 6) + 0.0 AS y2, round(y3, 6) + 0.0 AS y3, round(y4, 6) + 0.0 AS y4 FROM folds_ f JOIN wide_ w ON f.entity = w.entity")
def direct_bundle(t: Fixtures) -> DataFrame:
    rows = t.folds.select("entity", folds.role("random_fold", 0).alias("role")).join(t.wide, "entity")
    return rounded(rows.filter(F.coalesce(*(F.col(f"y{e}") for e in ENDPOINTS)).isNotNull()))


@query("""SELECT f.entity, CASE WHEN random_fold = 0 THEN 'validation' ELSE 'train' END AS role, round(y1, 6) + 0.0 AS y1, l.quality, x.value FROM folds_ f LEFT JOIN wide_ w ON f.entity = w.entity LEFT JOIN labels l ON l.doc_id = f.entity LEFT JOIN (SELECT user_id, round(avg(value), 6) + 0.0 AS value FROM events GROUP BY 1) x ON x.user_id = f.entity
WHERE CASE WHEN random_fold = 0 THEN y1 IS NOT NULL ELSE y1 IS NOT NULL OR quality IS NOT NULL OR x.value IS NOT NULL END""")
def joint_bundle(t: Fixtures) -> DataFrame:
    rows = t.folds.select("entity", folds.role("random_fold", 0).alias("role")).join(t.wide.select("entity", r6("y1").alias("y1")), "entity", "left")
    rows = rows.join(t.labels.select(F.col("doc_id").alias("entity"), "quality"), "entity", "left").join(t.events.groupBy(F.col("user_id").alias("entity")).agg(r6(F.avg("value")).alias("value")), "entity", "left")
    direct = F.col("y1").isNotNull()
    return rows.filter(F.when(F.col("role") == "validation", direct).otherwise(direct | F.col("quality").isNotNull() | F.col("value").isNotNull()))


@query("SELECT l.entity, CASE WHEN random_fold = 1 THEN 'test' WHEN group_fold = 2 THEN 'validation' ELSE 'train' END AS role, max(CASE WHEN endpoint = 1 THEN qty END) AS q1, max(CASE WHEN endpoint = 2 THEN qty END) AS q2 FROM long_ l JOIN folds_ f ON l.entity = f.entity GROUP BY 1, 2")
def auxiliary_bundle(t: Fixtures) -> DataFrame:
    wide = reshape.pivot_values(t.long, ["entity"], "endpoint", "qty", [1, 2], "q")
    return t.folds.select("entity", folds.nested_role("random_fold", "group_fold", 1).alias("role")).join(wide, "entity")


# Ensembles and out-of-fold tables


@query("SELECT entity, endpoint, round(avg(p), 6) + 0.0 AS p, count(*) AS members FROM (SELECT entity, endpoint, model, avg(p) AS p FROM pred_ GROUP BY 1, 2, 3) GROUP BY 1, 2")
def ensemble_mean(t: Fixtures) -> DataFrame:
    return rounded(registry.ensemble_mean(t.pred, ["entity", "endpoint"]))


@query(f"""WITH {_FOLD_SCORES}, s AS (SELECT model, avg(macro) AS score FROM mc GROUP BY 1), w AS (SELECT model, (1 / score) / (SELECT sum(1 / score) FROM s) AS weight FROM s), m AS (SELECT entity, endpoint, model, avg(p) AS p FROM pred_ GROUP BY 1, 2, 3)
SELECT entity, endpoint, round(sum(p * weight) / sum(weight), 6) + 0.0 AS p FROM m JOIN w ON m.model = w.model GROUP BY 1, 2""")
def ensemble_weighted(t: Fixtures) -> DataFrame:
    from tessera.plans.statistics import fold_macro

    weights = registry.ensemble_weights(fold_macro(t).groupBy("model").agg(F.avg("macro").alias("score")))
    return rounded(registry.ensemble_weighted(t.pred, weights, ["entity", "endpoint"]))


@query("""WITH s AS (SELECT model, seed, count(*) AS n, avg(abs(y - p)) AS mae FROM pred_ GROUP BY 1, 2) SELECT model, count(*) AS seeds, min(n) AS n, round(avg(mae), 6) + 0.0 AS mean, round(stddev_samp(mae), 6) + 0.0 AS sd FROM s GROUP BY 1""")
def oof_summary(t: Fixtures) -> DataFrame:
    s = t.pred.groupBy("model", "seed").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("y") - F.col("p"))).alias("mae"))
    return rounded(s.groupBy("model").agg(F.count("*").alias("seeds"), F.min("n").alias("n"), F.avg("mae").alias("mean"), F.stddev_samp("mae").alias("sd")))


@query("SELECT entity, endpoint, model, round(avg(p), 6) + 0.0 AS p, count(*) AS seeds FROM pred_ GROUP BY 1, 2, 3")
def seed_average(t: Fixtures) -> DataFrame:
    return rounded(registry.seed_mean(t.pred, ["entity", "endpoint", "model"]))


_RUNS = "SELECT user_id AS run, nullif(event_type, 'view') AS endpoint, min(ts) AS first_seen, max(ts) AS refreshed, count(*) AS n, round(avg(value), 6) + 0.0 AS score FROM events WHERE {w} GROUP BY 1, 2"
#: Two snapshots of the registry that share out all events: runs of the old one only, of the current one only, and of both, some of which lose an endpoint.
_OLD = "CASE user_id % 5 WHEN 0 THEN true WHEN 1 THEN false ELSE event_id % 2 = 0 OR event_type = 'click' AND user_id % 4 = 2 END"


@query(f"""WITH old AS ({_RUNS.format(w=_OLD)}), cur AS ({_RUNS.format(w=f'NOT ({_OLD})')})
SELECT c.run, c.endpoint, coalesce(least(o.first_seen, c.first_seen), c.first_seen) AS first_seen, c.refreshed, c.n, c.score FROM cur c LEFT JOIN old o ON o.run = c.run AND o.endpoint IS NOT DISTINCT FROM c.endpoint
UNION ALL SELECT * FROM old WHERE run NOT IN (SELECT run FROM cur)""")
def registry_upsert(t: Fixtures) -> DataFrame:
    return registry.upsert(run_rows(t, _OLD), run_rows(t, f"NOT ({_OLD})"), ["run", "endpoint"], "run")


def run_rows(t: Fixtures, where: str) -> DataFrame:
    g = t.events.filter(where).groupBy(F.col("user_id").alias("run"), F.nullif("event_type", F.lit("view")).alias("endpoint"))
    return g.agg(F.min("ts").alias("first_seen"), F.max("ts").alias("refreshed"), F.count("*").alias("n"), r6(F.avg("value")).alias("score"))


@query(f"""WITH v AS (SELECT *, avg(y) OVER (PARTITION BY model, seed, endpoint) AS ma, avg(y) OVER (PARTITION BY model, seed, endpoint, fold) AS mf FROM pred_),
e AS (SELECT model, seed, 'all' AS scope, CAST(endpoint AS VARCHAR) AS endpoint, count(*) AS n, sum({_EXCESS.format(p='p')}) / sum({_EXCESS.format(p='ma')}) AS s FROM v GROUP BY 1, 2, 4 UNION ALL SELECT model, seed, CAST(fold AS VARCHAR), CAST(endpoint AS VARCHAR), count(*), sum({_EXCESS.format(p='p')}) / sum({_EXCESS.format(p='mf')}) FROM v GROUP BY model, seed, fold, endpoint)
SELECT model, seed, scope, endpoint, n, round(s, 6) + 0.0 AS st_rae FROM e UNION ALL SELECT model, seed, scope, 'macro', CAST(sum(n) AS BIGINT), round(avg(s), 6) + 0.0 FROM e GROUP BY 1, 2, 3""")
def metric_tables(t: Fixtures) -> DataFrame:
    # Macro rows are means of endpoints, not rollups of rows.
    rows = t.pred.withColumn("scope", F.explode(F.array(F.lit("all"), F.col("fold").cast("string"))))
    e = scores.st_rae(rows, ["model", "seed", "scope", "endpoint"]).withColumn("endpoint", F.col("endpoint").cast("string"))
    macro = e.groupBy("model", "seed", "scope").agg(F.lit("macro").alias("endpoint"), F.sum("n").alias("n"), F.avg("st_rae").alias("st_rae"))
    return rounded(e.unionByName(macro))


@query("""SELECT event_id, coalesce(CASE WHEN event_type = 'click' THEN 'm' || user_id END, CASE WHEN user_id % 3 <> 0 THEN event_type || '::' || 'run' || (user_id % 3) END, event_type) AS model FROM events""")
def resolve_model_id(t: Fixtures) -> DataFrame:
    rows = t.events.select(
        "event_id", F.when(F.col("event_type") == "click", F.concat(F.lit("m"), "user_id")).alias("model_id"), "event_type", F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("run"), F.col("user_id") % 3)).otherwise("").alias("run_name")
    )
    return rows.select("event_id", registry.model_identity("model_id", "event_type", "run_name").alias("model"))


@query("SELECT event_id, 'exp' || (user_id % 4) || '/fold' || (event_id % 5) AS run, 'exp' || (user_id % 4) || '/fold' || (event_id % 5) || '|' || CASE WHEN event_type = 'view' THEN '' ELSE event_type END AS key FROM events")
def registry_key(t: Fixtures) -> DataFrame:
    path = F.concat(F.lit("/data/outputs/exp"), (F.col("user_id") % 4).cast("string"), F.lit("/fold"), (F.col("event_id") % 5).cast("string"), F.lit("/metadata.json"))
    rows = t.events.select("event_id", registry.relative_run(path, "outputs").alias("run"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("endpoint"))
    return rows.select("event_id", "run", registry.run_key("run", "endpoint").alias("key"))


@query("SELECT l_linenumber AS task, CASE l_linenumber WHEN 1 THEN 'first' WHEN 2 THEN 'second' ELSE 'third' END AS label, count(*) AS n FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1, 2")
def scored_task_subset(t: Fixtures) -> DataFrame:
    tasks = t.spark.createDataFrame([(k, n, k <= 3) for k, n in enumerate(("first", "second", "third", "fourth", "fifth", "sixth", "seventh"), 1)], "task int, label string, scored boolean")
    counts = t.lineitem.groupBy(F.col("l_linenumber").alias("task")).agg(F.count("*").alias("n"))
    return counts.join(tasks.filter("scored"), "task").select("task", "label", "n")


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN event_type || '_loss' ELSE 'shared_loss' END AS loss, CASE WHEN event_id % 2 = 0 THEN event_id % 7 ELSE 3 END AS depth FROM events")
def config_overlay(t: Fixtures) -> DataFrame:
    shared = F.create_map(F.lit("loss"), F.lit("shared_loss"), F.lit("depth"), F.lit("3"))
    stage = F.map_filter(
        F.create_map(F.lit("loss"), F.when(F.col("event_type").isin("click", "view"), F.concat("event_type", F.lit("_loss"))), F.lit("depth"), F.when(F.col("event_id") % 2 == 0, (F.col("event_id") % 7).cast("string"))), lambda k, v: v.isNotNull()
    )
    merged = F.map_zip_with(shared, stage, lambda k, a, b: F.coalesce(b, a))
    return t.events.select("event_id", merged["loss"].alias("loss"), merged["depth"].cast("long").alias("depth"))


@query("WITH s AS (SELECT user_id, event_id, value FROM events), h AS (SELECT user_id, event_id, coalesce(max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 100) AS estimate, 600 - coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining FROM s) SELECT user_id, event_id, round(estimate, 6) + 0.0 AS estimate, remaining >= estimate + 10 AS admitted FROM h")
def runtime_admission(t: Fixtures) -> DataFrame:
    before = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = t.events.select("user_id", "event_id", F.coalesce(F.max("value").over(before), F.lit(100.0)).alias("estimate"), (600 - F.coalesce(F.sum("value").over(before), F.lit(0.0))).alias("remaining"))
    return rows.select("user_id", "event_id", r6("estimate").alias("estimate"), (F.col("remaining") >= F.col("estimate") + 10).alias("admitted"))


@query("""SELECT * FROM (SELECT 'Row integrity' AS analysis, format('{:,}', count(*)) || ' orders; ' || format('{:,}', count(*) - count(DISTINCT o_orderkey)) || ' repeated keys' AS finding, 'Keys identify rows' AS implication, 'High' AS priority FROM orders UNION ALL
SELECT 'Label sparsity', format('{:,}', count(*)) || ' of ' || format('{:,}', (SELECT count(*) FROM documents)) || ' documents have labels', 'Losses must be masked', 'Critical' FROM labels UNION ALL
SELECT 'Uncertainty', 'sd is known of ' || format('{:,}', count(sd)) || ' of ' || format('{:,}', count(*)) || ' measurements', 'Weights need a default', 'Medium' FROM long_)""")
def report_summary(t: Fixtures) -> DataFrame:
    """Findings, each looked up in an aggregate, by priority."""
    from tessera.sources.reports import findings

    n = lambda c: F.format_number(c, 0)
    total = t.documents.agg(F.count("*").alias("total"))
    return findings(
        ("Row integrity", t.orders.agg(F.concat(n(F.count("*")), F.lit(" orders; "), n(F.count("*") - F.countDistinct("o_orderkey")), F.lit(" repeated keys"))), "Keys identify rows", "High"),
        ("Label sparsity", t.labels.agg(F.count("*").alias("n")).join(F.broadcast(total)).select(F.concat(n("n"), F.lit(" of "), n("total"), F.lit(" documents have labels"))), "Losses must be masked", "Critical"),  # one row each
        ("Uncertainty", t.long.agg(F.concat(F.lit("sd is known of "), n(F.count("sd")), F.lit(" of "), n(F.count("*")), F.lit(" measurements"))), "Weights need a default", "Medium"),
    )


# Models


@query()
def gbt_per_endpoint(t: Fixtures) -> DataFrame:
    """Boosted trees for every endpoint and held-out fold, twenty models that grow together, each until three trees have not improved the next fold, its
    validation; scored on all rows, each predicted by the model that did not see it."""
    rows = bundle(t).withColumn("held", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))))
    role = F.when(F.col("fold") == F.col("held"), "test").when(F.col("fold") == (F.col("held") + 1) % 5, "valid").otherwise("train")
    out = boosted(rows.withColumn("role", role), ["endpoint", "held"], ["qty", "tax", "total", "balance"], trees=None, bins=32, patience=3)
    return rounded(scores.regression_metrics(out.filter("role = 'test'"), ["endpoint"]))


@query()
def batch_inference(t: Fixtures) -> DataFrame:
    """The fitted models' long predictions for the held-out fold."""
    rows = bundle(t).withColumn("role", F.when(F.col("fold") == 1, "test").otherwise("train"))
    return boosted(rows, ["endpoint"], ["qty", "tax"], trees=3).filter("role = 'test'").select("entity", "endpoint", r6("p").alias("p"))


def bundle(t: Fixtures) -> DataFrame:
    return t.long.join(t.props.select("entity", "total", "balance"), "entity").join(t.folds.select("entity", F.col("random_fold").alias("fold")), "entity")
