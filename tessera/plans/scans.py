"""Scans, projections, filters, labels, scalar functions and reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import expr
from tessera.functions.expr import r6, rounded
from tessera.operators import joins, profile, ranks, reshape
from tessera.plans.base import ENDPOINTS, Fixtures, query, sql_bucket
from tessera.sources.tables import canonical_json


@query("SELECT l_orderkey AS entity, l_linenumber AS endpoint, l_quantity AS qty, l_extendedprice AS price FROM lineitem WHERE l_quantity >= 45 AND l_returnflag = 'R'")
def scan_filter_project(t: Fixtures) -> DataFrame:
    rows = expr.nan_to_null(t.raw("lineitem").filter((F.col("l_quantity") >= 45) & ~F.isnan("l_quantity") & (F.col("l_returnflag") == "R")))
    return rows.select(F.col("l_orderkey").alias("entity"), F.col("l_linenumber").alias("endpoint"), F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"))


@query("""WITH s AS (
  SELECT o_orderkey, o_custkey, 'finished' AS source, 0 AS priority FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT o_orderkey, o_custkey, 'urgent', 1 FROM orders WHERE o_orderpriority = '1-URGENT'
  UNION ALL SELECT o_orderkey, o_custkey, 'large', 2 FROM orders WHERE o_totalprice > 300000
  UNION ALL SELECT o_orderkey, o_custkey, 'all', 3 FROM orders)
SELECT o_orderkey, priority, o_custkey, source FROM s QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY priority) = 1""")
def tagged_union_first(t: Fixtures) -> DataFrame:
    o = t.orders
    slices = [("finished", o.filter("o_orderstatus = 'F'")), ("urgent", o.filter("o_orderpriority = '1-URGENT'")), ("large", o.filter("o_totalprice > 300000")), ("all", o)]
    return joins.first_of_sources([(n, df.select("o_orderkey", "o_custkey")) for n, df in slices], ["o_orderkey"])


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.absent') AS absent FROM events")
def json_extract_metadata(t: Fixtures) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.absent").alias("absent"))


@query("""SELECT user_id, '{' || string_agg('"' || event_type || '":' || n, ',' ORDER BY event_type) || '}' AS cell
FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1""")
def canonical_json_cell(t: Fixtures) -> DataFrame:
    counts = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    entries = F.map_from_entries(F.collect_list(F.struct("event_type", "n")))
    return counts.groupBy("user_id").agg(entries.alias("m")).select("user_id", canonical_json("m").alias("cell"))


@query("SELECT doc_id, strlen(text) AS bytes, sha256(text) AS sha256 FROM documents")
def sha256_rows(t: Fixtures) -> DataFrame:
    return t.documents.select("doc_id", F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("sha256"))


@query()
def file_provenance(t: Fixtures) -> DataFrame:
    from tessera.sources.tables import file_provenance as provenance

    return provenance(t.spark, f"{t.sf_dir}/region.parquet", "*.parquet")


@query("""SELECT n_nationkey, replace(n_name, '|', '\\|') AS name, CASE WHEN n_regionkey = 0 THEN 'NA' ELSE format('{:,.3f}', n_nationkey * 1234.5678::DOUBLE) END AS cell FROM nation""")
def format_report_cells(t: Fixtures) -> DataFrame:
    cell = F.when(F.col("n_regionkey") == 0, F.lit("NA")).otherwise(F.format_number(F.col("n_nationkey") * F.lit(1234.5678), 3))
    return t.nation.select("n_nationkey", F.replace("n_name", F.lit("|"), F.lit("\\|")).alias("name"), cell.alias("cell"))


@query("""SELECT entity, endpoint, round(upper - lower, 6) + 0.0 AS ci_width, round(y - (lower + upper) / 2, 6) + 0.0 AS shift, upper - lower < 0 AS invalid FROM long_""")
def derived_interval_width(t: Fixtures) -> DataFrame:
    mid = (F.col("lower") + F.col("upper")) / 2
    width = F.col("upper") - F.col("lower")
    return t.long.select("entity", "endpoint", r6(width).alias("ci_width"), r6(F.col("y") - mid).alias("shift"), (width < 0).alias("invalid"))


@query("SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, CAST(NULL AS VARCHAR) AS note, CAST(NULL AS DOUBLE) AS weight FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL, NULL FROM supplier")
def schema_conform(t: Fixtures) -> DataFrame:
    schema = {"id": "bigint", "name": "string", "balance": "double", "note": "string", "weight": "double"}
    old = t.customer.withColumnsRenamed({"c_custkey": "id", "c_name": "name", "c_acctbal": "balance"})
    new = t.supplier.withColumnsRenamed({"s_suppkey": "id", "s_name": "name", "s_acctbal": "balance"})
    return reshape.conform(old, schema).unionByName(reshape.conform(new, schema))


@query("SELECT o_orderkey AS entity, round(y1, 6) + 0.0 AS y1, round(y2, 6) + 0.0 AS y2, round(y3, 6) + 0.0 AS y3, round(y4, 6) + 0.0 AS y4 FROM orders LEFT JOIN wide_ ON o_orderkey = entity WHERE coalesce(y1, y2, y3, y4) IS NOT NULL")
def any_observed_filter(t: Fixtures) -> DataFrame:
    rows = t.orders.select(F.col("o_orderkey").alias("entity")).join(t.wide, "entity", "left")
    return rounded(rows.filter(F.coalesce("y1", "y2", "y3", "y4").isNotNull()))


@query("SELECT entity, round(y1, 6) + 0.0 AS y1, round(y2, 6) + 0.0 AS y2, round(y3, 6) + 0.0 AS y3, round(y4, 6) + 0.0 AS y4 FROM wide_ WHERE y1 IS NOT NULL AND y2 IS NOT NULL AND y3 IS NOT NULL AND y4 IS NOT NULL")
def complete_case(t: Fixtures) -> DataFrame:
    return rounded(t.wide.na.drop(subset=["y1", "y2", "y3", "y4"]))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_membership(t: Fixtures) -> DataFrame:
    keys = t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return joins.keep_matching(t.orders.select("o_orderkey", "o_custkey"), keys, ["o_custkey"])


@query(f"""WITH r AS (SELECT entity, CASE WHEN random_fold = 0 THEN 'validation' ELSE 'train' END AS role, {sql_bucket('entity', 16)} AS shard FROM folds_)
SELECT entity, role FROM r QUALIFY row_number() OVER (PARTITION BY role ORDER BY entity) <= 25""")
def smoke_subset(t: Fixtures) -> DataFrame:
    rows = t.folds.select("entity", F.when(F.col("random_fold") == 0, "validation").otherwise("train").alias("role"))
    return profile.first_n(rows, ["role"], [F.col("entity")], 25)


@query("""WITH f AS (SELECT endpoint, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3 FROM long_ GROUP BY 1)
SELECT l.endpoint, l.entity, round(l.y, 6) + 0.0 AS y FROM long_ l JOIN f ON l.endpoint = f.endpoint WHERE l.y < q1 - 0.2 * (q3 - q1) OR l.y > q3 + 0.2 * (q3 - q1)""")
def tukey_outliers(t: Fixtures) -> DataFrame:
    # The prices are near to uniform; at 0.2 IQR some lie outside.
    return rounded(profile.tukey_outliers(t.long.select("endpoint", "entity", "y"), ["endpoint"], "y", 0.2))


@query("""WITH w AS (SELECT entity, endpoint, upper - lower AS width FROM long_), f AS (SELECT endpoint, quantile_cont(width, 0.25) AS q1, quantile_cont(width, 0.75) AS q3 FROM w GROUP BY 1)
SELECT w.endpoint, entity, round(width, 6) + 0.0 AS width FROM w JOIN f ON w.endpoint = f.endpoint WHERE width > q3 + 1.5 * (q3 - q1)""")
def noisy_measurements(t: Fixtures) -> DataFrame:
    rows = t.long.select("endpoint", "entity", (F.col("upper") - F.col("lower")).alias("width"))
    return profile.tukey_outliers(rows, ["endpoint"], "width", 1.5, low=False).withColumn("width", r6("width"))


@query("SELECT p_partkey, p_size, CASE WHEN p_size / CAST(50 AS DOUBLE) >= 0.6 THEN 'high' WHEN p_size / CAST(50 AS DOUBLE) >= 0.4 THEN 'moderate' ELSE 'low' END AS regime, count(*) OVER () AS n FROM part")
def similarity_regime(t: Fixtures) -> DataFrame:
    rows = t.part.withColumn("sim", F.col("p_size") / F.lit(50.0))
    regime = F.when(F.col("sim") >= 0.6, "high").when(F.col("sim") >= 0.4, "moderate").otherwise("low")
    total = rows.agg(F.count("*").alias("n"))
    return rows.select("p_partkey", "p_size", regime.alias("regime")).join(F.broadcast(total))  # one row


@query("""SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_quantity < 10 THEN '00-09' WHEN l_quantity < 25 THEN '10-24' WHEN l_quantity < 40 THEN '25-39' ELSE '40-50' END AS band
FROM lineitem WHERE l_linenumber = 1""")
def cut_bands(t: Fixtures) -> DataFrame:
    rows = t.lineitem.filter("l_linenumber = 1")
    band = expr.cut("l_quantity", [0, 10, 25, 40, 51], ["00-09", "10-24", "25-39", "40-50"])
    return rows.select("l_orderkey", "l_linenumber", "l_quantity", band.alias("band"))


@query("""WITH w AS (SELECT entity, (CASE WHEN y1 >= 5 THEN 1 ELSE 0 END) + (CASE WHEN y2 >= 5 THEN 1 ELSE 0 END) + (CASE WHEN y3 >= 5 THEN 1 ELSE 0 END) + (CASE WHEN y4 >= 5 THEN 1 ELSE 0 END) AS active,
  (CASE WHEN y1 IS NULL THEN 0 ELSE 1 END) + (CASE WHEN y2 IS NULL THEN 0 ELSE 1 END) + (CASE WHEN y3 IS NULL THEN 0 ELSE 1 END) + (CASE WHEN y4 IS NULL THEN 0 ELSE 1 END) AS tested,
  greatest(y1, y2, y3, y4) - least(y1, y2, y3, y4) AS spread FROM wide_)
SELECT entity, CAST(active AS INTEGER) AS active, CAST(tested AS INTEGER) AS tested, round(spread, 6) + 0.0 AS spread, tested >= 2 AND active >= 2 AS broad, tested >= 2 AND active = 1 AS selective, tested >= 2 AND spread >= 3 AS discordant FROM w""")
def activity_categories(t: Fixtures) -> DataFrame:
    ys = [F.col(f"y{e}") for e in ENDPOINTS]
    active = sum((F.when(y >= 5, 1).otherwise(0) for y in ys), F.lit(0))
    tested = sum((y.isNotNull().cast("int") for y in ys), F.lit(0))
    rows = t.wide.select("entity", active.alias("active"), tested.alias("tested"), (F.greatest(*ys) - F.least(*ys)).alias("spread"))
    several = F.col("tested") >= 2
    return rows.select(
        "entity", "active", "tested", r6("spread").alias("spread"), (several & (F.col("active") >= 2)).alias("broad"), (several & (F.col("active") == 1)).alias("selective"), (several & (F.col("spread") >= 3)).alias("discordant")
    )


@query("""SELECT entity, round(y1, 6) + 0.0 AS direct, round(y2, 6) + 0.0 AS other, CASE WHEN y1 > 4 THEN CASE WHEN y2 - y1 > 0.301 THEN 'positive' ELSE 'negative' END
  WHEN y1 < 4 THEN CASE WHEN y2 > 4.301 THEN 'positive' WHEN y2 < 4 THEN 'negative' ELSE 'excluded' END END AS label, y1 > 9 AND y2 < 3 AS hit
FROM wide_ WHERE y1 IS NOT NULL AND y2 IS NOT NULL""")
def two_arm_label_rule(t: Fixtures) -> DataFrame:
    rows = t.wide.na.drop(subset=["y1", "y2"]).select("entity", F.col("y1").alias("direct"), F.col("y2").alias("other"))
    return rows.withColumn("label", profile.two_arm_label("direct", "other")).withColumn("hit", (F.col("direct") > 9) & (F.col("other") < 3)).transform(rounded)


@query("SELECT d.doc_id, coalesce(l.quality, l.toxic, CAST(-1 AS INTEGER)) AS label, coalesce(nullif(d.source, 'src0'), d.lang, 'none') AS origin FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def coalesce_chain(t: Fixtures) -> DataFrame:
    rows = t.documents.select("doc_id", "source", "lang").join(t.labels, "doc_id", "left")
    return rows.select("doc_id", F.coalesce("quality", "toxic", F.lit(-1)).alias("label"), F.coalesce(F.nullif("source", F.lit("src0")), "lang", F.lit("none")).alias("origin"))


@query("SELECT o_orderkey, TRY_CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS level, TRY_CAST(substr(o_orderpriority, 3) AS DOUBLE) AS failed FROM orders")
def try_cast_numeric(t: Fixtures) -> DataFrame:
    return t.orders.select("o_orderkey", F.substring("o_orderpriority", 1, 1).try_cast("int").alias("level"), F.substring("o_orderpriority", 3, 99).try_cast("double").alias("failed"))


# Scalar functions


@query("SELECT w.entity, regexp_extract(u.name, '^(y[0-9]+)', 1) AS endpoint, round(u.value, 6) + 0.0 AS value FROM wide_ w, LATERAL (VALUES ('y1_value', y1), ('y2_value', y2), ('y3_value', y3), ('y4_value', y4)) u(name, value) WHERE u.value IS NOT NULL")
def unpivot_extract(t: Fixtures) -> DataFrame:
    wide = t.wide.withColumnsRenamed({f"y{e}": f"y{e}_value" for e in ENDPOINTS})
    long = reshape.unpivot_values(wide, ["entity"], reshape.columns_like(wide, "y", "_value"))
    return long.select("entity", F.regexp_extract("name", "^(y[0-9]+)", 1).alias("endpoint"), r6("value").alias("value"))


@query("SELECT p_partkey, string_split(p_type, ' ')[1] AS head, CASE WHEN contains(p_name, ' ') THEN split_part(p_name, ' ', 1) ELSE p_name END AS first_word, replace(p_brand, 'Brand#', '') AS brand, concat_ws('|', p_brand, p_type) AS task, starts_with(p_type, 'S') AS s_type FROM part")
def split_task_name(t: Fixtures) -> DataFrame:
    return t.part.select(
        "p_partkey", F.split("p_type", " ")[0].alias("head"), F.substring_index("p_name", " ", 1).alias("first_word"), F.replace("p_brand", F.lit("Brand#"), F.lit("")).alias("brand"),
        F.concat_ws("|", "p_brand", "p_type").alias("task"), F.col("p_type").startswith("S").alias("s_type"),
    )


@query("SELECT entity, endpoint, round(9 - log10(y * 1000), 6) + 0.0 AS p_nano, round(-log10(y / 1000000), 6) + 0.0 AS p_molar FROM long_ WHERE y > 0")
def log_potency(t: Fixtures) -> DataFrame:
    return t.long.filter("y > 0").select("entity", "endpoint", r6(F.lit(9) - F.log10(F.col("y") * 1000)).alias("p_nano"), r6(expr.potency(F.col("y") / 1000000)).alias("p_molar"))


@query("""SELECT c_custkey, CASE WHEN s = 0 THEN 1 ELSE s END AS seed FROM (SELECT c_custkey, ('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))::BIGINT & 2147483647 AS s
FROM (SELECT c_custkey, sha256(c_name) AS h FROM customer))""")
def stable_seed(t: Fixtures) -> DataFrame:
    return t.customer.select("c_custkey", expr.stable_seed("c_name").alias("seed"))


_CRC_STEP = "list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))"


@query(f"SELECT c_custkey, xor(xor(list_reduce(list_concat([4294967295], list_transform(string_split(c_name, ''), lambda s: CAST(ord(s) AS BIGINT))), lambda c, b: {_CRC_STEP}), 4294967295), 42) & 2147483647 AS seed FROM customer")
def crc_seed(t: Fixtures) -> DataFrame:
    return t.customer.select("c_custkey", expr.crc_seed("c_name", 42).alias("seed"))


@query("SELECT c_custkey, " + ", ".join(f"CAST(c_mktsegment = '{s}' AS INTEGER) AS is_{k}" for k, s in enumerate(("AUTOMOBILE", "BUILDING", "FURNITURE"))) + ", CAST(c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE') AS INTEGER) AS is_other FROM customer")
def one_hot(t: Fixtures) -> DataFrame:
    known = ["AUTOMOBILE", "BUILDING", "FURNITURE"]
    slots = [(F.col("c_mktsegment") == s).cast("int").alias(f"is_{k}") for k, s in enumerate(known)]
    return t.customer.select("c_custkey", *slots, (~F.col("c_mktsegment").isin(known)).cast("int").alias("is_other"))


@query("""WITH f AS (SELECT c_custkey, list_concat([CAST(c_mktsegment = 'BUILDING' AS DOUBLE), CAST(c_mktsegment = 'MACHINERY' AS DOUBLE), CAST(c_mktsegment NOT IN ('BUILDING', 'MACHINERY') AS DOUBLE)], [c_acctbal], [CAST(c_nationkey AS DOUBLE), CAST(c_nationkey % 5 AS DOUBLE)]) AS x FROM customer)
SELECT c_custkey, CAST(i - 1 AS INTEGER) AS pos, CASE WHEN i <= 3 THEN 'segment' WHEN i = 4 THEN 'balance' ELSE 'nation' END AS block, x[i] AS x FROM f, LATERAL (SELECT unnest(range(1, 7)) AS i)""")
def feature_blocks(t: Fixtures) -> DataFrame:
    known = ["BUILDING", "MACHINERY"]
    segment = F.array(*((F.col("c_mktsegment") == s).cast("double") for s in known), (~F.col("c_mktsegment").isin(known)).cast("double"))
    nation = F.array(F.col("c_nationkey").cast("double"), (F.col("c_nationkey") % 5).cast("double"))
    features, block = reshape.concat_blocks({"segment": (segment, 3), "balance": (F.array("c_acctbal"), 1), "nation": (nation, 2)})
    return t.customer.select("c_custkey", F.posexplode(features).alias("pos", "x")).withColumn("block", block(F.col("pos"))).select("c_custkey", "pos", "block", "x")


@query("SELECT doc_id, n_lines, CAST(coalesce(sum(n_lines) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_line FROM (SELECT doc_id, source, len(string_split(text, chr(10))) AS n_lines FROM documents)")
def batch_offsets(t: Fixtures) -> DataFrame:
    """Where each document's parts begin when a source's are laid end to end."""
    rows = t.documents.select("doc_id", "source", F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"))
    return reshape.offsets(rows, ["source"], "doc_id", "n_lines", "first_line", t.segments).select("doc_id", "n_lines", "first_line")


# Reshape


@query("SELECT entity, round(y1, 6) + 0.0 AS y1, round(y2, 6) + 0.0 AS y2, round(y3, 6) + 0.0 AS y3, round(y4, 6) + 0.0 AS y4 FROM wide_")
def pivot_endpoints(t: Fixtures) -> DataFrame:
    return rounded(reshape.pivot_values(t.long, ["entity"], "endpoint", "y", list(ENDPOINTS), "y"))


@query("SELECT entity, endpoint, round(y, 6) + 0.0 AS y, round(lower, 6) + 0.0 AS lower, round(upper, 6) + 0.0 AS upper, round(sd, 6) + 0.0 AS sd FROM long_ WHERE y IS NOT NULL")
def unpivot_struct(t: Fixtures) -> DataFrame:
    fields = ("y", "lower", "upper", "sd")
    wide = t.long.groupBy("entity").agg(*(F.max(F.when(F.col("endpoint") == e, F.col(f))).alias(f"{f}_{e}") for e in ENDPOINTS for f in fields))
    return reshape.unpivot_groups(wide, ["entity"], {e: {f: f"{f}_{e}" for f in fields} for e in ENDPOINTS}).filter(F.col("y").isNotNull()).transform(rounded)


@query("SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, round(v[i], 6) + 0.0 AS x FROM vec_, LATERAL (SELECT unnest(range(1, 65)) AS i)")
def explode_vector(t: Fixtures) -> DataFrame:
    return t.vec.select("vec_id", F.posexplode("v").alias("pos", "x")).withColumn("x", r6("x"))


@query("""WITH c AS (SELECT o_custkey AS id, p_brand AS name, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT id, CAST(dense_rank() OVER (ORDER BY name) - 1 AS INTEGER) AS col, n FROM c""")
def sparse_vocab(t: Fixtures) -> DataFrame:
    return reshape.index_names(t_counts(t), "name", "col").select("id", "col", "n")


def t_counts(t: Fixtures) -> DataFrame:
    """Count maps: customer by brand."""
    lines = t.lineitem.select("l_orderkey", "l_partkey").join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.groupBy(F.col("o_custkey").alias("id"), F.col("p_brand").alias("name")).agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT a.n_nationkey AS a, b.n_nationkey AS b, CAST(abs(a.n_nationkey - b.n_nationkey) AS DOUBLE) AS v FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey)
SELECT a, b, v FROM p UNION ALL SELECT b, a, v FROM p UNION ALL SELECT n_nationkey, n_nationkey, CAST(1 AS DOUBLE) FROM nation WHERE n_nationkey IN (SELECT a FROM p UNION SELECT b FROM p)""")
def symmetric_matrix(t: Fixtures) -> DataFrame:
    n = t.nation
    a, b = n.select(F.col("n_nationkey").alias("a"), "n_regionkey"), n.select(F.col("n_nationkey").alias("b"), "n_regionkey")
    pairs = a.join(b, "n_regionkey").filter("a < b").select("a", "b", F.abs(F.col("a") - F.col("b")).cast("double").alias("v"))
    return reshape.symmetric(pairs, "a", "b", "v", F.lit(1.0))


@query("""SELECT l_orderkey, l_linenumber, l_shipdate, row_number() OVER (ORDER BY l_shipdate NULLS LAST, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS position FROM lineitem""")
def sorted_registry(t: Fixtures) -> DataFrame:
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    return ranks.positions(t.lineitem.select(*order), order, "position").select("l_orderkey", "l_linenumber", "l_shipdate", "position")
