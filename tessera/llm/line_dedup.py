"""Removal of lines that spread over many sites; DataFrame operations only.

A line is what stands between line feeds, without spaces at its ends; blank lines don't count. Each line's sites go
into a HyperLogLog sketch per line hash, merged by aggregation. Where the estimate is within `band` of the threshold, the line's
distinct sites are counted exactly; farther off, the estimate decides (its error is below 2 % at 2**12 registers, and
none at the few sites where the band is widest). Lines on `min_sites` sites or more are boilerplate: all their
occurrences go, but for the first one (smallest document, then first place), so that no text is lost to its copies.

Hashes have 128 bits. Null text: no lines, stays null. Null site: no site. Null document: ordered first. Rows that
repeat lose the same lines. A text that loses all lines is empty. Ties for the first occurrence: rows that repeat share it. Very long
texts are split into lines and joined again in one row. An empty table gives no rows. Other columns are kept; n_lines and n_removed are added
in place of columns of that name.

A line's occurrences are counted by pre-aggregation; the join that marks them broadcasts the boilerplate, or, where that is too large,
is split by the adaptive skew join, which an inner join of a hot line with its one row allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import stored


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(id_col: str, text_col: str) -> list[Column]:
    return [F.col(id_col).alias("_doc"), F.xxhash64(F.lit(7), text_col).alias("_of")]


def boilerplate(lines: DataFrame, min_sites: int = 10, band: float = 0.3, lg_registers: int = 12) -> DataFrame:
    """h1, h2, first (document, text hash and place of the first occurrence) of the lines on min_sites sites or more;
    lines: h1, h2, site, _doc, _of, pos."""
    spread = lines.groupBy("h1", "h2").agg(
        F.hll_sketch_agg("site", lg_registers).alias("sketch"), F.count("*").alias("n"), F.min(F.struct("_doc", "_of", "pos")).alias("first")
    )
    low, high = min_sites * (1 - band), min_sites * (1 + band)
    spread = stored(spread.filter(F.col("n") >= min_sites).select("h1", "h2", "first", F.hll_sketch_estimate("sketch").alias("sites")).filter(F.col("sites") >= low))
    near = spread.filter(F.col("sites") <= high)
    exact = lines.join(near.select("h1", "h2"), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.countDistinct("site").alias("exact"))
    near = near.join(exact.filter(F.col("exact") >= min_sites), ["h1", "h2"], "left_semi")
    return spread.filter(F.col("sites") > high).unionByName(near).select("h1", "h2", "first")


def dedup_lines(docs: DataFrame, min_sites: int = 10, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", **how) -> DataFrame:
    """docs with the text that is left, and n_lines and n_removed."""
    line = F.trim(F.col("line"))
    lines = docs.select(*_key(id_col, text_col), F.col(site_col).cast("string").alias("site"), F.posexplode(lines_of(F.col(text_col))).alias("pos", "line"))
    lines = stored(lines.filter(line != "").select("_doc", "_of", "pos", "site", F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")))
    common = stored(boilerplate(lines, min_sites, **how))
    here = F.struct("_doc", "_of", "pos")
    gone = lines.join(common, ["h1", "h2"]).filter(~F.col("first").eqNullSafe(here)).groupBy("_doc", "_of").agg(F.collect_set("pos").alias("_gone"))
    gone = stored(gone).withColumnsRenamed({"_doc": "_gone_doc", "_of": "_gone_of"})

    rows = docs.select(F.struct("*").alias("_row"), *_key(id_col, text_col), F.col(text_col).alias("_text"))
    rows = rows.join(gone, F.col("_doc").eqNullSafe(F.col("_gone_doc")) & (F.col("_of") == F.col("_gone_of")), "left")
    found = lines_of(F.col("_text"))
    left = F.array_except(F.sequence(F.lit(0), F.size(found) - 1), F.col("_gone"))
    text = F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(F.array_join(F.transform(left, lambda i: F.element_at(found, i + 1)), "\n"))
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    n_lines = F.when(F.col("_text").isNull(), 0).otherwise(F.size(found)).cast("long")
    return rows.select(
        *(text.alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in kept), n_lines.alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed")
    )


#: What op5 returns, by plain equality of lines and exact counts.
SQL = """
WITH docs AS (SELECT doc_id, source, text FROM documents),
lines AS (
  SELECT doc_id, source, u.pos AS pos, u.line AS line, trim(u.line) AS norm
  FROM docs, LATERAL (SELECT unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos) u
  WHERE text IS NOT NULL),
common AS (
  SELECT norm, min(struct_pack(d := doc_id, p := pos)) AS first FROM lines WHERE norm <> ''
  GROUP BY norm HAVING count(DISTINCT source) >= 10),
marked AS (
  SELECT l.doc_id, l.pos, l.line, c.norm IS NOT NULL AND NOT (c.first.d = l.doc_id AND c.first.p = l.pos) AS gone
  FROM lines l LEFT JOIN common c ON l.norm = c.norm),
kept AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
         string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS text
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
