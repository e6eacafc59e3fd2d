"""Cross-site boilerplate lines by distinct-site spread.

Method: per line hash a HyperLogLog sketch of the sites is merged by
aggregation (map-side first, so a line in a third of all rows reaches the
reducer as one sketch a task).  Lines whose estimate is clearly above or below
the threshold are decided by it; those near it get an exact distinct count.
Boilerplate lines are then removed from every text.

Which lines go depends on a text alone, so decisions are made per distinct
text and joined back by the text's digest: repeated ids and rows need no care,
and both joins have plain exchanges that adaptive execution can split when a
line or a text is very common.

Defined results: a line is compared without blanks, tabs and carriage returns
at its ends; blank lines are never removed, others by their spread alone; a null source counts as the site ``''``; a null text stays null with
no lines; an empty table gives no rows; extra columns are kept as they are by
:func:`clean`, whatever their names, and not read otherwise.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import begin, materialise, settle

MIN_SITES = 6
LG_K = 12
#: Half-width of the band around the threshold, in standard errors of the sketch, and in sites.
BAND_SIGMAS, BAND_SITES = 5.0, 1.0


def lines_of(docs: DataFrame) -> DataFrame:
    """``text_key``, ``site``, ``pos``, ``line_hash`` of the lines that can be boilerplate."""
    exploded = docs.where(F.col("text").isNotNull()).select(
        F.md5(F.col("text").cast("binary")).alias("text_key"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("site"),
        F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"),
    )
    return exploded.withColumn("line", F.trim(F.col("line"), F.lit(" \t\r"))).where(F.col("line") != "").select("text_key", "site", "pos", F.xxhash64("line").alias("line_hash"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """``line_hash`` of the lines on at least ``min_sites`` distinct sites."""
    spread = materialise(
        lines.groupBy("line_hash").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("sites")).where(F.col("sites") >= _low(min_sites, lg_k)),
        "line-spread",
    )
    high = min_sites + _half(min_sites, lg_k)
    near = spread.where(F.col("sites") <= high).select("line_hash")
    exact = lines.join(near, "line_hash", "left_semi").groupBy("line_hash", "site").agg(F.lit(1).alias("one")).groupBy("line_hash").agg(F.count("one").alias("sites"))
    return spread.where(F.col("sites") > high).select("line_hash").unionByName(exact.where(F.col("sites") >= min_sites).select("line_hash"))


def _half(min_sites: int, lg_k: int) -> float:
    return BAND_SITES + BAND_SIGMAS * 1.04 / math.sqrt(1 << lg_k) * min_sites


def _low(min_sites: int, lg_k: int) -> float:
    return min_sites - _half(min_sites, lg_k)


def decided(docs: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """Of each row: ``doc`` (the row as a struct), ``text`` without boilerplate lines, ``n_lines``, ``n_removed``."""
    mark = begin()
    lines = lines_of(docs)
    bad = materialise(boilerplate(lines, min_sites, lg_k), "line-boilerplate")
    hit = lines.select("text_key", "pos", "line_hash").join(bad, "line_hash", "left_semi")
    gone = materialise(hit.groupBy("text_key").agg(F.collect_set("pos").alias("gone")), "line-gone")
    settle(docs.sparkSession, mark, gone)
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.md5(F.col("text").cast("binary")).alias("text_key"))
    joined = keyed.join(gone, "text_key", "left").withColumn("lines", F.split(F.col("doc.text"), "\n", -1))
    kept = F.when(F.col("gone").isNull(), F.col("doc.text")).otherwise(F.array_join(F.filter("lines", lambda _, i: ~F.array_contains(F.col("gone"), i)), "\n"))
    is_null, zero = F.col("doc.text").isNull(), F.lit(0).cast("long")
    removed = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone"))
    return joined.select("doc", kept.alias("text"), F.when(is_null, zero).otherwise(F.size("lines").cast("long")).alias("n_lines"), F.when(is_null, zero).otherwise(removed.cast("long")).alias("n_removed"))


def clean(docs: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """``docs`` with boilerplate lines removed from ``text``."""
    out = decided(docs, min_sites, lg_k)
    return out.select(*[(F.col("text") if c == "text" else F.col("doc").getField(c)).alias(c) for c in docs.columns])


SQL = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rn, * FROM documents),
l AS (
  SELECT rn, source, u.pos, u.line, trim(u.line, chr(32) || chr(9) || chr(13)) AS body
  FROM d, LATERAL (SELECT unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos) u),
b AS (
  SELECT body FROM l WHERE body <> '' GROUP BY body HAVING count(DISTINCT coalesce(source, '')) >= {MIN_SITES}),
m AS (SELECT l.*, b.body IS NOT NULL AS gone FROM l LEFT JOIN b USING (body)),
g AS (
  SELECT rn, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept
  FROM m GROUP BY rn)
SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(length(kept) AS BIGINT) AS n_chars, md5(kept) AS text_md5
FROM d LEFT JOIN g USING (rn)
"""
