"""Mixing sources to target weights by weighted fair queueing.

Method: the documents of a source are shuffled by a hash of their id; each
gets a virtual finish time, the words of its source up to and including it
divided by the source's target.  Repeats queue up behind the first pass of the
source, so the k-th pass starts where the pass before ended.  All copies are
ordered by finish time and taken until the total budget is used up.

At scale: running sums are kept per (source, hash bucket), bucket totals are
added in two levels, so a source with a third of all rows is spread over many
tasks.  Of the global order only the place where the budget ends is needed:
sums per range of finish times tell in which range it lies, that range is cut
again until few copies are left, and only these are sorted.  Whether a copy is
taken is then a comparison with that place, so no rows are joined back.

Defined results: a null text has size 0; documents of size 0 are never taken;
a null source is a source of its own, sorted last; rows that agree in
``doc_id``, source and size queue up one behind the other, and which of them
comes first is told by no column of the result; an empty table gives no rows;
other columns are not read, whatever their names.  :func:`take` keeps all
columns; of rows that agree it takes those first whose content hashes lowest.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import begin, broadcast_if_small, materialise, settle

WEIGHTS = (5, 2, 1)
MAX_PASSES = 3
HASH_BITS = 60
#: Rows that all sources' hash buckets of one number hold together on average, and buckets whose totals are added at once.
BUCKET_ROWS = 512
BUCKETS_AT_ONCE = 4096
#: A bucket with more rows holds repeated rows, which are then counted first.
CROWDED_ROWS = 16384
#: Ranges of finish times that are summed in one pass, and copies that are sorted in one task.
RANGES = 1024
SORTED_ROWS = 65536
WORD = r"[^ \t-\r]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(doc_id: Column, seed: str) -> Column:
    """60 bits of md5 over the seed and the id's decimal text."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = MAX_PASSES) -> DataFrame:
    """``source``, ``source_size``, ``target`` from ``source``, ``source_size``.

    A target is its weight times a common level, but at most ``passes`` times
    the source's size; the level is such that targets add up to the total.
    Sources are sorted by the ratio at which they reach their limit: those
    before the first that stays below its limit are full.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    ranked = sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long"))
    limit = F.lit(passes) * F.col("source_size")
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    filled = (
        ranked.withColumn("ratio", limit.cast("double") / F.col("weight"))
        .withColumn("full", F.coalesce(F.sum(limit).over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(whole))
        .withColumn("level", (F.col("total") - F.col("full")).cast("double") / F.col("open"))
        .withColumn("common", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(whole)["level"])
    )
    return filled.select("source", "source_size", F.least(limit.cast("double"), F.col("common") * F.col("weight")).alias("target"))


def _key(source: Column) -> Column:
    """A source without nulls, for joins."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def _spread(rows: DataFrame, times: Column, most: int) -> DataFrame:
    """Each row ``times`` times, numbered from 1 as ``nth``; rows with very many are dealt out in pieces."""
    if most <= CROWDED_ROWS:
        return rows.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), times)))
    pieces = rows.withColumns({"_times": times, "_first": F.explode(F.sequence(F.lit(1).cast("long"), times, F.lit(CROWDED_ROWS).cast("long")))})
    pieces = pieces.repartition(F.xxhash64(F.col("_first"), F.monotonically_increasing_id()))
    last = F.least(F.col("_times"), F.col("_first") + CROWDED_ROWS - 1)
    return pieces.withColumn("nth", F.explode(F.sequence(F.col("_first"), last))).drop("_times", "_first")


def _queued(docs: DataFrame, weights: tuple[int, ...], passes: int, seed: str, crowded: int) -> tuple[DataFrame, int]:
    """``doc_id``, ``source``, ``size``, ``upto`` (words of the source up to and including the row), ``source_size``, ``target`` of each row; and all words."""
    mark = begin()
    source = F.col("source").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), _key(source).alias("key"), size_of(F.col("text")).alias("size"))
    rows = materialise(rows.withColumn("h", shuffle_key(F.col("doc_id"), seed)), "mix-rows")
    n_rows = rows.count()
    bits = max(0, math.ceil(math.log2(max(1, n_rows) / BUCKET_ROWS)))
    rows = rows.withColumn("bucket", F.shiftright("h", HASH_BITS - bits))

    # totals of buckets, and of runs of buckets, are added from the first on
    by_bucket = rows.groupBy("key", "bucket").agg(F.max("source").alias("source"), F.sum("size").alias("in_bucket"), F.count(F.lit(1)).alias("n"))
    by_bucket = materialise(by_bucket.withColumn("run", F.floor(F.col("bucket") / BUCKETS_AT_ONCE)), "mix-buckets")
    runs = by_bucket.groupBy("key", "run").agg(F.max("source").alias("source"), F.sum("in_bucket").alias("in_run"))
    in_source = Window.partitionBy("key")
    runs = runs.select("key", "source", "run", (F.sum("in_run").over(in_source.orderBy("run")) - F.col("in_run")).alias("before_run"), F.sum("in_run").over(in_source).alias("source_size"))
    runs = materialise(runs, "mix-runs")
    goals = targets(runs.groupBy("key").agg(F.max("source").alias("source"), F.max("source_size").alias("source_size")).drop("key"), weights, passes)
    places = by_bucket.select("key", "run", "bucket", (F.sum("in_bucket").over(Window.partitionBy("key", "run").orderBy("bucket")) - F.col("in_bucket")).alias("before_bucket"))
    places = places.join(runs.drop("source"), ["key", "run"]).join(goals.select(_key(F.col("source")).alias("key"), "target"), "key")
    places = materialise(places.select("key", "bucket", (F.col("before_run") + F.col("before_bucket")).alias("before"), "source_size", "target"), "mix-places")
    budget, most = by_bucket.agg(F.sum("in_bucket"), F.max("n")).first()

    if (most or 0) > crowded:
        rows = rows.groupBy("key", "source", "bucket", "h", "doc_id", "size").agg(F.count(F.lit(1)).alias("n"))
    else:
        rows = rows.withColumn("n", F.lit(1).cast("long"))
    in_bucket = Window.partitionBy("key", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    queued = rows.withColumn("run", F.sum(F.col("size") * F.col("n")).over(in_bucket)).join(places, ["key", "bucket"])
    queued = queued.select("doc_id", "source", "size", "n", (F.col("before") + F.col("run") - F.col("n") * F.col("size")).alias("begin"), "source_size", "target")
    if (most or 0) > crowded:
        queued = _spread(queued, F.col("n"), most)
    else:
        queued = queued.withColumn("nth", F.col("n"))
    queued = queued.select("doc_id", "source", "size", (F.col("begin") + F.col("nth") * F.col("size")).alias("upto"), "source_size", "target")
    queued = materialise(queued, "mix-queued")
    settle(docs.sparkSession, mark, queued)
    return queued, budget or 0


def _place(k: Column) -> Column:
    return k * F.col("source_size") + F.col("upto")


def _finish(k: Column) -> Column:
    return _place(k).cast("double") / F.col("target")


def _end(queued: DataFrame, budget: int, passes: int):
    """The first copy that is not taken: ``finish``, ``source``, ``place``; none if all are taken."""
    taking = queued.where((F.col("size") > 0) & (F.col("target") > 0))
    k = F.col("pass")
    copies = taking.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1)))).select(_finish(k).alias("finish"), "source", _place(k).alias("place"), "size")
    low, high, used = 0.0, copies.agg(F.max("finish")).first()[0], 0
    if high is None:
        return None
    while True:
        at = F.least(F.lit(RANGES - 1), F.greatest(F.lit(0), F.floor((F.col("finish") - F.lit(low)) / F.lit(high - low) * RANGES)))
        sums = sorted(map(tuple, copies.groupBy(at.alias("at")).agg(F.sum("size"), F.count(F.lit(1))).collect()))  # RANGES rows at most
        for range_, words, many in sums:
            if used + words > budget:
                break
            used += words
        else:
            return None
        copies, width = copies.where(at == range_), (high - low) / RANGES
        low, high = low + range_ * width, low + (range_ + 1) * width
        if many <= SORTED_ROWS or high - low <= 1e-15 * high:
            break
    order = [F.col("finish"), F.col("source").asc_nulls_last(), F.col("place")]
    upto = F.lit(used) + F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return copies.withColumn("upto", upto).where(F.col("upto") > budget).orderBy(*order).first()


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = MAX_PASSES, seed: str = "mix", crowded: int = CROWDED_ROWS) -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``taken``, ``copies`` of each row."""
    queued, budget = _queued(docs, weights, passes, seed, crowded)
    last = _end(queued, budget, passes)
    n_copies = F.lit(passes) if last is None else sum((F.when(_before(_finish(F.lit(k)), _place(F.lit(k)), last), 1).otherwise(0) for k in range(passes)), F.lit(0))
    out = queued.withColumn("copies", F.when((F.col("size") > 0) & (F.col("target") > 0), n_copies).otherwise(0).cast("int"))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies")


def _before(finish: Column, place: Column, last) -> Column:
    """Whether a copy sorts before the first copy that is not taken."""
    source = F.col("source")
    same = source.eqNullSafe(F.lit(last["source"]))
    less = source.isNotNull() if last["source"] is None else F.coalesce(source < F.lit(last["source"]), F.lit(False))
    return (finish < F.lit(last["finish"])) | ((finish == F.lit(last["finish"])) & (less | (same & (place < F.lit(last["place"])))))


def take(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = MAX_PASSES, seed: str = "mix", crowded: int = CROWDED_ROWS) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it takes them."""
    mark, agree = begin(), ["t_id", "t_source", "t_size"]
    decided = mix(docs, weights, passes, seed, crowded).groupBy(F.col("doc_id").alias("t_id"), F.col("source").alias("t_source"), F.col("size").alias("t_size"))
    decided = decided.agg(F.min("copies").alias("t_copies"), F.count_if(F.col("copies") > 0).alias("t_taken"), F.sum("copies").alias("t_sum"), F.count(F.lit(1)).alias("t_rows")).where("t_taken > 0")
    # of rows that agree, some may be taken once more than the others
    decided = materialise(decided.select(*agree, "t_copies", (F.col("t_sum") - F.col("t_copies") * F.col("t_rows")).alias("t_more")), "mix-decided")
    settle(docs.sparkSession, mark, decided)
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("doc_id").cast("long").alias("k_id"), F.col("source").cast("string").alias("k_source"), size_of(F.col("text")).alias("k_size"))
    same = F.col("k_id").eqNullSafe(F.col("t_id")) & F.col("k_source").eqNullSafe(F.col("t_source")) & (F.col("k_size") == F.col("t_size"))
    alike = keyed.join(broadcast_if_small(decided.where("t_more = 0")), same)
    out = alike.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("t_copies")))).select("doc.*")
    parted = decided.where("t_more > 0")  # one a source and pass at most: those in which the budget ends
    if parted.isEmpty():
        return out
    row = F.xxhash64(F.to_json("doc"))
    rows = keyed.join(broadcast_if_small(parted), same).groupBy(*agree, "t_copies", "t_more", row.alias("row")).agg(F.first("doc").alias("doc"), F.count(F.lit(1)).alias("n"))
    rows = materialise(rows.withColumn("part", F.pmod("row", F.lit(RANGES))), "mix-parted")
    parts = rows.groupBy(*agree, "part").agg(F.sum("n").alias("in_part"))
    parts = parts.withColumn("before", F.sum("in_part").over(Window.partitionBy(*agree).orderBy("part")) - F.col("in_part"))
    parts = materialise(parts.select(*[F.col(c).alias(f"p_{c}") for c in agree], F.col("part").alias("p_part"), "before"), "mix-parts")
    met = (F.col("part") == F.col("p_part")) & F.col("t_id").eqNullSafe(F.col("p_t_id")) & F.col("t_source").eqNullSafe(F.col("p_t_source")) & (F.col("t_size") == F.col("p_t_size"))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy(*agree, "part").orderBy("row")) - F.col("n")
    more = F.greatest(F.lit(0), F.least(F.col("n"), F.col("t_more") - upto))
    rows = rows.join(parts, met).withColumn("times", F.col("n") * F.col("t_copies") + more).where("times > 0")
    most = rows.agg(F.max("times")).first()[0] or 0
    return out.unionByName(_spread(rows.select("doc", "times"), F.col("times"), most).select("doc.*"))


#: DuckDB's rows for the default parameters.
SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rn, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT source, source_size, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)]::BIGINT AS weight FROM s),
q AS (SELECT *, CAST(3 * source_size AS DOUBLE) / weight AS ratio FROM r),
f AS (
  SELECT *,
    (SELECT sum(source_size) FROM s) AS total,
    coalesce(sum(3 * source_size) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_,
    sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_
  FROM q),
l AS (SELECT *, CAST(total - full_ AS DOUBLE) / CAST(open_ AS DOUBLE) AS level FROM f),
g AS (
  SELECT source, source_size,
    least(CAST(3 * source_size AS DOUBLE), (SELECT level FROM l WHERE ratio >= level ORDER BY ratio, level LIMIT 1) * weight) AS target
  FROM l),
w AS MATERIALIZED (
  SELECT d.*, g.source_size, g.target,
    sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id NULLS FIRST, size, rn ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
c AS (
  SELECT w.*, p.pass * source_size + upto AS place, CAST(p.pass * source_size + upto AS DOUBLE) / target AS finish
  FROM w, (SELECT unnest([0, 1, 2]) AS pass) p WHERE size > 0 AND target > 0),
o AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, place ROWS UNBOUNDED PRECEDING) AS used FROM c),
t AS (SELECT rn, count(*) AS copies FROM o WHERE used <= (SELECT sum(size) FROM d) GROUP BY rn)
SELECT w.doc_id, w.size, CAST(w.source_size AS BIGINT) AS source_size, w.target,
       CAST(coalesce(t.copies, 0) * w.size AS BIGINT) AS taken
FROM w LEFT JOIN t USING (rn)
"""
