"""Approximate nearest neighbours by adaptive dimension scan over inverted lists.

Method: centroids are fitted on a bounded sample; every vector is put into the
list of its nearest centroid and every query probes its nearest lists, as many
as the sample shows to be needed for the recall asked for.  Inside a list vectors are rotated by one fixed random orthogonal matrix and laid out
in column blocks.  A scan adds squared differences block by block; after each
block a hypothesis test on the partial distance abandons the candidates that
can hardly beat the k-th best so far.  What survives is measured exactly on
the original vectors in double precision.

At scale: lists are cut into chunks of bounded size by a hash of the id, so a
vector that a third of all rows share is spread over many tasks, and a list's
queries into chunks of their own; a chunk keeps its ``k + 1`` best before the
merge.  Equal query vectors are searched once.  Lists grow with the root of the
number of vectors; what is broadcast has a fixed bound (``MAX_LISTS`` centroids).

Fitted on a sample: at most about ``SAMPLE_ROWS`` vectors, chosen by a hash of
their id; every vector is indexed.

Defined results: vectors that are null, zero, hold null or non-finite
components, have no id, or whose length is not the most frequent one (the
smaller on a tie) take no part; ties go to the smaller ``vec_id``; rows that
repeat a ``vec_id`` count once, as a neighbour and as a query, with their
smallest distance, and never as a neighbour of that id; fewer than ``k`` candidates give fewer rows; an empty
table gives none; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import begin, materialise, parallelism, pieces, settle

K = 10
QUERY_EVERY = 100
SAMPLE_ROWS = 32768
MAX_LISTS = 8192
CHUNK_ROWS = (64, 65536)
#: Queries that meet a chunk of a list at once, on average.
CHUNK_QUERIES = 4096
BLOCK_DIMS = 16
#: Of the hypothesis test; larger keeps more candidates.
EPSILON = 2.1
#: Share of neighbours that the probed lists must hold, judged on the sample.
RECALL = 0.96
SEED = 7


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """``vec_id``, ``v`` of the vectors that take part, and their length."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0))
    lengths = kept.groupBy(F.size("v").alias("dims")).count().orderBy(F.col("count").desc(), "dims").first()
    dims = lengths["dims"] if lengths else 0
    return kept.where(F.size("v") == dims), dims


def rotation(dims: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def centroids(sample: np.ndarray, lists: int, rounds: int = 8, seed: int = SEED) -> np.ndarray:
    """Lloyd's iterations from distinct sample rows."""
    distinct = np.unique(sample, axis=0)
    rng = np.random.default_rng(seed)
    found = distinct[rng.permutation(len(distinct))[:lists]]
    for _ in range(rounds):
        near = nearest(sample, found, 1)[:, 0]
        sums = np.zeros_like(found)
        np.add.at(sums, near, sample)
        counts = np.bincount(near, minlength=len(found))
        found = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], found)
    return found


def nearest(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest centres of each row, nearest first, the smaller number on ties."""
    out = np.empty((len(x), n), dtype=np.int32)
    norms = (centres * centres).sum(axis=1)
    for at in range(0, len(x), 2048):
        d = norms - 2.0 * (x[at : at + 2048] @ centres.T)
        if n == 1:
            out[at : at + 2048, 0] = d.argmin(axis=1)
        else:
            some = np.argpartition(d, n - 1, axis=1)[:, :n] if n < d.shape[1] else np.tile(np.arange(d.shape[1]), (len(d), 1))
            part = np.take_along_axis(d, some, axis=1)
            out[at : at + 2048] = np.take_along_axis(some, np.lexsort((some, part), axis=1), axis=1)
    return out


def probes_for(sample: np.ndarray, centres: np.ndarray, k: int, recall: float, asked: int = 256, seed: int = SEED) -> int:
    """How many lists a query must probe so that ``recall`` of the ``k`` nearest within the sample lie in them.

    Neighbours in the whole table are nearer than those in a sample of it, so
    this errs to the safe side.
    """
    picked = np.random.default_rng(seed).permutation(len(sample))[:asked]
    near, home = nearest(sample[picked], centres, len(centres)), nearest(sample, centres, 1)[:, 0]
    place = np.empty_like(near)
    np.put_along_axis(place, near, np.arange(len(centres), dtype=near.dtype)[None, :], axis=1)
    norms = (sample * sample).sum(axis=1)
    need = []
    for row, at in enumerate(picked):
        d = norms - 2.0 * (sample @ sample[at])
        best = np.argpartition(d, min(k, len(d) - 1))[: k + 1]
        need.append(place[row, home[best[best != at]]])
    if not len(flat := np.sort(np.concatenate(need))):
        return 1
    return int(flat[min(len(flat) - 1, math.ceil(recall * len(flat)))]) + 1


def scan_list(query: np.ndarray, q_rot: np.ndarray, ids: np.ndarray, rows: np.ndarray, rot: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and exact distances of the ``keep`` best of a list. ``ids`` ascend; ``rot``: column blocks ``[blocks][rows, width]``."""
    dims = rows.shape[1]
    best_d, best_i = np.zeros(0), np.zeros(0, dtype=np.int64)
    step = max(64, 4 * keep)
    at = 0
    while at < len(ids):
        live = np.arange(at, min(len(ids), at + step))
        at, step = at + step, 2048
        limit = best_d[keep - 1] if len(best_d) >= keep else math.inf
        if limit < math.inf:
            part, done = np.zeros(len(live)), 0
            for block in rot:
                width = block.shape[1]
                diff = block[live] - q_rot[done : done + width]
                part = part + np.einsum("ij,ij->i", diff, diff)
                done += width
                bound = (limit * (1 + EPSILON / math.sqrt(done))) ** 2 * done / dims if done < dims else limit * limit * (1 + 1e-9)
                if not (ok := part <= bound).all():
                    live, part = live[ok], part[ok]
                if not len(live):
                    break
        if len(live):
            diff = rows[live] - query
            best_d = np.concatenate([best_d, np.sqrt(np.einsum("ij,ij->i", diff, diff))])
            best_i = np.concatenate([best_i, ids[live]])
            order = np.lexsort((best_i, best_d))
            best_d, best_i = best_d[order], best_i[order]
            if len(best_i) > 1:
                _, first = np.unique(best_i, return_index=True)
                if len(first) < len(best_i):
                    first.sort()
                    best_d, best_i = best_d[first], best_i[first]
            best_d, best_i = best_d[:keep], best_i[:keep]
    return best_i, best_d


def search(vectors: DataFrame, k: int = K, query_every: int = QUERY_EVERY, recall: float = RECALL) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of the ``k`` nearest found of every ``query_every``-th id."""
    spark, mark = vectors.sparkSession, begin()
    schema = "query_id long, rank int, vec_id long, score double"
    kept, dims = usable(vectors)
    n = kept.count()
    if not n:
        return spark.createDataFrame([], schema)
    share = min(1.0, SAMPLE_ROWS / n)
    picked = kept.where(F.pmod(F.xxhash64(F.col("vec_id"), F.lit(SEED)), F.lit(1 << 20)) < int(math.ceil(share * (1 << 20))))
    sample = _matrix(picked.select("v").toArrow().column("v"), dims)
    if not len(sample):
        sample = _matrix(kept.select("v").limit(1).toArrow().column("v"), dims)
    centres = centroids(sample, max(1, min(MAX_LISTS, round(math.sqrt(n)), len(sample))))
    lists = len(centres)
    probes = probes_for(sample, centres, k, recall)
    shared = spark.sparkContext.broadcast(centres)

    def assign(batches):
        for batch in pieces(batches, 4096):
            if batch.num_rows:
                near = nearest(_matrix(batch.column(1), dims), shared.value, 1)[:, 0]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.int32())], names=["vec_id", "v", "list"])

    def probe(batches):
        for batch in pieces(batches, 4096):
            if batch.num_rows:
                near = nearest(_matrix(batch.column(1), dims), shared.value, probes)
                at = np.repeat(np.arange(batch.num_rows), probes)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(near.reshape(-1), pa.int32())], names=["q_key", "v", "list"])

    indexed = materialise(kept.mapInArrow(assign, "vec_id long, v array<double>, list int"), "ann-index")
    chunk = min(CHUNK_ROWS[1], max(CHUNK_ROWS[0], n // (8 * parallelism(spark))))
    q_key = F.md5(F.col("v").cast("string").cast("binary"))
    queries = materialise(kept.where(F.pmod("vec_id", F.lit(query_every)) == 0).select(F.col("vec_id").alias("query_id"), q_key.alias("q_key"), "v").dropDuplicates(["query_id", "q_key"]), "ann-queries")
    once = queries.groupBy("q_key").agg(F.first("v").alias("v"))
    asked_lists = materialise(once.select("q_key", "v").mapInArrow(probe, "q_key string, v array<double>, list int"), "ann-probed")
    per_list, per_query = (dict(map(tuple, x.groupBy("list").count().collect())) for x in (indexed, asked_lists))  # at most MAX_LISTS rows
    sizes = [(k, -(-many // chunk), -(-per_query.get(k, 1) // CHUNK_QUERIES)) for k, many in per_list.items()]
    sizes = F.broadcast(spark.createDataFrame(sizes, "list int, chunks long, parts long"))  # at most MAX_LISTS rows
    part = F.pmod(F.xxhash64("q_key"), F.col("parts")).alias("part")
    probed = asked_lists.join(sizes, "list").select("q_key", "v", "list", part, F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
    chunked = indexed.join(sizes, "list").select("vec_id", "v", "list", F.pmod(F.xxhash64("vec_id"), F.col("chunks")).alias("chunk"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    turn = rotation(dims)

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, out_q, out_i, out_d = left.column("q_key").to_pylist(), [], [], []
        if len(keys) and right.num_rows:
            ids, rows = np.asarray(right.column("vec_id")), _matrix(right.column("v"), dims)
            order = np.argsort(ids, kind="stable")
            ids, rows = ids[order], rows[order]
            turned = rows @ turn
            blocks = [np.ascontiguousarray(turned[:, a : a + BLOCK_DIMS]) for a in range(0, dims, BLOCK_DIMS)]
            asked = _matrix(left.column("v"), dims)
            for key, query, q_rot in zip(keys, asked, asked @ turn):
                i, d = scan_list(query, q_rot, ids, rows, blocks, k + 1)
                out_q += [key] * len(i)
                out_i.append(i)
                out_d.append(d)
        return pa.table({"q_key": pa.array(out_q, pa.string()), "vec_id": pa.array(np.concatenate(out_i) if out_i else [], pa.int64()), "score": pa.array(np.concatenate(out_d) if out_d else [], pa.float64())})

    found = probed.groupBy("list", "chunk", "part").cogroup(chunked.groupBy("list", "chunk", "part")).applyInArrow(scan, "q_key string, vec_id long, score double")
    found = found.groupBy("q_key", "vec_id").agg(F.min("score").alias("score"))
    best = Window.partitionBy("q_key").orderBy("score", "vec_id")
    top = materialise(found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1).drop("place"), "ann-top")
    settle(spark, mark, queries, top)
    paired = queries.select("query_id", "q_key").join(top, "q_key").where(F.col("vec_id") != F.col("query_id"))
    paired = paired.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return paired.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _matrix(column, dims: int) -> np.ndarray:
    """Rows of a list column as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(-1, dims) if dims else flat.reshape(0, 0)
