"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a worker gets and takes up at once; whole texts travel, so that a
#: batch stays small enough for a worker that shares 3 GB with its JVM.
PIECE_ROWS = 1000
#: And about so many bytes, where texts are very long.
BATCH_BYTES = "32m"

_own_dir: list[str] = []


def free_name(columns: list[str], wanted: str) -> str:
    """A column name like ``wanted`` that none of ``columns`` has."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the setting is absent (a local session, as in tests) a folder
    of our own is used.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="quillstone-"))
    return "file://" + _own_dir[0]


@contextmanager
def small_batches(spark: SparkSession):
    """Small Arrow batches for the actions inside; the session's options are then as they were."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(PIECE_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
    there = spark.conf.getAll
    given = {k: there[k] for k in wanted if k in there}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k in wanted:
            if k in given:
                spark.conf.set(k, given[k])
            else:
                spark.conf.unset(k)


#: What was written and not yet deleted, oldest first.
_written: list[str] = []


def materialise(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    Cuts lineage and fixes what later passes see; the files outlive any
    executor.  Task commits make a retried task harmless.  The files stay
    until :func:`settle` or :func:`release` deletes them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    with small_batches(spark):
        df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _written.remove(path)


def begin() -> int:
    """A mark for :func:`settle`."""
    return len(_written)


def settle(spark: SparkSession, mark: int, *keep: DataFrame) -> None:
    """Delete what :func:`materialise` wrote since the mark, but for the tables ``keep`` that a result still reads."""
    stay = {df._written_to for df in keep}
    _delete(spark, [p for p in _written[mark:] if p not in stay])


def release(spark: SparkSession, *keep: DataFrame) -> None:
    """Delete everything that the operators wrote, but for ``keep``. Call it when their results have been read or written elsewhere."""
    settle(spark, 0, *keep)


#: Rows of a few dozen bytes that may be broadcast: some 16 MB.
BROADCAST_ROWS = 400_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, a written table of narrow rows, with a broadcast hint if it has at most ``rows`` of them; else it is joined by a shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(batches, rows: int = PIECE_ROWS):
    """The record batches cut to at most ``rows`` rows; empty ones are left out."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def id_crc(doc_id: Column, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo ``mod`` (null id: of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def parallelism(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions", "8")))
