"""Job, correction and audit streams. An extension: the modelled service polls rows instead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quillstone.operators.store import latest

# Stages of a job and the progress they stand for.
STAGES = {"queued": 0.0, "loading": 0.05, "preprocessing": 0.15, "understanding": 0.25, "detection": 0.35, "recognition": 0.6, "completed": 1.0, "failed": 1.0}
EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def stage_of(event_type: Column) -> Column:
    """The job stage that an event of the test data stands for."""
    return F.when(event_type == "signup", "queued").when(event_type == "view", "loading").when(event_type == "click", "recognition").when(event_type == "purchase", "completed").when(event_type == "error", "failed").otherwise("queued")


def progress_of(stage: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in STAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, stage), F.lit(0.0))


def status_of(stage: Column) -> Column:
    return F.when(stage.isin("completed", "failed", "queued"), stage).otherwise("processing")


def job_rows(events: DataFrame) -> DataFrame:
    stage = stage_of(F.col("event_type"))
    return events.select(F.col("user_id").alias("document_id"), stage.alias("stage"), status_of(stage).alias("status"), progress_of(stage).alias("progress"), F.col("ts").alias("updated_at"), "event_id")


def current_jobs(events: DataFrame) -> DataFrame:
    """The last state of each job, in batch."""
    return latest(job_rows(events), ["document_id"], ["updated_at", "event_id"])


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def deduplicated(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Each event once, state bounded by the watermark."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])


def stage_counts(events: DataFrame, window: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """Events per window and stage."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", window), stage_of(F.col("event_type")).alias("stage")).count()


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))


def keep_jobs(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep a table of current jobs: each micro-batch writes the next version of the table, so a repeated batch changes nothing."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = latest(job_rows(batch), ["document_id"], ["updated_at", "event_id"])
        if number:
            old = spark.read.schema(new.schema).parquet(f"{path}/v={number - 1}")
            new = latest(old.unionByName(new), ["document_id"], ["updated_at", "event_id"])
        new.write.mode("overwrite").parquet(f"{path}/v={number}")

    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Corrections and audit events: an append-only sink."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
