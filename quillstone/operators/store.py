"""Upserts, append tables and the review loop over Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions import text as T


def stable_id(*parts: Column) -> Column:
    """An id that a rerun gives again."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *[p.cast("string") for p in parts]), 256), 1, 32)


def latest(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The last row of each key; map-side combined, so a key with many versions costs little."""
    rest = [c for c in rows.columns if c not in keys]
    ordered = [F.col(o) if isinstance(o, str) else o for o in order]
    by = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(ordered)])
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("_row"))
    return best.select(*keys, "_row.*").select(*rows.columns)


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], order: str, keep_when_null: tuple[str, ...] = ()) -> DataFrame:
    """``base`` with the last change of each key; columns in ``keep_when_null`` keep their old value where the change has none."""
    new = latest(changes, keys, [order])
    rest = [c for c in base.columns if c not in keys]
    joined = base.alias("b").join(new.alias("n"), keys, "full_outer")
    there = F.col(f"n.{order}").isNotNull()
    merged = [F.when(there, F.coalesce(F.col(f"n.{c}"), F.col(f"b.{c}")) if c in keep_when_null else F.col(f"n.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in rest]
    return joined.select(*keys, *merged).select(*base.columns)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def write_once(blobs: DataFrame, existing: DataFrame) -> DataFrame:
    """Blobs whose digest is new: one of each."""
    keyed = blobs.withColumn("sha256", F.sha2("content", 256)).dropDuplicates(["sha256"])
    return keyed.join(existing.select("sha256"), "sha256", "left_anti")


def blob_path(digest: Column) -> Column:
    return F.concat_ws("/", F.lit("blobs"), F.substring(digest, 1, 2), digest)


def lineage(artifacts: DataFrame) -> DataFrame:
    """Each artifact with its ``root`` and its distance to it, ``steps``; an unknown source ends a chain.

    Every round doubles how far each artifact looks, so a chain of any length
    ends after a few rounds, each kept for the next; chains that run in a
    circle raise an error.
    """
    known = artifacts.select(F.col("id").alias("k_id"))
    there = artifacts.select("id", "source_artifact_id").join(known, F.col("source_artifact_id") == F.col("k_id"), "left")
    out = there.select("id", F.coalesce("k_id", "id").alias("root"), F.when(F.col("k_id").isNotNull(), 1).otherwise(0).cast("long").alias("steps")).persist()
    longest = out.count()
    while True:
        ahead = out.select(F.col("id").alias("a_id"), F.col("root").alias("a_root"), F.col("steps").alias("a_steps"))
        moved = out.join(ahead, F.col("root") == F.col("a_id")).select("id", F.col("a_root").alias("root"), (F.col("steps") + F.col("a_steps")).alias("steps"), F.col("a_steps").alias("more")).persist()
        # every step of a chain that ends is another artifact
        more, most = moved.agg(F.max("more"), F.max("steps")).first()
        if not more:
            return out
        if most >= longest:
            raise ValueError("sources of artifacts run in a circle")
        out = moved.drop("more")


def review_tasks(words: DataFrame) -> DataFrame:
    """A task for each word that needs a reader; high-risk ones first."""
    need = words.where(F.col("decision_state").isin(T.REVIEW, T.ILLEGIBLE))
    return need.select(F.col("word_id").alias("word_id"), F.col("decision_state").alias("reason"), F.when(F.col("is_high_risk"), 2).otherwise(1).alias("priority"))


def correct(words: DataFrame, patches: DataFrame, order: list[str], ascii_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """Apply readers' patches (``word_id``, ``new_text``, ``new_state``, order columns): the words as they are now, and the log.

    A text without a state accepts; a state without a text keeps the text; an
    unknown state voids the patch.  Each log row has what stood before it.
    """
    state = F.col("new_state")
    valid = patches.where(state.isNull() | T.parse_state(state).isNotNull())
    clean = F.when(F.col("new_text") == T.ILLEGIBLE_TEXT, F.col("new_text")).otherwise(T.normalize_candidate(F.col("new_text"), ascii_only))
    given = valid.select("word_id", *order, clean.alias("p_text"), F.coalesce(T.parse_state(state), F.when(F.col("new_text").isNotNull(), F.lit(T.ACCEPTED))).alias("p_state"))
    hit = given.join(words.select("word_id", "text", "decision_state"), "word_id")
    w = Window.partitionBy("word_id").orderBy(*order)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    log = hit.select(
        "word_id",
        *order,
        F.coalesce(F.last("p_text", True).over(before), F.col("text")).alias("previous_text"),
        F.coalesce(F.last("p_text", True).over(upto), F.col("text")).alias("new_text"),
        F.coalesce(F.last("p_state", True).over(before), F.col("decision_state")).alias("previous_state"),
        F.coalesce(F.last("p_state", True).over(upto), F.col("decision_state")).alias("new_state"),
    )
    now = latest(log.select("word_id", *order, F.col("new_text").alias("c_text"), F.col("new_state").alias("c_state")), ["word_id"], order)
    joined = words.join(now.select("word_id", "c_text", "c_state"), "word_id", "left")
    out = joined.withColumns({"text": F.coalesce("c_text", "text"), "decision_state": F.coalesce("c_state", "decision_state")}).select(*words.columns)
    return out, log


def create_tables(spark: SparkSession, root: str) -> None:
    """Empty Parquet tables of all schemas under ``root``, where they are not there yet."""
    from quillstone.schemas import TABLES

    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{root}/{name}")
