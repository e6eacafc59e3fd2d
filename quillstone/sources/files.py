"""Files in and out: uploads, manifests, images, exports."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.functions import text as X

# What may be uploaded.
EXTENSIONS = ("png", "jpg", "jpeg", "pdf")
MEDIA_TYPES = ("image/png", "image/jpeg", "image/jpg", "application/pdf")

CASE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "image", "image_path", "ground_truth", "source", "difficulty", "script", "notes")]
    + [T.StructField(n, T.BooleanType()) for n in ("is_synthetic", "needs_gt_review")]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("tags", "difficulty_tags", "ground_truth_lines")]
)


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """Files of an accepted kind with their digest; ``problem`` names why a file is refused."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return gate(files.withColumn("filename", X.file_name(F.col("path"))).withColumn("sha256", F.sha2("content", 256)))


def gate(files: DataFrame, media_type: str | None = None) -> DataFrame:
    """A kind is accepted by its media type or by its extension; empty files are not."""
    known = X.extension(F.col("filename")).isin(*EXTENSIONS)
    if media_type:
        known = known | F.coalesce(F.col(media_type).isin(*MEDIA_TYPES), F.lit(False))
    return files.withColumn("problem", F.when(~known, "unsupported_media_type").when(F.length("content") == 0, "empty_file"))


def page_kind(media_type: Column, filename: Column) -> Column:
    """``pdf`` or ``image``."""
    return F.when((media_type == "application/pdf") | (X.extension(filename) == "pdf"), "pdf").otherwise("image")


def manifest_cases(spark: SparkSession, path: str, split: str) -> DataFrame:
    """Cases of manifests: an object with ``cases`` or a bare list of cases; no file: no cases."""
    return parse_manifests(spark.read.text(path, wholetext=True), split)


def parse_manifests(texts: DataFrame, split: str) -> DataFrame:
    """Cases of manifests given as texts, ``value``."""
    as_object = F.from_json("value", T.StructType([T.StructField("cases", T.ArrayType(CASE))]))["cases"]
    as_list = F.from_json("value", T.ArrayType(CASE))
    bare = F.substring(F.ltrim("value"), 1, 1) == "["
    rows = texts.select(F.explode(F.when(bare, as_list).otherwise(as_object)).alias("c")).select("c.*")
    tags = F.coalesce("tags", "difficulty_tags", F.array())
    with_level = F.when(F.col("difficulty").isNotNull() & ~F.array_contains(tags, F.col("difficulty")), F.concat(tags, F.array("difficulty"))).otherwise(tags)
    return rows.withColumns({"split": F.lit(split), "tags": with_level, "image": F.coalesce("image", "image_path")}).drop("image_path", "difficulty_tags")


def select_cases(cases: DataFrame, require_truth: bool = True, hard_only: bool = False, allow_synthetic: bool = True) -> DataFrame:
    out = cases
    if require_truth:
        out = out.where(X.strip(F.coalesce("ground_truth", F.lit(""))) != "")
    if hard_only:
        out = out.where(F.exists(F.coalesce("tags", F.array()), lambda t: F.lower(t).isin("hard", "extreme")))
    return out if allow_synthetic else out.where(~F.coalesce("is_synthetic", F.lit(False)))


def resolve_images(cases: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """Find each case's image in a listing (``path``, ``sha256``): as named, below the root, in its ``images``, beside the root."""
    name = F.regexp_extract("image", r"([^/\\]+)$", 1)
    places = [F.col("image"), F.concat(F.lit(root + "/"), F.col("image")), F.concat(F.lit(root + "/images/"), name), F.concat(F.lit(root.rpartition("/")[0] + "/"), F.col("image"))]
    tried = cases.withColumn("_try", F.arrays_zip(F.array(*[F.lit(i) for i in range(4)]).alias("i"), F.array(*places).alias("p")))
    flat = tried.select("split", "id", F.explode("_try").alias("t")).select("split", "id", F.col("t.i").alias("i"), F.col("t.p").alias("path"))
    found = flat.join(files.select("path", "sha256"), "path").groupBy("split", "id").agg(F.min_by(F.struct("path", "sha256"), "i").alias("f"))
    return cases.join(found, ["split", "id"], "left").withColumns({"image_sha256": F.coalesce("f.sha256", F.lit("")), "image_name": name}).drop("f")


def write_text(rows: DataFrame, column: str, path: str) -> None:
    rows.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def report_text(rows: list[dict], title: str, columns: list[str]) -> tuple[str, str]:
    """A small collected summary as JSON and as a Markdown table."""
    head = [f"# {title}", "", "| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    body = ["| " + " | ".join(f"{r.get(c):.3f}" if isinstance(r.get(c), float) else str(r.get(c)) for c in columns) + " |" for r in rows]
    return json.dumps(rows, indent=2, sort_keys=True), "\n".join(head + body)


def held_out_export(documents: DataFrame, artifacts: DataFrame, words: DataFrame) -> DataFrame:
    """Cases made of finished documents: one per distinct image, the text as recognised, marked as needing review."""
    joined = documents.join(artifacts.select(F.col("id").alias("a_id"), "sha256"), documents["source_artifact_id"] == F.col("a_id"))
    first = joined.groupBy("sha256").agg(F.min_by(F.struct("id", "filename"), F.struct("created_at", "id")).alias("d")).select("sha256", "d.*")
    text = words.groupBy("document_id").agg(X.joined(F.col("text"), F.col("reading_order")).alias("ground_truth"))
    out = first.join(text, first["id"] == text["document_id"], "left")
    return out.select("id", X.file_name(F.col("filename")).alias("image"), F.coalesce("ground_truth", F.lit("")).alias("ground_truth"), "sha256", F.lit(True).alias("needs_gt_review"), F.lit(False).alias("is_synthetic"))


def pdf_pages(data: bytes, dpi: int = 200) -> list[bytes]:
    """Pages of a PDF as PNG images, where pdf2image and poppler are installed."""
    import io

    try:
        from pdf2image import convert_from_bytes
    except ImportError as e:
        raise RuntimeError("PDF input needs pdf2image and poppler") from e
    out = []
    for page in convert_from_bytes(data, dpi=dpi):
        buffer = io.BytesIO()
        page.save(buffer, "PNG")
        out.append(buffer.getvalue())
    return out


def explode_pages(files: DataFrame) -> DataFrame:
    """One row a page: images as they are, PDFs page by page."""
    pdf = page_kind(F.lit(None).cast("string"), F.col("filename")) == "pdf"

    def pages(batches):
        for batch in batches:
            rows = [(name, i, page) for name, data in zip(batch["filename"], batch["content"]) for i, page in enumerate(pdf_pages(data))]
            yield pd.DataFrame(rows, columns=["filename", "page_index", "content"])

    images = files.where(~pdf).select("filename", F.lit(0).alias("page_index"), "content")
    return images.unionByName(files.where(pdf).select("filename", "content").mapInPandas(pages, "filename string, page_index int, content binary"))
