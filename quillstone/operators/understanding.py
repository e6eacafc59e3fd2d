"""What page readers say about whole documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions import geometry as G
from quillstone.functions import text as T


def page_views(pages: DataFrame) -> DataFrame:
    """Pages (``document_id``, ``page_index``, ``reply``) with ``view``: the reply typed, names folded to known ones; null without a usable reply."""
    reply = T.parse_reply(F.col("reply"))
    regions = F.transform(F.coalesce(reply["layout_regions"], F.array()), lambda r: F.struct(G.parse_region(r["type"]).alias("region_type"), r["bbox"].alias("box"), r["description"].alias("description")))
    regions = F.filter(regions, lambda r: F.size(F.coalesce(r["box"], F.array())) == 4)
    view = F.struct(
        G.parse_category(reply["category"]).alias("category"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(reply["category_confidence"], F.lit(0.0)))).alias("confidence"),
        F.coalesce(reply["summary"], F.lit("")).alias("summary"),
        regions.alias("hints"),
        F.coalesce(reply["line_items"], F.array()).alias("items"),
    )
    return pages.withColumn("view", F.when(reply.isNotNull(), view))


def documents(views: DataFrame) -> DataFrame:
    """A row a document: category, confidence and summary of its first page that was understood; hints and items of all, in page order."""
    seen = views.where(F.col("view").isNotNull())
    parts = F.array_sort(F.collect_list(F.struct("page_index", "view")))
    rows = seen.groupBy("document_id").agg(parts.alias("parts"))
    first = F.get("parts", F.lit(0))["view"]
    merged = lambda name: F.flatten(F.transform("parts", lambda p: p["view"][name]))
    return rows.select("document_id", F.size("parts").alias("pages"), first["category"].alias("category"), first["confidence"].alias("confidence"), first["summary"].alias("summary"), merged("hints").alias("hints"), merged("items").alias("items"))
