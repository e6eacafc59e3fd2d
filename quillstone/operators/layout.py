"""Reading order, links and layout hints over lines of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import geometry as G

MIN_IOU, MAX_HINT_AREA = 0.25, 0.35
PRINTISH = ("form", "letter", "receipt", "id_card", "lab_report", "medical_report")


def middle(b: Column) -> Column:
    return b["y"] + b["height"] / 2


def reading_order(lines: DataFrame, page: list[str], tie: str) -> DataFrame:
    """Number lines from the top, then from the left."""
    w = Window.partitionBy(*page).orderBy(middle(F.col("bbox")), F.col("bbox.x"), tie)
    return lines.withColumn("reading_order", F.row_number().over(w) - 1)


def order_edges(lines: DataFrame, page: list[str], line: str) -> DataFrame:
    """An edge from each line to the next of its page."""
    w = Window.partitionBy(*page).orderBy("reading_order", line)
    return lines.select(*page, F.lag(line).over(w).alias("from"), F.col(line).alias("to"), F.lit("reading_order").alias("relation")).where(F.col("from").isNotNull())


def margin_links(lines: DataFrame, page: list[str], line: str) -> DataFrame:
    """Margin notes with the first body line that stands before them in reading order (none: null)."""
    body = F.col("region_type").isin("main_handwriting", "printed_text", "table")
    w = Window.partitionBy(*page).orderBy("reading_order", line).rowsBetween(Window.unboundedPreceding, 0)
    linked = lines.withColumn("linked", F.first(F.when(body, F.col(line)), ignorenulls=True).over(w))
    return linked.where(F.col("region_type") == "margin_note").select(*page, F.col(line).alias("from"), F.col("linked").alias("to"), F.lit("margin_to_body").alias("relation"))


def nearest_body(lines: DataFrame, page: list[str], line: str) -> DataFrame:
    """Margin notes with the body line whose middle is nearest, the earlier on ties.

    Of a page's body lines only the next above and the next below can be the
    nearest, so two window functions replace a join of all with all.
    """
    mid = middle(F.col("bbox"))
    body = F.when(F.col("region_type") != "margin_note", F.struct(mid.alias("m"), F.col("reading_order").alias("o"), F.col(line).alias("l")))
    up = Window.partitionBy(*page).orderBy(mid, F.col("reading_order").desc()).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*page).orderBy(mid.desc(), F.col("reading_order").desc()).rowsBetween(Window.unboundedPreceding, 0)
    found = lines.select(*page, line, "region_type", mid.alias("m"), F.last(body, ignorenulls=True).over(up).alias("a"), F.last(body, ignorenulls=True).over(down).alias("b"))
    away = F.array_sort(F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}.m") - F.col("m")).alias("d"), F.col(f"{c}.o").alias("o"), F.col(f"{c}.l").alias("l"))) for c in ("a", "b")])))
    return found.where(F.col("region_type") == "margin_note").select(*page, F.col(line).alias("from"), F.get(away, F.lit(0))["l"].alias("to"))


def best_hint(b: Column, hints: Column, page_w: Column, page_h: Column) -> Column:
    """Struct (iou, ordinal, hint) of the hint that overlaps most, the first on ties; hints of a large share of the page do not count.

    ``hints``: the page's few hints as an array of structs ``box`` and ``region_type``.
    """

    def scored(h: Column, i: Column) -> Column:
        area = (F.element_at(h["box"], 3) - F.element_at(h["box"], 1)) * (F.element_at(h["box"], 4) - F.element_at(h["box"], 2))
        return F.when(area <= MAX_HINT_AREA, F.struct(G.iou_with_hint(b, h["box"], page_w, page_h).alias("iou"), (-i).alias("o"), h.alias("hint")))

    best = F.array_max(F.array_compact(F.transform(hints, scored)))
    return F.when(best["iou"] >= MIN_IOU, best)


def apply_hints(lines: DataFrame) -> DataFrame:
    """Take a page reader's advice where it does not contradict what the pixels say.

    Reads ``bbox, region_type, script_mode, irregularity, print_score, hints,
    category, page_w, page_h``; sets ``region_type, script_mode,
    routing_uncertain, layout_source, layout_iou``.
    """
    script, irreg, score = F.lower(F.coalesce("script_mode", F.lit("handwriting"))), F.coalesce("irregularity", F.lit(0.5)), F.coalesce("print_score", F.lit(0.0))
    region = F.col("region_type")
    best = best_hint(F.col("bbox"), F.col("hints"), F.col("page_w"), F.col("page_h"))
    d = lines.withColumns(
        {
            "_best": best,
            "_hand": (script == "handwriting") & ((irreg > 0.28) | (score < 0.75)),
            "_print": (script == "print") & (score >= 0.88) & (irreg < 0.22),
            "_none": F.size(F.coalesce("hints", F.array())) == 0,
        }
    )
    hint, hand, printed = F.col("_best.hint.region_type"), F.col("_hand"), F.col("_print")
    printish = F.coalesce(F.col("category").isin(*PRINTISH), F.lit(False))
    by_category = printish & (score >= 0.90) & (script == "print") & (irreg < 0.22) & region.isin("main_handwriting", "unknown")
    conflict = (hint == "printed_text") & hand
    agree = hint.isin("table", "printed_text") & printed
    geometric = hint.isin("margin_note", "signature")
    written = (hint == "main_handwriting") & ~printed
    source = (
        F.when(F.col("_none"), F.when(by_category, "category_advisory").when(printish & (script == "handwriting"), "category_ignored_handwriting"))
        .when(region == "crossed_out_candidate", None)
        .when(F.col("_best").isNull(), "none")
        .when(conflict, "hint_conflict")
        .when(agree, "hint_agree")
        .when(geometric, "hint_geometry")
        .when(written, "hint_handwriting")
        .otherwise("hint_unused")
    )
    d = d.withColumn("layout_source", source)
    src = F.col("layout_source")
    unsure = (src == "hint_conflict") | ((src == "hint_unused") & ~hand & ~printed)
    new_region = (
        F.when(src == "category_advisory", "printed_text")
        .when((src == "hint_conflict") & (region == "unknown"), "main_handwriting")
        .when(src.isin("hint_agree", "hint_geometry"), hint)
        .when(src == "hint_handwriting", "main_handwriting")
        .otherwise(region)
    )
    unsure = F.coalesce(unsure, F.lit(False))
    out = d.withColumns({"region_type": new_region, "script_mode": F.when(unsure, "mixed").otherwise(script), "routing_uncertain": unsure, "layout_iou": F.col("_best.iou")})
    return out.drop("_best", "_hand", "_print", "_none")


def hit(lines: DataFrame, x: float, y: float, page: list[str], line: str) -> DataFrame:
    """Per page the last line whose box holds a point."""
    inside = lines.where(G.holds_point(F.col("bbox"), F.lit(x), F.lit(y)))
    return inside.groupBy(*page).agg(F.max(F.struct("reading_order", F.col(line).alias("line")))["line"].alias("line"))
