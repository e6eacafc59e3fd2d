"""Boxes, regions and layout rules as column expressions. A box is a struct of x, y, width, height."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.config import BoxThresholds

# Region types, and the names that page readers use for them.
REGION_TYPES = ("printed_text", "main_handwriting", "margin_note", "table", "signature", "crossed_out_candidate", "unknown")
REGION_ALIASES = {
    "printed_text": "printed_text", "print": "printed_text", "printed": "printed_text",
    "main_handwriting": "main_handwriting", "handwriting": "main_handwriting", "handwritten": "main_handwriting",
    "margin_note": "margin_note", "margin": "margin_note", "table": "table", "signature": "signature",
}
# Document categories and their aliases.
CATEGORIES = (
    "prescription", "medical_report", "lab_report", "handwritten_note", "form", "letter", "receipt", "id_card",
    "architecture_diagram", "flowchart", "other", "unknown",
)
CATEGORY_ALIASES = {
    "rx": "prescription", "script": "prescription", "diagram": "architecture_diagram", "architecture": "architecture_diagram",
    "flow_chart": "flowchart", "handwriting": "handwritten_note", "note": "handwritten_note", "report": "medical_report",
}


def box(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), width.cast("double").alias("width"), height.cast("double").alias("height"))


def corners(b: Column) -> Column:
    return F.array(b["x"], b["y"], b["x"] + b["width"], b["y"] + b["height"])


def box_of_polygon(points: Column) -> Column:
    """The box around an array of points, at least one unit wide and high."""
    xs, ys = F.transform(points, lambda p: F.element_at(p, 1)), F.transform(points, lambda p: F.element_at(p, 2))
    return box(F.array_min(xs), F.array_min(ys), F.greatest(F.lit(1.0), F.array_max(xs) - F.array_min(xs)), F.greatest(F.lit(1.0), F.array_max(ys) - F.array_min(ys)))


def crop(b: Column, page_w: Column, page_h: Column, pad: float = 4.0) -> Column:
    """The box with a margin, inside the page."""
    x0, y0 = F.greatest(F.lit(0.0), b["x"] - pad), F.greatest(F.lit(0.0), b["y"] - pad)
    x1, y1 = F.least(page_w.cast("double"), b["x"] + b["width"] + pad), F.least(page_h.cast("double"), b["y"] + b["height"] + pad)
    return box(x0, y0, F.greatest(F.lit(0.0), x1 - x0), F.greatest(F.lit(0.0), y1 - y0))


def holds_point(b: Column, x: Column, y: Column) -> Column:
    return (x >= b["x"]) & (x <= b["x"] + b["width"]) & (y >= b["y"]) & (y <= b["y"] + b["height"])


def iou_with_hint(b: Column, hint: Column, page_w: Column, page_h: Column) -> Column:
    """Overlap of a box with a hint in shares of the page, over their union; areas count as one unit at least."""
    hx0, hy0, hx1, hy1 = (F.element_at(hint, i + 1) * (page_w, page_h)[i % 2] for i in range(4))
    w = F.least(hx1, b["x"] + b["width"]) - F.greatest(hx0, b["x"])
    h = F.least(hy1, b["y"] + b["height"]) - F.greatest(hy0, b["y"])
    inter = F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)
    union = F.greatest(F.lit(1.0), (hx1 - hx0) * (hy1 - hy0)) + F.greatest(F.lit(1.0), b["width"] * b["height"]) - inter
    return F.when(inter <= 0, 0.0).otherwise(inter / union)


def script_mode(confidence: Column, irregularity: Column, print_primary: bool = True) -> Column:
    """Print only for a sure engine and even strokes."""
    sure = ((confidence >= 0.88) & (irregularity < 0.22)) | ((confidence >= 0.95) & (irregularity < 0.30))
    return F.when(F.lit(print_primary) & F.coalesce(sure, F.lit(False)), "print").otherwise("handwriting")


def region_type(b: Column, page_w: Column, page_h: Column, crossed: Column, script: Column) -> Column:
    at_edge = (b["x"] < 0.12 * page_w) | (b["x"] + b["width"] > 0.88 * page_w)
    return (
        F.when(crossed, "crossed_out_candidate")
        .when(at_edge & (b["width"] < 0.35 * page_w), "margin_note")
        .when((b["y"] > 0.82 * page_h) & (b["height"] < 0.08 * page_h), "signature")
        .when(script == "print", "printed_text")
        .otherwise("main_handwriting")
    )


def is_struck(kind: Column, score: Column, region: Column) -> Column:
    """Only a strike-through counts; in margins and signatures only a sure one."""
    return (kind == "strike_through") & (~region.isin("margin_note", "signature") | (score >= 0.8))


def _folded(raw: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.coalesce(raw, F.lit("unknown")))), "[ -]", "_")


def parse_region(raw: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in REGION_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, _folded(raw)), F.lit("unknown"))


def parse_category(raw: Column) -> Column:
    key = _folded(raw)
    table = F.create_map(*[F.lit(x) for pair in CATEGORY_ALIASES.items() for x in pair])
    return F.when(key.isin(*CATEGORIES), key).otherwise(F.coalesce(F.try_element_at(table, key), F.lit("unknown")))


def heuristic_category(print_ratio: Column, lines: Column) -> Column:
    """Struct (category, confidence, hint) without a page reader."""

    def row(category: str, confidence: float, hint: str | None) -> Column:
        return F.struct(F.lit(category).alias("category"), F.lit(confidence).alias("confidence"), F.lit(hint).cast("string").alias("hint"))

    return F.when((print_ratio >= 0.6) & (lines > 0), row("other", 0.35, "printed_text")).when(lines > 0, row("handwritten_note", 0.3, "main_handwriting")).otherwise(row("unknown", 0.1, None))


def check_box(b: Column, page_w: Column, page_h: Column, ink: Column, lines: Column, crop_height: Column, limits: BoxThresholds | None = None) -> Column:
    """Struct (ok, reason, flags, needs_split, blocked) of a line's box. Null ``ink`` and ``crop_height``: no crop was seen."""
    th = limits or BoxThresholds()
    area = F.greatest(b["width"] * b["height"], F.lit(1.0)) / F.greatest((page_w * page_h).cast("double"), F.lit(1.0))
    tall = b["height"] / F.greatest(page_h.cast("double"), F.lit(1.0))
    aspect = b["width"] / F.greatest(b["height"], F.lit(1.0))
    n = F.coalesce(lines, F.lit(1))
    flag = {
        "excessive_area": area > th.max_area_ratio,
        "excessive_height": tall > th.max_height_ratio,
        "tall_box": (b["height"] > th.max_line_height_px) & (aspect < 2.0),
        "implausible_aspect": (aspect < th.max_aspect_tall) & (b["height"] > 40),
        "too_tiny": (b["height"] < th.min_line_height_px) | (b["width"] < th.min_width_px),
        "low_ink": ink.isNotNull() & (ink < th.min_ink_ratio),
        "multi_line_projection": n > th.max_projected_lines,
        "destructive_upscale": crop_height.isNotNull() & (crop_height > 0) & (F.lit(float(th.target_height)) / F.greatest(crop_height.cast("double"), F.lit(1e-9)) > th.tiny_upscale_limit),
    }
    flags = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in flag.items()]))
    split = F.arrays_overlap(flags, F.array(*[F.lit(k) for k in ("excessive_area", "excessive_height", "tall_box", "multi_line_projection", "implausible_aspect")]))
    blocked = F.arrays_overlap(flags, F.array(*[F.lit(k) for k in ("excessive_area", "excessive_height", "multi_line_projection", "destructive_upscale")]))
    ok = ~split & ~F.arrays_overlap(flags, F.array(*[F.lit(k) for k in ("too_tiny", "low_ink", "destructive_upscale")]))
    reason = F.when(ok, "valid_line").otherwise(F.array_join(flags, ","))
    return F.struct(ok.alias("ok"), reason.alias("reason"), flags.alias("flags"), split.alias("needs_split"), blocked.alias("blocked"))
