"""Pixel operators in numpy, and the UDFs that carry them over image columns.

No image library is needed.  Angles are in degrees, pages are grey levels
(0 black, 255 white).  These run inside ``mapInPandas``-style workers, one page
at a time; nothing here depends on another page.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.config import BoxThresholds
from quillstone.operators import providers as P

VARIANTS = ("raw", "normalized", "deskewed", "clahe", "adaptive_binarized", "denoised")
#: What each variant is made from: the lineage of its artifact.
MADE_FROM = {"normalized": "raw", "deskewed": "normalized", "clahe": "deskewed", "adaptive_binarized": "deskewed", "denoised": "deskewed"}
MIN_SKEW, MAX_SKEW = 0.3, 15.0


def otsu(gray: np.ndarray) -> int:
    """The level that parts dark from bright with the least spread within both."""
    counts = np.bincount(gray.reshape(-1), minlength=256).astype(float)
    weight, mass = np.cumsum(counts), np.cumsum(counts * np.arange(256))
    left, right = np.maximum(weight, 1e-9), np.maximum(weight[-1] - weight, 1e-9)
    between = left * right * (mass / left - (mass[-1] - mass) / right) ** 2
    return int(between.argmax())


def skew(gray: np.ndarray) -> float:
    """The angle at which rows of ink are sharpest, searched coarse to fine; 0 without ink."""
    y, x = np.nonzero(gray < min(170, otsu(gray) + 1))
    if len(y) < 50:
        return 0.0
    if len(y) > 40_000:
        pick = np.linspace(0, len(y) - 1, 40_000).astype(int)
        y, x = y[pick], x[pick]

    def sharpness(angle: float) -> float:
        rows = np.round(y - x * np.tan(np.radians(angle))).astype(int)
        return float((np.bincount(rows - rows.min()).astype(float) ** 2).sum())

    best, step = 0.0, 1.0
    angles = np.arange(-MAX_SKEW, MAX_SKEW + 0.5)
    while step > 0.04:
        best = max(angles, key=lambda a: (sharpness(a), -abs(a)))
        step /= 4
        angles = best + np.arange(-4, 5) * step
    return round(float(best), 3)


def _sample(gray: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Bilinear samples; white outside."""
    h, w = gray.shape
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = y - y0, x - x0
    inside = (y0 >= 0) & (x0 >= 0) & (y0 < h) & (x0 < w)
    y0, x0 = np.clip(y0, 0, h - 1), np.clip(x0, 0, w - 1)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    g = gray.astype(float)
    value = (g[y0, x0] * (1 - fx) + g[y0, x1] * fx) * (1 - fy) + (g[y1, x0] * (1 - fx) + g[y1, x1] * fx) * fy
    return np.where(inside, np.round(value), 255).astype(np.uint8)


def deskew(gray: np.ndarray, angle: float) -> np.ndarray:
    """Turn the page upright; small angles are left alone."""
    if abs(angle) < MIN_SKEW:
        return gray
    h, w = gray.shape
    a = np.radians(angle)
    yy, xx = np.mgrid[0:h, 0:w]
    dy, dx = yy - (h - 1) / 2, xx - (w - 1) / 2
    return _sample(gray, np.sin(a) * dx + np.cos(a) * dy + (h - 1) / 2, np.cos(a) * dx - np.sin(a) * dy + (w - 1) / 2)


def page_corners(gray: np.ndarray, least: float = 0.3) -> np.ndarray | None:
    """Corners of a bright page on a dark ground, clockwise from the top left; None if it is no clear page or fills the image."""
    y, x = np.nonzero(gray > otsu(gray))
    if not len(y):
        return None
    points = np.stack([x, y], axis=1).astype(float)
    corners = points[[(x + y).argmin(), (x - y).argmax(), (x + y).argmax(), (x - y).argmin()]]
    cx, cy = corners[:, 0], corners[:, 1]
    area = abs((cx * np.roll(cy, -1) - np.roll(cx, -1) * cy).sum()) / 2
    whole = max(1, (gray.shape[0] - 1) * (gray.shape[1] - 1))
    return corners if least * whole < area < 0.98 * whole else None


def straighten(gray: np.ndarray, corners: np.ndarray) -> np.ndarray:
    """Map a quadrilateral onto an upright rectangle."""
    side = lambda i, j: float(np.hypot(*(corners[i] - corners[j])))
    w, h = int(max(side(0, 1), side(3, 2))) + 1, int(max(side(0, 3), side(1, 2))) + 1
    target = np.array([[0, 0], [w - 1, 0], [w - 1, h - 1], [0, h - 1]], dtype=float)
    rows, right = [], []
    for (u, v), (x, y) in zip(target, corners):
        rows += [[u, v, 1, 0, 0, 0, -u * x, -v * x], [0, 0, 0, u, v, 1, -u * y, -v * y]]
        right += [x, y]
    m = np.append(np.linalg.solve(np.array(rows), np.array(right)), 1.0).reshape(3, 3)
    vv, uu = np.mgrid[0:h, 0:w]
    z = m[2, 0] * uu + m[2, 1] * vv + m[2, 2]
    return _sample(gray, (m[1, 0] * uu + m[1, 1] * vv + m[1, 2]) / z, (m[0, 0] * uu + m[0, 1] * vv + m[0, 2]) / z)


def clahe(gray: np.ndarray, limit: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Local histogram equalisation with clipped histograms, interpolated between tiles."""
    h, w = gray.shape
    ny, nx = max(1, min(tiles, h // 8)), max(1, min(tiles, w // 8))
    ys, xs = np.linspace(0, h, ny + 1).astype(int), np.linspace(0, w, nx + 1).astype(int)
    maps = np.zeros((ny, nx, 256))
    for i in range(ny):
        for j in range(nx):
            part = gray[ys[i] : ys[i + 1], xs[j] : xs[j + 1]]
            counts = np.bincount(part.reshape(-1), minlength=256).astype(float)
            top = max(1.0, limit * part.size / 256)
            spare = np.maximum(counts - top, 0).sum()
            maps[i, j] = np.cumsum(np.minimum(counts, top) + spare / 256) * 255 / part.size
    cy, cx = (ys[:-1] + ys[1:] - 1) / 2, (xs[:-1] + xs[1:] - 1) / 2
    fy, fx = np.interp(np.arange(h), cy, np.arange(ny)), np.interp(np.arange(w), cx, np.arange(nx))
    y0, x0 = np.floor(fy).astype(int), np.floor(fx).astype(int)
    y1, x1 = np.minimum(y0 + 1, ny - 1), np.minimum(x0 + 1, nx - 1)
    wy, wx = (fy - y0)[:, None], (fx - x0)[None, :]
    at = lambda a, b: maps[a[:, None], b[None, :], gray]
    out = (at(y0, x0) * (1 - wx) + at(y0, x1) * wx) * (1 - wy) + (at(y1, x0) * (1 - wx) + at(y1, x1) * wx) * wy
    return np.clip(np.round(out), 0, 255).astype(np.uint8)


def _box_mean(values: np.ndarray, size: int) -> np.ndarray:
    half = size // 2
    padded = np.pad(values.astype(float), half + 1, mode="edge")[:-1, :-1]
    total = padded.cumsum(axis=0).cumsum(axis=1)
    h, w = values.shape
    n = 2 * half + 1
    return (total[n : n + h, n : n + w] - total[:h, n : n + w] - total[n : n + h, :w] + total[:h, :w]) / n**2


def sauvola(gray: np.ndarray, window: int = 25, k: float = 0.2) -> np.ndarray:
    """Black and white by each pixel's neighbourhood mean and spread."""
    mean = _box_mean(gray, window)
    spread = np.sqrt(np.maximum(_box_mean(gray.astype(float) ** 2, window) - mean**2, 0))
    return np.where(gray > mean * (1 + k * (spread / 128 - 1)), 255, 0).astype(np.uint8)


def denoise(gray: np.ndarray, strength: float = 10.0, reach: int = 3, patch: int = 3) -> np.ndarray:
    """Non-local means over a small neighbourhood."""
    g = gray.astype(float)
    padded = np.pad(g, reach, mode="reflect" if min(gray.shape) > reach else "edge")
    total, weight = np.zeros_like(g), np.zeros_like(g)
    for dy in range(2 * reach + 1):
        for dx in range(2 * reach + 1):
            other = padded[dy : dy + g.shape[0], dx : dx + g.shape[1]]
            w = np.exp(-_box_mean((g - other) ** 2, patch) / strength**2)
            total += w * other
            weight += w
    return np.clip(np.round(total / weight), 0, 255).astype(np.uint8)


def sharpen(gray: np.ndarray, amount: float = 0.5) -> np.ndarray:
    g = gray.astype(float)
    return np.clip(np.round(g + amount * (g - P._smooth(gray))), 0, 255).astype(np.uint8)


def page_variants(raw: np.ndarray, blur_limit: float = 80.0) -> dict[str, np.ndarray]:
    """The six variants of a page."""
    corners = page_corners(raw)
    normal = straighten(raw, corners) if corners is not None else raw
    upright = deskew(normal, skew(normal))
    if P.measures(upright)[0] < blur_limit:
        upright = sharpen(upright)
    return {"raw": raw, "normalized": normal, "deskewed": upright, "clahe": clahe(upright), "adaptive_binarized": sauvola(upright), "denoised": denoise(upright)}


def line_boxes(gray: np.ndarray, least: int = 6) -> list[tuple[int, int, int, int]]:
    """Boxes (x, y, width, height) of bands of ink, top to bottom."""
    out = []
    for top, bottom in P.split_bands(gray, least):
        columns = np.flatnonzero((gray[top:bottom] < 170).any(axis=0))
        if len(columns) >= 12:
            out.append((int(columns[0]), top, int(columns[-1] - columns[0] + 1), bottom - top))
    return out


def line_kind(gray: np.ndarray) -> tuple[str, float]:
    """Whether a long stroke crosses, underlines, rules or borders a line's crop; and how sure that is."""
    if gray.size == 0 or gray.shape[0] < 8 or gray.shape[1] < 20:
        return "none", 0.0
    ink = gray < 170
    h, w = ink.shape
    longest = np.zeros(h)
    for i in range(h):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], ink[i].astype(np.int8), [0]])))
        longest[i] = (edge[1::2] - edge[0::2]).max() if len(edge) else 0
    at = int(longest.argmax())
    share = longest[at] / w
    if share < 0.45:
        return "none", float(share)
    thick = longest >= 0.8 * longest[at]
    text = ink & ~thick[:, None]
    above, below = text[:at].sum(), text[at:].sum()
    place = at / max(1, h - 1)
    if place < 0.08 or place > 0.95:
        return "border", float(share)
    if above + below < 0.01 * ink.size:
        return "ruling", float(share)
    if below < 0.12 * (above + below):
        return "underline", float(share)
    balance = 2 * min(above, below) / (above + below)
    if 0.25 <= place <= 0.75 and balance >= 0.4:
        return ("strike_through" if share >= 0.6 else "strike_uncertain"), float(min(1.0, 0.5 * share + 0.5 * balance))
    return "ruling", float(share)


def recognition_crop(gray: np.ndarray, limits: BoxThresholds | None = None) -> np.ndarray | None:
    """A line's crop upright, contrasted, at the reader's height and padded; None if it is no line or would be blown up too far."""
    th = limits or BoxThresholds()
    if gray.size == 0 or gray.shape[0] < th.min_line_height_px or gray.shape[1] < th.min_width_px or P.ink_ratio(gray) < th.min_ink_ratio:
        return None
    scale = th.target_height / gray.shape[0]
    if scale > th.tiny_upscale_limit or P.line_bands(gray) > th.max_projected_lines:
        return None
    upright = clahe(deskew(gray, skew(gray)))
    yy, xx = np.mgrid[0 : th.target_height, 0 : max(1, round(gray.shape[1] * scale))]
    return np.pad(_sample(upright, yy / scale, xx / scale), 8, constant_values=255)


def sanitise(gray: np.ndarray, boxes: list[tuple[int, int, int, int]], limits: BoxThresholds | None = None) -> list[dict]:
    """Keep good line boxes, split those that hold several lines, block what stays page-like."""
    th, out = limits or BoxThresholds(), []
    page = max(1, gray.size)
    for x, y, w, h in boxes:
        crop = gray[y : y + h, x : x + w]
        big = w * h / page > th.max_area_ratio or h / gray.shape[0] > th.max_height_ratio or P.line_bands(crop) > th.max_projected_lines
        if not big:
            out.append({"box": (x, y, w, h), "parent": None, "blocked": False})
            continue
        children = line_boxes(crop)
        fit = [c for c in children if c[3] / gray.shape[0] <= th.max_height_ratio and c[2] * c[3] / page <= th.max_area_ratio]
        if len(fit) > 1:
            out += [{"box": (x + a, y + b, c, d), "parent": (x, y, w, h), "blocked": False} for a, b, c, d in fit]
        elif w * h / page < 0.9:
            out.append({"box": (x, y, w, h), "parent": None, "blocked": True})
    return out


FILTERS = {"clahe": clahe, "sauvola": sauvola, "denoise": denoise, "sharpen": sharpen, "deskew": lambda gray: deskew(gray, skew(gray))}


def filtered(image: Column, name: str, **options) -> Column:
    """A column of page images through one of ``FILTERS``; null for what cannot be read."""

    @F.pandas_udf("binary")
    def run(images: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in images:
            rows = []
            for data in series:
                try:
                    rows.append(P.encode_pgm(FILTERS[name](P.decode_image(data), **options)))
                except (ValueError, TypeError, IndexError):
                    rows.append(None)
            yield pd.Series(rows, dtype=object)

    return run(image)


def page_facts(image: Column) -> Column:
    """Struct of a page's skew in degrees and, where it shows a bright page on a dark ground, that page's corners."""

    @F.pandas_udf("skew double, corners array<int>")
    def run(images: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in images:
            rows = []
            for data in series:
                try:
                    gray = P.decode_image(data)
                    corners = page_corners(gray)
                    rows.append((skew(gray), None if corners is None else [int(v) for v in corners.reshape(-1)]))
                except (ValueError, TypeError, IndexError):
                    rows.append((None, None))
            yield pd.DataFrame(rows, columns=["skew", "corners"])

    return run(image)


def crop_kind(image: Column) -> Column:
    """Struct of a line crop's kind of stroke, its score, and the size at which a reader would get it (null: not at all)."""

    @F.pandas_udf("kind string, score double, width int, height int")
    def run(images: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in images:
            rows = []
            for data in series:
                try:
                    gray = P.decode_image(data)
                    ready = recognition_crop(gray)
                    rows.append((*line_kind(gray), None if ready is None else ready.shape[1], None if ready is None else ready.shape[0]))
                except (ValueError, TypeError, IndexError):
                    rows.append((None,) * 4)
            yield pd.DataFrame(rows, columns=["kind", "score", "width", "height"]).astype({"width": "Int32", "height": "Int32"})

    return run(image)


def variants_of(image: Column) -> Column:
    """Array of (name, made_from, content) for a column of page images; empty for what cannot be read."""

    @F.pandas_udf("array<struct<name:string,made_from:string,content:binary>>")
    def make(images: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in images:
            rows = []
            for data in series:
                try:
                    made = page_variants(P.decode_image(data))
                    rows.append([{"name": n, "made_from": MADE_FROM.get(n), "content": P.encode_pgm(g)} for n, g in made.items()])
                except (ValueError, TypeError, IndexError):
                    rows.append([])
            yield pd.Series(rows)

    return make(image)


def lines_of(image: Column) -> Column:
    """Array of line boxes with what the column rules ask of their pixels."""

    @F.pandas_udf("array<struct<x:int,y:int,width:int,height:int,blocked:boolean,ink:double,bands:int,irregularity:double,kind:string,kind_score:double>>")
    def find(images: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in images:
            rows = []
            for data in series:
                try:
                    gray = P.decode_image(data)
                    row = []
                    for item in sanitise(gray, line_boxes(gray)):
                        x, y, w, h = item["box"]
                        crop = P.crop_pixels(gray, x, y, w, h)
                        kind, score = line_kind(crop)
                        row.append({"x": x, "y": y, "width": w, "height": h, "blocked": item["blocked"], "ink": P.ink_ratio(crop), "bands": P.line_bands(crop), "irregularity": P.irregularity(crop), "kind": kind, "kind_score": score})
                    rows.append(row)
                except (ValueError, TypeError, IndexError):
                    rows.append([])
            yield pd.Series(rows)

    return find(image)
