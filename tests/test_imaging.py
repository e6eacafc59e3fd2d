"""Pixel operators on small drawn pages."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quillstone.operators import imaging as I
from quillstone.operators import providers as P


def page(lines=4, h=200, w=300):
    g = np.full((h, w), 255, dtype=np.uint8)
    rng = np.random.default_rng(1)
    for k in range(lines):
        y = 20 + 40 * k
        g[y : y + 14, 20 : w - 20] = np.where(rng.random((14, w - 40)) < 0.5, 0, 255)
    return g


def test_skew_and_deskew():
    turned = I.deskew(page(), 5.0)
    assert abs(abs(I.skew(turned)) - 5.0) < 0.5 and abs(I.skew(page())) < 0.3
    assert abs(I.skew(I.deskew(turned, I.skew(turned)))) < 0.6
    assert I.deskew(page(), 0.1) is not None and I.skew(np.full((30, 30), 255, np.uint8)) == 0.0


def test_corners_and_warp():
    scene = np.full((120, 160), 20, np.uint8)
    scene[10:110, 15:145] = 240
    corners = I.page_corners(scene)
    assert corners.astype(int).tolist() == [[15, 10], [144, 10], [144, 109], [15, 109]]
    flat = I.straighten(scene, corners)
    assert flat.shape == (100, 130) and flat.min() >= 200
    assert I.page_corners(np.full((20, 20), 255, np.uint8)) is None


def test_filters():
    g = page()
    assert set(np.unique(I.sauvola(g))) <= {0, 255} and (I.sauvola(np.full((40, 40), 255, np.uint8)) == 255).all()
    flat = np.tile(np.linspace(100, 140, 64).astype(np.uint8), (64, 1))
    assert I.clahe(flat).std() > flat.std()
    noisy = np.clip(128 + np.random.default_rng(0).normal(0, 8, (48, 48)), 0, 255).astype(np.uint8)
    assert I.denoise(noisy).std() < noisy.std() and I.sharpen(g).shape == g.shape
    assert I.otsu(np.array([[10] * 5 + [200] * 5], dtype=np.uint8)) in range(10, 200)
    assert list(I.page_variants(g)) == list(I.VARIANTS)


def test_line_kinds():
    base = np.full((40, 120), 255, np.uint8)
    words = base.copy()
    for x in range(10, 110, 12):
        words[8:32, x : x + 4] = 0
    assert I.line_kind(words)[0] == "none"
    struck = words.copy()
    struck[19:21, 5:115] = 0
    assert I.line_kind(struck)[0] == "strike_through"
    under = words.copy()
    under[35:37, 5:115] = 0
    assert I.line_kind(under)[0] == "underline"
    ruled = base.copy()
    ruled[20, 5:115] = 0
    assert I.line_kind(ruled)[0] == "ruling"
    edge = words.copy()
    edge[0:2, :] = 0
    assert I.line_kind(edge)[0] == "border"


def test_lines_and_crops(spark):
    g = page()
    boxes = I.line_boxes(g)
    assert len(boxes) == 4 and all(b[3] == 14 for b in boxes)
    assert len(I.sanitise(g, [(10, 10, 280, 170)])) == 4
    assert I.sanitise(g, [(0, 0, 300, 200)] * 0) == []
    crop = I.recognition_crop(g[15:60, 15:285])
    assert crop is not None and crop.shape[0] == 96
    assert I.recognition_crop(g[:5]) is None and I.recognition_crop(np.full((40, 200), 255, np.uint8)) is None
    frame = spark.createDataFrame([(bytearray(P.encode_pgm(g)),), (bytearray(b"x"),)], "image binary")
    rows = frame.select(I.lines_of(F.col("image")).alias("l"), F.size(I.variants_of(F.col("image"))).alias("n")).collect()
    assert [(len(r.l), r.n) for r in rows] == [(4, 6), (0, 0)]
