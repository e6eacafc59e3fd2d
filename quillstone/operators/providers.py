"""Boundaries to models and images: factories of pandas UDFs around plain callables.

A provider is a callable that is made once a worker process and called per
batch.  Models are not part of this library; the defaults read nothing.
"""

from __future__ import annotations

import io
import json
import struct
import urllib.request
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import scores as S

PNG = b"\x89PNG\r\n\x1a\n"

HYPOTHESES = "array<struct<text:string,sequence_score:double,rank:int,error:string>>"
#: Beams and returned texts of a first pass, and of the full one.
FAST, FULL = {"beams": 4, "returned": 2}, {"beams": 8, "returned": 5}
NO_SCORE = -100.0


def recogniser(make: Callable[[], Callable[[bytes, dict], list[tuple[str, float]]]], options: dict | None = None):
    """UDF from an image column to hypotheses; a failing image gives one without text that holds the error, instead of failing the task."""
    given = options or FAST

    @F.pandas_udf(HYPOTHESES)
    def read(images: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for series in images:
            out = []
            for image in series:
                try:
                    found = [(t, float(s), None) for t, s in (model(image, given) if image else [])]
                except Exception as e:  # noqa: BLE001  a model may fail in any way
                    found = [("", NO_SCORE, f"{type(e).__name__}: {e}")]
                out.append([{"text": t, "sequence_score": s, "rank": i + 1, "error": error} for i, (t, s, error) in enumerate(found)])
            yield pd.Series(out)

    return read


def visual(h: Column) -> Column:
    """The visual score of a hypothesis of :func:`recogniser`: 0 for an error."""
    return F.when(h["error"].isNotNull(), 0.0).otherwise(S.visual_from_sequence(h["sequence_score"], h["rank"]))


def readiness(spark, providers: dict[str, Callable[[], Callable]]) -> DataFrame:
    """Which providers can be made here: ``provider``, ``ready``, ``problem``. Making one also warms it up."""
    rows = []
    for name, make in providers.items():
        try:
            make()
            rows.append((name, True, None))
        except Exception as e:  # noqa: BLE001
            rows.append((name, False, f"{type(e).__name__}: {e}"))
    return spark.createDataFrame(rows, "provider string, ready boolean, problem string")


def mock_recogniser() -> Callable[[bytes, dict], list[tuple[str, float]]]:
    """Reads nothing, as a system without models does."""
    return lambda image, options: [("", -100.0)]


def with_fallback(primary: Callable[[], Callable], fallback: Callable[[], Callable], sticky: bool = False) -> Callable[[], Callable]:
    """The second model where the first gives nothing, image by image; ``sticky``: from the first failure on, in that worker."""

    def make() -> Callable:
        first, second = primary(), fallback()
        failed = False

        def read(image: bytes, options: dict) -> list:
            nonlocal failed
            found = []
            if not (failed and sticky):
                try:
                    found = [x for x in first(image, options) if x[0]]
                except Exception:  # noqa: BLE001
                    failed = True
            return found or second(image, options)

        return read

    return make


def verifier(make: Callable[[], Callable[[bytes, list[str]], dict]] | None):
    """UDF (image, texts) to status and index; None: a verifier that is switched off."""

    @F.pandas_udf("enabled boolean, status string, index int")
    def verify(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        ask = make() if make else None
        for images, texts in batches:
            rows = []
            for image, offered in zip(images, texts):
                if ask is None:
                    rows.append((False, "unavailable", None))
                    continue
                try:
                    reply = ask(image, list(offered))
                    at = reply.get("index")
                    bad = at is not None and not 0 <= int(at) < len(offered)
                    invented = reply.get("text") is not None and reply["text"] not in list(offered)
                    rows.append((True, "illegible" if at is None else "disagreement" if bad or invented else "supported", None if at is None or bad else int(at)))
                except Exception:  # noqa: BLE001
                    rows.append((True, "unavailable", None))
            yield pd.DataFrame(rows, columns=["enabled", "status", "index"]).astype({"index": "Int32"})

    return verify


def http_json(endpoint: str, build: Callable[..., dict], timeout: float = 30.0) -> Callable[..., dict]:
    """A callable that posts JSON and reads JSON, for :func:`verifier` and page readers."""

    def ask(*args) -> dict:
        request = urllib.request.Request(endpoint, json.dumps(build(*args)).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            return json.loads(reply.read())

    return ask


# --- pixels -----------------------------------------------------------------


def decode_image(data: bytes) -> np.ndarray:
    """Grey levels of a PGM/PPM image with numpy alone; other formats where Pillow is installed."""
    if data[:2] in (b"P5", b"P6"):
        fields, at = [], 2
        while len(fields) < 3:
            while data[at : at + 1].isspace():
                at += 1
            end = at
            while not data[end : end + 1].isspace():
                end += 1
            fields.append(int(data[at:end]))
            at = end
        w, h = fields[:2]
        pixels = np.frombuffer(data, np.uint8, offset=at + 1)
        return pixels[: w * h].reshape(h, w) if data[:2] == b"P5" else pixels[: w * h * 3].reshape(h, w, 3).mean(axis=2).astype(np.uint8)
    try:
        from PIL import Image, ImageOps
    except ImportError as e:
        if data[: len(PNG)] == PNG:
            pixels = decode_png(data)
            return pixels if pixels.ndim == 2 else pixels.mean(axis=2).astype(np.uint8)
        raise ValueError("only PGM, PPM and PNG images can be read without Pillow") from e
    return np.asarray(ImageOps.exif_transpose(Image.open(io.BytesIO(data))).convert("L"))


def encode_png(pixels: np.ndarray) -> bytes:
    """A PNG of grey levels ``[height, width]`` or colours ``[height, width, 3]``."""
    rows = pixels.astype(np.uint8).reshape(pixels.shape[0], -1)

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    head = struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], 8, 2 if pixels.ndim == 3 else 0, 0, 0, 0)
    body = zlib.compress(np.pad(rows, ((0, 0), (1, 0))).tobytes())
    return PNG + chunk(b"IHDR", head) + chunk(b"IDAT", body) + chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """Pixels of a PNG with 8 bits a sample that is not interlaced."""
    at, body, head = len(PNG), b"", b""
    while at < len(data):
        (size,), name = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + size]
        head, body = (part if name == b"IHDR" else head), body + (part if name == b"IDAT" else b"")
        at += 12 + size
    w, h, bits, kind, _, _, interlaced = struct.unpack(">IIBBBBB", head)
    if bits != 8 or kind not in (0, 2, 4, 6) or interlaced:
        raise ValueError("only PNG images with 8 bits a sample can be read without Pillow")
    n = {0: 1, 2: 3, 4: 2, 6: 4}[kind]
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * n)
    out = np.zeros((h, w * n), np.uint8)
    above = np.zeros(w * n, np.int64)
    for y in range(h):
        how, row = lines[y, 0], lines[y, 1:].astype(np.int64)
        if how == 2:
            row = row + above
        elif how:  # these need the pixel to the left
            for x in range(w * n):
                left, corner = (row[x - n], above[x - n]) if x >= n else (0, 0)
                if how == 1:
                    guess = left
                elif how == 3:
                    guess = (left + above[x]) // 2
                else:
                    p = left + above[x] - corner
                    guess = min((left, above[x], corner), key=lambda v: abs(p - v))
                row[x] = (row[x] + guess) & 255
        above = row & 255
        out[y] = above
    pixels = out.reshape(h, w, n)
    return pixels[:, :, 0] if n <= 2 else pixels[:, :, :3]


def encode_pgm(gray: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (gray.shape[1], gray.shape[0]) + gray.astype(np.uint8).tobytes()


def _smooth(gray: np.ndarray) -> np.ndarray:
    kernel = np.array([1, 4, 6, 4, 1], dtype=float) / 16
    padded = np.pad(gray.astype(float), 2, mode="reflect" if min(gray.shape) > 2 else "edge")
    rows = sum(k * padded[:, i : i + gray.shape[1]] for i, k in enumerate(kernel))
    return sum(k * rows[i : i + gray.shape[0]] for i, k in enumerate(kernel))


def measures(gray: np.ndarray) -> tuple[float, float, float]:
    """Blur (variance of the Laplacian), contrast (spread), noise (spread around the smoothed image)."""
    g = gray.astype(float)
    p = np.pad(g, 1, mode="edge")
    laplacian = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g
    return float(laplacian.var()), float(g.std()), float((g - _smooth(gray)).std())


def ink_ratio(gray: np.ndarray) -> float:
    return float((gray < 170).mean()) if gray.size else 0.0


def line_bands(gray: np.ndarray) -> int:
    """How many bands of ink a crop has from top to bottom."""
    if not gray.size:
        return 0
    if min(gray.shape) < 12:
        return 1
    rows = (gray < np.percentile(gray, 55)).sum(axis=1).astype(float)
    if rows.max() < 1:
        return 0
    k = max(3, gray.shape[0] // 40) | 1
    smooth = np.convolve(np.pad(rows, k // 2, mode="edge"), np.ones(k) / k, mode="valid")
    on = smooth > 0.28 * smooth.max()
    return max(1, int((on & ~np.concatenate([[False], on[:-1]])).sum()))


def split_bands(gray: np.ndarray, least: int = 6) -> list[tuple[int, int]]:
    """Top and bottom of each band of ink of at least ``least`` rows."""
    if not gray.size:
        return []
    rows = (gray < 170).sum(axis=1).astype(float)
    on = np.concatenate([[False], rows > 0.22 * max(rows.max(), 1e-9), [False]])
    edges = np.flatnonzero(on[1:] != on[:-1])
    return [(int(a), int(b)) for a, b in zip(edges[0::2], edges[1::2]) if b - a >= least]


def irregularity(gray: np.ndarray) -> float:
    """How uneven the ink of columns is, 0 to 1; 0.5 where there is too little to tell."""
    if gray.size == 0 or gray.shape[0] < 6 or gray.shape[1] < 12:
        return 0.5
    columns = (gray < 170).sum(axis=0).astype(float)
    columns = columns[columns > 0]
    return 0.5 if len(columns) < 5 else min(1.0, float(columns.std() / (columns.mean() + 1e-3)) / 8.0)


def crop_pixels(gray: np.ndarray, x: float, y: float, w: float, h: float, pad: int = 4) -> np.ndarray:
    top, left = max(0, int(y) - pad), max(0, int(x) - pad)
    return gray[top : min(gray.shape[0], int(y + h) + pad), left : min(gray.shape[1], int(x + w) + pad)]


def page_measures(image):
    """All numbers that the column rules need, from a column of image bytes; nulls for what cannot be read."""

    @F.pandas_udf("width int, height int, blur double, contrast double, noise double, ink double, bands int, irregularity double")
    def read(images: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in images:
            rows = []
            for data in series:
                try:
                    gray = decode_image(data)
                    rows.append((gray.shape[1], gray.shape[0], *measures(gray), ink_ratio(gray), line_bands(gray), irregularity(gray)))
                except (ValueError, TypeError, IndexError):
                    rows.append((None,) * 8)
            yield pd.DataFrame(rows, columns=["width", "height", "blur", "contrast", "noise", "ink", "bands", "irregularity"]).astype({"width": "Int32", "height": "Int32", "bands": "Int32"})

    return read(image)


def flatten_result(result) -> list[tuple[list, str, float]]:
    """A print engine's result in one shape, whatever its version: (polygon, text, score) of each line."""
    if result is None:
        return []
    if isinstance(result, dict):
        return [(list(map(list, p)), str(t), float(s)) for p, t, s in zip(result.get("rec_polys", result.get("dt_polys", [])), result.get("rec_texts", []), result.get("rec_scores", []))]
    if isinstance(result, (list, tuple)):
        if len(result) == 2 and isinstance(result[1], (list, tuple)) and len(result[1]) == 2 and isinstance(result[1][0], str):
            return [(list(map(list, result[0])), result[1][0], float(result[1][1]))]
        return [line for part in result for line in flatten_result(part)]
    return []


def detector(chain: list[Callable[[], Callable[[bytes], object]]]):
    """UDF from an image column to lines: of the first engine in the chain that finds any; else bands of ink, without text.

    An engine gives its own result shape (:func:`flatten_result`); one that
    fails is passed over.  ``source`` is the engine's place in the chain, -1 for the bands.
    """

    @F.pandas_udf("array<struct<x:double,y:double,width:double,height:double,text:string,score:double,source:int>>")
    def find(images: Iterator[pd.Series]) -> Iterator[pd.Series]:
        engines = [make() for make in chain]
        for series in images:
            out = []
            for image in series:
                lines: list[dict] = []
                for place, engine in enumerate(engines):
                    try:
                        found = flatten_result(engine(image))
                    except Exception:  # noqa: BLE001
                        continue
                    for polygon, text, score in found:
                        xs, ys = [float(p[0]) for p in polygon], [float(p[1]) for p in polygon]
                        lines.append({"x": min(xs), "y": min(ys), "width": max(1.0, max(xs) - min(xs)), "height": max(1.0, max(ys) - min(ys)), "text": text, "score": score, "source": place})
                    if lines:
                        break
                if not lines:
                    try:
                        gray = decode_image(image)
                        lines = [{"x": 0.0, "y": float(a), "width": float(gray.shape[1]), "height": float(b - a), "text": "", "score": 0.0, "source": -1} for a, b in split_bands(gray)]
                    except (ValueError, TypeError, IndexError):
                        lines = []
                out.append(lines)
            yield pd.Series(out)

    return find


def page_reader(make: Callable[[], Callable[[bytes], str]] | None):
    """UDF from an image column to a page reader's reply; null where there is no reader or it fails."""

    @F.pandas_udf("string")
    def ask(images: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = make() if make else None
        for series in images:
            out = []
            for image in series:
                try:
                    out.append(reader(image) if reader else None)
                except Exception:  # noqa: BLE001
                    out.append(None)
            yield pd.Series(out, dtype=object)

    return ask


def settings(env: dict[str, str]) -> dict:
    """Which providers an environment asks for; all are off by default."""
    on = lambda name: env.get(f"QUILLSTONE_{name}", "").lower() in ("1", "true", "yes")
    return {
        "recogniser": env.get("QUILLSTONE_RECOGNISER", "mock"),
        "verifier": env.get("QUILLSTONE_VERIFIER_ENDPOINT") if on("VERIFIER_ENABLED") else None,
        "page_reader": env.get("QUILLSTONE_READER_ENDPOINT") if on("READER_ENABLED") else None,
        "variants": tuple(v for v in env.get("QUILLSTONE_VARIANTS", "clahe").split(",") if v),
    }
