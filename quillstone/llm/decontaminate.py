"""Benchmark decontamination by the q-gram lemma.

Method: a text holds an item within ``e`` edits only if ``m + 1 - q * (e + 1)``
of the item's ``m + 1 - q`` character q-grams occur in it on ``e + 1``
neighbouring diagonals.  Shared q-grams are counted in overlapping bands of
diagonals, bands that meet the bound are kept, and a banded alignment of the
item against that region verifies them.  Texts are compared in lower case with
white space as single blanks.

At scale: one pass over the documents, no shuffle.  The items are the stated
query set; they are broadcast in blocks of at most ``BLOCK_CHARS`` characters,
one pass a block.  Long texts are searched in overlapping pieces.  Runs of one
q-gram (a line of dashes) count as one, and pairs of runs are expanded in
bounded portions, so that memory follows neither the length of a text nor how
often a q-gram comes back.  Neighbouring bands are aligned together.

Defined results: null and empty texts and items match nothing; an item shorter
than ``Q`` characters must occur exactly; the edit budget is ``EDITS`` of the
item's length, less where the lemma's bound would not be positive; repeated
rows and ids each give their rows; empty tables give none; of several places
the one with the fewest edits counts, the first of them on a tie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .common import materialise, pieces

Q = 8
EDITS = 0.1
BLOCK_CHARS = 4_000_000
_BITS = 22
#: Characters of a text that are searched at once, pairs of runs and bands that are expanded at once, and diagonals that are aligned at once.
PIECE, PORTION, WIDEST = 1 << 20, 1 << 20, 1 << 15
_BASE = 0xC2B2AE3D27D4EB4F | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def normalised(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def grams(points: np.ndarray) -> np.ndarray:
    """Hashes of all stretches of ``Q`` code points."""
    n = len(points)
    if n < Q:
        return np.zeros(0, dtype=np.uint64)
    c = points.astype(np.uint64)
    c = (c + np.uint64(1)) * np.uint64(0x9FB21C651E98DF25)
    c ^= c >> np.uint64(29)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(c * textvec._power_table(_BASE, n), out=total[1:])
    h = (total[Q:] - total[:-Q]) * textvec._power_table(_INVERSE, n)[: n + 1 - Q]
    return h ^ (h >> np.uint64(31))


def banded_infix(pattern: np.ndarray, text: np.ndarray, low: int, high: int, budget: int | None = None) -> tuple[int, int]:
    """Fewest edits that turn the pattern into a stretch of ``text``, and where the first such stretch ends.

    Only cells whose diagonal (place in text less place in pattern) lies in
    ``[low, high]`` are filled.  A row's least cost never falls again, so rows
    end once it is above ``budget``; the cost returned is then that.
    """
    width, n = high - low + 1, len(text)
    big = len(pattern) + width + 1
    place = np.arange(low, high + 1)
    padded = np.full(n + len(pattern) + 2 * width + 2 * abs(low) + 2, 0xFFFFFFFF, dtype=np.int64)
    shift = width + abs(low) + 1  # text[j] stands at padded[j + shift]
    padded[shift : shift + n] = text
    row = np.where((place >= 0) & (place <= n), 0, big)
    steps = np.arange(width)
    for i, ch in enumerate(pattern.tolist(), 1):
        at = i + place
        same = padded[i - 1 + low + shift : i - 1 + low + shift + width] == ch
        new = row + ~same
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        new = np.minimum.accumulate(new - steps) + steps
        row = np.where((at >= 0) & (at <= n), new, big)
        if budget is not None and not i % 4 and (least := int(row.min())) > budget:
            return least, 0
    best = int(row.argmin())
    return int(row[best]), len(pattern) + low + best


class Index:
    """The q-grams of one block of items."""

    def __init__(self, items: list[tuple[int, str | None]]) -> None:
        self.ids, self.texts = [], []
        for item_id, text in items:
            if plain := normalised(text):
                self.ids.append(item_id)
                self.texts.append(plain)
        self.points = [codes(t) for t in self.texts]
        m = np.array([len(p) for p in self.points], dtype=np.int64)
        self.edits = np.minimum((m * EDITS).astype(np.int64), np.maximum(m // Q - 1, 0))
        self.least = m + 1 - Q * (self.edits + 1)
        self.width = np.maximum(16, self.edits + 1)
        self.short = [i for i in range(len(m)) if m[i] < Q]
        hashes = [grams(p) for p in self.points]
        flat = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
        item = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.zeros(0, dtype=np.int64)
        # runs: the same q-gram at neighbouring places of an item
        new = np.ones(len(flat), dtype=bool)
        new[1:] = (flat[1:] != flat[:-1]) | (item[1:] != item[:-1])
        start = np.flatnonzero(new)
        length = np.diff(np.append(start, len(flat)))
        order = np.argsort(flat[start], kind="stable")
        self.keys, self.first, self.many = np.unique(flat[start][order], return_index=True, return_counts=True)
        self.item, self.place, self.length = item[start][order], place[start][order], length[order]
        self.seen = np.zeros(1 << _BITS, dtype=bool)
        self.seen[(self.keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        self.gap = int(m.max() + self.edits.max() * 2 + self.width.max() * 2 + 8) if len(m) else 0

    def candidates(self, texts: list[str]) -> np.ndarray:
        """Rows (text, item, band) that meet the bound, ascending."""
        nothing = np.zeros((0, 3), dtype=np.int64)
        h = grams(codes("\0".join(texts)))
        if not len(h) or not len(self.keys):
            return nothing
        hit = np.flatnonzero(self.seen[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
        key = np.searchsorted(self.keys, h[hit])
        ok = key < len(self.keys)
        ok[ok] = self.keys[key[ok]] == h[hit[ok]]
        hit, key = hit[ok], key[ok]
        if not len(hit):
            return nothing
        new = np.ones(len(hit), dtype=bool)
        new[1:] = (hit[1:] != hit[:-1] + 1) | (key[1:] != key[:-1])
        start = np.flatnonzero(new)
        run = np.diff(np.append(start, len(hit)))
        hit, key = hit[start], key[start]
        begins = np.cumsum([0] + [len(t) + 1 for t in texts])
        doc = np.searchsorted(begins, hit, side="right") - 1
        bands = int((max(map(len, texts)) + 2 * self.gap) // self.width.min()) + 2
        found: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for some in _portions(self.many[key]):
            many = self.many[key[some]]
            at = np.repeat(self.first[key[some]] - np.cumsum(many) + many, many) + np.arange(many.sum())
            item, place, length = self.item[at], self.place[at], self.length[at]
            own, where, last = np.repeat(doc[some], many), np.repeat(hit[some] - begins[doc[some]], many), np.repeat(run[some], many)
            # diagonals that the two runs share, all made positive, and the bands that these meet
            low = where - (place + length - 1) + self.gap
            high = where + last - 1 - place + self.gap
            width, edits = self.width[item], self.edits[item]
            b0 = np.maximum(0, (low - edits) // width)
            for part in _portions(high // width - b0 + 1):
                n = high[part] // width[part] - b0[part] + 1
                r = np.repeat(part, n)
                band = b0[r] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                # places of the item's run that have a partner in the band
                bottom = band * width[r] - self.gap
                top = bottom + width[r] + edits[r]
                count = np.minimum(place[r] + length[r] - 1, where[r] + last[r] - 1 - bottom) - np.maximum(place[r], where[r] - top + 1) + 1
                found.append(_summed((own[r] * len(self.ids) + item[r]) * bands + band, np.maximum(count, 0)))
                held += len(found[-1][0])
                if held > 4 * PORTION:
                    found = [_summed(*map(np.concatenate, zip(*found)))]
                    held = len(found[0][0])
        combined, counts = _summed(*map(np.concatenate, zip(*found)))
        pair, band = np.divmod(combined, bands)
        doc, item = np.divmod(pair, len(self.ids))
        keep = counts >= self.least[item]
        return np.stack([doc[keep], item[keep], band[keep]], axis=1)

    def search(self, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
        """Per text, the items it holds: (item_id, edits, end in the normalised text), by item_id."""
        plain = [normalised(t) for t in texts]
        found: list[dict[int, tuple[int, int]]] = [{} for _ in texts]
        for i in self.short:
            for d, t in enumerate(plain):
                if (at := t.find(self.texts[i])) >= 0:
                    found[d][i] = (0, at + len(self.texts[i]))
        # whatever an item matches lies whole in one piece
        parts = [(d, at) for d, t in enumerate(plain) for at in range(0, max(1, len(t)), PIECE)]
        pieces_ = [plain[d][at : at + PIECE + 2 * self.gap] for d, at in parts]
        exact: dict[tuple[int, int], bool] = {}
        for a, b in textvec.slices(pieces_, 300_000):
            rows = self.candidates(pieces_[a:b])
            # neighbouring bands of a text and an item are aligned together
            new = np.ones(len(rows), dtype=bool)
            new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1) | (rows[1:, 2] != rows[:-1, 2] + 1)
            start = np.flatnonzero(new)
            for (part, item, band), many in zip(rows[start].tolist(), np.diff(np.append(start, len(rows))).tolist()):
                d, offset = parts[a + part]
                if (d, item) not in exact:
                    at = plain[d].find(self.texts[item])
                    exact[d, item] = at >= 0
                    if at >= 0:
                        found[d][item] = (0, at + len(self.texts[item]))
                if exact[d, item]:
                    continue
                edits, width, m, piece = int(self.edits[item]), int(self.width[item]), len(self.points[item]), pieces_[a + part]
                at_once = max(1, WIDEST // width)
                for b0 in range(band, band + many, at_once):
                    wide = width * min(at_once, band + many - b0)
                    first = b0 * width - self.gap  # lowest diagonal of the bands
                    begin = max(0, first - edits)
                    region = codes(piece[begin : max(begin, first + wide + m + 2 * edits)])
                    cost, end = banded_infix(self.points[item], region, first - begin - edits, first - begin + wide + 2 * edits, edits)
                    if cost <= edits and (cost, offset + begin + end) < found[d].get(item, (edits + 1, 0)):
                        found[d][item] = (cost, offset + begin + end)
        return [sorted((self.ids[i], cost, end) for i, (cost, end) in f.items()) for f in found]


def _portions(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Places of ``sizes`` in runs that add up to about ``PORTION``; a larger one stands alone."""
    ends = np.cumsum(sizes)
    first = 0
    while first < len(sizes):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + PORTION, side="right")))
        yield np.arange(first, last)
        first = last


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def blocks(items: DataFrame, chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str | None]]]:
    """The items in blocks of bounded size; a block is all that the driver holds."""
    held, size = [], 0
    for row in items.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        if held and size + len(row[1] or "") > chars:
            yield held
            held, size = [], 0
        held.append((row[0], row[1]))
        size += len(row[1] or "")
    if held:
        yield held


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id``, ``item_id``, ``edits``, ``end`` for each item that a row's text holds."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, edits int, end long"
    out = None
    for block in blocks(items):
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            index = Index(shared.value)
            for batch in pieces(batches):
                rows = [(k, *m) for k, ms in zip(batch.column(0).to_pylist(), index.search(batch.column(1).to_pylist())) for m in ms]
                cols = list(zip(*rows)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64()))], names=["doc_id", "item_id", "edits", "end"])

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else materialise(out, "item-matches")


def _predicate(shared):
    """Predicate on a text column: whether it holds none of a broadcast block of items."""

    @F.pandas_udf("boolean")
    def clean(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = Index(shared.value)
        for series in texts:
            yield pd.Series([not m for m in index.search(series.tolist())], dtype=bool)

    return clean


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds no item."""
    kept = docs
    for block in blocks(items):
        kept = kept.where(_predicate(docs.sparkSession.sparkContext.broadcast(block))("text"))
    return docs if kept is docs else materialise(kept, "clean-documents")
