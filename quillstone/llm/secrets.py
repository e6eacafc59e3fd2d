"""Secret scans: fixed patterns plus sliding-window Shannon entropy.

Method: candidate strings are maximal runs of token characters.  Over each a
window slides once per character class; the sum of ``c * log2(c)`` over the
window's counts is updated for the one character that enters and the one that
leaves, which gives the window's entropy without recounting.  Windows above
the class's threshold merge into spans; an allow-list suppresses what is known
to be harmless: UUIDs, numbers, alphabets, strings in addresses, and strings
without a digit, which are words, paths and identifiers far more often than
keys.  Everything is local to a row: no shuffle, no state.

Defined results: a null or empty text has no spans; texts are read whole,
whatever their length; repeated rows each give a row; an empty table gives no
rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, pieces

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of 24 or more is a maximal run of that length
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")


@dataclass(frozen=True)
class CharClass:
    """Characters, window, and the entropy in bits from which a window counts."""

    name: str
    chars: frozenset
    window: int
    bits: float


CLASSES = (
    CharClass("hex", frozenset("0123456789abcdefABCDEF-"), 20, 3.0),
    CharClass("alnum", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"), 20, 3.7),
    CharClass("base64", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"), 24, 4.0),
)
#: What a span may not be: number-like and id-like strings that are no secrets.
ALLOWED = (
    re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z"),  # UUID
    re.compile(r"[0-9_=+/-]+\Z"),  # numbers, rules, dates
    re.compile(r"[A-Za-z_=+/-]+\Z"),  # no digit: words, paths, identifiers
    re.compile(r"(0123456789|abcdefghijklmnopqrstuvwxyz|ABCDEFGHIJKLMNOPQRSTUVWXYZ)+\Z"),  # alphabets
)
#: Addresses, in which no string counts, however long they are.
ADDRESS = re.compile(r"(?:https?://|www\.|@)[^\s\"'<>]*")
_SUMS = [0.0] + [c * math.log2(c) for c in range(1, 256)]


def hot_spans(run: str, kind: CharClass) -> list[tuple[int, int]]:
    """Merged windows of ``run`` whose entropy reaches the class's threshold; windows never leave the class."""
    window, limit = kind.window, math.log2(kind.window) - kind.bits
    limit = limit * window + 1e-9  # entropy >= bits  <=>  sum of c*log2(c) <= limit
    counts: dict[str, int] = {}
    spans: list[tuple[int, int]] = []
    total, begin = 0.0, 0
    for at, ch in enumerate(run):
        if ch not in kind.chars:
            counts, total, begin = {}, 0.0, at + 1
            continue
        c = counts.get(ch, 0)
        counts[ch] = c + 1
        total += _SUMS[c + 1] - _SUMS[c]
        if at - begin + 1 > window:
            old = run[begin]
            c = counts[old]
            counts[old] = c - 1
            total += _SUMS[c - 1] - _SUMS[c]
            begin += 1
        if at - begin + 1 == window and total <= limit:
            if spans and begin <= spans[-1][1]:
                spans[-1] = (spans[-1][0], at + 1)
            else:
                spans.append((begin, at + 1))
    return spans


def entropy_spans(text: str) -> list[tuple[int, int]]:
    found: list[tuple[int, int]] = []
    addresses: list[tuple[int, int]] | None = None
    for m in CANDIDATE.finditer(text):
        run, base = m.group(), m.start()
        if any(a.match(run) for a in ALLOWED):
            continue
        own = sorted(s for kind in CLASSES for s in hot_spans(run, kind))
        merged: list[list[int]] = []
        for a, b in own:
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        if merged and addresses is None:
            addresses = [(x.start(), x.end()) for x in ADDRESS.finditer(text)]
        at = bisect_right(addresses, (base, 0)) - 1 if merged else -1
        if at >= 0 and base < addresses[at][1]:
            continue
        for a, b in merged:
            if any(p.match(run[a:b]) for p in ALLOWED):
                continue
            found.append((base + a, base + b))
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_text(text: str | None) -> tuple[int, int, int, int, str, str]:
    """Counts per kind, sha256 of the base spans, all spans."""
    if not text:
        return 0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), ""
    base = base_spans(text)
    more = [(a, 3, b) for a, b in entropy_spans(text)]
    kinds = [k for _, k, _ in base]
    return kinds.count(0), kinds.count(1), kinds.count(2), len(more), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(sorted(base + more))


def scan(docs: DataFrame) -> DataFrame:
    """Secrets of each row's ``text``: counts, digest of the base spans, all spans."""

    def run(batches):
        for batch in pieces(batches):
            cols = list(zip(*map(scan_text, batch.column(1).to_pylist()))) or [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=["doc_id", "n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans"])

    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string"
    return materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema), "secret-spans")
