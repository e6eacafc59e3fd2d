"""Range asymmetric numeral system over token ids, vectorised with numpy.

One frequency table serves a whole corpus (:func:`quantise`).  Ids are coded
in blocks that know nothing of each other.  Inside a block ``LANES`` coder
states take the ids in turn and share one stream of 32-bit words; every
``STEP`` rows the states and the position in the stream are kept as a
checkpoint, so a decoder may start at any of them.  Blocks carry two
checksums: of the bytes and of the ids that they hold.

All blocks of a call advance in lockstep when coding, and all checkpoints of
all blocks when decoding, so numpy's cost per call is spread over many lanes.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

BITS = 20  # the quantised frequencies add up to 2**BITS
LOW = 1 << 31  # states stay in [LOW, LOW << 32)
LANES = 32
STEP = 256  # rows between checkpoints
ROWS = 2048  # rows of a full block
BLOCK = LANES * ROWS
MAGIC = b"QRB1"
_HEAD = struct.Struct("<4sIIIIII")  # magic, ids, rows, checkpoints, words, crc of ids, crc of body


@dataclass(frozen=True)
class Model:
    """Frequencies, their running sums, and the id of each slot."""

    freq: np.ndarray
    start: np.ndarray
    slot: np.ndarray

    @staticmethod
    def of(freq: np.ndarray) -> "Model":
        freq = freq.astype(np.uint64)
        start = np.zeros(len(freq) + 1, dtype=np.uint64)
        np.cumsum(freq, out=start[1:])
        slot = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))
        return Model(freq, start[:-1].copy(), slot)


def quantise(counts: np.ndarray) -> np.ndarray:
    """Frequencies that add up to ``2**BITS``, at least 1 for each id that occurs."""
    counts = np.asarray(counts, dtype=np.int64)
    size, total = 1 << BITS, int(counts.sum())
    used = counts > 0
    if int(used.sum()) > size:
        raise ValueError("more distinct ids than slots")
    if not total:
        freq = np.zeros(max(1, len(counts)), dtype=np.int64)
        freq[0] = size
        return freq
    freq = np.where(used, np.maximum(1, counts * float(size) // total), 0).astype(np.int64)
    order = np.argsort(-freq, kind="stable")
    left = size - int(freq.sum())
    if left > 0:
        freq[order[0]] += left
    for i in order:  # take what is too much from the largest, never the last slot of an id
        if left >= 0:
            break
        cut = min(-left, int(freq[i]) - max(1, int(freq[i]) // 2))
        freq[i] -= cut
        left += cut
    return freq if left >= 0 else _squeeze(freq, size)


def _squeeze(freq: np.ndarray, size: int) -> np.ndarray:
    while (over := int(freq.sum()) - size) > 0:
        big = np.flatnonzero(freq > 1)[:over]
        freq[big] -= 1
    return freq


def _encode_rows(model: Model, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code ``ids[rows, blocks, LANES]``; words, which of them count, states before each checkpoint row."""
    rows, blocks, lanes = ids.shape
    state = np.full((blocks, lanes), LOW, dtype=np.uint64)
    words = np.zeros((rows, blocks, lanes), dtype=np.uint32)
    given = np.zeros((rows, blocks, lanes), dtype=bool)
    marks = np.zeros(((rows + STEP - 1) // STEP, blocks, lanes), dtype=np.uint64)
    shift, half, bits = np.uint64(63 - BITS), np.uint64(32), np.uint64(BITS)
    for row in range(rows - 1, -1, -1):
        f, s = model.freq[ids[row]], model.start[ids[row]]
        over = state >= (f << shift)
        words[row] = state.astype(np.uint32)
        given[row] = over
        state = np.where(over, state >> half, state)
        whole = state // f
        state = (whole << bits) + (state - whole * f) + s
        if row % STEP == 0:
            marks[row // STEP] = state
    return words, given, marks


def encode(model: Model, ids: np.ndarray) -> list[bytes]:
    """The blocks that hold ``ids``, in order."""
    out: list[bytes] = []
    full = len(ids) // BLOCK
    for first in range(0, full, 64):
        many = min(64, full - first)
        part = ids[first * BLOCK : (first + many) * BLOCK]
        out += _blocks(model, part.reshape(many, ROWS, LANES).transpose(1, 0, 2), [BLOCK] * many, part.reshape(many, BLOCK))
    if len(tail := ids[full * BLOCK :]):
        rows = -(-len(tail) // LANES)
        filled = np.full(rows * LANES, int(np.argmax(model.freq)), dtype=np.int64)
        filled[: len(tail)] = tail
        out += _blocks(model, filled.reshape(rows, 1, LANES), [len(tail)], [tail])
    return out


def _blocks(model: Model, ids: np.ndarray, counts: list[int], plain) -> list[bytes]:
    words, given, marks = _encode_rows(model, ids)
    out = []
    for b, count in enumerate(counts):
        stream = words[:, b][given[:, b]]
        at = np.concatenate([[0], np.cumsum(given[:, b].sum(axis=1))])[: ids.shape[0] : STEP].astype("<u4")
        body = at.tobytes() + marks[:, b].astype("<u8").tobytes() + stream.astype("<u4").tobytes()
        own = np.asarray(plain[b]).astype("<u4").tobytes()
        out.append(_HEAD.pack(MAGIC, count, ids.shape[0], len(at), len(stream), zlib.crc32(own), zlib.crc32(body)) + body)
    return out


def _parse(block: bytes) -> tuple[int, int, int, np.ndarray, np.ndarray, np.ndarray]:
    magic, count, rows, marks, size, of_ids, of_body = _HEAD.unpack_from(block)
    body = memoryview(block)[_HEAD.size :]
    if magic != MAGIC or zlib.crc32(body) != of_body:
        raise ValueError("damaged block")
    at = np.frombuffer(body, "<u4", marks)
    states = np.frombuffer(body, "<u8", marks * LANES, 4 * marks).reshape(marks, LANES)
    return count, rows, of_ids, at, states, np.frombuffer(body, "<u4", size, 4 * marks + 8 * marks * LANES)


def decode(model: Model, blocks: list[bytes]) -> np.ndarray:
    """The ids of ``blocks``, each verified; checkpoints of many blocks are decoded side by side."""
    out = []
    for first in range(0, len(blocks), 32):
        out.append(_decode_some(model, [_parse(b) for b in blocks[first : first + 32]]))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)


def _decode_some(model: Model, parsed: list) -> np.ndarray:
    base = np.cumsum([0] + [len(p[5]) for p in parsed])
    stream = np.concatenate([p[5] for p in parsed] + [np.zeros(LANES, dtype="<u4")]).astype(np.uint64)
    state = np.concatenate([p[4] for p in parsed]).astype(np.uint64)
    at = np.concatenate([p[3].astype(np.int64) + b for p, b in zip(parsed, base)])
    rows = np.concatenate([np.minimum(STEP, p[1] - STEP * np.arange(len(p[3]))) for p in parsed])
    ids = np.zeros((len(state), STEP, LANES), dtype=np.uint32)
    mask, bits, half, low = np.uint64((1 << BITS) - 1), np.uint64(BITS), np.uint64(32), np.uint64(LOW)
    live = np.arange(len(state))
    for row in range(int(rows.max())):
        if rows[live].min() <= row:
            keep = rows[live] > row
            live, state, at = live[keep], state[keep], at[keep]
        slot = state & mask
        symbol = model.slot[slot]
        ids[live, row] = symbol
        state = model.freq[symbol] * (state >> bits) + slot - model.start[symbol]
        need = state < low
        ranks = np.cumsum(need, axis=1)
        word = stream[np.minimum(at[:, None] + ranks - need, len(stream) - 1)]
        state = np.where(need, (state << half) | word, state)
        at = at + ranks[:, -1]
    out, seg = [], 0
    for count, _, of_ids, marks, *_ in parsed:
        own = ids[seg : seg + len(marks)].reshape(-1)[:count]
        seg += len(marks)
        if zlib.crc32(own.astype("<u4").tobytes()) != of_ids:
            raise ValueError("ids differ from their checksum")
        out.append(own)
    return np.concatenate(out)
