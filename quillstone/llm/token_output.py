"""Token-ID output in rANS containers, and the way back.

Method: static range asymmetric numeral system.  Every text is encoded with a
public tokenizer, the ids of the whole corpus are counted once into one shared
frequency table, and ids are written in ascending ``doc_id`` order as
containers of independent interleaved blocks (:mod:`.rans`) with checkpoints
and checksums.

Stages, each written to the shared folder so that a lost executor costs one
task:

1. ids per document (no shuffle);
2. counts per id (map-side sums, then a shuffle of at most vocabulary rows a task);
3. range partitioning by ``doc_id`` into parts of about ``PART_IDS`` ids, sort
   inside the part, containers of about ``container_ids`` ids each; a container
   is self-contained, so reading needs no shuffle and any container can be
   decoded alone.  Rows with the same ``doc_id`` may lie in several parts.

Words are known by a 64-bit hash, and a second one is compared, so that a word
is not taken for another at any size of corpus.  Long texts that may be cut
are encoded in slices.

Positions: a container knows where its documents start inside its partition;
the partitions' totals (one row each) are added on reading.

Defined results: a null or empty text gives only the end id; texts of any
length stay whole (a container grows with its longest document); repeated
``doc_id`` s keep all their rows, shorter ones first; a null ``doc_id`` comes
first; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rans, textvec
from .common import begin, materialise, parallelism, pieces, settle, small_batches

END_ID = 0
CONTAINER_IDS = 1 << 22
#: Ids that a part of the output holds on average, at most.
PART_IDS = 1 << 26
#: Words of which a worker process keeps the ids; beyond that it starts anew with the next texts, so its memory is bounded.
KEPT_WORDS = 1 << 20
#: Characters that are encoded at once of a text that may be cut.
SLICE = 1 << 21
#: A text of these characters, without doubled blanks and line ends, may be cut
#: before blanks and line ends: the byte-level pre-tokenizer cuts there too, and
#: its merges never cross a cut.  Other texts go through the library whole.
PLAIN = r"[\n\x20-\x7e\xa1-\u024f]*"
UNSAFE = ("  ", "\n\n", " \n", "\n ")
_CUT = re.compile(r"[ \n]")
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", dtype=np.uint8)] = True
MAGIC = b"QTC1"
_HEAD = struct.Struct("<4sII")


class Words:
    """Ids of words by the words' hashes: an open-addressing table of numpy arrays that grows as needed."""

    def __init__(self, dtype: np.dtype, kept: int) -> None:
        self.dtype, self.kept = dtype, kept
        self.clear()

    def clear(self) -> None:
        self.held = 0
        self._slots(2 * self.kept)
        self.ids = np.zeros(1 << 16, dtype=self.dtype)
        self.used = 0

    def _slots(self, n: int) -> None:
        self.mask = np.uint64(n - 1)
        self.keys, self.checks = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)
        self.begin, self.count = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slots of keys; -1 for those that are not there."""
        slot = keys & self.mask
        there = self.keys[slot]
        out = np.where(there == keys, slot.astype(np.int64), -1)
        left = np.flatnonzero((there != keys) & (there != 0))
        slot = slot[left]
        while len(left):
            slot = (slot + np.uint64(1)) & self.mask
            there = self.keys[slot]
            hit = there == keys[left]
            out[left[hit]] = slot[hit]
            go = ~hit & (there != 0)
            left, slot = left[go], slot[go]
        return out

    def add(self, keys: np.ndarray, checks: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """New distinct keys with their second hashes and their ids, one after another."""
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(ids), len(self.ids)), dtype=self.dtype)])
        self.ids[self.used : self.used + len(ids)] = ids
        begins = self.used + np.cumsum(counts) - counts
        self.used += len(ids)
        if 4 * (self.held + len(keys)) > 3 * len(self.keys):  # a full table would be searched without end
            old = np.flatnonzero(self.keys)
            rows = self.keys[old], self.checks[old], self.begin[old], self.count[old]
            size = len(self.keys)
            while 2 * (self.held + len(keys)) > size:
                size *= 2
            self._slots(size)
            self._place(*rows)
        self.held += len(keys)
        self._place(keys, checks, begins, counts)

    def _place(self, keys: np.ndarray, checks: np.ndarray, begins: np.ndarray, counts: np.ndarray) -> None:
        slot, left = keys & self.mask, np.arange(len(keys))
        while len(left):
            free = np.flatnonzero(self.keys[slot] == 0)
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            at = slot[won]
            self.keys[at], self.checks[at], self.begin[at], self.count[at] = keys[left[won]], checks[left[won]], begins[left[won]], counts[left[won]]
            go = np.ones(len(left), dtype=bool)
            go[won] = False
            left, slot = left[go], (slot[go] + np.uint64(1)) & self.mask


class Encoder:
    """``tokenizers`` with the ids of words kept, so that repeated words are encoded once."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if self.vocabulary <= 1 << 16 else np.dtype("<u4")
        kind = type(self.tokenizer.pre_tokenizer).__name__
        self.by_word = kind == "ByteLevel" and self.tokenizer.normalizer is None and not self.tokenizer.pre_tokenizer.add_prefix_space
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.plain = re.compile(PLAIN).fullmatch
        # a byte-level token has one character a byte
        self.token_bytes = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(self.vocabulary)], dtype=np.int64)
        self.known = Words(self.dtype, KEPT_WORDS)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, dtype=self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _easy(self, text: str | None) -> bool:
        return self.by_word and bool(text) and self.plain(text) is not None and not any(u in text for u in UNSAFE) and not any(s in text for s in self.special)

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        out = [b""] * len(texts)
        easy = [i for i, t in enumerate(texts) if self._easy(t)]
        hard = sorted(set(i for i, t in enumerate(texts) if t).difference(easy))
        for a, b in textvec.slices([texts[i] for i in hard]):
            for i, ids in zip(hard[a:b], self._whole([texts[i] for i in hard[a:b]])):
                out[i] = ids.tobytes()
        for a, b in textvec.slices([texts[i] for i in easy]):
            if b - a == 1 and len(texts[easy[a]]) > SLICE:
                out[easy[a]] = b"".join(self._by_words([part])[0] for part in self._parts(texts[easy[a]]))
                continue
            for i, ids in zip(easy[a:b], self._by_words([texts[i] for i in easy[a:b]])):
                out[i] = ids
        return out

    @staticmethod
    def _parts(text: str) -> Iterator[str]:
        """A long text, cut before blanks and line ends."""
        at = 0
        while at < len(text):
            cut = _CUT.search(text, min(len(text), at + SLICE))
            end = cut.start() if cut else len(text)
            yield text[at:end]
            at = end

    def _by_words(self, texts: list[str]) -> list[bytes]:
        if self.known.held > KEPT_WORDS * 3 // 4:
            self.known.clear()
        data = b"\0" + "\0".join(texts).encode()
        # a unit is a separator and the word after it, or the sentence mark that ends a word; a zero byte begins a text
        values = np.frombuffer(data, dtype=np.uint8)
        begin = (values == 32) | (values == 10) | (values == 0)
        mark = np.flatnonzero((values == 44) | (values == 46))
        mark = mark[_ALNUM[values[mark - 1]] & np.append(begin, True)[mark + 1]]
        begin[mark] = True
        begins = np.flatnonzero(begin)
        ends = np.append(begins[1:], len(data))
        keys = textvec.stretches(values, begins, ends)
        keys[keys == 0] = 1
        checks = textvec.stretches(values, begins, ends, second=True)
        at = self.known.find(keys)
        if (new := np.flatnonzero(at < 0)).size:
            fresh, first = np.unique(keys[new], return_index=True)
            first = new[first]
            lead = values[begins[first]]
            for sep in (32, 10, 0, 44, 46):
                own = np.flatnonzero(lead == sep)
                for part in range(0, len(own), 5000):
                    some = own[part : part + 5000]
                    self._learn(sep, fresh[some], checks[first[some]], [data[x:y] for x, y in zip(begins[first[some]].tolist(), ends[first[some]].tolist())])
            at[new] = self.known.find(keys[new])
        if (self.known.checks[at] != checks).any():  # two words with one hash
            return [x.tobytes() for x in self._whole(texts)]
        counts = self.known.count[at]
        ids_end = np.cumsum(counts)
        ids = self.known.ids[np.repeat(self.known.begin[at] - ids_end + counts, counts) + np.arange(ids_end[-1])]
        cuts = np.append((ids_end - counts)[values[begins] == 0], len(ids)) * self.dtype.itemsize
        flat, cuts = ids.tobytes(), cuts.tolist()
        return [flat[x:y] for x, y in zip(cuts[:-1], cuts[1:])]

    def _learn(self, sep: int, keys: np.ndarray, checks: np.ndarray, units: list[bytes]) -> None:
        """Encode new units. Those after blanks or line ends go as one text, cut where the units' bytes end."""
        sizes = np.array([len(u) for u in units], dtype=np.int64)
        if sep in (32, 10) and (sizes > 1).all():
            ids = self._whole([b"".join(units).decode()])[0]
            ends, want = np.cumsum(self.token_bytes[ids]), np.cumsum(sizes)
            cut = np.searchsorted(ends, want)
            if (cut < len(ends)).all() and (ends[cut] == want).all():
                self.known.add(keys, checks, ids, np.diff(np.concatenate([[0], cut + 1])))
                return
        each = self._whole([(u if sep else u[1:]).decode() for u in units])  # a zero byte is no part of the text
        self.known.add(keys, checks, np.concatenate(each), np.array([len(x) for x in each], dtype=np.int64))


@lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    """One a worker process, so that tasks share what it has learned."""
    return Encoder(path)


def token_ids(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``ids`` (little-endian, end id last) of each row.

    Each task adds a row with only ``counts``: pairs of an id and how often the task met it.
    """

    def encode(batches):
        encoder = encoder_of(tokenizer_path)
        end = np.asarray([END_ID], dtype=encoder.dtype).tobytes()
        total = np.zeros(encoder.vocabulary, dtype=np.int64)
        names = ["doc_id", "n_tokens", "ids", "counts"]
        for batch in pieces(batches):
            for first in range(0, batch.num_rows, 250):
                part = batch.slice(first, 250)
                ids = [x + end for x in encoder(part.column(1).to_pylist())]
                total += np.bincount(np.frombuffer(b"".join(ids), dtype=encoder.dtype), minlength=encoder.vocabulary)
                n = [len(x) // encoder.dtype.itemsize for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.nulls(len(n), pa.binary())], names=names)
        at = np.flatnonzero(total)
        counts = np.stack([at, total[at]], axis=1).astype("<i8").tobytes()
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([counts], pa.binary())], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, "doc_id long, n_tokens long, ids binary, counts binary")


def count_ids(tokens: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs in all documents; the driver gets one number an id of the vocabulary."""

    def count(batches):
        total = np.zeros(vocabulary, dtype=np.int64)
        for batch in pieces(batches):
            for blob in batch.column(0).to_pylist():
                pairs = np.frombuffer(blob, dtype="<i8").reshape(-1, 2)
                total[pairs[:, 0]] += pairs[:, 1]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["id", "n"])

    with small_batches(tokens.sparkSession):
        rows = tokens.where(F.col("counts").isNotNull()).select("counts").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(vocabulary, dtype=np.int64)
    counts[np.asarray(rows.column("id"))] = np.asarray(rows.column("n"))
    return counts


def pack(docs: list[tuple], starts: list[int], model: rans.Model, dtype: str) -> bytes:
    """One container: index of documents, then blocks. ``docs``: (doc_id or None, ids)."""
    ids = np.frombuffer(b"".join(d[1] for d in docs), dtype=dtype)
    blocks = rans.encode(model, ids)
    width = np.dtype(dtype).itemsize
    index = np.array([d[0] or 0 for d in docs], dtype="<i8").tobytes()
    index += np.array([d[0] is None for d in docs], dtype="u1").tobytes()
    index += np.array(starts, dtype="<i8").tobytes()
    index += np.array([len(d[1]) // width for d in docs], dtype="<i8").tobytes()
    sizes = np.array([len(b) for b in blocks], dtype="<u4").tobytes()
    head = _HEAD.pack(MAGIC, len(docs), len(blocks))
    return head + struct.pack("<I", zlib.crc32(head + index + sizes)) + index + sizes + b"".join(blocks)


def unpack(container: bytes, model: rans.Model) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of documents (None: null), their starts in the partition, their lengths, and all ids."""
    magic, docs, blocks = _HEAD.unpack_from(container)
    at = _HEAD.size + 4
    end = at + docs * 25 + blocks * 4
    if magic != MAGIC or struct.unpack_from("<I", container, _HEAD.size)[0] != zlib.crc32(container[at:end], zlib.crc32(container[: _HEAD.size])):
        raise ValueError("damaged container")
    keys = np.frombuffer(container, "<i8", docs, at)
    nulls = np.frombuffer(container, "u1", docs, at + 8 * docs)
    starts = np.frombuffer(container, "<i8", docs, at + 9 * docs)
    lengths = np.frombuffer(container, "<i8", docs, at + 17 * docs)
    sizes = np.frombuffer(container, "<u4", blocks, at + 25 * docs)
    cuts = end + np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    ids = rans.decode(model, [container[a:b] for a, b in zip(cuts[:-1], cuts[1:])])
    return [None if z else int(k) for k, z in zip(keys, nulls)], starts, lengths, ids


def write_containers(docs: DataFrame, tokenizer_path: str, container_ids: int = CONTAINER_IDS) -> tuple[DataFrame, "np.ndarray"]:
    """Write the corpus; returns the containers as read from the shared folder (``part``, ``n_ids``, ``payload``) and the table's frequencies."""
    spark = docs.sparkSession
    probe = encoder_of(tokenizer_path)
    vocabulary, dtype = probe.vocabulary, probe.dtype.str
    mark = begin()
    tokens = materialise(token_ids(docs, tokenizer_path).withColumn("row", F.monotonically_increasing_id()), "token-ids", "zstd")
    counts = count_ids(tokens, vocabulary)
    freq = rans.quantise(counts)
    shared = spark.sparkContext.broadcast(freq)  # one number an id of the vocabulary, whatever the corpus

    def write(batches):
        from pyspark import TaskContext

        part, model = TaskContext.get().partitionId(), rans.Model.of(shared.value)
        held, starts, at, since = [], [], 0, 0

        def row():
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([since], pa.int64()), pa.array([pack(held, starts, model, dtype)], pa.binary())], names=["part", "n_ids", "payload"])

        for batch in pieces(batches):
            for doc_id, n, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                held.append((doc_id, ids))
                starts.append(at)
                at, since = at + n, since + n
                if since >= container_ids:
                    yield row()
                    held, starts, since = [], [], 0
        if held:
            yield row()

    order = [F.col("doc_id").asc_nulls_first(), F.col("n_tokens"), F.col("row")]
    n_parts = max(parallelism(spark), int(counts.sum()) // PART_IDS + 1)
    ordered = tokens.where(F.col("ids").isNotNull()).drop("counts").repartitionByRange(n_parts, *order).sortWithinPartitions(*order)
    containers = materialise(ordered.select("doc_id", "n_tokens", "ids").mapInArrow(write, "part int, n_ids long, payload binary"), "token-containers")
    settle(spark, mark, containers)
    return containers, freq


def read_index(containers: DataFrame, freq: "np.ndarray") -> DataFrame:
    """Decode containers: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` of each document."""
    spark = containers.sparkSession
    # two numbers a part of the writing job
    totals = containers.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").toArrow()
    part, n = (np.asarray(totals.column(c)).astype(np.int64) for c in ("part", "n"))
    base = np.zeros(int(part[-1]) + 1 if len(part) else 0, dtype=np.int64)
    base[part] = np.cumsum(n) - n
    bases, shared = spark.sparkContext.broadcast(base), spark.sparkContext.broadcast(freq)

    def read(batches):
        model = rans.Model.of(shared.value)
        for batch in pieces(batches, 16):
            for part, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys, starts, lengths, ids = unpack(payload.as_py(), model)
                own = ids.astype("<u4", copy=False)
                ends = np.cumsum(lengths)
                crcs = [zlib.crc32(own[e - n : e].tobytes()) for e, n in zip(ends, lengths)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts + bases.value[part], pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return materialise(containers.select("part", "payload").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long"), "token-index")


def token_output(docs: DataFrame, tokenizer_path: str, container_ids: int = CONTAINER_IDS) -> DataFrame:
    """Write ``docs`` as containers, read them back and index the documents by what was read."""
    mark = begin()
    out = read_index(*write_containers(docs, tokenizer_path, container_ids))
    settle(docs.sparkSession, mark, out)
    return out
