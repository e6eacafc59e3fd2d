"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

Method: a text is the weighted set of its five-word shingles, weight = term
frequency x damped inverse document frequency.  Improved consistent weighted
sampling draws ``BANDS * ROWS`` samples whose collision probability is the
weighted Jaccard similarity; texts that agree on all rows of a band are
candidates, and candidates are verified by their exact weighted Jaccard
similarity.  Classes are the connected components of the verified links.

Document frequencies come from a count-min sketch of fixed size over all
documents.  The damping keeps a large group of copies from making its own
shingles worthless.

At scale: equal texts are one node.  A bucket never yields all its pairs:

1. every node is paired with its buckets' hubs; a bucket's hub is the node that
   meets most others over all its buckets, which is the text that the copies in
   a group come from, or one near it;
2. where a bucket still spans several components, all its pairs between
   components whose signatures agree on ``AGREE`` samples are verified, without
   a cap, in blocks of ``BLOCK_NODES`` nodes: those outside the bucket's largest
   component with one another and with it.  A pair stands in the first band
   that it shares alone, and what a block has linked is not compared again.
   Only links leave a block.

Pairs whose signatures agree on fewer than ``AGREE`` samples (five standard
deviations below the threshold) are not verified.  The bands miss a pair at
exactly the threshold with a chance of 2.2 in 10,000, ``AGREE`` with one of
less than 1 in 100,000.  Texts of candidates are fetched by joins; links and
components stay in tables.

Defined results: a null text counts as empty; equal texts are one class
whatever their length; a text without words is near no other; fewer than five
words make one shingle; a class's id is its smallest ``doc_id`` (null first);
repeated rows and ids each give a row; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec
from .common import begin, broadcast_if_small, materialise, pieces, settle, small_batches

BANDS, ROWS = 16, 4
SAMPLES = BANDS * ROWS
SIMILARITY = 0.8
AGREE = 35  # of 64 samples; 0.8 * 64 less five standard deviations
#: Count-min sketch of document frequencies: rows and counters a row.
SKETCH = (2, 1 << 16)
DAMPING = 0.25
BLOCK_NODES = 512
#: Texts whose shingles a verifying task keeps.
HELD_TEXTS = 4000

_rng = np.random.default_rng(99)
_SEEDS = _rng.integers(1, 1 << 63, SAMPLES, dtype=np.int64).astype(np.uint64)


def _gamma2_table() -> np.ndarray:
    """Quantiles of Gamma(2, 1) at 65,536 equal steps, by Newton's method."""
    p = (np.arange(1 << 16) + 0.5) / (1 << 16)
    x = np.maximum(np.sqrt(2 * p), -np.log1p(-p))
    for _ in range(60):
        cdf = 1 - (1 + x) * np.exp(-x)
        x = np.maximum(1e-9, x - (cdf - p) / np.maximum(x * np.exp(-x), 1e-12) * 0.7)
    return x


_GAMMA = _gamma2_table()
_R = _GAMMA.astype(np.float32)
_LN_C = np.log(_GAMMA).astype(np.float32)


def node_of(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text (ascending), their frequency, and where each text's begin."""
    hashes, at = textvec.shingles([t.lower() for t in texts])
    if not len(hashes):
        return hashes, np.zeros(0, dtype=np.int64), at
    doc = np.repeat(np.arange(len(texts)), np.diff(at))
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])])
    where = np.flatnonzero(new)
    begins = np.searchsorted(doc[where], np.arange(len(texts) + 1))
    return hashes[where], np.diff(np.concatenate([where, [len(hashes)]])), begins


def _counters(hashes: np.ndarray) -> list[np.ndarray]:
    width = np.uint64(SKETCH[1] - 1)
    return [((hashes >> np.uint64(16 * row + 8)) & width).astype(np.int64) for row in range(SKETCH[0])]


class Weights:
    """Inverse document frequencies from the sketch."""

    def __init__(self, sketch: np.ndarray, documents: int) -> None:
        self.by_counter = sketch
        self.documents = documents

    def of(self, hashes: np.ndarray, frequency: np.ndarray) -> np.ndarray:
        df = np.minimum.reduce([self.by_counter[row][c] for row, c in enumerate(_counters(hashes))])
        idf = np.log((1.0 + self.documents) / (1.0 + np.minimum(df, self.documents))) / np.log(2.0 + self.documents)
        return frequency * (1.0 + DAMPING * idf)


def sketch_of(docs: DataFrame) -> Weights:
    """Count the documents of each shingle, in all documents, into the count-min sketch."""

    def count(batches):
        table = np.zeros(SKETCH, dtype=np.int64)
        for batch in pieces(batches):
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for a, b in textvec.slices(texts):
                hashes, _, _ = counted(texts[a:b])
                for row, counters in enumerate(_counters(hashes)):
                    table[row] += np.bincount(counters, minlength=SKETCH[1])
        at = np.flatnonzero(table.reshape(-1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(table.reshape(-1)[at], pa.int64())], names=["counter", "n"])

    with small_batches(docs.sparkSession):
        rows = docs.select("text").mapInArrow(count, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()  # SKETCH[0] * SKETCH[1] rows at most
    table = np.zeros(SKETCH[0] * SKETCH[1], dtype=np.int64)
    table[np.asarray(rows.column("counter"))] = np.asarray(rows.column("n"))
    return Weights(table.reshape(SKETCH), docs.count())


def sample(hashes: np.ndarray, weights: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Signatures ``[texts, SAMPLES]`` of the texts that have shingles, uint32."""
    held = np.flatnonzero(np.diff(begins))
    out = np.zeros((len(begins) - 1, SAMPLES), dtype=np.uint32)
    if not len(held):
        return out
    starts = begins[:-1][held]
    ln_w = np.log(weights).astype(np.float32)
    low = (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    for k in range(SAMPLES):
        h = hashes ^ _SEEDS[k]
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        halves = h.view(np.uint32).reshape(-1, 2)
        r = _R[halves[:, 0] & np.uint32(0xFFFF)]
        ln_c = _LN_C[halves[:, 0] >> np.uint32(16)]
        beta = halves[:, 1].astype(np.float32) * np.float32(2.0**-32)
        t = np.floor(ln_w / r + beta)
        ln_a = ln_c - r * (t - beta + np.float32(1)) + np.float32(256)  # positive: its bits sort as it does
        key = np.empty((len(h), 2), dtype=np.uint32)
        key[:, 1] = ln_a.view(np.uint32)
        key[:, 0] = low * np.uint32(0x9E3779B1) + t.astype(np.int32).astype(np.uint32) * np.uint32(0x85EBCA77)
        out[held, k] = np.minimum.reduceat(key.view(np.uint64)[:, 0], starts).astype(np.uint32)
    return out


def signatures(docs: DataFrame, weights: Weights) -> DataFrame:
    """``doc_id``, ``node``, ``sig`` (null without words) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # the sketch, of fixed size

    def run(batches):
        for batch in pieces(batches):
            texts = [t or "" for t in batch.column(2).to_pylist()]
            once = list(dict.fromkeys(texts))
            found: dict[str, bytes | None] = {}
            for a, b in textvec.slices(once):
                hashes, frequency, begins = counted(once[a:b])
                sig = sample(hashes, shared.value.of(hashes, frequency), begins)
                found.update((t, s.tobytes() if n else None) for t, s, n in zip(once[a:b], sig, np.diff(begins)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([found[t] for t in texts], pa.binary())], names=["doc_id", "node", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), node_of(F.col("text")).alias("node"), "text").mapInArrow(run, "doc_id long, node binary, sig binary")


def similarity(a: str, b: str, weights: Weights) -> float:
    """Exact weighted Jaccard similarity of two texts."""
    hashes, frequency, begins = counted([a, b])
    w, cut = weights.of(hashes, frequency), begins[1]
    _, left, right = np.intersect1d(hashes[:cut], hashes[cut:], assume_unique=True, return_indices=True)
    shared = np.minimum(w[:cut][left], w[cut:][right]).sum()
    total = w.sum() - shared
    return float(shared / total) if total else 0.0


def _overlap(a: tuple, b: tuple) -> float:
    """Weighted Jaccard similarity of (ascending hashes, weights, their sum)."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    if not len(a[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    same = b[0][at] == a[0]
    shared = float(np.minimum(a[1][same], b[1][at[same]]).sum())
    return shared / (a[2] + b[2] - shared)


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).sum(axis=-1)


def texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node``, ``text`` of some nodes."""
    wanted = broadcast_if_small(materialise(nodes.select("node").distinct(), "near-wanted"))
    found = docs.select(node_of(F.col("text")).alias("node"), "text").join(wanted, "node", "left_semi")
    return materialise(found.groupBy("node").agg(F.first("text").alias("text")), "near-texts")


def shingle_lists(texts: DataFrame) -> DataFrame:
    """``node``, ``shingles``: the hashes of each text's shingles, ascending, repeated ones as often as they occur."""

    def run(batches):
        for batch in pieces(batches):
            given, found = [t or "" for t in batch.column(1).to_pylist()], []
            for a, b in textvec.slices(given):
                hashes, frequency, begins = counted(given[a:b])
                at = np.concatenate([[0], np.cumsum(frequency)])[begins]
                every = np.repeat(hashes, frequency)
                found += [every[x:y].tobytes() for x, y in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["node", "shingles"])

    return materialise(texts.mapInArrow(run, "node binary, shingles binary"), "near-shingles")


def verified(pairs: DataFrame, texts: DataFrame, weights: Weights, least: float) -> DataFrame:
    """The pairs ``a``, ``b`` of nodes whose texts are similar enough."""
    spark = pairs.sparkSession
    shared = spark.sparkContext.broadcast(weights)
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")

    def check(batches):
        held: dict[bytes, tuple] = {}
        for batch in pieces(batches, 200):
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if len(held) > HELD_TEXTS:
                held.clear()
            texts_ = dict(zip(a, batch.column(2).to_pylist())) | dict(zip(b, batch.column(3).to_pylist()))
            new = [k for k in texts_ if k not in held]
            hashes, frequency, begins = counted([texts_[k] or "" for k in new])
            w = shared.value.of(hashes, frequency)
            for i, k in enumerate(new):
                own = slice(begins[i], begins[i + 1])
                held[k] = (hashes[own].copy(), w[own].copy(), float(w[own].sum()))
            keep = [_overlap(held[x], held[y]) >= least for x, y in zip(a, b)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(check, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``label`` (smallest node of its component) of the nodes on ``edges`` (``a``, ``b``).

    Labels spread along edges and are then followed one step further, so long
    chains shorten by half each round; every round is a written table.
    """
    both = materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label")), "cc-labels")
    while True:
        seen = broadcast_if_small(labels.select(F.col("node").alias("b"), F.col("label").alias("seen")))
        near = both.join(seen, "b").groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("seen"))
        spread = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        spread = materialise(spread, "cc-spread")
        ahead = broadcast_if_small(spread.select(F.col("node").alias("at"), F.col("label").alias("far")))
        jumped = materialise(spread.join(ahead, F.col("label") == F.col("at")).select("node", "old", F.least("label", "far").alias("label")), "cc-jumped")
        labels = jumped.select("node", "label")
        if jumped.where(F.col("old") != F.col("label")).isEmpty():
            return labels


def band_keys(texts: DataFrame) -> DataFrame:
    """``bucket``, ``band``, ``node`` for each band of each text."""
    pieces = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("sig"), i * (4 * ROWS) + 1, F.lit(4 * ROWS))))
    return texts.where(F.col("sig").isNotNull()).select("node", F.posexplode(pieces).alias("band", "bucket"))


def first_pairs(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of each node with the hubs of its buckets; and the members of buckets with more than one node."""
    keys = band_keys(texts)
    shared = materialise(keys.groupBy("bucket").agg(F.count("node").alias("n")).where(F.col("n") > 1), "near-buckets")
    members = materialise(keys.join(broadcast_if_small(shared), "bucket").select("bucket", "band", "node", "n"), "near-members")
    meets = materialise(members.groupBy("node").agg(F.sum("n").alias("meets")), "near-meets")
    hubs = materialise(members.join(meets, "node").groupBy("bucket").agg(F.max(F.struct("meets", "node"))["node"].alias("hub")), "near-hubs")
    pairs = members.join(hubs, "bucket").where(F.col("node") != F.col("hub"))
    return pairs.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct(), members


def agreeing(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose signatures agree on enough samples."""
    sigs = texts.select("node", "sig")
    both = pairs.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a").join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b")

    def check(batches):
        for batch in pieces(batches, 4096):
            x, y = (_signature_matrix(batch.column(i)) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(_agree(x, y) >= AGREE))

    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(check, "a binary, b binary")


def _first_band(same: np.ndarray) -> np.ndarray:
    return same.reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1)


def _signature_matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u4").reshape(-1, SAMPLES)


def mixed_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members, with their component, of the buckets that span several components."""
    labelled = members.join(labels, "node", "left").select("bucket", "band", "node", "n", F.coalesce("label", "node").alias("label"))
    labelled = materialise(labelled, "near-labelled")
    mixed = materialise(labelled.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where(F.col("x") != F.col("y")).select("bucket"), "near-mixed")
    return materialise(labelled.join(broadcast_if_small(mixed), "bucket", "left_semi"), "near-mixed-members")


def _blocks(members: DataFrame) -> DataFrame:
    """``members`` of buckets that span components, once for each pair of blocks (``x`` <= ``y``) in which they are compared.

    The nodes outside a bucket's largest component make the first blocks, which
    meet all blocks; those inside it make the rest, which meet the first only.
    """
    per_label = members.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    per_bucket = per_label.groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("n"))
    count = lambda n: F.ceil(n / BLOCK_NODES).cast("int")
    per_bucket = materialise(per_bucket.select("bucket", F.col("most.label").alias("largest"), count(F.col("n") - F.col("most.n")).alias("others"), count(F.col("most.n")).alias("inside")), "near-blocks")
    placed = members.drop("n").join(broadcast_if_small(per_bucket), "bucket")
    inside, spread = F.col("label") == F.col("largest"), F.xxhash64("node")
    own = F.when(inside, F.col("others") + F.pmod(spread, F.col("inside"))).otherwise(F.pmod(spread, F.greatest("others", F.lit(1)))).cast("int")
    last = F.when(inside, F.col("others")).otherwise(F.col("others") + F.col("inside")) - 1
    met = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return met.select("bucket", "band", "node", "label", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))


def linked(held: DataFrame, signatures_: DataFrame, shingles: DataFrame, weights: Weights, least: float) -> DataFrame:
    """Links ``a``, ``b`` between the components of each bucket; pairs that earlier links of a block join are left out."""
    shared = held.sparkSession.sparkContext.broadcast(weights)
    rows = _blocks(held).join(signatures_, "node").join(shingles, "node")
    empty = pa.schema([("a", pa.binary()), ("b", pa.binary())]).empty_table()

    def compare(group: pa.Table) -> pa.Table:
        n = group.num_rows
        own, x, y = np.asarray(group.column("own")), group.column("x")[0].as_py(), group.column("y")[0].as_py()
        comp = np.unique(np.array(group.column("label").to_pylist(), dtype="V16"), return_inverse=True)[1]
        sig, band = _signature_matrix(group.column("sig")), group.column("band")[0].as_py()
        overlap = Overlaps(group.column("shingles").to_pylist(), shared.value)
        links: list[tuple[int, int]] = []
        for i in np.flatnonzero(own == x):
            ok = comp != comp[i]
            ok &= (np.arange(n) > i) if x == y else (own == y)
            at = np.flatnonzero(ok)
            same = sig[at] == sig[i]
            at = at[(same.sum(axis=1) >= AGREE) & (_first_band(same) == band)]
            if len(at):
                for j in at[overlap.similar(i, at) >= least]:
                    if comp[j] != comp[i]:
                        comp[comp == comp[j]] = comp[i]
                        links.append((i, j))
        if not links:
            return empty
        nodes = group.column("node").to_pylist()
        pairs = [sorted((nodes[i], nodes[j])) for i, j in links]
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.binary()), "b": pa.array([p[1] for p in pairs], pa.binary())})

    return rows.groupBy("bucket", "x", "y").applyInArrow(compare, "a binary, b binary")


class Overlaps:
    """Exact weighted Jaccard similarities of one of some texts with many others at once."""

    def __init__(self, shingles: list[bytes], weights: Weights) -> None:
        flat = np.frombuffer(b"".join(shingles), dtype=np.uint64)
        text = np.repeat(np.arange(len(shingles)), [len(s) // 8 for s in shingles])
        # one row a text and shingle; a text's shingles ascend
        first = np.flatnonzero(np.append(True, (flat[1:] != flat[:-1]) | (text[1:] != text[:-1]))) if len(flat) else np.zeros(0, dtype=np.int64)
        self.times = np.diff(np.append(first, len(flat)))
        known, self.place = np.unique(flat[first], return_inverse=True)
        self.weight = weights.of(known, np.ones(len(known)))
        self.begins = np.searchsorted(text[first], np.arange(len(shingles) + 1))
        self.total = np.bincount(text[first], weights=self.times * self.weight[self.place], minlength=len(shingles))
        self.held = np.zeros(len(known), dtype=np.int64)

    def similar(self, i: int, others: np.ndarray) -> np.ndarray:
        own = slice(self.begins[i], self.begins[i + 1])
        self.held[self.place[own]] = self.times[own]
        many = self.begins[others + 1] - self.begins[others]
        cuts = np.concatenate([[0], np.cumsum(many)])
        rows = np.repeat(self.begins[others] - cuts[:-1], many) + np.arange(cuts[-1])
        place = self.place[rows]
        sums = np.concatenate([[0.0], np.cumsum(np.minimum(self.held[place], self.times[rows]) * self.weight[place])])
        self.held[self.place[own]] = 0
        shared = sums[cuts[1:]] - sums[cuts[:-1]]
        return shared / np.maximum(self.total[i] + self.total[others] - shared, 1e-300)


def merged(labels: DataFrame, added: DataFrame) -> DataFrame:
    """``labels`` after more edges: only the components that these touch are looked at."""
    if added.isEmpty():
        return labels
    l_a, l_b = (labels.select(F.col("node").alias(c), F.col("label").alias(f"l_{c}")) for c in "ab")
    ends = added.join(l_a, "a", "left").join(l_b, "b", "left").select("a", "b", F.coalesce("l_a", "a").alias("l_a"), F.coalesce("l_b", "b").alias("l_b"))
    ends = materialise(ends, "cc-ends")
    joined = components(ends.where(F.col("l_a") != F.col("l_b")).select(F.col("l_a").alias("a"), F.col("l_b").alias("b")))
    news = ends.select(F.col("a").alias("node"), F.col("l_a").alias("label")).unionByName(ends.select(F.col("b").alias("node"), F.col("l_b").alias("label"))).distinct()
    known = labels.unionByName(news.join(labels, "node", "left_anti"))
    final = joined.select(F.col("node").alias("label"), F.col("label").alias("to"))
    return materialise(known.join(broadcast_if_small(final), "label", "left").select("node", F.coalesce("to", "label").alias("label")), "cc-merged")


def classes(docs: DataFrame, least: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Rows ``doc_id``, ``node``, ``sig`` of ``docs``, and per node of a component its ``label``."""
    weights = sketch_of(docs)
    rows = materialise(signatures(docs, weights), "near-signatures")
    texts = materialise(rows.groupBy("node").agg(F.first("sig").alias("sig")), "near-nodes")
    pairs, members = first_pairs(texts)
    tried = materialise(agreeing(pairs, texts), "near-pairs")
    ends = tried.select(F.col("a").alias("node")).unionByName(tried.select(F.col("b").alias("node")))
    labels = components(materialise(verified(tried, texts_of(docs, ends), weights, least), "near-edges"))
    held = mixed_members(members, labels)
    if not held.isEmpty():
        links = linked(held, texts.select("node", "sig"), shingle_lists(texts_of(docs, held)), weights, least)
        labels = merged(labels, materialise(links, "near-links"))
    return rows, labels


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``doc_id``, ``class_id``, ``class_size`` (rows) of each row."""
    rows, by_class = _classed(docs, least)
    out = rows.alias("r").join(by_class.alias("c"), "node")
    return out.select("r.doc_id", "c.class_id", "c.class_size")


def _classed(docs: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Rows ``doc_id``, ``node``, ``sig``; per node ``class_id``, ``kept_node``, ``class_size``."""
    mark = begin()
    rows, labels = classes(docs, least)
    per_node = rows.groupBy("node").agg(F.min(F.struct("doc_id")).alias("low"), F.count(F.lit(1)).alias("n"))
    labelled = materialise(per_node.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), F.col("low.doc_id").alias("low"), "n"), "near-per-node")
    per_class = labelled.groupBy("label").agg(F.min(F.struct("low", "node")).alias("best"), F.sum("n").alias("class_size"))
    per_class = materialise(per_class.select("label", F.col("best.low").alias("class_id"), F.col("best.node").alias("kept_node"), "class_size"), "near-per-class")
    by_node = materialise(labelled.join(per_class, "label").select("node", "class_id", "kept_node", "class_size"), "near-by-node")
    settle(docs.sparkSession, mark, rows, by_node)
    return rows, by_node


def deduplicate(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row of each class: the row with the smallest ``doc_id`` (of several, the one whose content hashes lowest)."""
    rows, by_node = _classed(docs, least)
    # most texts stand alone and need no rule
    rules = by_node.where(F.col("class_size") > 1).select(F.col("node").alias("r_node"), (F.col("node") == F.col("kept_node")).alias("r_kept"), F.col("class_id").alias("r_id"))
    rules = broadcast_if_small(materialise(rules, "near-rules"))
    twice = rows.groupBy("node", "doc_id").count().where(F.col("count") > 1)
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), node_of(F.col("text")).alias("node"), F.col("doc_id").cast("long").alias("id"))
    out = keyed.join(rules, F.col("node") == F.col("r_node"), "left").where(F.col("r_kept").isNull() | (F.col("r_kept") & F.col("id").eqNullSafe(F.col("r_id"))))
    if not twice.isEmpty():
        out = out.groupBy("node", "id").agg(F.min_by("doc", F.xxhash64(F.to_json("doc"))).alias("doc"))
    return out.select("doc.*")
