"""Language identification by nearest centroid.

Method: a text is the normalised TF-IDF vector of its hashed letter trigrams;
per language several centroids come from spherical clustering; the language of
the centroid with the largest cosine is predicted.  A text whose cosine lies
below what all but ``REJECT`` of the language's texts reach, of texts that took
no part in the clustering, is rejected: too far from every language.  Its
language stays the nearest one, as the column ``rejected`` tells; its score is
its cosine, lowered by the share of that limit that it reaches.

Inverse document frequencies count all texts that may be learned from.
Centroids are fitted on a bounded sample: about ``SAMPLE_PER_LANG`` texts a
language, chosen by a hash of id and text, repeated rows once; the limits of
rejection on a third of it that the centroids do not see.

At scale: two passes over the documents without any shuffle of texts but the
sample's; what is broadcast is ``DIMS`` numbers and ``CLUSTERS`` centroids a
language.

Defined results: a null text and a text without a letter are ``und`` with
score 0; rows with a null ``lang`` are predicted but not learned from; without
anything to learn from all is ``und``; ties go to the language first in
alphabetical order; repeated rows each give a row; an empty table gives no
rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import begin, broadcast_if_small, id_crc, materialise, pieces, settle, small_batches

DIMS = 4096
CLUSTERS = 4
SAMPLE_PER_LANG = 900
#: Share of a language's texts that are rejected.
REJECT = 0.01
_HASH = 1 << 60
UNKNOWN = "und"

#: ASCII letters in lower case; all other ASCII bytes are a word's end.
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def trigram_counts(texts: list[str]) -> np.ndarray:
    """Counts of hashed byte trigrams, ``[texts, DIMS]``; a blank stands at both ends, and trigrams without a letter are left out."""
    out = np.zeros((len(texts), DIMS), dtype=np.float32)
    for i, text in enumerate(texts):
        data = _FOLD[np.frombuffer(b" " + text.encode("utf-8", "surrogatepass") + b" ", dtype=np.uint8)]
        if len(data) < 3:
            continue
        three = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
        code = (three * np.uint32(0x9E3779B1)) >> np.uint32(20)
        code = code[(data[1:-1] != 32) | ((data[:-2] != 32) & (data[2:] != 32))]
        out[i] = np.bincount(code, minlength=DIMS)
    return out


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    x = np.log1p(trigram_counts(texts)) * idf
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


def cluster(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Centroids of unit length by spherical k-means, first centres far apart."""
    rng = np.random.default_rng(seed)
    centres = [x[rng.integers(len(x))]]
    while len(centres) < min(k, len(x)):
        near = np.max(x @ np.stack(centres).T, axis=1)
        weight = np.maximum(1 - near, 0) ** 2
        if not weight.sum():
            break
        centres.append(x[rng.choice(len(x), p=weight / weight.sum())])
    c = np.stack(centres)
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        for j in range(len(c)):
            if (own == j).any():
                s = x[own == j].sum(axis=0)
                c[j] = s / max(np.sqrt((s * s).sum()), 1e-12)
    return c


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each trigram occurs, and how many texts there are."""

    def run(batches):
        total = np.zeros(DIMS + 1, dtype=np.int64)
        for batch in pieces(batches):
            texts = [t or "" for t in batch.column(0).to_pylist()]
            total[DIMS] += len(texts)
            for a in range(0, len(texts), 256):
                total[:DIMS] += (trigram_counts(texts[a : a + 256]) > 0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS + 1), pa.int32()), pa.array(total)], names=["place", "n"])

    got = np.zeros(DIMS + 1, dtype=np.int64)
    with small_batches(docs.sparkSession):
        rows = docs.select("text").mapInArrow(run, "place int, n long").groupBy("place").agg(F.sum("n")).collect()  # DIMS + 1 rows
    for place, n in rows:
        got[place] = n
    return got[:DIMS], int(got[DIMS])


class Model:
    """Languages, inverse document frequencies, centroids, the language of each, least cosines."""

    def __init__(self, idf: np.ndarray, langs: list[str], centres: np.ndarray, owner: np.ndarray, least: np.ndarray) -> None:
        self.idf, self.langs, self.centres, self.owner, self.least = idf, langs, centres, owner, least

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """Language, score and whether it is rejected, of each text."""
        out: list[tuple[str, float, bool]] = []
        for a in range(0, len(texts), 256):
            part = [t or "" for t in texts[a : a + 256]]
            has = [_has_letter(t) for t in part]
            if not self.langs:
                out += [(UNKNOWN, 0.0, True)] * len(part)
                continue
            near = vectors(part, self.idf) @ self.centres.T
            best = np.stack([near[:, self.owner == k].max(axis=1) for k in range(len(self.langs))], axis=1)
            lang = best.argmax(axis=1)
            top = np.clip(best[np.arange(len(part)), lang], 0.0, 1.0)
            limit = self.least[lang]
            top = np.where(top < limit, top * top / np.maximum(limit, 1e-12), top)
            out += [(self.langs[k], float(s), bool(s < self.least[k])) if h else (UNKNOWN, 0.0, True) for k, s, h in zip(lang, top, has)]
        return out


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text[:64])) or any(map(str.isalpha, text[64:]))


def fit(docs: DataFrame) -> Model:
    """Learn from ``text`` and ``lang`` of all rows of ``docs``."""
    spark, mark = docs.sparkSession, begin()
    learned = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    df, n = document_frequencies(learned)
    idf = (np.log((1.0 + n) / (1.0 + df)) + 0.1).astype(np.float32)
    per_lang = materialise(learned.groupBy("lang").count(), "lang-counts")
    limits = broadcast_if_small(per_lang.select(F.col("lang").alias("l"), (F.least(F.lit(1.0), F.lit(float(SAMPLE_PER_LANG)) / F.col("count")) * _HASH).cast("long").alias("count_limit")))
    hashed = learned.select("text", "lang", F.pmod(F.xxhash64("doc_id", "text", F.lit(11)), F.lit(_HASH)).alias("h"))
    drawn = hashed.join(limits, F.col("lang") == F.col("l")).where(F.col("h") < F.col("count_limit"))
    sample = materialise(drawn.groupBy("lang", "h").agg(F.min("text").alias("text")), "lang-sample")
    shared = spark.sparkContext.broadcast(idf)

    def run(group: pa.Table) -> pa.Table:
        texts = [t for _, t in sorted(zip(group.column("h").to_pylist(), group.column("text").to_pylist())) if _has_letter(t)]
        if not texts:
            return pa.table({"lang": pa.array([], pa.string()), "least": pa.array([], pa.float64()), "centre": pa.array([], pa.binary())})
        x = np.concatenate([vectors(texts[a : a + 256], shared.value) for a in range(0, len(texts), 256)])
        apart = len(x) // 3
        c = cluster(x[apart:], CLUSTERS)
        least = float(np.quantile((x[:apart] @ c.T).max(axis=1), REJECT)) if apart else 0.0
        lang = group.column("lang")[0].as_py()
        return pa.table({"lang": [lang] * len(c), "least": [least] * len(c), "centre": [row.astype("<f4").tobytes() for row in c]})

    rows = sorted(map(tuple, sample.groupBy("lang").applyInArrow(run, "lang string, least double, centre binary").collect()))  # CLUSTERS rows a language
    settle(spark, mark)
    langs = sorted({r[0] for r in rows})
    centres = np.stack([np.frombuffer(r[2], "<f4") for r in rows]) if rows else np.zeros((0, DIMS), dtype=np.float32)
    owner = np.array([langs.index(r[0]) for r in rows], dtype=np.int64)
    least = np.array([next(r[1] for r in rows if r[0] == lang) for lang in langs])
    return Model(idf, langs, centres, owner, least)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score``, ``rejected`` of each row, from its text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in pieces(batches):
            got = list(zip(*shared.value.predict(batch.column(1).to_pylist()))) or [()] * 3
            cols = [pa.array(c, t) for c, t in zip(got, (pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "lang_pred", "score", "rejected"])

    return materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean"), "lang-predicted")


def identify(docs: DataFrame, held_out_mod: int = 4, held_out_rest: int = 2) -> DataFrame:
    """Predict all rows with a model of those that are not held out."""
    held_out = id_crc(F.col("doc_id"), held_out_mod) == held_out_rest
    model = fit(docs.where(~held_out))
    out = predict(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
