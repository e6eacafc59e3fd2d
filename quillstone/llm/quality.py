"""Quality scores by regularised quadratic discriminant analysis.

Method: each text becomes a vector of transformed statistics (shares of
character classes and of their neighbourhoods, word and line statistics).
Per label the mean and the shrunk covariance are estimated; a text's score is
the logistic of the difference of the two Gaussian log densities, computed as
Mahalanobis distances with the Cholesky factors that the model keeps.  The
difference is divided by ``TEMPERATURE``: statistics of one text depend on each
other more than shrunk covariances say, so densities are too sure.

At scale: one pass computes the vectors; the model needs only, per label,
count, sums and sums of products, added map-side first.  All labelled rows
that may be learned from are used.  The model (two factors) is what is
broadcast.  :func:`keep_good` computes vectors of the labelled rows alone where
their ids are few enough to be broadcast, and else of all rows, since texts
are never shuffled.

Defined results: a null text counts as empty and is scored as such; labels
that are null or neither 0 nor 1 are not learned from; without rows of both
labels every score is the share of label 1, or 0.5 without labels; repeated
rows each give a row; an empty table gives no rows; other columns are not
read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .common import BROADCAST_ROWS, begin, free_name, id_crc, materialise, pieces, settle

SHRINKAGE = 0.15
TEMPERATURE = 4.0
#: Words' worth of the mean text that is mixed into every text's statistics: shares of a few words say little.
MEAN_WORDS = 12.0
#: Classes of bytes: lower-case and non-ASCII letters, capitals, digits, blanks, line ends, sentence marks, other signs.
_CLASS = np.full(256, 6, dtype=np.int64)
_CLASS[128:] = 0
_CLASS[97:123] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[0, 9, 11, 12, 13, 32]] = 3
_CLASS[10] = 4
_CLASS[[ord(c) for c in ".,;:?!'\"()-"]] = 5
FEATURES = (
    "letters", "capitals", "digits", "blanks", "marks", "signs", "sign_after_letter", "sign_alone", "mark_after_mark",
    "word_length", "word_length_spread", "distinct_words", "top_word", "repeated_runs", "distinct_lines", "line_words", "size",
)


def statistics(texts: list[str]) -> np.ndarray:
    """One row of ``FEATURES`` for each text."""
    out = np.zeros((len(texts), len(FEATURES)))
    for a, b in textvec.slices(texts):
        part = texts[a:b]
        hashes, at, lengths = textvec.words(part, with_lengths=True)
        runs, run_at = textvec.shingles(part, 3)
        for i, text in enumerate(part):
            cls = _CLASS[np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)]
            n = len(cls)
            if not n:
                continue
            pairs = np.bincount(cls[:-1] * 7 + cls[1:], minlength=49).reshape(7, 7)
            single = np.bincount(cls, minlength=7) / n
            letters = single[0] + single[1]
            own, size = hashes[at[i] : at[i + 1]], lengths[at[i] : at[i + 1]]
            run = runs[run_at[i] : run_at[i + 1]]
            many = max(1, len(own))
            _, counts = np.unique(own, return_counts=True) if len(own) else (None, np.ones(1))
            lines = [x for x in text.split("\n") if x.strip()]
            mean = size.mean() if len(size) else 0.0
            out[a + i] = (
                letters,
                np.sqrt(single[1] / max(letters, 1e-9)),
                np.sqrt(single[2]),
                single[3] + single[4],
                np.sqrt(single[5]),
                np.sqrt(single[6]),
                np.sqrt(pairs[:2, 6].sum() / n),
                np.sqrt(pairs[3:5, 6].sum() / n),
                np.sqrt(pairs[5:, 5:].sum() / n),
                np.log1p(mean),
                np.log1p(size.std()) if len(size) else 0.0,
                np.log1p(len(counts)) / np.log1p(many),
                np.sqrt((counts.max() - 1) / many),
                np.sqrt(1.0 - len(np.unique(run)) / max(1, len(run))) if len(run) else 0.0,
                len(set(lines)) / len(lines) if lines else 1.0,
                np.log1p(many / max(1, len(lines))),
                np.log1p(many) / 10.0,
            )
    return out


def steadied(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Statistics drawn towards the mean, the more so the fewer words a text has."""
    words = np.expm1(10.0 * x[:, -1:])
    out = mean + (x - mean) * (words / (words + MEAN_WORDS))
    out[:, -1] = x[:, -1]
    return out


@dataclass
class Model:
    """The mean that statistics are drawn to, scale and shift; per label: log prior, mean, Cholesky factor's inverse, half the log determinant, in scaled features."""

    mean: np.ndarray
    scale: np.ndarray
    shift: np.ndarray
    prior: float
    parts: list | None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.parts is None:
            return np.full(len(x), self.prior)
        z = (steadied(x, self.mean) - self.shift) / self.scale
        log = []
        for mean, inverse, half_det in self.parts:
            d = (z - mean) @ inverse.T
            log.append(-0.5 * (d * d).sum(axis=1) - half_det)
        gap = log[1] - log[0] + np.log(self.prior / (1 - self.prior))
        return 1.0 / (1.0 + np.exp(-np.clip(gap / TEMPERATURE, -30, 30)))


def features(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``x`` of each row, written once."""

    def run(batches):
        for batch in pieces(batches):
            x = statistics([t or "" for t in batch.column(1).to_pylist()])
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32()), pa.array(x.reshape(-1), pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), flat], names=["doc_id", "x"])

    return materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, x array<double>"), "quality-features")


def usable(labels: DataFrame, held_out_mod: int = 3, held_out_rest: int = 1) -> DataFrame:
    """``doc_id``, ``quality`` of the labels that may be learned from."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    return own.where(F.col("quality").isin(0, 1) & (id_crc(F.col("doc_id"), held_out_mod) != held_out_rest))


def fit(rows: DataFrame, labels: DataFrame, shrinkage: float = SHRINKAGE) -> Model:
    """Learn from the rows of ``features`` that ``labels``, those of :func:`usable`, name."""
    mark, d = begin(), len(FEATURES)
    known = materialise(rows.join(labels, "doc_id").select("quality", "x"), "quality-known")
    mean = np.array([v if v is not None else 0.0 for v in known.agg(*[F.avg(F.get("x", F.lit(i))).alias(f"m{i}") for i in range(d)]).first()])
    shared = rows.sparkSession.sparkContext.broadcast(mean)

    def add(batches):
        sums = np.zeros((2, 1 + d + d * d))
        for batch in pieces(batches):
            label = np.asarray(batch.column(0))
            x = steadied(np.asarray(batch.column(1).flatten(), dtype=np.float64).reshape(-1, d), shared.value)
            for k in (0, 1):
                own = x[label == k]
                sums[k] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).reshape(-1)])
        at = np.arange(sums.size)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums.reshape(-1), pa.float64())], names=["place", "value"])

    sums = known.mapInArrow(add, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()  # 2 * (1 + d + d * d) rows
    settle(rows.sparkSession, mark)
    got = np.zeros(2 * (1 + d + d * d))
    for place, value in sums:
        got[place] = value
    got = got.reshape(2, -1)
    n = got[:, 0]
    prior = float((n[1] + 1) / (n.sum() + 2)) if n.sum() else 0.5
    if n.min() < 2:
        return Model(mean, np.ones(d), np.zeros(d), prior, None)
    total = got.sum(axis=0)
    shift = total[1 : 1 + d] / total[0]
    means = got[:, 1 : 1 + d] / n[:, None]
    covs = got[:, 1 + d :].reshape(2, d, d) / n[:, None, None] - np.einsum("ki,kj->kij", means, means)
    scale = np.sqrt(np.maximum(np.einsum("k,kii->i", n / n.sum(), covs), 1e-8))
    parts = []
    for k in (0, 1):
        cov = covs[k] / np.outer(scale, scale)
        cov = (1 - shrinkage) * cov + shrinkage * np.eye(d) * max(np.trace(cov) / d, 1e-3)
        lower = np.linalg.cholesky(cov)
        parts.append(((means[k] - shift) / scale, np.linalg.inv(lower), float(np.log(np.diag(lower)).sum())))
    return Model(mean, scale, shift, prior, parts)


def score(rows: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``score``, ``predicted`` for each row of ``features``."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    d = len(FEATURES)

    def run(batches):
        for batch in pieces(batches):
            x = np.asarray(batch.column(1).flatten(), dtype=np.float64).reshape(-1, d)
            s = shared.value.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    out = materialise(rows.mapInArrow(run, "doc_id long, score double, predicted int"), "quality-scores")
    return out


def _held_out(scored: DataFrame, held_out_mod: int = 3, held_out_rest: int = 1) -> DataFrame:
    return scored.select("doc_id", (id_crc(F.col("doc_id"), held_out_mod) == held_out_rest).alias("held_out"), "score", "predicted")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    mark = begin()
    rows = features(docs)
    scored = score(rows, fit(rows, usable(labels)))
    settle(docs.sparkSession, mark, scored)
    return _held_out(scored)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject."""
    mark = begin()
    known = materialise(usable(labels), "quality-labels")
    few = known.count() <= BROADCAST_ROWS
    name = free_name(docs.columns, "named")
    named = docs.join(F.broadcast(known.select(F.col("doc_id").alias(name)).distinct()), F.col("doc_id").cast("long") == F.col(name), "left_semi") if few else docs
    model = fit(features(named), known)
    settle(docs.sparkSession, mark)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def good(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            yield pd.Series(shared.value.score(statistics([t or "" for t in series.tolist()])) >= 0.5, dtype=bool)

    return materialise(docs.where(good("text")), "good-documents")
