"""Quality classifier: regularised quadratic discriminant over transformed text statistics.

Thirteen statistics of the whole text (length, word length, shares of symbols, capitals,
digits, marks, other scripts, repeated words, lines and n-grams) are transformed to be nearly
normal: logarithms of counts, square roots of shares. Each class has its mean and a covariance
shrunk towards the pooled one and towards a multiple of the identity. A text's score is the
difference of the two log-densities, from Mahalanobis lengths under Cholesky factors that are
computed once and cached.

Sums and cross products of all learning rows are added up in Spark; what reaches the driver is
one row of sums for each class and pair of statistics, a number that does not grow with the
data. Identifiers, language, source and labels are never inputs of a score.

Defined cases: a null text is empty; empty texts get a score like any other; a null doc_id is
held out and never learnt from; conflicting labels of a document both count; labels other than
0 and 1 are ignored; where a class has no learning rows every score is 0.5; repeated rows are
scored each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytesets import U64, Words, counted, mix, slices, utf8
from .common import map_arrow, stage, table, text_or_empty
from .quality_rules import measure

POOL_SHRINKAGE, IDENTITY_SHRINKAGE = 0.5, 0.1
FEATURES = ["words", "word_chars", "symbols", "capitals", "digits", "marks", "shouts", "beyond_ascii", "lines", "repeated_words", "repeated_lines", "in_repeated_3grams", "in_repeated_5grams"]


def _class_of(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


CAPITALS, DIGITS = _class_of(bytes(range(65, 91))), _class_of(bytes(range(48, 58)))
MARKS, SHOUTS, NEWLINES, BEYOND = _class_of(b".,;:?\"'()-"), _class_of(b"!"), _class_of(b"\n"), _class_of(bytes(range(128, 256)))


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of transformed statistics for each text between neighbouring offsets."""
    m = measure(data, off)
    n, chars, size = np.maximum(m["n_words"], 1), np.maximum(m["word_chars"], 1), np.maximum(np.diff(off), 1)
    count = lambda members: counted(members, data, off)

    words = Words(data, off)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(words.row))
    key = np.sort((mix(words.hashes(lower=True)) >> U64(20)) | (doc.astype(U64) << U64(44)))
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    distinct = np.bincount((key[fresh] >> U64(44)).astype(np.int64), minlength=len(off) - 1)
    return np.stack(
        [
            np.log1p(m["n_words"]), np.log(chars / n), np.sqrt(m["n_symbols"] / size), np.sqrt(count(CAPITALS) / size), np.sqrt(count(DIGITS) / size),
            np.sqrt(count(MARKS) / size), np.sqrt(count(SHOUTS) / size), np.sqrt(count(BEYOND) / size), np.log1p(count(NEWLINES)),
            np.sqrt(np.maximum(0, 1 - distinct / n) * (m["n_words"] > 0)), np.sqrt(m["dup_line_chars"] / chars), np.sqrt(m["n_repeat_words"] / n), np.sqrt(m["dup5_chars"] / chars),
        ],
        axis=1,
    )


def with_features(docs: DataFrame) -> DataFrame:
    """doc_id and x, the array of statistics, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in _scanned(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), _lists(x)], names=["doc_id", "x"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")), run, "doc_id long, x array<double>")


def _scanned(batch: pa.RecordBatch, at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of a batch, whose texts are column at, and their statistics."""
    data, off = utf8(batch.column(at))
    for i, j in slices(off):
        yield batch.slice(i, j - i), features(data[off[i] : off[j]], off[i : j + 1] - off[i])


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)), pa.array(x.ravel()))


@dataclass
class Discriminant:
    """Per class 0 and 1: prior, mean and regularised covariance of standardised statistics."""

    shift: np.ndarray
    scale: np.ndarray
    prior: np.ndarray
    mean: np.ndarray
    cov: np.ndarray

    @cached_property
    def factors(self) -> list[tuple[np.ndarray, float]]:
        """The inverse Cholesky factor and half the log-determinant of each class."""
        out = []
        for c in self.cov:
            lower = np.linalg.cholesky(c)
            out.append((np.linalg.inv(lower), float(np.log(np.diag(lower)).sum())))
        return out

    def difference(self, x: np.ndarray) -> np.ndarray:
        """log p(1, x) - log p(0, x)."""
        z = (x - self.shift) / self.scale
        density = []
        for k in (0, 1):
            inverse, half = self.factors[k]
            density.append(np.log(self.prior[k]) - half - 0.5 * (((z - self.mean[k]) @ inverse.T) ** 2).sum(1))
        return density[1] - density[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        """In (0, 1), 0.5 where both densities are equal; asinh keeps far scores apart."""
        return 1 / (1 + np.exp(-np.arcsinh(self.difference(x))))


def moments(labelled: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Row count, sums and cross products of x for each label, added up in Spark."""
    d = len(FEATURES) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, d, d))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column("x").flatten()).reshape(batch.num_rows, d - 1)
            x = np.hstack([np.ones((len(x), 1)), x])
            y = np.asarray(batch.column("label"))
            for k in (0, 1):
                total[k] += x[y == k].T @ x[y == k]
        label, place = np.divmod(np.arange(2 * d * d), d * d)
        yield pa.RecordBatch.from_arrays([pa.array(label.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(total.ravel())], names=["label", "place", "value"])

    summed = map_arrow(labelled.select("x", "label"), run, "label int, place int, value double").groupBy("label", "place").agg(F.sum("value").alias("value"))
    out = np.zeros((2, d * d))
    for r in summed.collect():  # 2 (d + 1)^2 rows at any size of input
        out[r.label, r.place] = r.value
    out = out.reshape(2, d, d)
    return {k: (out[k, 0, 0], out[k, 0, 1:], out[k, 1:, 1:]) for k in (0, 1)}


def fit(stats: dict[int, tuple[float, np.ndarray, np.ndarray]], pool: float = POOL_SHRINKAGE, identity: float = IDENTITY_SHRINKAGE) -> Discriminant | None:
    """The discriminant of these moments; None where a class has no rows."""
    n = np.array([stats[k][0] for k in (0, 1)])
    if (n == 0).any():
        return None
    total = n.sum()
    shift = (stats[0][1] + stats[1][1]) / total
    second = np.diag(stats[0][2] + stats[1][2]) / total
    scale = np.sqrt(np.maximum(second - shift**2, 0)) + 1e-6
    mean, cov = [], []
    for k in (0, 1):
        m = stats[k][1] / n[k]
        mean.append((m - shift) / scale)
        cov.append((stats[k][2] / n[k] - np.outer(m, m)) / np.outer(scale, scale))
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / total
    shrunk = []
    for k in (0, 1):
        c = (1 - pool) * cov[k] + pool * pooled
        spread = np.trace(c) / len(c)
        shrunk.append((1 - identity) * c + (identity * spread + 1e-9) * np.eye(len(c)))
    return Discriminant(shift, scale, n / total, np.array(mean), np.array(shrunk))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def train(stats: DataFrame, labels: DataFrame, label: str = "quality") -> Discriminant | None:
    """Learns from all labelled rows that are not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter("label in (0, 1)").filter(~held_out(F.col("doc_id")))
    model = fit(moments(stats.join(known, "doc_id")))
    if model:
        model.factors  # noqa: B018  (computed here, so that tasks receive them)
    return model


def scored(stats: DataFrame, model: Discriminant | None) -> DataFrame:
    """doc_id and score of every row of with_features()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column("x").flatten()).reshape(batch.num_rows, len(FEATURES))
            score = model.score(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    return map_arrow(stats, run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs."""
    stats = stage(with_features(docs), "features")
    result = scored(stats, train(stats, labels))
    return result.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def accept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that are not predicted to be of low quality.

    Rows are written once with their statistics, which the classifier learns from and scores.
    """
    own = "x"
    while own in docs.columns:
        own += "_"
    at, schema = docs.columns.index("text"), docs.schema

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in _scanned(batch, at):
                yield part.append_column(own, _lists(x))

    wide = stage(map_arrow(docs, add, docs.select("*", F.expr("cast(array() as array<double>)").alias(own)).schema), "features")
    model = train(wide.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(own).alias("x")), labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(own).flatten()).reshape(batch.num_rows, len(FEATURES))
            keep = model.score(x) >= 0.5 if model else np.ones(len(x), bool)
            yield batch.select(schema.names).filter(pa.array(keep))

    return map_arrow(wide, run, schema)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
