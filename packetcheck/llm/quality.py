"""Quality of documents by a regularised quadratic discriminant.

Each text becomes a vector of transformed statistics (shares of kinds of characters,
word lengths, repetition of words and lines, size). For each label the mean and the
covariance of the learning rows are summed up by Spark over all of them; the
covariance is shrunk toward the pooled one and toward a multiple of the identity, and
its Cholesky factor is kept inverted. The score is the logistic function of the
difference of the two log densities (Mahalanobis distance and determinant) and of the
labels' shares.

Defined cases: null and empty texts have the statistics of an empty text and are
scored; a label that is null, or differs between rows of one doc_id, isn't learned
from; without learning rows every score is 0.5, with one label only it is that label;
rows with equal doc_id are scored each; an empty table gives an empty result; other
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetcheck.llm.common import slices, strings
from packetcheck.session import stored

#: Shares of the pooled covariance and of the identity in each label's covariance.
TO_POOLED = 0.1
TO_IDENTITY = 0.01
THRESHOLD = 0.3

_KINDS = 7


def _kind_table() -> np.ndarray:
    """Kind of each byte: lower case, capital, digit, white space, usual marks, other marks, part of a wider character."""
    out = np.full(256, 5, dtype=np.uint8)
    out[97:123], out[65:91], out[48:58], out[128:] = 0, 1, 2, 6
    out[[9, 10, 11, 12, 13, 32]] = 3
    out[list(b".,;:'\"-()?")] = 4
    return out


_TABLE = _kind_table()
NAMES = ("bytes", "words", "word_bytes", "capitals", "digits", "spaces", "marks", "odd_marks", "wide", "different_words", "different_lines", "top_word", "line_words", "word_bytes_spread")


def statistics(texts: list[str]) -> np.ndarray:
    """A row of ``NAMES`` per text."""
    raw = [x.encode() for x in texts]
    sizes = np.array([len(x) for x in raw], dtype=np.int64)
    kinds = _TABLE[np.frombuffer(b"".join(raw), dtype=np.uint8)]
    full = np.flatnonzero(sizes)
    counts = np.zeros((len(raw), _KINDS))
    if len(full):
        starts = (np.cumsum(sizes) - sizes)[full]
        for k in range(_KINDS):
            counts[full, k] = np.add.reduceat(kinds == k, starts, dtype=np.int64)
    rest = np.empty((len(raw), 6))
    for row, text in enumerate(texts):
        words = text.split()
        n = len(words)
        lines = text.split("\n")
        if not n:
            rest[row] = 0, 1, 1, 0, 0, 0
            continue
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
        often: dict[str, int] = {}
        for x in words:
            often[x] = often.get(x, 0) + 1
        rest[row] = n, len(often) / n, len(set(lines)) / len(lines), max(often.values()) / n, n / len(lines), lengths.std()
    letters = counts[:, 0] + counts[:, 1] + counts[:, 6]
    total = np.maximum(sizes, 1)

    def odds(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
        return np.log((part + 0.5) / (np.maximum(whole - part, 0) + 0.5))

    n = rest[:, 0]
    return np.column_stack([
        np.log1p(sizes), np.log1p(n), np.log((letters + 1) / (n + 1)), odds(counts[:, 1], letters), odds(counts[:, 2], total), odds(counts[:, 3], total),
        odds(counts[:, 4], total), odds(counts[:, 5], total), odds(counts[:, 6], total),
        rest[:, 1], rest[:, 2], np.log(rest[:, 3] + 1e-3), np.log1p(rest[:, 4]), np.log1p(rest[:, 5]),
    ])


class Discriminant:
    """Densities of both labels from their counts, sums and sums of products."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], to_pooled: float = TO_POOLED, to_identity: float = TO_IDENTITY):
        self.labels = sorted(k for k, m in moments.items() if m[0] > 0)
        total = sum(moments[k][0] for k in self.labels)
        own = {}
        for k in self.labels:
            n, sums, products = moments[k]
            mean = sums / n
            own[k] = n, mean, products / n - np.outer(mean, mean)
        self.parts = {}
        pooled = sum(n * c for n, _, c in own.values()) / total if own else None
        for k, (n, mean, cov) in own.items():
            d = len(mean)
            cov = (1 - to_pooled) * cov + to_pooled * pooled
            cov = (1 - to_identity) * cov + to_identity * max(np.trace(cov) / d, 1e-6) * np.eye(d)
            factor = np.linalg.cholesky(cov)
            self.parts[k] = mean, np.linalg.inv(factor), np.log(np.diag(factor)).sum(), np.log(n / total)

    def score(self, rows: np.ndarray) -> np.ndarray:
        if len(self.labels) < 2:
            return np.full(len(rows), float(self.labels[0]) if self.labels else 0.5)
        density = {}
        for k, (mean, inverse, log_root, log_share) in self.parts.items():
            density[k] = log_share - log_root - 0.5 * (((rows - mean) @ inverse.T) ** 2).sum(axis=1)
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics x of every text (written)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = statistics(strings(batch.column("text")))
            at = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(at), pa.array(rows.ravel()))], ["doc_id", "x"])

    return stored(docs.select("doc_id", "text").mapInArrow(each, f"doc_id {kind}, x array<double>"), "statistics")


def fit(measured: DataFrame, labels: DataFrame) -> Discriminant:
    """Learn from the labelled rows that are not held out, all of them."""
    known = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("other")) \
        .where("label = other").select("doc_id", F.col("label").cast("int").alias("label"))
    rows = measured.where(~is_held_out(F.col("doc_id"))).join(known, "doc_id").select("label", "x")
    d = len(NAMES)

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: np.zeros(1 + d + d * d) for k in (0, 1)}
        for batch in batches:
            x = np.asarray(batch.column("x").flatten()).reshape(-1, d)
            label = np.asarray(batch.column("label"))
            for k, out in total.items():
                own = x[label == k]
                out += np.r_[len(own), own.sum(axis=0), (own.T @ own).ravel()]
        for k, out in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(out), k, np.int32)), pa.array(np.arange(len(out), dtype=np.int32)), pa.array(out)], ["label", "k", "v"])

    added = rows.mapInArrow(sums, "label int, k int, v double").groupBy("label", "k").agg(F.sum("v").alias("v")).collect()
    vectors = {k: np.zeros(1 + d + d * d) for k in (0, 1)}
    for r in added:
        vectors[r["label"]][r["k"]] = r["v"]
    return Discriminant({k: (v[0], v[1:1 + d], v[1 + d:].reshape(d, d)) for k, v in vectors.items()})


def apply(measured: DataFrame, model: Discriminant) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    kind = measured.schema["doc_id"].dataType.simpleString()

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column("x").flatten()).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    scored = measured.mapInArrow(each, f"doc_id {kind}, score double")
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document's score; see the module."""
    measured = measure(docs)
    return apply(measured, fit(measured, labels))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are predicted good, in one pass with the model at hand."""
    model = fit(measure(docs), labels)

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            good = model.score(statistics(strings(batch.column("text")))) >= THRESHOLD
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(each, docs.schema)
