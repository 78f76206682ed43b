"""Shared pieces: reading tables, walking Arrow batches, connected components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetcheck.session import BATCH_BYTES, stored, tuned

SLICE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tuned(spark, BATCH_BYTES).read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of a text column.

    A batch always has a row; one very long text makes a batch of its own.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.binary_length(batch.column(column)).fill_null(0)).astype(np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def as_row(df: DataFrame) -> Column:
    """All columns of a table as one struct column ``row``."""
    return F.struct(*(F.col("`" + x.replace("`", "``") + "`") for x in df.columns)).alias("row")


def strings(array: pa.Array) -> list[str]:
    """Texts with nulls as empty."""
    return array.fill_null("").to_pylist()


def components(edges: DataFrame, purpose: str) -> DataFrame:
    """Smallest node each node is connected to.

    ``edges`` has bigint columns a and b; the result has node and component for
    every node of an edge between different nodes. Alternates large-star and
    small-star steps; both are aggregates that combine before the shuffle and
    joins on a node, and every step is a written table, so a lost executor
    repeats one step at most. Null ends are ignored.
    """
    now = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        purpose,
    )
    seen = None
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.where("a <> b").distinct(), purpose)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")),
        )).alias("e")).select("e.*")
        now = stored(small.where("a <> b").distinct(), purpose)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        seen = mark


class Forest:
    """Links between the rows of one task, kept as a spanning forest."""

    def __init__(self, n: int):
        self.root = np.arange(n, dtype=np.int64)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        """Join the trees of i[k] and j[k]; the smaller row is the root."""
        while len(i):
            a, b = self.root[i], self.root[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up
