"""Token ids in Parquet files that can be read by column, by row group and by page.

A file holds a range of documents in ascending doc_id order: doc_id, shard, start
(ids of the shard's earlier documents), n_tokens and the ids as a list. Ids are
dictionary-encoded, the other columns delta-encoded; row groups and pages have
set sizes, and the page index lets a filter on doc_id skip pages. Readers that
need no ids never touch their column.

Defined cases: a null text is empty and still has its end id; a null doc_id sorts
first; rows with equal doc_id follow each other, ordered by text; an empty table
gives files without rows; other columns of the input are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from packetcheck.llm.common import slices
from packetcheck.llm.tokens import encoder

END_ID = 2
LAYOUT = {
    "compression": "zstd",
    "parquet.compression.codec.zstd.level": "1",
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#start": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "1000",
}


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, shards: int | None = None) -> None:
    """Encode all documents and write them as ``shards`` ordered files."""
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer, keeps_space=True)
        shard, total = TaskContext.get().partitionId(), 0
        for batch in slices(batches, "text"):
            ids, at = coder.encode(batch.column("text"))
            n = np.diff(at) + 1
            with_end = np.insert(ids, at[1:], end_id).astype("<i4")
            ends = np.r_[0, np.cumsum(n)]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(np.full(len(n), shard, dtype=np.int32)), pa.array(total + ends[:-1]),
                pa.array(n), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(with_end)),
            ], ["doc_id", "shard", "start", "n_tokens", "ids"])
            total += int(ends[-1])

    ordered = docs.select("doc_id", "text").repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    tokens = ordered.mapInArrow(encode, f"doc_id {kind}, shard int, start long, n_tokens long, ids array<int>")
    tokens.write.options(**LAYOUT).parquet(path)


def read(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """The stored rows, only the named columns."""
    rows = spark.read.parquet(path)
    return rows.select(*columns) if columns else rows


def index(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: shard, and ``base``, the ids of all earlier files."""
    totals = read(spark, path, "shard", "n_tokens").groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Per stored document: doc_id, start over all files, n_tokens, crc32 of its ids."""
    rows = read(spark, path)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            at = np.asarray(lists.offsets)
            ids = np.asarray(lists.values).astype("<u4")
            crc = [zlib.crc32(ids[at[k]:at[k + 1]].tobytes()) for k in range(len(lists))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(x) for x in ("doc_id", "shard", "start", "n_tokens")), pa.array(crc, pa.int64())],
                ["doc_id", "shard", "start", "n_tokens", "ids_crc32"])

    own = rows.mapInArrow(digest, f"doc_id {kind}, shard int, start long, n_tokens long, ids_crc32 long")
    return own.join(index(spark, path), "shard").select(
        "doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")
