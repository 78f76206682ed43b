"""Live counts of log lines by class."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from packetcheck.plans.logs import shown_lines


def stream_class_counts(lines: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Keep ``class, lines`` up to date in ``out`` for a stream of log lines.

    The state is one counter per class. Each batch rewrites the small result,
    so a repeated batch leaves the same table.
    """
    counts = shown_lines(lines).groupBy("class").agg(F.count("*").alias("lines"))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    return (
        counts.writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
