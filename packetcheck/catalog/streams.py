"""Queries that run a stream over the given tables to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from packetcheck.catalog.comparing import FAILURES, typed_sides
from packetcheck.catalog.derived import SQL, Tables
from packetcheck.catalog.keeping import _CLASSES
from packetcheck.catalog.registry import query
from packetcheck.operators.rules import packet_rules, reconcile
from packetcheck.session import shared_dir
from packetcheck.streaming.incremental import current_verdicts, stream_reconcile
from packetcheck.streaming.logs import stream_class_counts


def table_stream(t: Tables, name: str) -> DataFrame:
    """A given table as a file stream; the pattern makes one file a valid source."""
    schema = getattr(t, name).schema
    return t.spark.readStream.schema(schema).parquet(f"{t.sf_dir}/{name[:-1]}[{name[-1]}].parquet")


@query("stream_log_classes", f"""
    with {_CLASSES} select class, count(*) as lines from classed group by class
""")
def stream_log_classes(t: Tables) -> DataFrame:
    lines = t.spark.sql(SQL["runtime_logs"], events=table_stream(t, "events"))
    out = shared_dir(t.spark, "log-classes")
    stream_class_counts(lines, out, shared_dir(t.spark, "checkpoint")).awaitTermination()
    return t.spark.read.parquet(out)


@query("stream_verdicts", f"""
    with {FAILURES}
    select s.project_name, count(f.ord) = 0 as passed, count(f.ord) as failures
    from sides s left join f on f.project_name = s.project_name group by s.project_name
""")
def stream_verdicts(t: Tables) -> DataFrame:
    key = F.concat(F.lit("QXA-"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"), F.lit("-01"))
    changes = table_stream(t, "orders").select(key.alias("project_name"))
    sides = t.sides

    def judge_keys(keys: DataFrame) -> DataFrame:
        rows = typed_sides(sides.join(keys, "project_name", "left_semi"))
        return reconcile(rows, packet_rules()).select(
            "project_name", "passed", F.size("failures").cast("bigint").alias("failures")
        )

    out = shared_dir(t.spark, "verdicts")
    stream_reconcile(changes, judge_keys, out, shared_dir(t.spark, "checkpoint")).awaitTermination()
    return current_verdicts(t.spark, out)
