"""Run logs: appending, classing, filtering and counting lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from packetcheck import vocab
from packetcheck.functions.payload import json_kind, node, parse_object, string_at
from packetcheck.plans.journal import commit, compact, current, write_part
from packetcheck.plans.report import COLUMNS, CONFLICTS

# --- lines ------------------------------------------------------------------


def report_variant(line: Column) -> Column:
    """Report carried by a line; null unless it is valid and has rows."""
    at = F.instr(line, F.lit(vocab.LOG_PREFIX))
    text = F.when(at > 0, F.substr(line, at + len(vocab.LOG_PREFIX)))
    v = parse_object(text)
    return F.when(json_kind(node(v, "$.rows")) == "ARRAY", v)


def shown_lines(lines: DataFrame) -> DataFrame:
    """Lines to show, classed success, failed or system; cache lines are hidden."""
    shown = lines.filter(~F.col("message").contains(vocab.CACHE_TAG))
    v = F.col("report")
    passed = F.coalesce(F.try_variant_get(v, "$.passed", "boolean"), F.lit(False))
    cls = F.when(v.isNull(), "system").when(passed, "success").otherwise("failed")
    return shown.withColumn("report", report_variant(F.col("message"))).withColumn("class", cls)


def filter_lines(lines: DataFrame, *views: str) -> DataFrame:
    """Shown lines of the views success, failed or system; all without any."""
    shown = shown_lines(lines)
    return shown.filter(F.col("class").isin(*views)) if views else shown


def class_counts(lines: DataFrame) -> DataFrame:
    """One row with the number of lines per view."""
    cls = F.col("class")
    return shown_lines(lines).agg(
        F.count("*").alias("all"),
        F.count_if(cls == "success").alias("success"),
        F.count_if(cls == "failed").alias("failed"),
        F.count_if(cls == "system").alias("system"),
    )


def conflict_columns(lines: DataFrame, *keys: str) -> DataFrame:
    """Per report line, which report columns disagree by its result row."""
    reports = shown_lines(lines).filter(F.col("report").isNotNull())
    rows = F.try_variant_get("report", "$.rows", "array<variant>")
    result = F.get(
        F.filter(rows, lambda r: string_at(r, "$.fileName") == vocab.RESULT_ROW), F.lit(0)
    )
    names = dict(COLUMNS)
    flags = [
        F.coalesce(
            string_at(F.col("result"), f"$.{names[key]}") == vocab.BAD_MARK, F.lit(False)
        ).alias(key)
        for key in CONFLICTS
    ]
    return reports.withColumn("result", result).select(*keys, *flags)


def latest_lines(lines: DataFrame, n: int = 500) -> DataFrame:
    """The last ``n`` lines in ascending order."""
    return lines.orderBy(F.desc("id")).limit(n).orderBy("id")


def latest_collection(lines: DataFrame) -> DataFrame:
    """Numbers of the last collection summary line."""
    message = F.col("message")

    def number(group: int) -> Column:
        return F.regexp_extract(message, vocab.COLLECT_SUMMARY, group).cast("bigint")

    last = F.max_by(F.struct(number(1), number(2), number(3)), "id").alias("m")
    names = ["downloaded", "skipped", "errors"]
    return (
        lines.filter(message.rlike(vocab.COLLECT_SUMMARY))
        .agg(last)
        .filter(F.col("m").isNotNull())
        .select(*[F.col(f"m.col{i + 1}").alias(name) for i, name in enumerate(names)])
    )


# --- collection summary -----------------------------------------------------

OUTCOMES = {"downloaded": "已下载: ", "skipped": "已跳过: ", "error": "错误: "}


def collection_lines(outcomes: DataFrame) -> DataFrame:
    """Log lines of a collection run from ``seq, outcome, item``.

    The first line counts, then one line per item by outcome; the items are
    never gathered, ``part`` and ``seq`` give the order.
    """
    prefix = F.create_map(*[x for k, v in OUTCOMES.items() for x in (F.lit(k), F.lit(v))])
    part = F.array_position(F.array(*[F.lit(k) for k in OUTCOMES]), F.col("outcome"))
    items = outcomes.select(
        part.cast("int").alias("part"), "seq",
        F.concat(F.lit(vocab.COLLECT_TAG), prefix[F.col("outcome")], "item").alias("message"),
    )
    counts = outcomes.agg(
        *[F.count_if(F.col("outcome") == k).cast("string").alias(k) for k in OUTCOMES]
    )
    first = counts.select(
        F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("seq"),
        F.concat(
            F.lit(vocab.COLLECT_TAG + "完成: 下载="), "downloaded",
            F.lit(" | 跳过="), "skipped", F.lit(" | 错误="), "error",
        ).alias("message"),
    )
    nothing = counts.filter(" and ".join(f"{k} = '0'" for k in OUTCOMES)).select(
        F.lit(4).alias("part"), F.lit(0).cast("bigint").alias("seq"),
        F.lit(vocab.COLLECT_NOTHING).alias("message"),
    )
    return first.unionByName(items).unionByName(nothing)


# --- stored lines -----------------------------------------------------------


def append_lines(lines: DataFrame, path: str, epoch: int) -> None:
    """Append ``id, bucket, message, created_at`` to the log table."""
    lines.withColumn("epoch", F.lit(epoch)).write.mode("append").partitionBy("epoch").parquet(path)


def clear_lines(spark: SparkSession, path: str, epoch: int) -> None:
    """Start a new epoch; lines of older ones are no longer current."""
    marker = spark.range(1).select(
        F.lit(None).cast("bigint").alias("id"), F.lit("default").alias("bucket"),
        F.lit(None).cast("string").alias("message"),
        F.lit(None).cast("timestamp").alias("created_at"), F.lit(epoch + 1).alias("epoch"),
    )
    marker.write.mode("append").partitionBy("epoch").parquet(path)


LINES = "epoch int, id bigint, bucket string, message string, created_at timestamp"


def write_lines(lines: DataFrame, root: str, run_id: str, epoch: int) -> None:
    """Add ``id, bucket, message, created_at`` of one writer to the log journal; the same id
    again replaces its lines."""
    rows = lines.select(F.lit(epoch).alias("epoch"), "id", "bucket", "message", "created_at")
    write_part(rows, root, "runtime_logs", run_id)
    commit(lines.sparkSession, root, run_id)


def _columns(lines: DataFrame) -> DataFrame:
    return lines.select("epoch", "id", "bucket", "message", "created_at")


def _of_latest_epoch(lines: DataFrame) -> DataFrame:
    """Lines of the latest epoch, its start marker too."""
    return lines.filter(F.col("epoch") == lines.agg(F.max("epoch")).scalar())


def journal_lines(spark: SparkSession, root: str) -> DataFrame:
    """Current lines of the log journal, from the snapshot and what came after it."""
    return current_lines(current(spark, root, "runtime_logs", LINES, _columns))


def compact_lines(spark: SparkSession, root: str) -> int:
    """Fold the log journal into its next snapshot, which holds the latest epoch only."""
    return compact(spark, root, "runtime_logs", LINES, _columns, _of_latest_epoch)


def current_lines(stored: DataFrame) -> DataFrame:
    """Lines of the latest epoch."""
    latest = stored.agg(F.max("epoch")).scalar()
    return stored.filter((F.col("epoch") == latest) & F.col("message").isNotNull())
