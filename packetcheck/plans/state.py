"""Run results, success records, ledger and recognition cache as parquet tables.

Tables are append-only. The current state of a key is an aggregate over its
events, so a key with very many events still combines before the shuffle.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from packetcheck import vocab
from packetcheck.plans.journal import commit, compact, current, write_part
from packetcheck.session import stored
from packetcheck.sources.tables import SCHEMAS

EVENTS = "success_events"
PENDING, EXPORTED = "pending", "exported"
MISSING_LEDGER = "missing_workbook"

# --- runs -------------------------------------------------------------------


def save_run(
    results: DataFrame, root: str, run_id: str, created_at: str
) -> None:
    """Write a run's results, then the run itself, as parts of the run.

    Readers join on the runs table, so a half-written run stays invisible; a
    retry overwrites the run's own folders only.
    """
    spark = results.sparkSession
    write_part(
        results.select("item_order", "project_code", "project_name", "passed", "log_json"),
        root, "compare_results", run_id,
    )
    saved = spark.read.parquet(f"{root}/compare_results/run_id={run_id}")
    total = saved.agg(F.count("*").alias("total_count"))
    write_part(
        total.withColumn("created_at", F.to_timestamp(F.lit(created_at))), root, "compare_runs", run_id
    )


def ordered_results(results: DataFrame) -> DataFrame:
    """Add ``item_order``, increasing with the project name (not dense)."""
    return results.orderBy("project_name").withColumn(
        "item_order", F.monotonically_increasing_id()
    )


def latest_run(results: DataFrame, runs: DataFrame) -> DataFrame:
    """Results of the latest completed run."""
    latest = runs.agg(F.max(F.col("run_id").cast("string"))).scalar()
    return results.filter(F.col("run_id").cast("string") == latest)


def latest_failures(results: DataFrame, runs: DataFrame) -> DataFrame:
    """Failed results of the latest run in item order."""
    return latest_run(results, runs).filter(~F.col("passed")).orderBy("item_order", "project_name")


def failed_count(results: DataFrame, runs: DataFrame) -> DataFrame:
    return latest_run(results, runs).agg(F.count_if(~F.col("passed")).alias("failed_count"))


def failure_lines(results: DataFrame, runs: DataFrame) -> DataFrame:
    """Text lines of the failure export."""
    return latest_failures(results, runs).select(
        F.concat(F.lit(vocab.LOG_PREFIX), "log_json").alias("value")
    )


def export_failures(results: DataFrame, runs: DataFrame, path: str) -> None:
    """Write the failure lines as text; part files follow the item order."""
    failure_lines(results, runs).write.mode("overwrite").text(path)


# --- success records --------------------------------------------------------


def success_event(
    project_code: Column, project_name: Column, row: Column, seq: Column, ts: Column
) -> list[Column]:
    """Columns of the event a passed packet adds."""
    return [
        seq.alias("seq"), project_code.alias("project_code"),
        project_name.alias("project_name"), F.to_json(row).alias("row_json"),
        F.lit(PENDING).alias("state"), ts.alias("ts"),
    ]


def add_success_events(verdicts: DataFrame, root: str, run_id: str, ts: str) -> None:
    """Write one event for every passed packet of ``project_code, project_name, passed, row``,
    as the run's part of the events.

    Numbers follow the largest one that is visible and increase with the packet's name.
    """
    spark = verdicts.sparkSession
    passed = ordered_results(verdicts.filter("passed"))
    latest = success_partials(spark, root, without=[run_id]).agg(F.max("seq")).first()[0]
    rows = passed.select(*success_event(
        F.col("project_code"), F.col("project_name"), F.col("row"),
        F.col("item_order") + F.lit(-1 if latest is None else latest).cast("bigint") + 1, F.to_timestamp(F.lit(ts)),
    ))
    write_part(rows, root, EVENTS, run_id)


# Events in the form of a snapshot: what is known of a code from some of its events.


def partial_state(events: DataFrame) -> DataFrame:
    """One row per event in the snapshot's form."""
    pending = F.col("state") == PENDING
    return events.select(
        "project_code", F.when(pending, F.col("seq")).alias("first_seq"),
        F.when(pending, F.col("seq")).alias("pending_seq"),
        F.when(pending, F.struct("project_name", "row_json")).alias("record"),
        "seq", F.col("state").alias("status"), F.when(~pending, F.col("ts")).alias("exported_at"),
    )


def merged_state(partials: DataFrame) -> DataFrame:
    """One row per code, in the same form."""
    return partials.groupBy("project_code").agg(
        F.min("first_seq").alias("first_seq"), F.max("pending_seq").alias("pending_seq"),
        F.max_by("record", "pending_seq").alias("record"), F.max("seq").alias("seq"),
        F.max_by("status", "seq").alias("status"), F.max_by("exported_at", "seq").alias("exported_at"),
    )


def success_partials(spark: SparkSession, root: str, without: list[str] | None = None) -> DataFrame:
    """Snapshot and later events below ``root``, not yet merged."""
    return current(spark, root, EVENTS, SCHEMAS[EVENTS], partial_state, without)


def success_records(spark: SparkSession, root: str, without: list[str] | None = None) -> DataFrame:
    """As ``success_state``, of the events below ``root``: from the snapshot and what came after it."""
    rows = merged_state(success_partials(spark, root, without)).filter(F.col("first_seq").isNotNull())
    return rows.select("project_code", "record.*", "status", "first_seq", "exported_at")


def compact_success(spark: SparkSession, root: str) -> int:
    """Fold the committed events into the next snapshot; returns its version."""
    return compact(spark, root, EVENTS, SCHEMAS[EVENTS], partial_state, merged_state)


def success_state(events: DataFrame) -> DataFrame:
    """Latest state per project code.

    A pending event creates or renews a record, an exported event only marks an
    existing one. A renewed record keeps its first place in the order.
    """
    pending = F.col("state") == PENDING
    pending_seq = F.when(pending, F.col("seq"))
    latest = F.max_by(F.struct("project_name", "row_json"), pending_seq)
    return (
        events.groupBy("project_code")
        .agg(
            F.min(pending_seq).alias("first_seq"),
            latest.alias("record"),
            F.max_by("state", "seq").alias("status"),
            F.max_by(F.when(~pending, F.col("ts")), "seq").alias("exported_at"),
        )
        .filter(F.col("first_seq").isNotNull())
        .select("project_code", "record.*", "status", "first_seq", "exported_at")
    )


def pending_records(state: DataFrame) -> DataFrame:
    return state.filter(F.col("status") == PENDING)


def marked_pending(pending: DataFrame, ledger_codes: DataFrame) -> DataFrame:
    """Add ``appended``: whether a row goes to the ledger or is a duplicate.

    ``pending`` has ``project_code, first_seq``. Of each new code the first row
    is appended; rows without a code are always appended. Codes are reduced to
    one row each before they meet the ledger, and rows find their part by
    (code, sequence), so a frequent code is never gathered.
    """
    known = ledger_codes.select("project_code").filter(F.col("project_code") != "").distinct()
    firsts = (
        pending.filter(F.col("project_code") != "")
        .groupBy("project_code")
        .agg(F.min("first_seq").alias("first_seq"))
        .join(known, "project_code", "left_anti")
    )
    marked = pending.join(
        firsts.withColumn("is_first", F.lit(True)), ["project_code", "first_seq"], "left"
    )
    appended = F.coalesce("is_first", F.lit(False)) | (F.col("project_code") == "")
    return marked.withColumn("appended", appended).drop("is_first")


def ledger_counts(marked: DataFrame) -> DataFrame:
    """Status and counts of an export, from rows with ``appended``."""
    counts = marked.agg(
        F.count("*").alias("pending_count"),
        F.count_if("appended").alias("appended_count"),
        F.count_if(~F.col("appended")).alias("duplicate_count"),
    )
    status = F.when(F.col("pending_count") == 0, "empty").otherwise("exported")
    return counts.select(status.alias("status"), "*")


def ledger_rows(records: DataFrame, headers: list[str]) -> DataFrame:
    """Ledger columns of success records; headers the ledger lacks are dropped."""
    row = F.from_json("row_json", "map<string,string>")
    cells = [F.try_element_at("row", F.lit(h)).alias(h) for h in headers]
    return records.withColumn("row", row).select("first_seq", *cells)


def export_pending(
    spark: SparkSession, root: str, ledger_path: str, batch: str, ts: str
) -> DataFrame:
    """Append pending records to the ledger, then mark them exported.

    Rows are written before the marks: a crash between the two repeats the
    export of this batch, which overwrites its own rows and marks. The ledger is
    parquet partitioned by batch; where there is none, nothing is written and
    the status is ``missing_workbook``.
    """
    run_id = f"export-{batch}"
    pending = pending_records(success_records(spark, root, without=[run_id]))
    try:
        ledger = spark.read.parquet(ledger_path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        waiting = ledger_counts(pending.withColumn("appended", F.lit(False)))
        return waiting.select(
            F.lit(MISSING_LEDGER).alias("status"), "pending_count",
            F.lit(0).cast("bigint").alias("appended_count"),
            F.lit(0).cast("bigint").alias("duplicate_count"),
        )
    # this batch's own folder may hold rows of a run that failed half-way
    ledger = ledger.filter(F.col("batch").cast("string") != batch)
    headers = [c for c in ledger.columns if c != "batch"]
    codes = ledger.select(F.col(vocab.LEDGER_CODE).alias("project_code"))
    # rows, counts and marks all come from what was pending when the export began
    marked = stored(marked_pending(stored(pending, "pending"), codes), "marked")
    ledger_rows(marked.filter("appended"), headers).orderBy("first_seq").select(*headers).write.mode(
        "overwrite"
    ).parquet(f"{ledger_path}/batch={batch}")
    partials = success_partials(spark, root, without=[run_id])
    write_part(exported_events(marked, partials, ts), root, EVENTS, run_id)
    commit(spark, root, run_id)
    return ledger_counts(marked)


def exported_events(pending: DataFrame, events: DataFrame, ts: str) -> DataFrame:
    """Events that mark appended and duplicate records exported; numbered behind those of
    ``events``, or of snapshot rows."""
    following = events.agg(F.max("seq") + 1).scalar()
    return pending.select(
        following.alias("seq"), "project_code", "project_name", "row_json",
        F.lit(EXPORTED).alias("state"), F.to_timestamp(F.lit(ts)).alias("ts"),
    )


def run_summary(state: DataFrame, results: DataFrame, runs: DataFrame, packets: DataFrame) -> DataFrame:
    """One row: pending records, failures of the latest run, packets on hand.

    The packet names themselves are ``discover_projects``; they stay a table.
    """
    pending = pending_records(state).agg(F.count("*").alias("pending_success_count"))
    projects = packets.agg(F.count("*").alias("project_count"))
    counts = pending.select(
        "pending_success_count",
        failed_count(results, runs).scalar().alias("failed_count"),
        projects.scalar().alias("project_count"),
    )
    return counts


# --- recognition cache ------------------------------------------------------


def fingerprint(
    length: Column, mtime: Column, detect_stamp: Column, context: Column, settings: dict
) -> Column:
    """Digest of everything a recognition result depends on; no credentials."""
    parts = [
        F.concat_ws(":", length.cast("string"), F.unix_seconds(mtime).cast("string")).alias("file"),
        detect_stamp.alias("detect_stamp"),
        *[F.lit(settings.get(k)).alias(k) for k in (
            "ai_enabled", "ai_base_url", "ai_model", "ocr_base_url", "image_max_kb")],
        context["candidate_names"].alias("candidate_names"),
        context["candidate_phones"].alias("candidate_phones"),
        context["registry_date"].cast("string").alias("excel_acceptance_date"),
        context["range_start"].cast("string").alias("acceptance_start"),
        context["range_end"].cast("string").alias("acceptance_end"),
    ]
    return F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256)


def cache_state(entries: DataFrame) -> DataFrame:
    """Latest entry per file; a new fingerprint replaces the old one."""
    latest = F.max_by(F.struct("fingerprint", "data_json"), "seq")
    return entries.groupBy("file_path").agg(latest.alias("e")).select("file_path", "e.*")


CACHE = "recognition_cache"


def save_recognition(entries: DataFrame, root: str, run_id: str) -> None:
    """Add ``file_path, fingerprint, data_json, seq`` to the cache journal."""
    write_part(entries.select("file_path", "fingerprint", "data_json", "seq"), root, CACHE, run_id)
    commit(entries.sparkSession, root, run_id)


def _cache_columns(entries: DataFrame) -> DataFrame:
    return entries.select("file_path", "fingerprint", "data_json", "seq")


def _latest_entries(entries: DataFrame) -> DataFrame:
    latest = F.max_by(F.struct("fingerprint", "data_json", "seq"), "seq")
    return entries.groupBy("file_path").agg(latest.alias("e")).select("file_path", "e.*")


def saved_recognition(spark: SparkSession, root: str) -> DataFrame:
    """Latest entry per file of the cache journal."""
    return cache_state(current(spark, root, CACHE, SCHEMAS[CACHE], _cache_columns))


def compact_recognition(spark: SparkSession, root: str) -> int:
    """Fold the cache journal into its next snapshot: the latest entry of each file."""
    return compact(spark, root, CACHE, SCHEMAS[CACHE], _cache_columns, _latest_entries)


def marked_cached(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Add ``hit``, whether a file's recognition can be reused, and its ``data_json``."""
    key = ["file_path", "fingerprint"]
    known = cache.select(*key, "data_json", F.lit(True).alias("hit"))
    return files.join(known, key, "left").na.fill(False, ["hit"])
