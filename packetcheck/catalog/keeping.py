"""Queries over run results, success records, ledger, cache and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from packetcheck.catalog.derived import Tables
from packetcheck.catalog.registry import query
from packetcheck.plans.logs import (
    class_counts, collection_lines, conflict_columns, current_lines, filter_lines,
    latest_collection, latest_lines,
)
from packetcheck.plans.state import (
    cache_state, exported_events, failed_count, failure_lines, fingerprint, latest_failures,
    ledger_counts, ledger_rows, pending_records, run_summary, marked_cached, marked_pending,
    success_state,
)

TS = "2026-01-01 00:00:00"

_STATE = """
    state as (
        select project_code, min(seq) filter (state = 'pending') as first_seq,
               arg_max(project_name, seq) filter (state = 'pending') as project_name,
               arg_max(row_json, seq) filter (state = 'pending') as row_json,
               arg_max(state, seq) as status
        from success_events group by project_code
        having count(*) filter (state = 'pending') > 0
    )
"""


@query("success_state", f"with {_STATE} select project_code, project_name, row_json, status, first_seq from state")
def success_state_query(t: Tables) -> DataFrame:
    return success_state(t.success_events).select(
        "project_code", "project_name", "row_json", "status", "first_seq"
    )


@query("pending_records", f"""
    with {_STATE} select project_code, project_name, first_seq from state where status = 'pending'
""")
def pending_query(t: Tables) -> DataFrame:
    pending = pending_records(success_state(t.success_events)).orderBy("first_seq")
    return pending.select("project_code", "project_name", "first_seq")


# a batch in which codes repeat: every pending event
_SPLIT = """
    batch as (
        select project_code, seq as first_seq, row_json,
               row_number() over (partition by project_code order by seq) as nth
        from success_events where state = 'pending'
    ),
    split as (
        select *, project_code = '' or (nth = 1 and project_code not in (select project_code from ledger_codes)) as appended
        from batch
    )
"""


def _batch(t: Tables) -> DataFrame:
    pending = t.success_events.filter(F.col("state") == "pending").select(
        "project_code", F.col("seq").alias("first_seq"), "row_json"
    )
    return marked_pending(pending, t.ledger_codes)


@query("ledger_split", f"""
    with {_SPLIT} select project_code, first_seq, appended from split
""")
def ledger_split(t: Tables) -> DataFrame:
    return _batch(t).select("project_code", "first_seq", "appended")


@query("ledger_counts", f"""
    with {_SPLIT}
    select 'exported' as status, count(*) as pending_count, count(*) filter (appended) as appended_count,
           count(*) filter (not appended) as duplicate_count from split
""")
def ledger_counts_query(t: Tables) -> DataFrame:
    return ledger_counts(_batch(t))


@query("ledger_rows", f"""
    with {_SPLIT}
    select first_seq, json_extract_string(row_json, '项目编码') as "项目编码",
           json_extract_string(row_json, '项目全称') as "项目全称", '' as "联系人"
    from split where appended
""")
def ledger_rows_query(t: Tables) -> DataFrame:
    rows = ledger_rows(_batch(t).filter("appended"), ["项目编码", "项目全称", "联系人"])
    return rows.na.fill("", ["联系人"])


@query("exported_state", f"""
    with {_STATE} select project_code, 'exported' as status, first_seq, row_json from state
""")
def exported_state(t: Tables) -> DataFrame:
    events = t.success_events.withColumn("ts", F.col("ts").cast("timestamp"))
    marks = exported_events(pending_records(success_state(events)), events, TS)
    after = success_state(events.unionByName(marks))
    return after.select("project_code", "status", "first_seq", "row_json")


@query("latest_failures", """
    select item_order, project_code, project_name from compare_results
    where run_id = (select max(run_id) from compare_runs) and not passed
""")
def latest_failures_query(t: Tables) -> DataFrame:
    failures = latest_failures(t.compare_results, t.compare_runs)
    return failures.select("item_order", "project_code", "project_name")


@query("failure_lines", """
    select '[项目比对] ' || log_json as value from compare_results
    where run_id = (select max(run_id) from compare_runs) and not passed
""")
def failure_lines_query(t: Tables) -> DataFrame:
    return failure_lines(t.compare_results, t.compare_runs)


@query("failed_count", """
    select count(*) as failed_count from compare_results
    where run_id = (select max(run_id) from compare_runs) and not passed
""")
def failed_count_query(t: Tables) -> DataFrame:
    return failed_count(t.compare_results, t.compare_runs)


@query("run_summary", f"""
    with {_STATE}
    select (select count(*) from state where status = 'pending') as pending_success_count,
           (select count(*) from compare_results where run_id = (select max(run_id) from compare_runs) and not passed) as failed_count,
           (select count(*) from sides) as project_count
""")
def run_summary_query(t: Tables) -> DataFrame:
    return run_summary(success_state(t.success_events), t.compare_results, t.compare_runs, t.packets)


@query("recognition_cache", """
    select project_name as file_path, k % 2 = 0 and k % 3 <> 1 as hit,
           case when k % 2 = 0 and k % 3 <> 1 then 'v2' else '' end as data_json from sides
""")
def recognition_cache(t: Tables) -> DataFrame:
    k = F.col("k")
    path = F.col("project_name").alias("file_path")
    files = t.sides.select(path, F.concat(F.lit("f"), k.cast("string")).alias("fingerprint"))
    # every second file has two entries; in some the newer one no longer fits
    newer = F.when(k % 3 == 1, "stale").otherwise(F.concat(F.lit("f"), k.cast("string")))
    old = F.struct(F.concat(F.lit("f"), k.cast("string")).alias("fingerprint"),
                   F.lit("v1").alias("data_json"), F.lit(1).alias("seq"))
    new = F.struct(newer.alias("fingerprint"), F.lit("v2").alias("data_json"), F.lit(2).alias("seq"))
    entries = t.sides.filter(k % 2 == 0).select(path, F.inline_outer(F.array(old, new)))
    return marked_cached(files, cache_state(entries)).select(
        "file_path", "hit", F.coalesce("data_json", F.lit("")).alias("data_json")
    )


@query("fingerprints", """
    select project_name, sha256(cast(to_json(struct_pack(
        file := k || ':' || epoch(cast(d as timestamp)), detect_stamp := cents > 5000, ai_enabled := true,
        ai_base_url := cast(null as varchar), ai_model := 'm', ocr_base_url := cast(null as varchar), image_max_kb := 100,
        candidate_names := doc_names, candidate_phones := doc_phones,
        excel_acceptance_date := strftime(d, '%Y-%m-%d'), acceptance_start := strftime(doc_start, '%Y-%m-%d'),
        acceptance_end := strftime(doc_end, '%Y-%m-%d'))) as varchar)) as fingerprint
    from (select * exclude (d), cast(d as date) as d from sides)
""".replace("epoch(cast(d as timestamp))", "cast(epoch(cast(d as timestamp)) as bigint)"))
def fingerprints(t: Tables) -> DataFrame:
    context = F.struct(
        F.col("doc_names").alias("candidate_names"), F.col("doc_phones").alias("candidate_phones"),
        F.col("d").alias("registry_date"), F.col("doc_start").alias("range_start"),
        F.col("doc_end").alias("range_end"),
    )
    settings = {"ai_enabled": True, "ai_model": "m", "image_max_kb": 100}
    mtime = F.to_timestamp(F.concat(F.col("d").cast("string"), F.lit(" 00:00:00Z")))
    digest = fingerprint(F.col("k"), mtime, F.col("cents") > 5000, context, settings)
    return t.sides.select("project_name", digest.alias("fingerprint"))


# --- logs -------------------------------------------------------------------

_CLASSES = """
    classed as (
        select *, case when not contains(message, '[项目比对] ') or not json_valid(substr(message, 8)) then 'system'
                       when contains(message, '"passed":true') then 'success' else 'failed' end as class
        from runtime_logs where not contains(message, '[缓存]')
    )
"""


@query("log_classes", f"""
    with {_CLASSES}
    select count(*) as "all", count(*) filter (class = 'success') as success,
           count(*) filter (class = 'failed') as failed, count(*) filter (class = 'system') as system from classed
""")
def log_classes(t: Tables) -> DataFrame:
    return class_counts(t.runtime_logs)


@query("log_views", f"""
    with {_CLASSES} select id, class, message from classed where class in ('failed', 'system')
""")
def log_views(t: Tables) -> DataFrame:
    return filter_lines(t.runtime_logs, "failed", "system").select("id", "class", "message")


@query("conflict_columns", f"""
    with {_CLASSES}
    select id, contains(message, '"比对结果","projectCode":"❌"') as project_code, false as project_name,
           false as contact_name, contains(message, '"contactPhone":"❌"') as contact_phone, false as acceptance_time,
           false as start_time, false as amount, false as has_red_stamp
    from classed where class <> 'system'
""")
def conflict_columns_query(t: Tables) -> DataFrame:
    return conflict_columns(t.runtime_logs, "id")


@query("latest_lines", """
    select id, message from (select id, message from runtime_logs order by id desc limit 500)
""")
def latest_lines_query(t: Tables) -> DataFrame:
    return latest_lines(t.runtime_logs).select("id", "message")


@query("current_lines", """
    select id, message from runtime_logs where id % 4 = 3
""")
def current_lines_query(t: Tables) -> DataFrame:
    stored = t.runtime_logs.withColumn("epoch", F.col("id") % 4)
    return current_lines(stored).select("id", "message")


@query("latest_collection", """
    select user_id as downloaded, event_id % 7 as skipped, event_id % 3 as errors
    from events where event_type = 'view' order by event_id desc limit 1
""")
def latest_collection_query(t: Tables) -> DataFrame:
    return latest_collection(t.runtime_logs)


@query("collection_lines", """
    with o as (select event_id, case event_type when 'view' then 1 when 'click' then 2 else 3 end as part from events)
    select 0 as part, 0 as seq, '[网页阶段] 完成: 下载=' || count(*) filter (part = 1) || ' | 跳过='
        || count(*) filter (part = 2) || ' | 错误=' || count(*) filter (part = 3) as message from o
    union all
    select part, event_id, '[网页阶段] ' || case part when 1 then '已下载: ' when 2 then '已跳过: ' else '错误: ' end || 'P' || event_id from o
""")
def collection_lines_query(t: Tables) -> DataFrame:
    outcome = F.when(F.col("event_type") == "view", "downloaded").when(
        F.col("event_type") == "click", "skipped"
    ).otherwise("error")
    outcomes = t.events.select(
        F.col("event_id").alias("seq"), outcome.alias("outcome"),
        F.concat(F.lit("P"), F.col("event_id").cast("string")).alias("item"),
    )
    return collection_lines(outcomes)
