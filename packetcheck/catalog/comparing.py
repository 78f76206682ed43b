"""Queries over rules, verdicts and reports."""

from __future__ import annotations

from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from packetcheck.catalog import duck
from packetcheck.catalog.derived import Tables
from packetcheck.catalog.registry import query
from packetcheck.functions.dates import parse_date
from packetcheck.functions.text import compact_text, normalize_text, project_code
from packetcheck.functions.values import make_value, parse_amount
from packetcheck.operators.report import report_struct
from packetcheck.operators.rules import (
    ArrowNormalizer, CandidateRule, FieldRule, exploded_failures, packet_rules, reconcile,
)
from packetcheck.operators.verdict import active_packets, assemble, judge, until_first_fatal
from packetcheck.plans.packets import PacketTables, compare
from packetcheck.plans.report import (
    exploded_rows, report_json, report_rows, run_totals, success_row,
)
from packetcheck.plans.run import run_comparison
from packetcheck.plans.journal import visible
from packetcheck.plans.state import success_records
from packetcheck.session import shared_dir
from packetcheck.sources.tables import SCHEMAS

FINISHED_AT = "2026-01-01 00:00:00"


def typed_sides(sides: DataFrame) -> DataFrame:
    """Sides with parsed date and amount, ready for the rule suite."""
    return sides.withColumns({
        "reg_date": parse_date(F.col("reg_date_text")),
        "amount": parse_amount(F.lit("string"), F.col("reg_amount")),
        "doc_invalid": F.coalesce(F.col("doc_start") > F.col("doc_end"), F.lit(False)),
    })


def evidence(values: Column) -> Column:
    """Evidence map as one comparable text."""
    pairs = F.transform(
        F.map_entries(values),
        lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("∅"))),
    )
    return F.array_join(pairs, ";")


def _rule(ord_: int, field: str, message: str, ev: str, where: str) -> str:
    return (
        f"select project_name, {ord_} as ord, '{field}' as field_name, {message} as message, "
        f"{ev} as evidence from n where {where}"
    )


def _pair(a: str, left: str, b: str, right: str) -> str:
    return f"'{a}=' || coalesce({left}, '∅') || ';{b}=' || coalesce({right}, '∅')"


def _dates(excel: str) -> str:
    return (
        f"'excel=' || {excel} || ';docx=' || {duck.iso('doc_end')} || ';pdf=' || "
        f"{duck.iso('rep_date')} || ';开始时间=' || {duck.iso('doc_start')}"
    )


_LISTED = "case when len({0}) = 0 then '<空>' else array_to_string({0}, ' | ') end"
_IN_RANGE = "{} between doc_start and doc_end"

FAILURES = f"""
n as (
    select *, {duck.code('reg_code')} as nc, {duck.code('doc_code')} as ndc,
           {duck.code("coalesce(web_code, '')")} as nwc,
           {duck.compact('reg_name')} as nn, {duck.compact('doc_name')} as ndn,
           {duck.compact("coalesce(web_name, '')")} as nwn,
           {duck.digits('reg_phone')} as np, {duck.digits('rep_phone')} as nrp,
           {duck.date('reg_date_text')} as reg_date, {duck.amount('reg_amount')} as amount,
           coalesce(doc_start > doc_end, false) as invalid
    from sides
),
f as (
    {_rule(0, '项目编号', "'xlsx 与 docx 不一致'", _pair('xlsx', 'reg_code', 'docx', 'doc_code'),
           "nc <> '' and nc <> ndc")}
    union all {_rule(1, '项目编号', "'xlsx 与 web 不一致'", _pair('xlsx', 'reg_code', 'web', 'web_code'),
           "has_web and nc <> '' and nc <> nwc")}
    union all {_rule(2, '项目全称', "'xlsx 与 docx 不一致'", _pair('xlsx', 'reg_name', 'docx', 'doc_name'),
           "nn <> '' and nn <> ndn")}
    union all {_rule(3, '项目全称', "'xlsx 与 web 不一致'", _pair('xlsx', 'reg_name', 'web', 'web_name'),
           "has_web and nn <> '' and nn <> nwn")}
    union all {_rule(4, '用户姓名', "'xlsx 与 docx 不一致'",
           _pair('xlsx', 'reg_contact', 'docx', _LISTED.format('doc_names')),
           "not list_contains(doc_names, reg_contact)")}
    union all {_rule(5, '用户姓名', "'xlsx 与 pdf 不一致'", _pair('xlsx', 'reg_contact', 'pdf', 'rep_name'),
           f"not {duck.names_match('reg_contact', 'rep_name')}")}
    union all {_rule(6, '联系电话', "'xlsx 与 docx 不一致'",
           _pair('xlsx', 'reg_phone', 'docx', _LISTED.format('doc_phones')),
           "not list_contains(doc_phones, np)")}
    union all {_rule(7, '联系电话', "'xlsx 与 pdf 不一致'", _pair('xlsx', 'reg_phone', 'pdf', 'rep_phone'),
           "np <> '' and np <> nrp")}
    union all {_rule(8, '竣工验收时间区间', '''case when doc_start is null and doc_end is null
                then 'Word 开始时间和完成时间未识别' else '开始时间晚于完成时间' end''', _dates("'∅'"),
           "invalid or doc_start is null or doc_end is null")}
    union all {_rule(9, '验收时间', f'''case
                when reg_date is null then 'Excel 验收日期未识别'
                when doc_start is null then 'Word 开始时间未识别，无法校验验收时间区间'
                when doc_end is null then 'Word 完成时间未识别，无法校验验收时间区间'
                when rep_date is null then 'PDF 手写日期未识别'
                when invalid then 'Word 开始/完成时间区间无效，无法校验验收时间'
                when not {_IN_RANGE.format('reg_date')} and not {_IN_RANGE.format('rep_date')}
                    then 'Excel、PDF 验收时间不在 Word 开始/完成时间区间内'
                when not {_IN_RANGE.format('reg_date')} then 'Excel 验收时间不在 Word 开始/完成时间区间内'
                else 'PDF 验收时间不在 Word 开始/完成时间区间内' end''', _dates(duck.iso('reg_date')),
           f'''reg_date is null or doc_start is null or doc_end is null or rep_date is null or invalid
               or not {_IN_RANGE.format('reg_date')} or not {_IN_RANGE.format('rep_date')}''')}
    union all {_rule(10, '盖章检查', "'合同额超过 50 万但 pdf 未识别到红章'",
           "'合同额（万元）=' || reg_amount || ';pdf_has_red_stamp=false'",
           "amount > 50 and not has_red_stamp")}
)
"""


@query("rule_failures", f"""
    with {FAILURES}
    select project_name, cast(row_number() over (partition by project_name order by ord) - 1 as bigint) as seq,
           field_name, message, evidence from f
""")
def rule_failures(t: Tables) -> DataFrame:
    found = exploded_failures(reconcile(typed_sides(t.sides), packet_rules()), "project_name")
    return found.select(
        "project_name", F.col("seq").cast("bigint").alias("seq"), "field_name", "message",
        evidence(F.col("values")).alias("evidence"),
    )


@query("rule_verdicts", f"""
    with {FAILURES}
    select s.project_name, count(f.ord) = 0 as passed, count(f.ord) as failures,
           coalesce(string_agg(f.field_name, ',' order by f.ord), '') as failed_fields
    from sides s left join f on f.project_name = s.project_name group by s.project_name
""")
def rule_verdicts(t: Tables) -> DataFrame:
    rows = reconcile(typed_sides(t.sides), packet_rules())
    fields = F.transform("failures", lambda f: f["field_name"])
    return rows.select(
        "project_name", "passed", F.size("failures").cast("bigint").alias("failures"),
        F.array_join(fields, ",").alias("failed_fields"),
    )


@query("failures_by_rule", f"""
    with {FAILURES}
    select field_name, message, count(*) as packets from f group by field_name, message
""")
def failures_by_rule(t: Tables) -> DataFrame:
    found = exploded_failures(reconcile(typed_sides(t.sides), packet_rules()), "project_name")
    return found.groupBy("field_name", "message").agg(F.count("*").alias("packets"))


# --- whole packets ----------------------------------------------------------


def structured_records(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Packets and their four records straight from the sides, some unreadable."""
    s, k = t.sides, F.col("k")
    c = F.col

    def text_value(column: str) -> Column:
        return make_value("string", c(column))

    fields = F.create_map(
        F.lit("项目编号"), F.when(k % 47 != 0, text_value("reg_code")),
        F.lit("项目全称"), text_value("reg_name"),
        F.lit("用户联系人"), text_value("reg_contact"),
        F.lit("用户联系方式"), text_value("reg_phone"),
        F.lit("完成日期"), text_value("reg_date_text"),
        F.lit("合同额（万元）"), text_value("reg_amount"),
    )
    fields = F.map_filter(fields, lambda _, v: v.isNotNull())
    no_error = F.lit(None).cast("string")
    registry = s.select(
        "project_name", F.when(k % 211 != 0, fields).alias("fields"),
        F.when(k % 211 == 0, "损坏").otherwise(no_error).alias("error"),
    )
    summary = s.select("project_name", F.struct(
        project_code(c("doc_code")).alias("project_code"), c("doc_name").alias("project_name"),
        c("doc_names").alias("contact_names"), c("doc_phones").alias("contact_phones"),
        c("doc_start").alias("acceptance_start"), c("doc_end").alias("acceptance_end"),
        F.coalesce(c("doc_start") > c("doc_end"), F.lit(False)).alias("invalid_range"),
    ).alias("summary")).filter(k % 223 != 0)
    report = s.select("project_name", report_struct(
        c("code"), c("rep_name"), c("rep_phone"), c("rep_date"), c("has_red_stamp")
    ).alias("report"))
    web = s.filter("has_web").select("project_name", F.struct(
        project_code(c("web_code")).alias("project_code"), c("web_name").alias("project_name")
    ).alias("web"))
    return t.packets, registry, summary, report, web


def structured_verdicts(t: Tables) -> DataFrame:
    return judge(assemble(*structured_records(t)))


VERDICTS = FAILURES + f""",
m as (
    select *, k % 101 = 0 as no_registry, k % 101 <> 0 and k % 211 = 0 as bad_registry,
           k % 103 = 0 as no_summary, k % 103 <> 0 and k % 223 = 0 as bad_summary, k % 107 = 0 as no_report
    from n
),
c as (
    select *, not (no_registry or bad_registry) as has_registry,
           not (no_summary or bad_summary) as has_summary
    from m
),
e as (
    select *,
           has_registry and has_summary and not no_report as complete,
           case when has_registry and k % 47 <> 0 then reg_code
                when has_summary then ndc
                when has_web then nwc else project_name end as project_code
    from c
),
ff as (select f.* from f join e on e.project_name = f.project_name and e.complete
       where not (e.k % 47 = 0 and f.ord in (0, 1))),
counts as (select project_name, count(*) as nf, string_agg(field_name, ',' order by ord) as failed from ff group by project_name),
v as (
    select e.*, coalesce(nf, 0) as nf, failed,
           complete and coalesce(nf, 0) = 0 as passed,
           cast((not has_registry) as int) + cast((not has_summary) as int) + cast((not has_web) as int)
             + cast((has_registry and has_summary and no_report) as int) + coalesce(nf, 0) as details
    from e left join counts on counts.project_name = e.project_name
),
verdicts as (
    select *, case when no_registry then '缺少 Excel 文件' when bad_registry then 'Excel 读取失败'
                   when no_summary then '缺少 Word 文件' when bad_summary then 'Word 读取失败'
                   when no_report then '缺少竣工验收报告文件'
                   when passed then '比对成功'
                   else '比对失败，' || cast(details as string) || ' 个问题' end as status,
              case when bad_registry then project_name || ' | xlsx读取 | 损坏，已停止后续任务' end as fatal_reason
    from v
)
"""


@query("packet_verdicts", f"""
    with {VERDICTS}
    select project_name, project_code, passed, status, cast(details as bigint) as details,
           coalesce(fatal_reason, '') as fatal_reason from verdicts
""")
def packet_verdicts(t: Tables) -> DataFrame:
    return structured_verdicts(t).select(
        "project_name", "project_code", "passed", "status",
        F.size("details").cast("bigint").alias("details"),
        F.coalesce("fatal_reason", F.lit("")).alias("fatal_reason"),
    )


@query("verdicts_until_fatal", f"""
    with {VERDICTS}
    select project_name, status from verdicts
    where project_name <= coalesce((select min(project_name) from verdicts where fatal_reason is not null), project_name)
""")
def verdicts_until_fatal(t: Tables) -> DataFrame:
    return until_first_fatal(structured_verdicts(t)).select("project_name", "status")


@query("run_totals", f"""
    with {VERDICTS}
    select count(*) filter (passed) as passed, cast(sum(details) as bigint) as error_details from verdicts
""")
def run_totals_query(t: Tables) -> DataFrame:
    return run_totals(structured_verdicts(t))


@query("active_packets", f"""
    with {VERDICTS}
    select project_name from verdicts where not passed
""")
def active_packets_query(t: Tables) -> DataFrame:
    archived = structured_verdicts(t).filter("passed")
    return active_packets(t.packets, archived).select("project_name")


_U, _D = "'未识别'", "'—'"
_MARKS = """case when passed then '✅' when nf = 0 then '—' when {hit} then '❌' else {ok} end"""


def _mark(field: str) -> str:
    return _MARKS.format(hit=f"contains(',' || failed || ',', ',{field},')", ok="'✅'")


def _shown(d: str) -> str:
    return f"coalesce(strftime({d}, '%Y-%m-%d'), {_U})"


_READ_SUMMARY = "case when has_summary then {} else '未识别' end"
REPORT_ROWS = VERDICTS + f""",
report_rows as (
    select project_name as packet, 0 as pos, '关闭移交登记表' as file_name,
           trim(case when has_registry and k % 47 <> 0 then reg_code else project_code end) as project_code,
           case when has_registry then reg_name else project_name end as project_name,
           case when has_registry then reg_contact else {_U} end as contact_name,
           case when has_registry then reg_phone else {_U} end as contact_phone,
           case when has_registry then reg_date_text else {_U} end as acceptance_time, {_D} as start_time,
           case when has_registry then reg_amount else {_U} end as amount, {_D} as has_red_stamp
    from verdicts
    union all
    select project_name, 1, '竣工总结报告', {_READ_SUMMARY.format('ndc')}, {_READ_SUMMARY.format('doc_name')},
           {_READ_SUMMARY.format("coalesce(nullif(array_to_string(doc_names, ' | '), ''), '未识别')")},
           {_READ_SUMMARY.format("coalesce(nullif(array_to_string(doc_phones, ' | '), ''), '未识别')")},
           {_READ_SUMMARY.format(_shown('doc_end'))}, {_READ_SUMMARY.format(_shown('doc_start'))}, {_D}, {_D}
    from verdicts
    union all
    select project_name, 2, '竣工验收报告', {_D}, {_D},
           case when no_report then {_U} else rep_name end, case when no_report then {_U} else rep_phone end,
           case when no_report then {_U} else {_shown('rep_date')} end, {_D}, {_D},
           case when no_report then {_U} when has_red_stamp then '有' else '无' end
    from verdicts
    union all
    select project_name, 3, '网页', case when has_web then nwc else {_U} end,
           case when has_web then web_name else {_U} end, {_D}, {_D}, {_D}, {_D}, {_D}, {_D}
    from verdicts
    union all
    select project_name, 4, '比对结果', {_mark('项目编号')}, {_mark('项目全称')}, {_mark('用户姓名')},
           {_mark('联系电话')}, {_mark('验收时间')},
           {_MARKS.format(hit="(contains(failed, '竣工验收时间区间') or contains(',' || failed || ',', ',验收时间,'))",
                          ok="case when has_summary and doc_start is not null and doc_end is not null then '✅' else '—' end")},
           case when has_registry and amount > 50 then '✅' else '—' end,
           case when not (has_registry and amount > 50) then '—'
                when contains(coalesce(failed, ''), '盖章检查') then '❌'
                when not no_report then '✅' else '—' end
    from verdicts
)
"""
_REPORT_COLUMNS = (
    "file_name, project_code, project_name, contact_name, contact_phone, "
    "acceptance_time, start_time, amount, has_red_stamp"
)


@query("report_rows", f"""
    with {REPORT_ROWS}
    select packet, cast(pos as bigint) as pos, {_REPORT_COLUMNS} from report_rows
""")
def report_rows_query(t: Tables) -> DataFrame:
    rows = exploded_rows(report_rows(structured_verdicts(t)))
    return rows.withColumn("pos", F.col("pos").cast("bigint"))


@query("report_json", f"""
    with {REPORT_ROWS},
    packed as (
        select packet, list(struct_pack(
            "fileName" := file_name, "projectCode" := project_code, "projectName" := project_name,
            "contactName" := contact_name, "contactPhone" := contact_phone,
            "acceptanceTime" := acceptance_time, "startTime" := start_time,
            "amount" := amount, "hasRedStamp" := has_red_stamp) order by pos) as rows
        from report_rows group by packet
    )
    select v.project_name, cast(to_json(struct_pack(
        "projectName" := v.project_name, "projectCode" := v.project_code, "passed" := v.passed,
        "summary" := v.status, "finishedAt" := '{FINISHED_AT}', "rows" := p.rows)) as varchar) as log_json
    from verdicts v join packed p on p.packet = v.project_name
""")
def report_json_query(t: Tables) -> DataFrame:
    reports = report_json(report_rows(structured_verdicts(t)), FINISHED_AT)
    return reports.select("project_name", "log_json")


@query("success_rows", f"""
    with {VERDICTS}
    select project_name, reg_code as "项目编码", reg_name as "项目全称", reg_contact as "联系人",
           reg_phone as "联系方式", reg_date_text as "完成关闭", reg_amount as "合同额（万元）"
    from verdicts where passed and k % 47 <> 0
    union all
    select project_name, '∅', reg_name, reg_contact, reg_phone, reg_date_text, reg_amount
    from verdicts where passed and k % 47 = 0
""")
def success_rows(t: Tables) -> DataFrame:
    passed = structured_verdicts(t).filter("passed")
    row = success_row(F.col("fields"))
    headers = ["项目编码", "项目全称", "联系人", "联系方式", "完成关闭", "合同额（万元）"]
    return passed.withColumn("row", row).select(
        "project_name",
        *[F.coalesce(F.try_element_at("row", F.lit(h)), F.lit("∅")).alias(h) for h in headers],
    )


# --- from documents to verdicts ---------------------------------------------


def rendered_tables(t: Tables) -> PacketTables:
    pixels = t.lineitem.select(
        F.concat(F.lit("QXA-"), F.lpad(F.col("l_orderkey").cast("string"), 8, "0"), F.lit("-01")).alias("project_name"),
        F.col("l_linenumber").alias("page"), F.col("l_partkey").cast("int").alias("idx"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_orderkey") % 2 == 0), 200).otherwise(100).alias("r"),
        (F.lit(50) + F.col("l_linenumber")).alias("g"), (F.lit(50) + F.col("l_linenumber")).alias("b"),
    )
    return PacketTables(
        t.packets, t.cells, t.summary_texts,
        t.report_pages, t.web_texts, pixels,
    )


DOCUMENT_VERDICTS = f"""
    with {FAILURES},
    miss as (
        select s.project_name, case when k % 101 = 0 then '缺少 Excel 文件' when k % 103 = 0 then '缺少 Word 文件'
               when k % 107 = 0 then '缺少竣工验收报告文件' end as why from sides s
    ),
    c as (select project_name, count(*) as nf, string_agg(field_name, ',' order by ord) as failed from f group by project_name)
    select m.project_name, why is null and nf is null as passed,
           case when why is null then coalesce(failed, '') else '' end as failed_fields,
           coalesce(why, case when nf is null then '比对成功' else '比对失败，'
               || cast(nf + cast((not s.has_web) as int) as string) || ' 个问题' end) as status
    from miss m join sides s on s.project_name = m.project_name left join c on c.project_name = m.project_name
"""


@query("documents_to_verdicts", DOCUMENT_VERDICTS)
def documents_to_verdicts(t: Tables) -> DataFrame:
    fields = F.transform("failures", lambda f: f["field_name"])
    return compare(rendered_tables(t)).select(
        "project_name", "passed", F.array_join(fields, ",").alias("failed_fields"), "status"
    )


# what recognition makes of the signer: confirmed by the other documents where it answered
_SEEN = f"""
    seen as (
        select * replace (
            case when k % 5 < 3 and (k % 7 <> 0 or (k % 5 > 0 and k % 4 <> 3)) then
                case when {duck.names_match('reg_contact', 'rep_name')} then reg_contact
                     when len(doc_names) > 0 and {duck.names_match('doc_names[1]', 'rep_name')} then doc_names[1]
                     else rep_name end
                else rep_name end as rep_name,
            case when k % 5 < 3 then {duck.digits('reg_phone')} else rep_phone end as rep_phone)
        from sides
    )
"""


@query("whole_run", f"""
    with {_SEEN}, {FAILURES.replace("from sides", "from seen")},
    bad as (
        select distinct project_name from f
        union
        select project_name from sides where k % 101 = 0 or k % 103 = 0 or k % 107 = 0 or (k % 31 = 5 and k % 5 < 3)
    )
    select s.project_name, b.project_name is null as passed, row_number() over (partition by substr(s.project_name, 1, 9) order by s.project_name) as place,
           case when b.project_name is null then 'pending' else '' end as event, b.project_name is null as archived
    from sides s left join bad b on b.project_name = s.project_name
""")
def whole_run(t: Tables) -> DataFrame:
    """What two runs leave: the saved results in order, the events, the archive.

    Reports are recognised by services, one of which fails at times, and some folders
    hold a second text. The second run finds nothing new, but compares what did not pass again.
    """
    root = shared_dir(t.spark, "run")
    k = F.substring("project_name", 5, 8).cast("bigint")
    other = t.web_texts.where(k % 9 == 0).select(
        "project_name", F.replace("path", F.lit("web.txt"), F.lit("web2.txt")).alias("path"), F.lit("项目编号: X").alias("text"))
    broken = (k % 31 == 5) & (F.col("kind") == "ai")
    payloads = t.payloads.withColumn("body", F.when(broken, "<html>502</html>").otherwise(F.col("body")))
    tables = replace(rendered_tables(t), web_texts=t.web_texts.unionByName(other), payloads=payloads)
    run_comparison(tables, root, "1", FINISHED_AT)
    run_comparison(tables, root, "2", FINISHED_AT)
    results = visible(t.spark, root, "compare_results", SCHEMAS["compare_results"])
    events = success_records(t.spark, root)
    first = results.filter("run_id = 1").select("project_name", "passed", "item_order")
    again = results.filter("run_id = 2").select("project_name", F.lit(True).alias("again"))
    place = F.row_number().over(Window.partitionBy(F.substring("project_name", 1, 9)).orderBy("item_order")).cast("bigint")
    return (
        first.withColumn("place", place)
        .join(events.select("project_name", "status"), "project_name", "left")
        .join(again, "project_name", "left")
        .select("project_name", "passed", "place", F.coalesce("status", F.lit("")).alias("event"),
                F.col("again").isNull().alias("archived"))
    )


# --- rules over other tables ------------------------------------------------


@query("rules_supplier_customer", """
    with p as (
        select c_name, s_name, c_nationkey as left_nation, coalesce(s_nationkey, -1) as right_nation
        from customer left join supplier on s_suppkey = c_custkey
    )
    select c_name, 'nation' as field_name, left_nation, right_nation from p where left_nation <> right_nation
    union all
    select c_name, 'number', left_nation, right_nation from p where s_name is null or substr(s_name, 10) <> substr(c_name, 10)
""")
def rules_supplier_customer(t: Tables) -> DataFrame:
    """Customers against the supplier of the same number, which many don't have."""
    pairs = t.customer.join(t.supplier, F.col("s_suppkey") == F.col("c_custkey"), "left")
    rules = [
        FieldRule("nation", F.col("c_nationkey").cast("string"), F.col("s_nationkey").cast("string")),
        FieldRule("number", F.col("c_name"), F.col("s_name"), lambda c: F.substr(c, F.lit(10))),
    ]
    found = exploded_failures(reconcile(pairs, rules), "c_name", "c_nationkey", "s_nationkey")
    return found.select(
        "c_name", "field_name", F.col("c_nationkey").alias("left_nation"),
        F.coalesce("s_nationkey", F.lit(-1)).alias("right_nation"),
    )


def _digits(values: pd.Series) -> pd.Series:
    return values.str.replace("[^0-9]", "", regex=True).str.lstrip("0")


@query("rules_arrow", """
    with p as (
        select c_name, ltrim(cast(c_nationkey as varchar), '0') as cp, ltrim(coalesce(cast(s_nationkey as varchar), ''), '0') as sp,
               ltrim(regexp_replace(c_name, '[^0-9]', '', 'g'), '0') as cn, ltrim(regexp_replace(coalesce(s_name, ''), '[^0-9]', '', 'g'), '0') as sn
        from customer left join supplier on s_suppkey = c_custkey
    )
    select c_name, 'number' as field_name from p where cn <> sn
    union all
    select c_name, 'listed' from p where cn not in (sn, '7')
    union all
    select c_name, 'nation' from p where cp <> '' and cp <> sp
""")
def rules_arrow(t: Tables) -> DataFrame:
    """Numbers of customers and suppliers, by a normaliser that runs in Arrow batches."""
    pairs = t.customer.join(t.supplier, F.col("s_suppkey") == F.col("c_custkey"), "left")
    digits = ArrowNormalizer(_digits)
    rules = [
        FieldRule("number", F.col("c_name"), F.col("s_name"), digits),
        CandidateRule("listed", F.col("c_name"), F.array(F.col("s_name"), F.lit("No. 007")), digits),
        FieldRule("nation", F.col("c_nationkey").cast("string"), F.col("s_nationkey").cast("string"), digits),
    ]
    return exploded_failures(reconcile(pairs, rules), "c_name").select("c_name", "field_name")


@query("rules_documents_labels", f"""
    select d.doc_id, 'lang' as field_name, lang as left_value from documents d join labels l on l.doc_id = d.doc_id
    where not (case when quality = 1 then lang in ('en', 'de') else false end)
    union all
    select d.doc_id, 'head', {duck.compact('text')} from documents d join labels l on l.doc_id = d.doc_id
    where lower({duck.compact('text')}) <> lower(lang)
""")
def rules_documents_labels(t: Tables) -> DataFrame:
    rows = t.documents.join(t.labels, "doc_id")
    allowed = F.when(F.col("quality") == 1, F.array(F.lit("en"), F.lit("de"))).otherwise(
        F.array().cast("array<string>")
    )
    head = compact_text(F.col("text"))
    rules = [
        CandidateRule("lang", F.col("lang"), allowed),
        FieldRule("head", head, F.col("lang"), lambda c: F.lower(normalize_text(c))),
    ]
    found = exploded_failures(reconcile(rows, rules), "doc_id")
    return found.select("doc_id", "field_name", F.col("values")["left"].alias("left_value"))
