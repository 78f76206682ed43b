"""Queries over extraction: documents to records."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from packetcheck import vocab
from packetcheck.catalog import duck
from packetcheck.catalog.derived import Tables
from packetcheck.catalog.registry import query
from packetcheck.functions.text import strip_rtf, text_runs
from packetcheck.operators.cells import (
    registry_columns, registry_date, registry_fields, registry_records,
)
from packetcheck.operators.recognition import (
    open_projects, payload_records, recognition_context, resolved_reports,
)
from packetcheck.operators.report import joined_pages, report_records
from packetcheck.operators.stamps import page_ratios, stamps_where_needed
from packetcheck.operators.summary import best_texts, summary_records
from packetcheck.operators.web import web_records
from packetcheck.session import stored
from packetcheck.sources.packets import discover_projects, packets

_ISO = "coalesce(strftime({0}, '%Y-%m-%d'), '∅') as {1}"


def iso(column: str, name: str):
    return F.coalesce(F.col(column).cast("string"), F.lit("∅")).alias(name)


@query("summary_records", f"""
    select project_name, {duck.code('doc_code')} as code, doc_name as name,
           array_to_string(doc_names, '|') as names, array_to_string(doc_phones, '|') as phones,
           {_ISO.format('doc_start', 'range_start')}, {_ISO.format('doc_end', 'range_end')},
           coalesce(doc_start > doc_end, false) as invalid
    from sides
""")
def summary_query(t: Tables) -> DataFrame:
    r = summary_records(t.summary_texts)
    return r.select(
        "project_name", F.col("summary.project_code").alias("code"),
        F.col("summary.project_name").alias("name"),
        F.array_join("summary.contact_names", "|").alias("names"),
        F.array_join("summary.contact_phones", "|").alias("phones"),
        iso("summary.acceptance_start", "range_start"), iso("summary.acceptance_end", "range_end"),
        F.col("summary.invalid_range").alias("invalid"),
    )


@query("report_records", f"""
    select project_name, code, rep_name as signer_name, rep_phone as signer_phone,
           {_ISO.format('rep_date', 'sign_date')} from sides
""")
def report_query(t: Tables) -> DataFrame:
    r = report_records(joined_pages(t.report_pages))
    return r.select(
        "project_name", F.col("report.project_code").alias("code"), "report.signer_name",
        "report.signer_phone", iso("report.sign_date", "sign_date"),
    )


@query("web_records", "select project_name, web_code as code, web_name as name from sides where has_web")
def web_query(t: Tables) -> DataFrame:
    r = web_records(t.web_texts)
    return r.select(
        "project_name", F.col("web.project_code").alias("code"), F.col("web.project_name").alias("name")
    )


_AMOUNT_CELL = """case when k % 2 = 0 then reg_amount when cents % 100 = 0
    then cast(cast(cents / 100 as bigint) as string) else cast(cents / 100 as string) end"""
_DATE_CELL = "case when reg_date_text = '待定' then reg_date_text else strftime(d, '%Y-%m-%d') end"


@query("registry_fields", f"""
    with cell as (
        select project_name, unnest(['项目编号', '项目全称', '用户联系人', '用户联系方式', '验收日期', '合同额（万元）']) as label,
               unnest(['string', 'string', 'string', 'string', 'string',
                   case when k % 2 = 1 and cents % 100 <> 0 then 'number' else 'string' end]) as kind,
               unnest([reg_code, reg_name, reg_contact, reg_phone, {_DATE_CELL}, {_AMOUNT_CELL}]) as s
        from sides
    )
    select project_name, label, kind, s from cell
""")
def registry_query(t: Tables) -> DataFrame:
    r = registry_fields(t.cells)
    return r.select("project_name", "label", "value.kind", "value.s")


@query("registry_columns", f"""
    select project_name, reg_code as code, reg_contact as contact, {_AMOUNT_CELL} as amount,
           {_ISO.format(f"case when reg_date_text = '待定' then null else d end", 'accepted')}
    from sides
""")
def registry_columns_query(t: Tables) -> DataFrame:
    fields = registry_fields(t.cells)
    wide = registry_columns(fields, ["项目编号", "用户联系人", vocab.AMOUNT_LABEL, *vocab.DATE_LABELS])
    known = F.create_map(*[x for label in vocab.DATE_LABELS for x in (F.lit(label), F.col(label))])
    return wide.withColumn("accepted", registry_date(known)).select(
        "project_name", F.col("项目编号.s").alias("code"), F.col("用户联系人.s").alias("contact"),
        F.col(f"{vocab.AMOUNT_LABEL}.s").alias("amount"), iso("accepted", "accepted"),
    )


# --- recognised fields ------------------------------------------------------

_CONF = "case k % 4 when 0 then 0.9e0 when 1 then 0.9e0 when 2 then 0.91e0 end"


@query("recognition_records", f"""
    select project_name, 'ai' as kind, case when k % 7 = 0 then '' else rep_name end as signer_name,
           {duck.digits('reg_phone')} as signer_phone, {_ISO.format('rep_date', 'sign_date')},
           coalesce({_CONF}, -1.0e0) as confidence, '' as error
    from sides where k % 5 < 3
    union all
    select project_name, 'ocr', case when k % 4 = 3 then '∅' else rep_name end,
           case when k % 4 = 3 then '∅' else rep_phone end, '∅', -1.0e0,
           case when k % 4 = 3 then '识别 失败' else '' end
    from sides where k % 5 > 0
""")
def recognition_query(t: Tables) -> DataFrame:
    r = payload_records(t.payloads)
    return r.select(
        "project_name", "kind",
        F.coalesce("report.signer_name", F.lit("∅")).alias("signer_name"),
        F.coalesce("report.signer_phone", F.lit("∅")).alias("signer_phone"),
        iso("report.sign_date", "sign_date"),
        F.coalesce("report.name_conf", F.lit(-1.0)).alias("confidence"),
        F.coalesce("error", F.lit("")).alias("error"),
    )


# A recognised name becomes the registry contact where it sounds alike, or the
# first summary name where it equals that; gaps come from OCR, then from text.
_CONFIRMED = f"""case when {duck.names_match('reg_contact', 'rep_name')} then reg_contact
    when len(doc_names) > 0 and {duck.names_match('doc_names[1]', 'rep_name')} then doc_names[1]
    else rep_name end"""


@query("resolved_reports", f"""
    with x as (
        select *, k % 5 < 3 as has_ai, k % 5 > 0 and k % 4 <> 3 as has_ocr, {_CONFIRMED} as confirmed from sides
    )
    select project_name, code,
           case when has_ai and (k % 7 <> 0 or has_ocr) then confirmed else rep_name end as signer_name,
           case when has_ai then {duck.digits('reg_phone')} else rep_phone end as signer_phone,
           {_ISO.format('rep_date', 'sign_date')}
    from x
""")
def resolved_query(t: Tables) -> DataFrame:
    return _resolved(t, always=True)


def _resolved(t: Tables, always: bool) -> DataFrame:
    texts = report_records(joined_pages(t.report_pages))
    cells, summary_texts, payloads = t.cells, t.summary_texts, t.payloads
    if not always:
        # the other documents are dealt out once, and only those of open reports are taken apart
        texts = stored(texts, "report")
        wanted = open_projects(texts)
        cells, summary_texts, payloads = (
            stored(df.join(wanted, "project_name", "left_semi"), name)
            for name, df in {"cells": cells.drop("sheet"), "summary_texts": summary_texts.drop("path"), "payloads": payloads}.items()
        )
    registry = registry_records(registry_fields(cells))
    summary = summary_records(summary_texts)
    contexts = recognition_context(registry.join(summary, "project_name", "left"))
    r = resolved_reports(texts, payload_records(payloads), contexts, always)
    return r.select(
        "project_name", F.col("report.project_code").alias("code"), "report.signer_name",
        "report.signer_phone", iso("report.sign_date", "sign_date"),
    )


@query("reports_where_needed", f"""
    with x as (
        select *, k % 5 < 3 as has_ai, k % 5 > 0 and k % 4 <> 3 as has_ocr, {_CONFIRMED} as confirmed,
               rep_date is null as open from sides
    )
    select project_name, code,
           case when open and has_ai and (k % 7 <> 0 or has_ocr) then confirmed else rep_name end as signer_name,
           case when open and has_ai then {duck.digits('reg_phone')} else rep_phone end as signer_phone,
           {_ISO.format('rep_date', 'sign_date')}
    from x
""")
def reports_where_needed(t: Tables) -> DataFrame:
    """Recognition only where the page text left a field open."""
    return _resolved(t, always=False)


@query("candidate_sets", f"""
    select project_name,
           array_to_string(case when len(doc_names) = 0 then [reg_contact]
               else [reg_contact, doc_names[1]] end, '|') as names,
           array_to_string(case when len(doc_phones) = 0 then [{duck.digits('reg_phone')}]
               when doc_phones[2] = {duck.digits('reg_phone')} then [{duck.digits('reg_phone')}, doc_phones[1]]
               else [{duck.digits('reg_phone')}, doc_phones[1], doc_phones[2]] end, '|') as phones
    from sides
""")
def candidate_sets(t: Tables) -> DataFrame:
    registry = registry_records(registry_fields(t.cells))
    summary = summary_records(t.summary_texts)
    contexts = recognition_context(registry.join(summary, "project_name", "left"))
    return contexts.select(
        "project_name", F.array_join("context.candidate_names", "|").alias("names"),
        F.array_join("context.candidate_phones", "|").alias("phones"),
    )


# --- stamps -----------------------------------------------------------------


@query("stamp_pages", """
    select cast(l_orderkey as string) as project_name, cast(l_linenumber as bigint) as page,
           count(*) as counted, count(*) filter (l_returnflag = 'R' and l_orderkey % 2 = 0) as red,
           count(*) filter (l_returnflag = 'R' and l_orderkey % 2 = 0) * 100 >= count(*) as stamped
    from lineitem group by l_orderkey, l_linenumber
""")
def stamp_pages(t: Tables) -> DataFrame:
    red = (F.col("l_returnflag") == "R") & (F.col("l_orderkey") % 2 == 0)
    pixels = t.lineitem.select(
        F.col("l_orderkey").cast("string").alias("project_name"),
        F.col("l_linenumber").cast("bigint").alias("page"),
        F.when(red, 200).otherwise(100).alias("r"), F.lit(60).alias("g"), F.lit(60).alias("b"),
    )
    return page_ratios(pixels)


@query("stamp_large_pages", """
    with px as (
        select l_returnflag as project_name, l_linestatus as page, cast(100 + l_quantity * 3 as int) as r, cast(l_partkey % 200 as int) as g, cast(l_suppkey % 150 as int) as b
        from lineitem
    )
    select px.project_name, px.page, count(*) as counted,
           count(*) filter (r >= 180 and r > least(g + 40, 255) and r > least(b + 40, 255)) as red,
           count(*) filter (r >= 180 and r > least(g + 40, 255) and r > least(b + 40, 255)) * 1.0e0 / count(*) >= 0.01e0 as stamped
    from px group by 1, 2
""")
def stamp_large_pages(t: Tables) -> DataFrame:
    pixels = t.lineitem.select(
        F.col("l_returnflag").alias("project_name"), F.col("l_linestatus").alias("page"),
        (100 + F.col("l_quantity") * 3).cast("int").alias("r"),
        (F.col("l_partkey") % 200).cast("int").alias("g"),
        (F.col("l_suppkey") % 150).cast("int").alias("b"),
    )
    return page_ratios(pixels)


@query("stamped_packets", """
    select cast(k as string) as project_name, cents > 5000 and red = 1 and k % 2 = 0 as has_red_stamp from packet_base
""")
def stamped_packets(t: Tables) -> DataFrame:
    red = (F.col("l_returnflag") == "R") & (F.col("l_orderkey") % 2 == 0)
    pixels = t.lineitem.select(
        F.col("l_orderkey").cast("string").alias("project_name"),
        F.col("l_linenumber").alias("page"),
        F.when(red, 200).otherwise(100).alias("r"), F.lit(60).alias("g"), F.lit(60).alias("b"),
    )
    amounts = t.orders.select(
        F.col("o_orderkey").cast("string").alias("project_name"),
        (F.floor(F.col("o_totalprice") / 50) / 100).alias("amount"),
    )
    return stamps_where_needed(amounts, pixels)


# --- decodings and discovery ------------------------------------------------

_RUN_NOISE = r"[^\x21-\x7E\s\x0b\x{85}\p{Z}\x{4e00}-\x{9fff}，。：；（）、—]+"


@query("document_runs", rf"""
    with runs as (
        select doc_id, list_filter(
            list_transform(string_split_regex(text, '{_RUN_NOISE}'), lambda r: {duck.norm('r')}),
            lambda r: len(regexp_replace(r, '[^0-9A-Za-z\x{{4e00}}-\x{{9fff}}]', '', 'g')) >= 2) as kept
        from documents
    )
    select doc_id, md5(array_to_string(kept, ' ')) as digest, len(array_to_string(kept, ' ')) as chars from runs
""")
def document_runs(t: Tables) -> DataFrame:
    runs = t.documents.select("doc_id", text_runs(F.col("text")).alias("runs"))
    return runs.select(
        "doc_id", F.md5("runs").alias("digest"), F.char_length("runs").cast("bigint").alias("chars")
    )


@query("best_texts", """
    with c as (
        select lang || source as project_name, doc_id as ord, doc_id % 6 as score,
               text || array_to_string((['项目编号', '项目全称', '用户姓名', '联系电话', '竣工验收'])[1:doc_id % 6], ' ') as text,
               strlen(text || array_to_string((['项目编号', '项目全称', '用户姓名', '联系电话', '竣工验收'])[1:doc_id % 6], ' ')) as bytes
        from documents
    )
    select project_name, md5(arg_max(text, struct_pack(score, bytes, neg := -ord))) as digest from c group by project_name
""")
def best_texts_query(t: Tables) -> DataFrame:
    """Texts with none to five of the anchor labels; more of them win over length."""
    n = (F.col("doc_id") % 6).cast("int")
    labels = F.slice(F.array(*[F.lit(x) for x in vocab.SUMMARY_ANCHORS]), 1, n)
    candidates = t.documents.select(
        F.concat("lang", "source").alias("project_name"), F.col("doc_id").alias("ord"),
        F.concat("text", F.array_join(labels, " ")).alias("text"),
    )
    return best_texts(candidates).select("project_name", F.md5("text").alias("digest"))


@query("rtf_text", r"""
    select doc_id, md5(translate(regexp_replace(regexp_replace('{\rtf1\ansi \''e9' || replace(text, '.', '\par '),
        '\\''[0-9a-fA-F]{2}', ' ', 'g'), '\\[a-zA-Z]+[0-9]* ?', ' ', 'g'), '{}', '  ')) as digest from documents
""")
def rtf_text(t: Tables) -> DataFrame:
    marked = F.concat(F.lit(r"{\rtf1\ansi \'e9"), F.replace("text", F.lit("."), F.lit(r"\par ")))
    return t.documents.select("doc_id", F.md5(strip_rtf(marked)).alias("digest"))


_FILES = """
x as (select *, replace(project_name, '-', '_') as folder from sides where k % 50 <> 0)
"""


@query("packet_listing", f"""
    with {_FILES}
    select folder as project_name,
           case when k % 6 = 1 then 'a关闭移交登记表.xls' when k % 6 <> 0 then 'b关闭移交登记表.XLSX' else '' end as registry,
           case when k % 5 <> 0 then '竣工总结报告.doc' else '' end as summary,
           case when k % 4 <> 0 then '竣工验收报告.JPeG' else '' end as report,
           case k % 3 when 0 then project_name || '.txt' when 1 then '说明.txt' else '' end as web,
           concat_ws(',', case when k % 6 = 0 then 'xlsx/xls' end, case when k % 5 = 0 then 'docx/doc' end,
                     case when k % 4 = 0 then 'pdf/jpg/jpeg/png' end) as missing
    from x
""")
def packet_listing(t: Tables) -> DataFrame:
    files = t.files
    found = packets(files.drop("text"), files.filter(F.col("text").isNotNull()))
    names = [
        F.coalesce(F.element_at(F.split(f"{role}_path", "/"), -1), F.lit("")).alias(role)
        for role in ("registry", "summary", "report", "web")
    ]
    return found.select("project_name", *names, F.array_join("missing", ",").alias("missing"))


@query("empty_folders", """
    select cast(o_orderkey as varchar) as project_name, 'xlsx/xls,docx/doc,pdf/jpg/jpeg/png' as missing
    from orders where o_orderkey % 7 < 5
""")
def empty_folders(t: Tables) -> DataFrame:
    """Folders of a listing: some without a file, some with the state file only."""
    k = F.col("o_orderkey")
    name = k.cast("string").alias("project_name")
    held = t.orders.filter((k % 7).isin(3, 4)).select(F.concat(F.lit("/d/"), k.cast("string"), F.lit(f"/{vocab.STATE_FILE}")).alias("path"))
    listed = t.orders.filter(k % 7 < 4).select(name)
    return packets(held, folders=listed).select("project_name", F.array_join("missing", ",").alias("missing"))


@query("discovered_projects", f"""
    with {_FILES} select folder as project_name from x
""")
def discovered_projects(t: Tables) -> DataFrame:
    return discover_projects(t.files)
