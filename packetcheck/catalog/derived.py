"""Packet data derived from the given tables.

Each entry is one SQL text that Spark and DuckDB both understand, so a query
and its check start from the same rows. ``{name}`` stands for another table.
"""

from __future__ import annotations

import re
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from packetcheck.catalog import rendered
from packetcheck.session import shared_dir

NAMES = ["王明", "汪明", "张三", "李四", "陈平", "Lee"]


def pick(index: str, items: list[str]) -> str:
    cases = " ".join(f"when {i} then {item}" for i, item in enumerate(items))
    return f"case {index} {cases} end"


def quoted(items: list[str]) -> list[str]:
    return [f"'{item}'" for item in items]


def text(x: str) -> str:
    return f"cast({x} as string)"


def pad2(x: str) -> str:
    return f"lpad({text(x)}, 2, '0')"


def ymd(d: str, a: str, b: str, c: str = "", padded: bool = True) -> str:
    month, day = f"month({d})", f"day({d})"
    part = pad2 if padded else text
    return f"{text(f'year({d})')} || '{a}' || {part(month)} || '{b}' || {part(day)} || '{c}'"


_DATE_FORMS = [
    ymd("d", "-", "-"), ymd("d", "-", "-", padded=False), ymd("d", "/", "/", padded=False),
    ymd("d", ".", "."), ymd("d", "年", "月", "日", padded=False), ymd("d", "", ""),
]
_CONTACT = pick("k % 6", quoted(NAMES))
_NEXT = pick("(k + 1) % 6", quoted(NAMES))

SQL = {
    # one row per order with its shipping range; red marks returned goods
    "packet_base": """
        select o.o_orderkey as k, o.o_custkey as ck, cast(o.o_orderdate as date) as d,
               cast(floor(o.o_totalprice / 50) as bigint) as cents,
               o.o_orderpriority as category, s.ship_min, s.ship_max,
               coalesce(s.red, 0) as red
        from {orders} o
        left join (
            select l_orderkey, min(cast(l_shipdate as date)) as ship_min,
                   max(cast(l_shipdate as date)) as ship_max,
                   max(case when l_returnflag = 'R' then 1 else 0 end) as red
            from {lineitem} group by l_orderkey
        ) s on s.l_orderkey = o.o_orderkey
    """,
    "packet_names": f"""
        select *,
               'QXA-' || lpad({text('k')}, 8, '0') || '-01' as project_name,
               'QXA-' || lpad({text('k')}, 8, '0') || '/01' as code,
               'QXA-' || lpad({text('k + 1')}, 8, '0') || '/01' as next_code,
               'Project Customer#' || lpad({text('ck')}, 9, '0') as title,
               {_CONTACT} as contact, {_NEXT} as next_contact,
               '13' || lpad({text('ck')}, 9, '0') as phone,
               '139' || lpad({text('ck')}, 8, '0') as other_phone,
               {text("cast(floor(cents / 100) as bigint)")} || '.' || {pad2('cents % 100')} as amount_text
        from {{packet_base}}
    """,
    # the structured sides of every packet, with the noise people add
    "sides": f"""
        select k, ck, d, cents, category, project_name, code,
               case k % 5
                   when 0 then code when 1 then lower(code)
                   when 2 then replace(code, '/', ' ／ ')
                   when 3 then replace(code, '/', '​/') else '  ' || code || ' ' end as reg_code,
               case when k % 3 = 1 then replace(title, 'Project', 'Pro ject') else title end as reg_name,
               contact as reg_contact,
               case when k % 2 = 0
                   then substr(phone, 1, 3) || '-' || substr(phone, 4, 4) || '-' || substr(phone, 8)
                   else phone end as reg_phone,
               case when k % 37 = 0 then '待定' else {pick('k % 6', _DATE_FORMS)} end as reg_date_text,
               case k % 3
                   when 0 then amount_text || '万元'
                   when 1 then substr(amount_text, 1, 1) || ',' || substr(amount_text, 2)
                   else amount_text end as reg_amount,
               case when k % 29 = 0 then next_code else code end as doc_code,
               case when k % 3 = 2 then replace(title, 'Project', 'Pro ject') else title end
                   || case when k % 23 = 0 then 'X' else '' end as doc_name,
               case when k % 19 = 0 then $none else $arr(next_contact, contact) end as doc_names,
               case when k % 19 = 0 then $none else $arr(other_phone,
                   case when k % 17 = 0
                       then substr(phone, 1, 10) || {text('(cast(substr(phone, 11, 1) as int) + 1) % 10')}
                       else phone end) end as doc_phones,
               case when k % 41 = 0 then ship_max else ship_min end as doc_start,
               case when k % 41 = 0 then ship_min else ship_max end as doc_end,
               case k % 4
                   when 0 then contact
                   when 1 then case contact when '王明' then '汪明' when '汪明' then '王明' else contact end
                   when 2 then substr(contact, 1, 1) || ' ' || substr(contact, 2)
                   else next_contact end as rep_name,
               case when k % 17 = 1
                   then substr(phone, 1, 10) || {text('(cast(substr(phone, 11, 1) as int) + 1) % 10')}
                   else phone end as rep_phone,
               case when k % 43 = 0 then null else d + cast(k % 11 - 5 as int) end as rep_date,
               (red = 1 and k % 2 = 0) as has_red_stamp,
               (k % 13 <> 0) as has_web,
               case when k % 13 = 0 then null when k % 31 = 0 then next_code else code end as web_code,
               case when k % 13 = 0 then null else title end as web_name
        from {{packet_names}}
    """,
    # success events and run results out of the event stream
    "success_events": f"""
        select event_id as seq,
               case when user_id % 25 = 0 then '' else 'C' || {text('user_id')} end as project_code,
               'P' || {text('event_id')} as project_name,
               '{{{{"项目编码":"C' || {text('user_id')} || '","项目全称":"P' || {text('event_id')}
                   || '","备用":"x"}}}}' as row_json,
               case when event_type = 'view' then 'exported' else 'pending' end as state,
               ts
        from {{events}} where event_type in ('purchase', 'signup', 'view')
    """,
    "ledger_codes": f"""
        select distinct 'C' || {text('user_id')} as project_code from {{events}} where user_id % 10 = 0
    """,
    "compare_results": f"""
        select {text('cast(ts as date)')} as run_id, event_id as item_order,
               'C' || {text('user_id')} as project_code, 'P' || {text('event_id')} as project_name,
               event_type <> 'error' as passed,
               '{{{{"projectCode":"C' || {text('user_id')} || '","passed":'
                   || case when event_type <> 'error' then 'true' else 'false' end || '}}}}' as log_json
        from {{events}}
    """,
    "compare_runs": f"""
        select {text('cast(ts as date)')} as run_id, count(*) as total_count
        from {{events}} group by {text('cast(ts as date)')}
    """,
    # run log lines; some reports are cut short and must count as system lines
    "runtime_logs": f"""
        select event_id as id, 'default' as bucket, ts as created_at,
               case event_type
                   when 'view' then '[网页阶段] 完成: 下载=' || {text('user_id')} || ' | 跳过='
                       || {text('event_id % 7')} || ' | 错误=' || {text('event_id % 3')}
                   when 'click' then '[运行] 第 ' || {text('event_id')} || ' 行'
                   when 'signup' then '[缓存] 命中 ' || {text('event_id')}
                   else left('[项目比对] {{{{"projectName":"P' || {text('event_id')} || '","passed":'
                       || case when event_type = 'purchase' then 'true' else 'false' end
                       || ',"rows":[{{{{"fileName":"网页","projectCode":"❌"}}}},{{{{"fileName":"比对结果","projectCode":"'
                       || case when user_id % 2 = 0 then '❌' else '✅' end
                       || '","contactPhone":"' || case when user_id % 3 = 0 then '❌' else '—' end
                       || '"}}}}]}}}}', case when event_id % 50 = 0 then 60 else 2147483647 end)
               end as message
        from {{events}}
    """,
}

_TOKENS = {
    "spark": {"$arr(": "array(", "$none": "cast(array() as array<string>)"},
    "duck": {"$arr(": "list_value(", "$none": "cast([] as varchar[])"},
}


def _dialect(sql: str, engine: str) -> str:
    for token, form in _TOKENS[engine].items():
        sql = sql.replace(token, form)
    return sql


def _needs(sql: str) -> list[str]:
    return re.findall(r"(?<!\{)\{(\w+)\}", sql)


def with_derived(sql: str) -> str:
    """DuckDB query with the derived tables it mentions put in front."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in SQL and name not in order:
            for other in _needs(SQL[name]):
                visit(other)
            order.append(name)

    for name in SQL:
        if re.search(rf"\b{name}\b", sql):
            visit(name)
    ctes = []
    for name in order:
        body = _dialect(SQL[name], "duck")
        ctes.append(f"{name} as ({body.format(**{n: n for n in _needs(SQL[name])})})")
    if not ctes:
        return sql
    head = ",\n".join(ctes)
    body = sql.strip()
    if body.lower().startswith("with "):
        return f"with {head},\n{body[5:]}"
    return f"with {head}\n{body}"


RENDERED = {
    "packets": rendered.packets,
    "cells": rendered.cells,
    "summary_texts": rendered.summary_texts,
    "report_pages": rendered.report_pages,
    "web_texts": rendered.web_texts,
    "payloads": rendered.payloads,
    "detail_pages": rendered.detail_pages,
    "files": rendered.files,
    "todo_pages": partial(rendered.todo_pages, with_bad=False),
    "bad_todo_pages": partial(rendered.todo_pages, with_bad=True),
}
# rendered from another table than the sides
SOURCES = {
    "detail_pages": "packet_names", "todo_pages": "packet_base", "bad_todo_pages": "packet_base",
}
_stored: dict[tuple[str, str, str], str] = {}


class Tables:
    """Given and derived tables of one data folder, as attributes.

    Sides and documents are written to the shared folder on first use and read
    back, as a real run finds its documents stored.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._frames: dict[str, DataFrame] = {}

    def _store(self, name: str, df: DataFrame) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _stored:
            path = shared_dir(self.spark, name)
            df.write.parquet(path)
            _stored[key] = path
        return self.spark.read.schema(df.schema).parquet(_stored[key])

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._frames:
            if name in SQL:
                sql = _dialect(SQL[name], "spark")
                frames = {n: getattr(self, n) for n in _needs(SQL[name])}
                df = self.spark.sql(sql, **frames)
                if name == "packet_base":
                    # dealt out while rows are few and small: what is derived from them lies in as many files,
                    # so that small data isn't read by one task and large data isn't dealt out again
                    df = df.repartition(self.spark.sparkContext.defaultParallelism, "k")
                self._frames[name] = self._store(name, df) if name == "sides" else df
            elif name in RENDERED:
                source = getattr(self, SOURCES.get(name, "sides"))
                self._frames[name] = self._store(name, RENDERED[name](source))
            else:
                self._frames[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._frames[name]
