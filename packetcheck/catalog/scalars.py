"""Queries over single functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from packetcheck.catalog import duck
from packetcheck.catalog.derived import NAMES, Tables, pick, quoted
from packetcheck.catalog.registry import query
from packetcheck.functions.dates import parse_date
from packetcheck.functions.names import fold_name, names_match
from packetcheck.functions.pages import (
    code_in_report, code_in_text, decode_js_string, detail_url, filled_url, folder_code,
    looks_expired, looks_like_html, looks_like_login, safe_filename, strip_html,
)
from packetcheck.functions.text import (
    compact_text, display_joined, display_value, field_label, normalize_text, phone_digits,
    project_code,
)
from packetcheck.functions.values import (
    as_fraction, confidence_number, is_meaningful, parse_amount, with_cell_value,
)

BASE = "https://portal.example.org"


@query("normalized_fields", f"""
    select project_name, {duck.norm("reg_name || '　 x'")} as text, {duck.compact('reg_name')} as compact,
           {duck.code('reg_code')} as code, {duck.digits('reg_phone')} as phone,
           regexp_replace(translate(reg_contact || ' ：' || project_name || ':　', ' 　:：', ''), '\\s', '', 'g') as label
    from sides
""")
def normalized_fields(t: Tables) -> DataFrame:
    c = F.col
    return t.sides.select(
        "project_name", normalize_text(F.concat("reg_name", F.lit("　 x"))).alias("text"),
        compact_text(c("reg_name")).alias("compact"), project_code(c("reg_code")).alias("code"),
        phone_digits(c("reg_phone")).alias("phone"),
        field_label(F.concat("reg_contact", F.lit(" ："), "project_name", F.lit(":　"))).alias("label"),
    )


@query("parsed_dates", f"""
    select project_name, coalesce(strftime({duck.date('reg_date_text')}, '%Y-%m-%d'), '∅') as plain,
           strftime(d, '%Y-%m-%d') as inside
    from sides
""")
def parsed_dates(t: Tables) -> DataFrame:
    inside = F.concat(F.lit("于 "), F.date_format("d", "yyyy 年 M月 d 日"), F.lit("验收"))
    return t.sides.select(
        "project_name",
        F.coalesce(parse_date(F.col("reg_date_text")).cast("string"), F.lit("∅")).alias("plain"),
        parse_date(inside).cast("string").alias("inside"),
    )


@query("parsed_amounts", f"""
    select project_name, {duck.amount('reg_amount')} as amount,
           case when k % 3 = 0 then null else cast(cents as double) end as number
    from sides
""")
def parsed_amounts(t: Tables) -> DataFrame:
    k = F.col("k")
    kind = F.when(k % 3 == 0, "bool").when(k % 3 == 1, "number").otherwise("string")
    return t.sides.select(
        "project_name", parse_amount(F.lit("string"), F.col("reg_amount")).alias("amount"),
        parse_amount(kind, F.col("cents").cast("string")).alias("number"),
    )


_LEFT = pick("c_custkey % 6", quoted(NAMES))
_RIGHT = pick("cast(floor(c_custkey / 6) as bigint) % 6", quoted(NAMES))


@query("name_matches", f"""
    with p as (select c_custkey, {_LEFT} as a,
        case when c_custkey % 5 = 0 then ' ' || substr({_RIGHT}, 1, 1) || ' ' || substr({_RIGHT}, 2) else {_RIGHT} end as b
        from customer)
    select c_custkey, {duck.fold(duck.compact('b'))} as folded, {duck.names_match('a', 'b')} as same from p
""")
def name_matches(t: Tables) -> DataFrame:
    right = F.expr(_RIGHT)
    spaced = F.concat(F.lit(" "), F.substring(right, 1, 1), F.lit(" "), F.substr(right, F.lit(2)))
    pairs = t.customer.select(
        "c_custkey", F.expr(_LEFT).alias("a"),
        F.when(F.col("c_custkey") % 5 == 0, spaced).otherwise(right).alias("b"),
    )
    return pairs.select(
        "c_custkey", fold_name(compact_text(F.col("b"))).alias("folded"),
        names_match(F.col("a"), F.col("b")).alias("same"),
    )


_CELL = """
    c as (
        select k, case when k % 4 < 2 then '验收日期' else '备注项' end as label,
               case k % 6 when 0 then 'string' when 1 then 'int' when 2 then 'float' when 3 then 'float'
                   when 4 then 'bool' else 'empty' end as kind,
               case k % 6 when 0 then case when k % 5 = 0 then ' 备注 ' when k % 5 = 1 then '项目 经理：' else 'v' || k end
                   when 4 then 'TRUE' end as s,
               case k % 6 when 1 then 46000 + k % 90 when 2 then 46000 + k % 90 when 3 then k % 90 + 0.5 end as n
        from packet_base
        union all
        select -1, '备注项', 'float', null, 12345678.5 union all select -2, '备注项', 'float', null, 0.0005
        union all select -3, '备注项', 'int', null, 10000000000000000000 union all select -4, '验收日期', 'datetime', '无', 5000000000
    )
"""


@query("cell_values", f"""
    with {_CELL}
    select k, case when label = '验收日期' and kind in ('int', 'float') and n >= 20000 then 'string'
                   when kind = 'bool' then 'bool' when kind = 'float' and n <> floor(n) then 'number'
                   when kind = 'empty' then '∅' else 'string' end as kind,
           case when kind = 'empty' then '∅'
                when label = '验收日期' and n between 20000 and 80000 then strftime(date '1899-12-30' + cast(floor(n) as int), '%Y-%m-%d')
                when kind = 'int' or (kind = 'float' and n = floor(n)) then cast(cast(n as decimal(38,0)) as string)
                when kind = 'float' then cast(cast(n as double) as string) when kind = 'bool' then 'true' else s end as s,
           kind <> 'empty' and not (kind = 'string' and (s = ' 备注 ' or s = '项目 经理：')) as meaningful
    from c
""")
def cell_values(t: Tables) -> DataFrame:
    cells = t.spark.sql(f"with {_CELL} select * from c".replace("packet_base", "{base}"), base=t.packet_base)
    cells = cells.withColumn("n", F.col("n").cast("double"))
    c = F.col
    valued = with_cell_value(cells, c("label"), c("kind"), c("s"), c("n"))
    return valued.select(
        "k", F.coalesce("value.kind", F.lit("∅")).alias("kind"),
        F.coalesce("value.s", F.lit("∅")).alias("s"), is_meaningful(c("value")).alias("meaningful"),
    )


@query("confidences", """
    select c_custkey, case c_custkey % 5 when 0 then (c_custkey % 100) / 100.0e0
        when 1 then case when c_custkey % 100 > 1 then (c_custkey % 100) / 100.0e0 else cast(c_custkey % 100 as double) end
        when 2 then 0.5e0 end as confidence from customer
""")
def confidences(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    raw = (
        F.when(k % 5 == 0, ((k % 100) / 100).cast("string"))
        .when(k % 5 == 1, F.concat((k % 100).cast("string"), F.lit(" %")))
        .when(k % 5 == 2, "+.5")
        .when(k % 5 == 3, (k % 100 + 101).cast("string"))
        .otherwise("n/a")
    )
    numbered = t.customer.select("c_custkey", confidence_number(raw).alias("x"))
    return numbered.select("c_custkey", as_fraction(F.col("x")).alias("confidence"))


_DASHED = f"""regexp_replace(regexp_replace({{0}}, '[\\x00-\\x1f\\x7f-\\x{{{{9f}}}}<>:"/\\\\|?*]', '-', 'g'), '-+', '-', 'g')"""
_CUT = "array_to_string(list_filter(string_split(substr({0}, 1, 120), ''), lambda c, i: strlen(substr({0}, 1, i - 1)) < 120), '')"


_NAMED = """case when regexp_full_match(split_part({0}, '.', 1), '(?i)(con|prn|aux|nul|com[1-9]|lpt[1-9])')
    then '_' || {0} else {0} end"""


@query("safe_names", f"""
    with a as (select doc_id, {_DASHED.format(f"replace({duck.norm('text')}, '/', '-')")} as folder,
                      {_DASHED.format(duck.norm("doc_id || '/' || text || '?'"))} as file from documents)
    select doc_id, {_NAMED.format(f"trim({_CUT.format('folder')}, ' .-')")} as folder,
           {_NAMED.format(f"trim({_CUT.format('file')}, ' .-')")} as file from a
""")
def safe_names(t: Tables) -> DataFrame:
    name = F.concat(F.col("doc_id").cast("string"), F.lit("/"), "text", F.lit("?"))
    return t.documents.select(
        "doc_id", folder_code(F.col("text")).alias("folder"), safe_filename(name).alias("file")
    )


@query("codes_in_text", """
    select o_orderkey, case when o_orderkey % 7 = 0 then '∅' else 'QXA-' || o_orderkey || case when o_orderkey % 2 = 0 then '/Z1' else '' end end as portal_code,
           case when o_orderkey % 3 = 0 then '' else 'QXB-' || lpad(cast(o_orderkey as string), 8, '0') || '/B1' end as report_code
    from orders
""")
def codes_in_text(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    portal = F.when(k % 7 == 0, "没有编号 12-34").otherwise(F.concat(
        F.lit("见 项目号： qxa-"), k.cast("string"), F.when(k % 2 == 0, "/z1 等").otherwise(" (x").cast("string")
    ))
    report = F.when(k % 3 == 0, "qxb-12/b1").otherwise(F.concat(
        F.lit("报告 qxb-"), F.lpad(k.cast("string"), 8, "0"), F.lit("/b1 完")
    ))
    return t.orders.select(
        "o_orderkey", F.coalesce(code_in_text(portal), F.lit("∅")).alias("portal_code"),
        code_in_report(report).alias("report_code"),
    )


_STRIP = "regexp_replace(regexp_replace({0}, '(?is)<(?:script|style)\\b[^>]*>.*?</(?:script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g')"
_ENTITIES = ("replace(replace(replace(replace(replace(replace({0}, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), "
             "'&gt;', '>'), '&quot;', '\"'), '&#39;', '''')")


@query("html_text", f"""
    select page_id, md5({duck.norm(_ENTITIES.format(_STRIP.format('html')))}) as digest,
           regexp_matches(html, '(?i)^\\s*<(!doctype html|html)') as is_html,
           regexp_matches(lower(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '登录|login')
             or regexp_matches(lower(html), 'name="(j_username|password)"|location.href ?= ?''/login.jsp')
             or (contains(lower(html), '<form') and contains(lower(html), 'login.do')) as is_login,
           regexp_matches({duck.norm('lower(html)')}, '请先登录|未登录|重新登录|登录超时|登录已超时|会话已失效|会话失效|login\\.jsp|session expired|session timeout|not logged in|login required') as is_expired
    from pages
""")
def html_text(t: Tables) -> DataFrame:
    html = F.col("html")
    return t.pages.select(
        "page_id", F.md5(strip_html(html)).alias("digest"), looks_like_html(html).alias("is_html"),
        looks_like_login(html).alias("is_login"), looks_expired(html).alias("is_expired"),
    )


@query("page_links", f"""
    select page_id, case when page_id % 2 = 0 then url else '{BASE}/' || ltrim(substr(url, 8), '/') end
               || case when contains(url, '?') then '&view=full' else '?view=full' end as detail,
           '{BASE}/files/get?id=' || page_id as download,
           '{BASE}/lists/a?page=' || page_id || '&size=100' as list
    from pages
""")
def page_links(t: Tables) -> DataFrame:
    path = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.substr("url", F.lit(8)))
    page = F.col("page_id").cast("string")
    return t.pages.select(
        "page_id", detail_url(path, BASE, "view=full").alias("detail"),
        filled_url("/files/get?id={id}", BASE, id=page).alias("download"),
        filled_url("/lists/{list}?page={page}&size=100", BASE, list=F.lit("a"), page=page).alias("list"),
    )


@query("script_strings", """
    select event_id, case when event_id % 2 = 0 then props else '坏\\q' || event_id end as decoded from events
""")
def script_strings(t: Tables) -> DataFrame:
    escaped = F.replace("props", F.lit('"'), F.lit('\\u0022'))
    raw = F.when(F.col("event_id") % 2 == 0, escaped).otherwise(
        F.concat(F.lit("坏\\q"), F.col("event_id").cast("string"))
    )
    return t.events.select("event_id", decode_js_string(raw).alias("decoded"))


@query("display_fields", """
    select c_custkey, case when c_custkey % 4 = 0 then '未识别' else c_name end as shown,
           case c_custkey % 3 when 0 then '未识别' when 1 then c_name else c_name || ' | ' || c_mktsegment end as joined
    from customer
""")
def display_fields(t: Tables) -> DataFrame:
    k, name = F.col("c_custkey"), F.col("c_name")
    many = F.when(k % 3 == 0, F.array(F.lit(" "), F.lit("未识别"))).when(
        k % 3 == 1, F.array(name, F.lit("　"))
    ).otherwise(F.array(F.concat(F.lit(" "), name), F.col("c_mktsegment")))
    return t.customer.select(
        "c_custkey", display_value(F.when(k % 4 == 0, " \t").otherwise(name)).alias("shown"),
        display_joined(many).alias("joined"),
    )
