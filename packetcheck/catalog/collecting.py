"""Queries over portal pages and attachments."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from packetcheck.catalog.derived import Tables
from packetcheck.catalog.registry import query
from packetcheck.operators.portal import (
    collected, collected_items, detail_records, first_items, marked_skips, page_progress,
    reject_reason, todo_lists, todo_rows, with_choice,
)

_SHOWN = """
    own as (select category, k, cast(floor(k / 500) as bigint) + 1 as own from packet_base),
    shown as (
        select category, k, own as page_no from own where not (category = '4-NOT SPECIFIED' and own = 3)
        union all
        select category, k, own + 1 from own where k % 100 = 0 or (category = '4-NOT SPECIFIED' and own = 2)
    ),
    linked as (select * from shown where k % 11 <> 5),
    firsts as (select category, k, min(page_no) as page_no from linked group by category, k),
    pages as (select category, page_no from shown group by category, page_no),
    progress as (
        select p.category, p.page_no,
               (select count(*) from firsts f where f.category = p.category and f.page_no = p.page_no) as fresh
        from pages p
    ),
    loaded as (
        select *, cast(sum(fresh) over (partition by category order by page_no) as bigint) as loaded from progress
    ),
    ends as (
        select *, fresh = 0 or (category = '1-URGENT' and page_no >= 20) or (category = '2-HIGH' and page_no >= 25)
                  or (category = '3-MEDIUM' and loaded >= 1000) as ends from loaded
    )
"""


@query("todo_progress", f"""
    with {_SHOWN} select category, page_no, fresh, loaded, ends from ends
""")
def todo_progress(t: Tables) -> DataFrame:
    lists = todo_lists(t.todo_pages)
    pages = page_progress(lists, first_items(todo_rows(lists)))
    return pages.select(
        "category", F.col("page_no").cast("bigint").alias("page_no"), "fresh", "loaded", "ends"
    )


@query("todo_items", f"""
    with {_SHOWN},
    stops as (select category, min(page_no) as stop_page from ends where ends group by category)
    select f.category, case when k % 10 = 3 then '' else 't' || k end as fd_id, '项目号：QXA-' || k as subject,
           '/d/' || k as detail_path, f.page_no
    from firsts f left join stops s on s.category = f.category where f.page_no <= coalesce(stop_page, f.page_no)
""")
def todo_items(t: Tables) -> DataFrame:
    items = collected_items(t.todo_pages)
    return items.select(
        "category", "fd_id", "subject", "detail_path", F.col("page_no").cast("bigint").alias("page_no")
    )


@query("todo_ends", f"""
    with {_SHOWN},
    bad as (
        select category, min(page_no) as page_no from pages
        where (category in ('1-URGENT', '2-HIGH') and page_no % 7 = 3) or (category = '3-MEDIUM' and page_no % 6 = 5)
        group by category
    ),
    done as (select category, min(page_no) as page_no from progress where fresh = 0 group by category),
    last as (select category, max(page_no) as page_no from pages group by category)
    select l.category, least(coalesce(b.page_no - 1, l.page_no), coalesce(d.page_no, l.page_no)) as stop_page,
           case when d.page_no < coalesce(b.page_no, d.page_no + 1) then 'complete' when b.page_no is null then 'open'
                when l.category = '3-MEDIUM' then 'login_page' else 'missing_page' end as end_reason
    from last l left join bad b on b.category = l.category left join done d on d.category = l.category
""")
def todo_ends(t: Tables) -> DataFrame:
    """One category lacks a page, one has a login page; no page says how many there are."""
    no, category = F.col("page_no"), F.col("category")
    login = F.lit("<html><head><title>登录</title></head></html>")
    body = F.regexp_replace("body", '"(totalPage|pageCount|total)":("[^"]*"|[0-9]+),', "")
    pages = t.todo_pages.filter(~(category.isin("1-URGENT", "2-HIGH") & (no % 7 == 3))).withColumn(
        "body", F.when((category == "3-MEDIUM") & (no % 6 == 5), login).otherwise(body)
    )
    return collected(pages)[1].select(
        "category", F.col("stop_page").cast("bigint").alias("stop_page"), "end_reason"
    )


@query("todo_rejects", f"""
    with {_SHOWN}
    select category, page_no, case page_no % 6 when 1 then 'login_page' when 2 then 'no_datas'
        when 3 then 'session_expired' when 4 then 'not_json' else '' end as reason from pages
""")
def todo_rejects(t: Tables) -> DataFrame:
    return t.bad_todo_pages.select(
        "category", F.col("page_no").cast("bigint").alias("page_no"),
        F.coalesce(reject_reason(F.col("body")), F.lit("")).alias("reason"),
    )


_FOUND = """
    calls as (
        select *, unnest(range(0, k % 7)) as i from packet_names where k % 7 > 0
    ),
    found as (
        select project_name, k, i, (k + i) % 5 as kind,
               i || '-' || ['关闭移交登记表.xlsx', '竣工总结报告.docx', '竣工验收报告.PDF', '来往.eml', '其他.zip'][(k + i) % 5 + 1] as name
        from calls where not (k % 9 = 0 and i = 1)
    )
"""


@query("attachments", f"""
    with {_FOUND}
    select project_name, name, md5(k || '-' || i) as fd_id,
           row_number() over (partition by project_name order by i) - 1 as pos from found
""")
def attachments(t: Tables) -> DataFrame:
    records = detail_records(t.detail_pages)
    # the listing keeps pages by id: the project name may be missing on the page
    ids = t.sides.select(F.md5(F.col("k").cast("string")).alias("page"), F.col("project_name").alias("packet"))
    rows = records.select("fd_id", F.posexplode_outer("attachments").alias("pos", "a"))
    return (
        rows.filter(F.col("pos").isNotNull())
        .join(ids, F.col("fd_id") == F.col("page"))
        .select(F.col("packet").alias("project_name"), "a.name", "a.fd_id",
                F.col("pos").cast("bigint").alias("pos"))
    )


@query("attachment_choice", f"""
    with {_FOUND},
    ranked as (
        select *, case when kind < 3 and row_number() over (partition by k, kind order by i) = 1 then kind else 3 end as prio
        from found where kind <> 3
    ),
    chosen as (select *, row_number() over (partition by k order by prio, i) as rank from ranked)
    select md5(cast(p.k as string)) as page, coalesce(string_agg(name, '|' order by rank), '') as chosen
    from packet_names p left join chosen c on c.k = p.k and rank <= 3 group by p.k
""")
def attachment_choice(t: Tables) -> DataFrame:
    records = detail_records(t.detail_pages)
    return with_choice(records).select(
        F.col("fd_id").alias("page"), F.array_join("chosen.name", "|").alias("chosen")
    )


_DETAIL = """
    detail as (
        select md5(cast(k as string)) as fd_id,
               case when k % 24 = 5 then '∅' else code end as project_code,
               case when k % 14 = 6 then '∅' else title end as project_name,
               case when k % 24 = 5 then 'no_code' when k % 14 = 6 then 'no_name' else '' end as error
        from packet_names
    )
"""


@query("detail_records", f"with {_DETAIL} select * from detail")
def detail_records_query(t: Tables) -> DataFrame:
    r = detail_records(t.detail_pages)
    none = F.lit("∅")
    return r.select(
        "fd_id", F.coalesce("project_code", none).alias("project_code"),
        F.coalesce("project_name", none).alias("project_name"),
        F.coalesce("error", F.lit("")).alias("error"),
    )


@query("skipped_records", f"""
    with {_DETAIL}
    select replace(project_code, '/', '-') as code,
           case when substr(project_code, 12, 1) in ('0', '5') then 'skipped' else 'kept' end as outcome
    from detail where error = ''
""")
def skipped_records(t: Tables) -> DataFrame:
    good = detail_records(t.detail_pages).filter(F.col("error").isNull())
    skips = t.sides.filter(F.col("k") % 5 == 0).select(F.translate("code", "/", "-").alias("code"))
    outcome = F.when(F.col("skipped"), "skipped").otherwise("kept").alias("outcome")
    return marked_skips(good, skips).select("code", outcome)
