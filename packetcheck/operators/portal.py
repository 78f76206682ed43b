"""Portal collection: to-do lists, detail pages, attachments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from packetcheck import vocab
from packetcheck.functions.pages import (
    code_in_text, decode_js_string, detail_field, folder_code, json_signals_expiry,
    looks_like_login, strip_html,
)
from packetcheck.functions.payload import (
    count_field, parse_object, string_at,
)
from packetcheck.functions.text import blank_to_null
from packetcheck.session import stored

# --- to-do lists ------------------------------------------------------------

PAGE_RANGE = 1_000


def reject_reason(body: Column) -> Column:
    """Why a to-do list response is unusable; null if it is fine."""
    return _reject_reason(body, parse_object(body))


def _reject_reason(body: Column, parsed: Column) -> Column:
    return (
        F.when(looks_like_login(body), "login_page")
        .when(parsed.isNull(), "not_json")
        .when(json_signals_expiry(body), "session_expired")
        .when(F.try_variant_get(parsed, "$.datas", "array<variant>").isNull(), "no_datas")
    )


def todo_lists(pages: DataFrame) -> DataFrame:
    """Usable responses of ``category, page_no, body`` with totals and raw rows."""
    v = F.col("v")
    return (
        pages.filter(reject_reason(F.col("body")).isNull())
        .withColumn("v", parse_object(F.col("body")))
        .select(
            "category", "page_no",
            count_field(v, vocab.TOTAL_COUNT_KEYS).alias("total_count"),
            count_field(v, vocab.TOTAL_PAGE_KEYS).alias("total_pages"),
            F.try_variant_get(v, "$.datas", "array<variant>").alias("rows"),
        )
    )


def read_pages(pages: DataFrame) -> DataFrame:
    """Every response parsed once: per row of its list ``category, page_no, why, total_count,
    total_pages, pos, fd_id, subject, detail_path``; a page without rows, or one that is
    rejected (``why``), has one row without a place.
    """
    v, why = F.col("v"), F.col("why")
    rows = F.when(why.isNull(), F.try_variant_get(v, "$.datas", "array<variant>"))
    opened = (
        pages.withColumn("v", parse_object(F.col("body")))
        .withColumn("why", _reject_reason(F.col("body"), v))
        .select(
            "category", "page_no", "why",
            F.when(why.isNull(), count_field(v, vocab.TOTAL_COUNT_KEYS)).alias("total_count"),
            F.when(why.isNull(), count_field(v, vocab.TOTAL_PAGE_KEYS)).alias("total_pages"),
            F.posexplode_outer(rows).alias("pos", "raw"),
        )
        .withColumn("pairs", _pairs(F.col("raw")))
    )
    return opened.select("category", "page_no", "why", "total_count", "total_pages", "pos", *_item(F.col("pairs")))


def _pairs(raw: Column) -> Column:
    """Columns and values of a list row."""
    return F.transform(
        F.try_variant_get(raw, "$", "array<variant>"),
        lambda c: F.struct(
            string_at(c, "$.col").alias("col"),
            F.coalesce(string_at(c, "$.value"), F.lit("")).alias("value"),
        ),
    )


def _item(pairs: Column) -> list[Column]:
    return [
        _row_value(pairs, "fdId").alias("fd_id"),
        strip_html(_row_value(pairs, "todo.subject4View")).alias("subject"),
        _row_value(pairs, "tr_href", "_tr_href").alias("detail_path"),
    ]


def _row_value(pairs: Column, *names: str) -> Column:
    """Last value of the first named column present in a list row."""

    def value(name: str) -> Column:
        return F.try_element_at(F.filter(pairs, lambda p: p["col"] == name), F.lit(-1))["value"]

    return F.coalesce(*[value(name) for name in names], F.lit(""))


def todo_rows(lists: DataFrame) -> DataFrame:
    """Items of the to-do lists in page order; rows without a link are skipped."""
    # a one-element explode, so that the filter below is not pushed into the
    # parsing and every row is read once
    return (
        lists.select("category", "page_no", F.posexplode_outer("rows").alias("pos", "raw"))
        .withColumn("pairs", _pairs(F.col("raw")))
        .select("category", "page_no", "pos", F.explode_outer(F.array(F.struct(*_item(F.col("pairs"))))).alias("i"))
        .select("category", "page_no", "pos", "i.*")
        .filter(F.col("detail_path") != "")
    )


def first_items(rows: DataFrame) -> DataFrame:
    """Each item once per category, where it first appears.

    An aggregate rather than a window: repeats collapse before the shuffle.
    """
    key = F.when(F.col("fd_id") != "", F.concat(F.lit("id:"), "fd_id")).otherwise(
        F.concat(F.lit("path:"), "detail_path")
    )
    rest = [c for c in rows.columns if c not in ("category", "page_no", "pos")]
    first = F.min_by(F.struct("page_no", "pos", *rest), F.struct("page_no", "pos"))
    return (
        rows.withColumn("item_key", key)
        .groupBy("category", "item_key")
        .agg(first.alias("f"))
        .select("category", "item_key", "f.*")
    )


def page_progress(lists: DataFrame, items: DataFrame) -> DataFrame:
    """Per list page: its new items, all loaded so far, whether paging ends there, and
    whether it is ``reached``: it and all pages before it are there and usable.

    Paging ends on an empty page, one without anything new, the last page by
    its number, or when all announced items are loaded. The sums run over page
    summaries, never over items: within ranges of pages, and over the ranges.
    """
    fresh = items.groupBy("category", "page_no").agg(F.count("*").alias("fresh"))
    span = F.floor(F.col("page_no") / PAGE_RANGE)
    pages = (
        lists.groupBy("category", "page_no")
        .agg(F.max("total_count").alias("total_count"), F.max("total_pages").alias("total_pages"))
        .join(fresh, ["category", "page_no"], "left")
        .na.fill(0, ["fresh"])
        .withColumn("range", span)
    )
    ranges = pages.groupBy("category", "range").agg(
        F.sum("fresh").alias("items"), F.count("*").alias("pages")
    )
    before = Window.partitionBy("category").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(
        "category", "range",
        *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"{x}_before") for x in ("items", "pages")],
    )
    within = Window.partitionBy("category", "range").orderBy("page_no").rowsBetween(
        Window.unboundedPreceding, 0
    )
    pages = pages.join(ranges, ["category", "range"])
    loaded = F.col("items_before") + F.sum("fresh").over(within)
    reached = F.col("pages_before") + F.count("*").over(within) == F.col("page_no")
    by_pages = (F.col("total_pages") > 0) & (F.col("page_no") >= F.col("total_pages"))
    by_count = (F.col("total_count") > 0) & (F.col("loaded") >= F.col("total_count"))
    ends = (F.col("fresh") == 0) | F.coalesce(by_pages, F.lit(False)) | F.coalesce(
        by_count, F.lit(False)
    )
    summed = pages.withColumns({"loaded": loaded, "reached": reached})
    return summed.withColumn("ends", ends).drop("range", "items_before", "pages_before")


def paging_ends(pages: DataFrame, progress: DataFrame) -> DataFrame:
    """Per category its last page, and why collecting ends behind it.

    ``pages``: category, page_no, why (it is rejected). ``end_reason`` is ``complete`` where paging ends by itself. A page that is
    rejected or absent ends its category too: then it is the page's reject reason,
    or ``missing_page``; ``open`` means that no further page is known.
    """
    done = F.when(F.col("ends") & F.col("reached"), F.col("page_no"))
    ends = progress.groupBy("category").agg(
        F.min(done).alias("done"), F.max(F.when(F.col("reached"), F.col("page_no"))).alias("last")
    )
    known = pages.groupBy("category").agg(F.max("page_no").alias("known"))
    ends = known.join(ends, "category", "left").select(
        "category", "known", F.col("done").isNotNull().alias("is_done"),
        F.coalesce("done", "last", F.lit(0)).alias("stop_page"),
    )
    rejected = pages.filter(F.col("why").isNotNull()).groupBy(
        "category", F.col("page_no").alias("bad_page")
    ).agg(F.min("why").alias("why"))
    at = (ends["category"] == rejected["category"]) & (ends["stop_page"] + 1 == rejected["bad_page"])
    reason = (
        F.when(F.col("is_done"), "complete").when(F.col("why").isNotNull(), F.col("why"))
        .when(F.col("known") > F.col("stop_page"), "missing_page").otherwise("open")
    )
    return ends.join(rejected, at, "left").select(
        ends["category"], "stop_page", reason.alias("end_reason")
    )


def collected(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """De-duplicated items up to the page where each category ends, and the ends.

    Pages are parsed once and stored, and so are the items: where paging ends
    depends on all of them.
    """
    read = stored(read_pages(pages), "todo-pages")
    lists = read.filter("why is null")
    rows = lists.filter("detail_path <> ''").select("category", "page_no", "pos", "fd_id", "subject", "detail_path")
    items = stored(first_items(rows), "todo-items")
    ends = paging_ends(read, page_progress(lists, items))
    kept = items.join(ends.select("category", "stop_page"), "category")
    return kept.filter(F.col("page_no") <= F.col("stop_page")).drop("stop_page"), ends


def collected_items(pages: DataFrame) -> DataFrame:
    """The items of ``collected``."""
    return collected(pages)[0]


# --- detail pages -----------------------------------------------------------

_QUOTED = r'"([^"\\]*+(?:\\.[^"\\]*+)*+)"'
_ADD_DOC = (
    r"addDoc\(" + _QUOTED + r',"([0-9a-f]+)",(?:true|false),'
    + ",".join([_QUOTED] * 4) + r"\s*\);"
)


ATTACHMENTS_TYPE = (
    "array<struct<name:string,fd_id:string,mime_type:string,size:string,file_key:string>>"
)


def announced(html: Column, section: str = vocab.ATTACHMENT_SECTION) -> Column:
    """Attachments announced from a page section on to the page's end, in page order."""
    at = F.instr(html, F.lit(section))
    part = F.when(at > 0, F.substr(html, at))
    calls = F.regexp_extract_all(part, F.lit(_ADD_DOC), 0)

    def attachment(call: Column) -> Column:
        def group(n: int) -> Column:
            return F.regexp_extract(call, _ADD_DOC, n)

        return F.struct(
            decode_js_string(group(1)).alias("name"),
            group(2).alias("fd_id"),
            decode_js_string(group(3)).alias("mime_type"),
            decode_js_string(group(4)).alias("size"),
            decode_js_string(group(5)).alias("file_key"),
        )

    return F.coalesce(F.transform(calls, attachment), F.array().cast(ATTACHMENTS_TYPE))


def first_by_id(attachments: Column) -> Column:
    """Each attachment id once, where it first stands."""
    return F.filter(
        attachments, lambda a, i: F.array_position(attachments["fd_id"], a["fd_id"]) == i + 1
    )


def is_message(a: Column) -> Column:
    name = F.lower(a["name"])
    return name.endswith(".eml") | name.endswith(".msg") | (a["mime_type"] == "message/rfc822")


def has_role(a: Column, role: tuple[str, list[str]]) -> Column:
    """Attachment name holds the role's keyword and ends with one of its extensions."""
    keyword, extensions = role
    name = F.lower(a["name"])
    return name.contains(keyword) & name.rlike(r"\.(" + "|".join(extensions) + ")$")


def with_choice(records: DataFrame) -> DataFrame:
    """Add ``chosen``, at most three attachments: one per role, then in page order.

    A record's attachments stay in one array, so the choice is a projection.
    """
    usable = F.col("_usable")

    def first(role: tuple[str, list[str]]) -> Column:
        return F.slice(F.filter(usable, lambda a: has_role(a, role)), 1, 1)

    roles = [vocab.REGISTRY_ROLE, vocab.SUMMARY_ROLE, vocab.REPORT_ROLE]
    chosen = F.concat("_picked", F.array_except("_usable", "_picked"))
    return (
        records.withColumn("_usable", F.filter("attachments", lambda a: ~is_message(a)))
        .withColumn("_picked", F.concat(*[first(role) for role in roles]))
        .withColumn("chosen", F.slice(chosen, 1, vocab.ATTACHMENTS_KEPT))
        .drop("_usable", "_picked")
    )


def detail_records(details: DataFrame) -> DataFrame:
    """``fd_id, subject, html`` to portal records; ``error`` says what is missing."""
    html = F.col("html")
    field = detail_field(html, "项目编号")
    code = F.coalesce(code_in_text(field), field, code_in_text(F.col("subject")))
    parsed = details.select(
        *[c for c in details.columns if c != "html"],
        looks_like_login(html).alias("is_login"),
        code.alias("project_code"),
        detail_field(html, "项目名称").alias("project_name"),
        announced(html).alias("announced"),
    ).withColumn("attachments", first_by_id(F.col("announced"))).drop("announced")
    error = (
        F.when(F.col("is_login"), "session_expired")
        .when(F.col("project_code").isNull(), "no_code")
        .when(F.col("project_name").isNull(), "no_name")
    )
    return parsed.withColumn("error", error).drop("is_login")


def marked_skips(records: DataFrame, skip_codes: DataFrame) -> DataFrame:
    """Add ``code``, the folder code, and ``skipped``: whether ``skip_codes`` has it."""
    coded = records.withColumn("code", folder_code(F.col("project_code")))
    skips = skip_codes.select("code").distinct().withColumn("skipped", F.lit(True))
    return coded.join(skips, "code", "left").na.fill(False, ["skipped"])
