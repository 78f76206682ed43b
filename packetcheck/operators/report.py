"""Acceptance reports: page texts to a typed signature record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from packetcheck import vocab
from packetcheck.functions.dates import parse_date
from packetcheck.functions.pages import code_in_report
from packetcheck.functions.text import (
    blank_to_null, normalize_text, phone_digits, value_after_first,
)

REPORT_TYPE = (
    "struct<project_code:string,signer_name:string,signer_phone:string,sign_date:date,"
    "has_red_stamp:boolean,name_conf:double,phone_conf:double,date_conf:double>"
)


def joined_pages(pages: DataFrame) -> DataFrame:
    """``project_name, page, text`` to one text per report, pages in order.

    A report is one document; its whole text must be one value because a label
    and its value may stand on different pages.
    """
    ordered = F.array_sort(F.collect_list(F.struct("page", "text")))
    lines = F.transform(ordered, lambda p: p["text"])
    return pages.groupBy("project_name").agg(F.array_join(lines, "\n").alias("text"))


def signer_name(text: Column) -> Column:
    tries = [blank_to_null(value_after_first(text, label, stops)) for label, stops in vocab.SIGNER_RULES]
    return F.coalesce(*tries, F.lit(""))


def signer_phone(text: Column) -> Column:
    """First mobile number between a phone label and the next label or the end."""
    tries = []
    for label in vocab.PHONE_LABELS:
        digits = phone_digits(value_after_first(text, label, vocab.PHONE_STOPS))
        tries.append(blank_to_null(F.regexp_extract(digits, vocab.PHONE, 0)))
    return F.coalesce(*tries, F.lit(""))


def sign_date(text: Column) -> Column:
    """First date written forwards, else day-first as handwriting is often read."""
    direct = parse_date(F.regexp_extract(text, "(?U)" + vocab.SIGN_DATE, 0))
    backwards = F.regexp_replace(
        F.regexp_extract(text, "(?U)" + vocab.SIGN_DATE_DAY_FIRST, 0),
        "(?U)" + vocab.SIGN_DATE_DAY_FIRST,
        "$2-$3-$1",
    )
    return F.coalesce(direct, F.try_to_date(blank_to_null(backwards), "y-M-d"))


def report_struct(
    code: Column, name: Column, phone: Column, date: Column,
    stamp: Column | None = None,
    confidences: tuple[Column, Column, Column] | None = None,
) -> Column:
    none = F.lit(None).cast("double")
    name_conf, phone_conf, date_conf = confidences or (none, none, none)
    return F.struct(
        code.alias("project_code"),
        name.alias("signer_name"),
        phone.alias("signer_phone"),
        date.alias("sign_date"),
        (F.lit(False) if stamp is None else stamp).alias("has_red_stamp"),
        name_conf.alias("name_conf"),
        phone_conf.alias("phone_conf"),
        date_conf.alias("date_conf"),
    )


def report_from_text(text: Column) -> Column:
    """Signature record of a report text."""
    t = normalize_text(text)
    return report_struct(code_in_report(t), signer_name(t), signer_phone(t), sign_date(t))


def report_records(texts: DataFrame) -> DataFrame:
    """``project_name, text`` to one ``report`` struct per project."""
    return texts.select("project_name", report_from_text(F.col("text")).alias("report"))
