"""Typed values: spreadsheet cells, JSON scalars, amounts, confidences.

A value is ``struct<kind string, s string>`` with kind ``string``, ``number``
or ``bool``; a missing value is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from packetcheck import vocab
from packetcheck.functions.dates import excel_serial_date, parse_date
from packetcheck.functions.text import field_label, normalize_text, trim_text

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def make_value(kind, s: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(kind.alias("kind"), s.alias("s"))


def value_text(value: Column) -> Column:
    """Normalised text of a value; empty for a missing one."""
    s = value["s"]
    text = F.when(value["kind"] == "string", normalize_text(s)).otherwise(s)
    return F.coalesce(text, F.lit(""))


def parse_number(c: Column) -> Column:
    """Decimal text to double; anything else, NaN and infinities too, is null."""
    return F.when(c.rlike(_NUMBER), c.try_cast("double"))


def parse_amount(kind: Column, s: Column) -> Column:
    """Amount in units of ten thousand; bools have none.

    Number texts hold none of the characters removed, so one form serves both.
    """
    bare = F.translate(normalize_text(s), ",，", "")
    bare = F.replace(F.replace(bare, F.lit("万元"), F.lit("")), F.lit("万"), F.lit(""))
    return parse_number(F.when(kind != "bool", trim_text(bare)))


def confidence_number(s: Column) -> Column:
    """Number of a confidence value; a percent sign is left out."""
    return parse_number(trim_text(F.regexp_replace(normalize_text(s), "%+$", "")))


def as_fraction(number: Column) -> Column:
    """Fraction in 0..1 from a fraction or a percent number; others are null."""
    return F.when(number.between(0, 1), number).when(number.between(1, 100), number / 100)


# --- cells ------------------------------------------------------------------

def plain_number(n: Column) -> Column:
    """Shortest decimal text of a number, without an exponent where it fits 38 digits."""
    text = n.cast("string")
    exact = F.regexp_replace(text.try_cast("decimal(38,18)").cast("string"), r"\.?0+$", "")
    return F.when(text.contains("E") & (F.abs(n) >= 1e-17), F.coalesce(exact, text)).otherwise(text)


def cell_string(kind: Column, s: Column, n: Column) -> Column:
    """Cell content as text; whole numbers without a fraction part."""
    whole = (kind == "int") | ((kind == "float") & (n == F.floor(n)))
    return (
        F.when(whole, F.coalesce(n.try_cast("decimal(38,0)").cast("string"), n.cast("string")))
        .when(kind == "float", plain_number(n))
        .when(kind == "bool", F.lower(s))
        .when(kind == "datetime", F.coalesce(s, n.cast("string")))
        .when(kind != "empty", s)
    )


def cell_kind(kind: Column, n: Column) -> Column:
    """Kind of the value a cell holds."""
    return (
        F.when(kind == "bool", "bool")
        .when((kind == "float") & (n != F.floor(n)), "number")
        .otherwise("string")
    )


def cell_text(kind: Column, s: Column, n: Column) -> Column:
    """Cell as one-line text."""
    text = F.coalesce(cell_string(kind, s, n), F.lit(""))
    return trim_text(F.translate(text, "\n", ""))


def cell_day(label: Column, kind: Column, s: Column, n: Column, text: Column) -> Column:
    """ISO date of a cell under a date label; null elsewhere or if it is none."""
    serial = (
        F.when(
            (kind == "datetime") | (kind.isin("int", "float") & n.between(20_000, 80_000)),
            excel_serial_date(n),
        )
        .when(kind == "datetime_iso", F.try_to_date(F.regexp_extract(s, r"^(\d{4}-\d{2}-\d{2})(?:[T ].*)?$", 1), "yyyy-MM-dd"))
    )
    return F.when(
        label.rlike("日期|时间"), F.coalesce(parse_date(text), serial).cast("string")
    )


def with_cell_value(df: DataFrame, label: Column, kind: Column, s: Column, n: Column) -> DataFrame:
    """Add ``value``, the cell read under a label; null for an empty cell.

    Text and date are projected one after the other, so neither is computed
    more than once per row.
    """
    text, day = F.col("_text"), F.col("_day")
    value = make_value(
        F.when(day.isNotNull(), "string").otherwise(cell_kind(kind, n)), F.coalesce(day, text)
    )
    return (
        df.withColumn("_text", cell_string(kind, s, n))
        .withColumn("_day", cell_day(label, kind, s, n, text))
        .withColumn("value", F.when(text.isNotNull(), value))
        .drop("_text", "_day")
    )


def is_meaningful(value: Column) -> Column:
    """Whether a cell next to a label can be that label's value."""
    text = trim_text(value["s"])
    labels = [label.translate(str.maketrans("", "", "\n\r 　:：")) for label in vocab.REGISTRY_LABELS]
    reserved = [vocab.FIELD_HEADER, vocab.CONTENT_HEADER, vocab.REMARK, vocab.SHEET_TITLE]
    wordy = (text != "") & ~field_label(text).isin(labels) & ~text.isin(reserved)
    return F.coalesce(F.when(value["kind"] == "string", wordy).otherwise(value.isNotNull()), F.lit(False))
