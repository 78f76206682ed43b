"""Dates written by people."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from packetcheck.functions.text import compact_text

_WHOLE = (
    r"^[0-9]{1,4}(?:([-/.])[0-9]{1,2}\1[0-9]{1,2}|年[0-9]{1,2}月[0-9]{1,2}日)$"
)
_INSIDE = r"(?U)\d{4}\s*年\s*\d{1,2}\s*月\s*\d{1,2}\s*日"


def parse_date(c: Column) -> Column:
    """Date in any of the accepted notations, else null.

    The whole text without blanks may be ``Y-M-D`` with ``-``, ``/`` or ``.``,
    ``Y年M月D日`` or eight digits; failing these, the first ``Y年M月D日`` inside
    the text counts. The notations exclude each other, so one parse is enough.
    """
    k = compact_text(c)
    whole = F.when(k.rlike(_WHOLE), F.translate(k, "/.年月日", "----"))
    digits = F.when(
        k.rlike("^[0-9]{8}$"), F.regexp_replace(k, "^(.{4})(..)(..)$", "$1-$2-$3")
    )
    inside = F.translate(compact_text(F.regexp_extract(c, _INSIDE, 0)), "年月日", "--")
    return F.try_to_date(F.coalesce(whole, digits, inside), "y-M-d")


def first_date(*candidates: Column) -> Column:
    """First candidate text that is a date."""
    return F.coalesce(*[parse_date(c) for c in candidates])


def excel_serial_date(n: Column) -> Column:
    """Date of a spreadsheet day number; null outside the years 1 to 9999."""
    day = F.when(n.between(-693_593, 2_958_465), F.floor(n)).cast("int")
    return F.date_add(F.lit("1899-12-30").cast("date"), day)
