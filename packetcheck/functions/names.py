"""Loose equality of Chinese names by folded pinyin."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, SparkSession, functions as F

from packetcheck.functions.text import compact_text, contains_chinese, normalize_text

FIRST_HAN, LAST_HAN = 0x4E00, 0x9FFF
_NO_READING = "?"


def fold_syllable(marked: str) -> str:
    """Letters a-z of a toneless syllable; a final -ng after a, e, i, o becomes -n."""
    plain = "".join(
        ch
        for ch in unicodedata.normalize("NFC", _drop_tones(marked)).lower()
        if "a" <= ch <= "z"
    )
    return re.sub("(?<=[aeio]n)g$", "", plain)


def _drop_tones(marked: str) -> str:
    tones = {"\u0300", "\u0301", "\u0304", "\u030c"}
    return "".join(ch for ch in unicodedata.normalize("NFD", marked) if ch not in tones)


@lru_cache(maxsize=1)
def _syllables(transliterator) -> str:
    han = "\n".join(chr(c) for c in range(FIRST_HAN, LAST_HAN + 1))
    read = transliterator.transliterate(han).split("\n")
    return " ".join(
        _NO_READING if FIRST_HAN <= ord(s[0]) <= LAST_HAN else fold_syllable(s) for s in read
    )


def folded_syllables(spark: SparkSession | None = None) -> str:
    """Folded syllable of each Han character in code-point order, blank-separated.

    Readings come from the ICU library that ships with Spark, so the table has
    a fixed size of 20,992 entries whatever the data.
    """
    global _shared
    if _shared is None:
        spark = spark or SparkSession.active()
        icu = spark._jvm.com.ibm.icu.text.Transliterator
        _shared = _syllables(icu.getInstance("Han-Latin"))
    return _shared


_shared: str | None = None


def fold_name(c: Column) -> Column:
    """Name as folded pinyin; characters without a reading stay.

    The table is a constant array indexed by code point, so a lookup costs the
    same for every character and needs no join.
    """
    table = F.split(F.lit(folded_syllables()), " ")

    def fold(ch: Column) -> Column:
        syllable = F.get(table, F.ascii(ch) - FIRST_HAN)
        return F.when(
            F.ascii(ch).between(FIRST_HAN, LAST_HAN) & (syllable != _NO_READING), syllable
        ).otherwise(ch)

    chars = F.regexp_extract_all(c, F.lit("(?s)."), 0)
    return F.array_join(F.transform(chars, fold), "")


def names_match(left: Column, right: Column) -> Column:
    """Equal names; Chinese names also match without blanks or by sound."""
    a, b = normalize_text(left), normalize_text(right)
    ka, kb = compact_text(left), compact_text(right)
    by_sound = contains_chinese(ka) & contains_chinese(kb) & (
        (ka == kb) | (fold_name(ka) == fold_name(kb))
    )
    return F.coalesce((a != "") & (b != "") & ((a == b) | by_sound), F.lit(False))
