"""Text normalisation and document-text cleaning."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from packetcheck import vocab

# Every character with the Unicode White_Space property, as Java regex class.
WS = r"[\s\x{0085}\p{Z}]"


def normalize_text(c: Column) -> Column:
    """Runs of white space become one blank; both ends trimmed."""
    return F.trim(F.regexp_replace(c, WS + "+", " "))


def trim_text(c: Column) -> Column:
    """Unicode-aware trim; inner white space stays."""
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def compact_text(c: Column) -> Column:
    """Drop all white space."""
    return F.regexp_replace(c, WS, "")


def phone_digits(c: Column) -> Column:
    """ASCII digits only."""
    return F.regexp_replace(c, "[^0-9]", "")


def project_code(c: Column) -> Column:
    """Comparable project code: no blanks or zero-width marks, plain slash, upper case."""
    bare = F.regexp_replace(c, r"[\s\x{0085}\p{Z}\x{200B}-\x{200D}\x{FEFF}]", "")
    return F.upper(F.translate(bare, "／⁄∕", "///"))


def contains_chinese(c: Column) -> Column:
    return c.rlike(r"[\x{4e00}-\x{9fff}]")


def field_label(c: Column) -> Column:
    """Sheet label without line breaks, blanks and colons."""
    return trim_text(F.translate(c, "\n\r 　:：", ""))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def value_after(text: Column, label: str, stops: list[str]) -> Column:
    """Every value that follows ``label``, up to the nearest stop label.

    The value sits in a look-ahead, so a label inside another label's value
    still starts a value of its own. White space is normalised, leading colons
    go, empty values are skipped and repeats keep their first place.
    """
    found = F.regexp_extract_all(text, F.lit(_labelled(label, stops)), 1)
    cleaned = F.transform(found, _strip_colon)
    return F.array_distinct(F.filter(cleaned, lambda v: v != ""))


def first_value_after(text: Column, label: str, stops: list[str]) -> Column:
    """First non-empty value after ``label``, or the empty string."""
    return F.coalesce(F.get(value_after(text, label, stops), F.lit(0)), F.lit(""))


def value_after_first(text: Column, label: str, stops: list[str]) -> Column:
    """Value after the first occurrence of ``label`` only, maybe empty."""
    return _strip_colon(F.regexp_extract(text, _labelled(label, stops), 1))


def text_after(text: Column, label: str) -> Column:
    """All behind the first ``label``; null if absent."""
    at = F.instr(text, F.lit(label))
    return F.when(at > 0, F.substr(text, at + len(label)))


def _labelled(label: str, stops: list[str]) -> str:
    ends = "|".join([re.escape(s) for s in stops] + [r"\z"])
    return f"(?s){re.escape(label)}(?=(.*?)(?:{ends}))"


def _strip_colon(c: Column) -> Column:
    return F.regexp_replace(normalize_text(c), "^[:：]+", "")


# --- text rescued from word-processor files ---------------------------------

def strip_rtf(c: Column) -> Column:
    """RTF escapes, control words and braces become blanks."""
    no_hex = F.regexp_replace(c, r"\\'[0-9a-fA-F]{2}", " ")
    return F.translate(F.regexp_replace(no_hex, r"\\[a-zA-Z]+[0-9]* ?", " "), "{}", "  ")


def text_runs(c: Column) -> Column:
    """Readable runs of a noisy decoding, joined by blanks."""
    noise = r"[^\x21-\x7E\s\x{0085}\p{Z}\x{4e00}-\x{9fff}，。：；（）、—]+"
    runs = F.transform(F.split(c, noise), normalize_text)
    useful = r"[^0-9A-Za-z\x{4e00}-\x{9fff}]"
    kept = F.filter(runs, lambda r: F.char_length(F.regexp_replace(r, useful, "")) >= 2)
    return F.array_join(kept, " ")


def anchor_score(c: Column) -> Column:
    """How many of the five anchor labels occur in a summary text."""
    hits = [c.contains(label).cast("int") for label in vocab.SUMMARY_ANCHORS]
    return sum(hits[1:], hits[0])


def looks_like_summary(c: Column) -> Column:
    return anchor_score(c) > 0


# --- display ----------------------------------------------------------------

def display_value(c: Column) -> Column:
    """Trimmed value, or the word for "not recognised"."""
    return F.coalesce(blank_to_null(trim_text(c)), F.lit(vocab.UNRECOGNIZED))


def display_joined(values: Column) -> Column:
    shown = F.filter(
        F.transform(values, display_value), lambda v: v != vocab.UNRECOGNIZED
    )
    return F.coalesce(blank_to_null(F.array_join(shown, " | ")), F.lit(vocab.UNRECOGNIZED))


def display_date(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(vocab.UNRECOGNIZED))


def display_stamp(c: Column) -> Column:
    return F.when(c.isNull(), vocab.UNRECOGNIZED).when(c, "有").otherwise("无")
