"""Portal pages: HTML text, codes in free text, safe names, links, page state."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from packetcheck import vocab
from packetcheck.functions.text import WS, blank_to_null, normalize_text

def strip_html(c: Column) -> Column:
    """Text of an HTML fragment, without scripts and styles."""
    text = F.regexp_replace(
        c, r"(?is)<(?:script|style)\b[^>]*>.*?</(?:script|style)>", " "
    )
    text = F.regexp_replace(text, "<[^>]+>", " ")
    for entity, char in vocab.ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return normalize_text(text)


def decode_js_string(c: Column) -> Column:
    """Body of a quoted script string with its escapes resolved, or as it is."""
    escaped = F.when(c.contains("\\"), c)
    decoded = F.from_json(F.concat(F.lit('{"v":"'), escaped, F.lit('"}')), "v string")["v"]
    return F.coalesce(decoded, c)


def detail_field(html: Column, label: str) -> Column:
    """Text of the table cell after a label; null if blank or missing."""
    tagged = F.instr(html, F.lit(f"<label>{label}</label>"))
    at = F.when(tagged > 0, tagged).otherwise(F.instr(html, F.lit(label)))
    tail = F.when(at > 0, F.substr(html, at))
    return blank_to_null(strip_html(F.get(F.split(tail, "</td>", 3), F.lit(1))))


def code_in_text(c: Column) -> Column:
    """Project code found in free text, upper-cased; null if there is none."""
    pattern = r"(?i)(?:项目号|项目编号)?[:：]?" + WS + r"*([A-Z]+-[0-9]+(?:/[A-Z0-9]+)?)"
    return F.upper(blank_to_null(F.regexp_extract(c, pattern, 1)))


def code_in_report(c: Column) -> Column:
    """Project code found in report text, or the empty string."""
    return F.regexp_extract(F.upper(c), vocab.REPORT_CODE, 0)


def safe_component(c: Column) -> Column:
    """Text usable as a path component on any file system."""
    dashed = F.regexp_replace(c, r"[\p{Cc}<>:\"/\\|?*]", "-")
    dashed = F.regexp_replace(dashed, "-+", "-")
    limit = vocab.SAFE_NAME_BYTES
    chars = F.regexp_extract_all(F.substring(dashed, 1, limit), F.lit("(?s)."), 0)
    cut = F.aggregate(
        chars,
        F.lit(""),
        lambda kept, ch: F.when(F.octet_length(kept) < limit, F.concat(kept, ch)).otherwise(kept),
    )
    bounded = F.when(F.octet_length(dashed) > limit, cut).otherwise(dashed)
    trimmed = F.regexp_replace(bounded, "^[ .-]+|[ .-]+$", "")
    stem = F.upper(F.substring_index(trimmed, ".", 1))
    return F.when(
        stem.isin(vocab.WINDOWS_RESERVED), F.concat(F.lit("_"), trimmed)
    ).otherwise(trimmed)


def folder_code(c: Column) -> Column:
    """Project code as folder name. Case stays, unlike ``text.project_code``."""
    return safe_component(F.translate(normalize_text(c), "/", "-"))


def safe_filename(c: Column) -> Column:
    return F.coalesce(blank_to_null(safe_component(normalize_text(c))), F.lit("unnamed"))


# --- page state -------------------------------------------------------------

def looks_like_html(c: Column) -> Column:
    return c.rlike(f"(?i)^{WS}*<(?:!doctype html|html)")


def looks_like_login(c: Column) -> Column:
    """Login page by its title, redirect script or form fields."""
    text = F.lower(c)
    title = F.lower(F.regexp_extract(c, "(?is)<title[^>]*>(.*?)</title>", 1))
    hit = title.contains("登录") | title.contains("login")
    for marker in vocab.LOGIN_MARKERS:
        hit = hit | text.contains(marker)
    return hit | (text.contains("<form") & text.contains("login.do"))


def looks_expired(c: Column) -> Column:
    """Text that says the session has ended."""
    text = F.lower(normalize_text(c))
    hit = text.contains(vocab.EXPIRED_PHRASES[0])
    for phrase in vocab.EXPIRED_PHRASES[1:]:
        hit = hit | text.contains(phrase)
    return hit


def json_signals_expiry(body: Column) -> Column:
    """Whether any string value inside a JSON text says the session has ended.

    Keys are matched together with their colon and left out. Only bodies that
    hold one of the words at all, or an escape that may hide one, are taken apart.
    """
    hint = body.rlike("(?i)登录|会话|login|session|logged|password|j_username")
    tokens = F.regexp_extract_all(
        body, F.lit(r'"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:\s*:)?'), 0
    )
    values = F.transform(
        F.filter(tokens, lambda s: s.endswith('"')),
        lambda s: decode_js_string(F.substr(s, F.lit(2), F.char_length(s) - 2)),
    )
    said = F.exists(values, lambda v: looks_like_login(v) | looks_expired(v))
    return F.when(hint | body.contains("\\"), said).otherwise(False)


# --- links ------------------------------------------------------------------

def detail_url(path: Column, base_url: str, suffix: str = "") -> Column:
    """Address of a page by its path, with a query ``suffix`` such as ``view=full``."""
    rooted = F.concat(F.lit(base_url + "/"), F.regexp_replace(path, "^/+", ""))
    url = F.when(path.startswith("http"), path).otherwise(rooted)
    if not suffix:
        return url
    return F.concat(url, F.when(url.contains("?"), "&" + suffix).otherwise("?" + suffix))


def filled_url(template: str, base_url: str, **values: Column) -> Column:
    """``base_url`` and a path template with its ``{name}`` places filled.

    A portal's paths are its own, so they are arguments: ``/view?id={id}``.
    """
    parts = re.split(r"\{(\w+)\}", template)
    pieces = [values[x].cast("string") if i % 2 else F.lit(x) for i, x in enumerate(parts)]
    return F.concat(F.lit(base_url), *pieces)
