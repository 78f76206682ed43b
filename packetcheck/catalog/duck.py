"""SQL snippets for the checks: DuckDB forms of the scalar functions."""

from __future__ import annotations

WS = r"[\s\x0b\x{85}\p{Z}]"
ZERO_WIDTH = r"\x{200B}-\x{200D}\x{FEFF}"


def norm(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def compact(x: str) -> str:
    return f"regexp_replace({x}, '{WS}', '', 'g')"


def digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '', 'g')"


def code(x: str) -> str:
    bare = rf"regexp_replace({x}, '[\s\x0b\x{{85}}\p{{Z}}{ZERO_WIDTH}]', '', 'g')"
    return f"upper(translate({bare}, '／⁄∕', '///'))"


def date(x: str) -> str:
    """Date of the notations used in the derived data."""
    k = compact(x)
    return (
        f"coalesce(case when regexp_full_match({k}, '[0-9]{{4}}([-/.])[0-9]{{1,2}}[-/.][0-9]{{1,2}}') "
        f"then cast(try_strptime(replace(replace({k}, '/', '-'), '.', '-'), '%Y-%m-%d') as date) end, "
        f"case when regexp_full_match({k}, '[0-9]{{4}}年[0-9]{{1,2}}月[0-9]{{1,2}}日') "
        f"then cast(try_strptime({k}, '%Y年%m月%d日') as date) end, "
        f"case when regexp_full_match({k}, '[0-9]{{8}}') "
        f"then cast(try_strptime({k}, '%Y%m%d') as date) end)"
    )


def amount(x: str) -> str:
    bare = f"replace(replace(replace(replace({norm(x)}, ',', ''), '，', ''), '万元', ''), '万', '')"
    return f"try_cast(trim({bare}) as double)"


FOLDS = {"王": "wan", "汪": "wan", "明": "min", "张": "zhan", "三": "san",
         "李": "li", "四": "si", "陈": "chen", "平": "pin"}


def fold(x: str) -> str:
    for ch, syllable in FOLDS.items():
        x = f"replace({x}, '{ch}', '{syllable}')"
    return x


def names_match(a: str, b: str) -> str:
    ka, kb = compact(a), compact(b)
    han = "[\\x{4e00}-\\x{9fff}]"
    return (
        f"({norm(a)} <> '' and {norm(b)} <> '' and ({norm(a)} = {norm(b)} or "
        f"(regexp_matches({ka}, '{han}') and regexp_matches({kb}, '{han}') "
        f"and {fold(ka)} = {fold(kb)})))"
    )


def iso(d: str) -> str:
    return f"coalesce(strftime({d}, '%Y-%m-%d'), '∅')"
