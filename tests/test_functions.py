"""Scalar functions, table-driven."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from packetcheck.functions import dates, names, pages, payload, text, values

WHITE = "\t\n\x0b\x0c\r \x85\xa0        　"


def test_normalize_text(each):
    got = each(text.normalize_text, [" a 　 b\n", WHITE + "x" + WHITE + "y", "", None])
    assert got == ["a b", "x y", "", None]


def test_compact_and_digits(each):
    assert each(text.compact_text, ["李 四　丁", " a b "]) == ["李四丁", "ab"]
    assert each(text.phone_digits, ["(021) 55-66", "１2３4", ""]) == ["0215566", "24", ""]


def test_project_code(each):
    got = each(text.project_code, [" qhe-1 ／ z​2﻿ ", "a⁄b∕c", ""])
    assert got == ["QHE-1/Z2", "A/B/C", ""]


def test_field_label(each):
    assert each(text.field_label, ["项目 编号：\n", "　核实人 :"]) == ["项目编号", "核实人"]


@pytest.mark.parametrize("raw, expected", [
    ("2025-11-02", date(2025, 11, 2)), ("2025-1-2", date(2025, 1, 2)),
    ("2025/1/02", date(2025, 1, 2)), ("2025.01.2", date(2025, 1, 2)),
    (" 2025 年 1 月 2 日 ", date(2025, 1, 2)), ("20250102", date(2025, 1, 2)),
    ("2025-1-1 2", date(2025, 1, 12)), ("于 2025年1月2日 完成", date(2025, 1, 2)),
    ("26-3-8", date(26, 3, 8)),
    ("2025-02-30", None), ("20251301", None), ("2025", None), ("20250-1-2", None),
    ("2025-1/2", None), ("待定", None), ("", None), ("２０２５年1月2日", None),
])
def test_parse_date(each, raw, expected):
    assert each(dates.parse_date, [raw]) == [expected]


def test_parse_amount(each):
    cases = {"2,345.5": 2345.5, "８": None, "12万元": 12.0, "12 万": 12.0, "1，000": 1000.0,
             "100元": None, "1d": None, "0x1p3": None, "1e2": 100.0, ".5": 0.5, "5.": 5.0, "": None}
    got = each(lambda c: values.parse_amount(F.lit("string"), c), list(cases))
    assert got == list(cases.values())
    assert each(lambda c: values.parse_amount(F.lit("bool"), c), ["true"]) == [None]


def test_confidence(each):
    got = each(lambda c: values.as_fraction(values.confidence_number(c)),
               ["0.8", "85%", "93", "250", "-1", "1", " 7 % ", "x"])
    assert got == [0.8, 0.85, 0.93, None, None, 1.0, 0.07, None]


def test_names(spark):
    cases = [
        ("赵强", "赵强", True), (" 赵 强 ", "赵强", True), ("", "赵强", False), ("赵强", "", False),
        ("张珊", "章山", True), ("林静", "林进", True), ("赵强", "钱伟", False),
        ("Li Si", "LiSi", False), ("Li  Si", "Li Si", True), ("赵a", "赵b", False), (None, "赵", False),
    ]
    df = spark.createDataFrame(cases, "a string, b string, want boolean")
    rows = df.select("*", names.names_match(F.col("a"), F.col("b")).alias("got")).collect()
    assert [(r.a, r.b, r.got) for r in rows] == cases


def test_folding(each):
    assert each(names.fold_name, ["西安", "先", "东x", "光"]) == ["xian", "xian", "donx", "guan"]
    assert len(names.folded_syllables().split(" ")) == 20_992
    assert names.fold_syllable("lǜ") == "l" and names.fold_syllable("zhuāng") == "zhuan"
    assert names.fold_syllable("ēng") == "en"


CELLS = [
    # label, kind, s, n, expected kind, expected text
    ("验收日期", "int", None, 20250102.0, "string", "2025-01-02"),
    ("验收日期", "float", None, 45659.0, "string", "2025-01-02"),
    ("验收日期", "float", None, 45659.75, "string", "2025-01-02"),
    ("验收日期", "int", None, 19999.0, "string", "19999"),
    ("验收日期", "datetime", None, 45659.0, "string", "2025-01-02"),
    ("接收时间", "datetime_iso", "2025-01-02T08:00:00", None, "string", "2025-01-02"),
    ("验收日期", "string", "待定", None, "string", "待定"),
    ("合同额（万元）", "float", None, 12.5, "number", "12.5"),
    ("合同额（万元）", "float", None, 12.0, "string", "12"),
    ("核实人", "bool", "TRUE", None, "bool", "true"),
    ("核实人", "error", "#N/A", None, "string", "#N/A"),
    ("核实人", "empty", None, None, None, None),
]


def test_cell_values(spark):
    df = spark.createDataFrame([c[:4] for c in CELLS], "label string, kind string, s string, n double")
    c = F.col
    rows = values.with_cell_value(df, c("label"), c("kind"), c("s"), c("n")).collect()
    got = [(r.value.kind, r.value.s) if r.value else (None, None) for r in rows]
    assert got == [c[4:] for c in CELLS]


def test_meaningful(spark):
    data = [("string", "x", True), ("string", "　", False), ("string", "项目 编号：", False),
            ("string", " 备注 ", False), ("number", "1.5", True), ("bool", "false", True)]
    df = spark.createDataFrame([d[:2] for d in data], "kind string, s string")
    got = df.select(values.is_meaningful(F.struct("kind", "s")).alias("r")).collect()
    assert [r.r for r in got] == [d[2] for d in data]


def test_html(each):
    html = "<p>a<SCRIPT x>if(1<2){}</script>&nbsp;b &amp;lt; <style>p</style>&quot;c&#39;</p>"
    assert each(pages.strip_html, [html]) == ["a b < \"c'"]
    assert each(pages.looks_like_html, [" <!DOCTYPE html>", "<HTML>", "x<html>"]) == [True, True, False]
    assert each(pages.looks_like_login, [
        "<title>系统登录</title>", "<title> LOGIN </title>", '<input name="j_username">',
        "<form action=login.do>", "<title>首页</title><script>tip='请重新登录'</script>",
    ]) == [True, True, True, True, False]
    assert each(pages.looks_expired, ["Session   Expired", "登录超时", "正常"]) == [True, True, False]


def test_json_expiry(each):
    assert each(pages.json_signals_expiry, [
        '{"a":{"b":["未登录"]}}', '{"未登录":"ok"}', '{"a":"\\u672a\\u767b\\u5f55"}', '{"a":1,"b":"x"}',
        '{"a":"x\\"","b":"login required"}',
    ]) == [True, False, True, False, True]


def test_codes_and_names(each):
    assert each(pages.code_in_text, ["项目号：qhe-77/k1 x", "QHE-5 (a", "无 12-3"]) == ["QHE-77/K1", "QHE-5", None]
    assert each(pages.code_in_report, ["见 qhe-123456/a1-b2。", "QHE-12345/A"]) == ["QHE-123456/A1-B2", ""]
    assert each(pages.folder_code, ["Qhe-1/2 |x:*", " .a/. "]) == ["Qhe-1-2 -x", "a"]
    assert each(pages.safe_filename, ["报/告?.doc", "nul.txt", "???", "com1"]) == [
        "报-告-.doc", "_nul.txt", "unnamed", "_com1"]
    long = each(pages.safe_filename, ["验" * 50, "a" + "验" * 50, "b" * 200])
    assert [len(x.encode()) for x in long] == [120, 121, 120]


def test_links(each):
    base = "https://p.example.org"
    assert each(lambda c: pages.detail_url(c, base, "view=full"), ["/a?b=1", "a", "http://x/y"]) == [
        base + "/a?b=1&view=full", base + "/a?view=full", "http://x/y?view=full"]
    assert each(pages.decode_js_string, ["\\u4e2d\\\"x", "bad\\q", "plain"]) == ['中"x', "bad\\q", "plain"]


def test_text_runs(each):
    assert each(text.text_runs, ["项目编号\x00\x01：\x02QHE 1�é a é；；", "\x00a\x00"]) == ["项目编号 QHE 1", ""]
    assert each(text.strip_rtf, [r"{\rtf1 a\'e9b\par c}"]) == ["  a b c "]
    assert each(text.anchor_score, ["项目编号 联系电话 x", "y"]) == [2, 0]
    assert each(text.looks_like_summary, ["竣工验收", "y"]) == [True, False]


def test_display(each):
    assert each(text.display_value, [" x ", "　", None]) == ["x", "未识别", "未识别"]
    assert each(text.display_joined, [["a", " "], ["", "未识别"], []], "array<string>") == ["a", "未识别", "未识别"]
    assert each(text.display_stamp, [True, False, None], "boolean") == ["有", "无", "未识别"]


def test_embedded_object(each):
    got = each(lambda c: payload.embedded_object(c, text.normalize_text(c)), [' {"a":1}\n', 'x {"a":\n{"b":2}} y', "none", "[1]"])
    assert got == ['{"a":1}', '{"a":\n{"b":2}}', None, None]
