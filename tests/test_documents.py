"""Extraction from texts, sheets and pages, on invented documents."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from packetcheck.operators import cells as sheets, portal, recognition, report, summary, web


def summaries(spark, *texts):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "project_name string, text string")
    rows = summary.summary_records(df).collect()
    return [r.summary for r in sorted(rows, key=lambda r: int(r.project_name))]


def test_summary_record(spark):
    (r,) = summaries(spark, (
        "项目编号： qhe-7/k1 报告日期：2025年05月06日 一、信息 项目全称 北山 水厂 项目类型 A "
        "用户姓名 钱伟 用户职务 x 联系电话 139-0013-9000 电子邮件 用户姓名：孙丽 联系电话 无 电子邮件 "
        "用户姓名 钱伟 用户职务 竣工验收 20 25 年0 4 月 19 日 202 5 年0 4 月 22 日 完"
    ))
    assert r.project_code == "QHE-7/K1" and r.project_name == "北山 水厂"
    assert r.contact_names == ["钱伟", "孙丽"] and r.contact_phones == ["13900139000"]
    assert (r.acceptance_start, r.acceptance_end) == (date(2025, 4, 19), date(2025, 4, 22))
    assert not r.invalid_range


@pytest.mark.parametrize("text, start, end", [
    ("竣工验收(完成时间) 2025.04.10 竣工验收(开始时间) 2025.03.10", date(2025, 3, 10), date(2025, 4, 10)),
    ("竣工验收开始时间 2025-3-1 竣工验收 2025-1-1 2025-1-2", date(2025, 3, 1), None),
    ("竣工 验收（开始 时间） 2025-3-1 x", date(2025, 3, 1), None),
    ("竣工验收 20 25 - 4 - 1 6 20 25 - 4 - 17", date(2025, 4, 16), date(2025, 4, 17)),
    ("竣工验收 2025-4-1 仅一", None, None),
    ("竣工验收 2025-04-09 2025-04-01", date(2025, 4, 9), date(2025, 4, 1)),
    # a one-digit day takes in the first digit of the next year, which spoils both
    ("竣工验收 2025-4-9 2025-4-1", None, None),
    ("竣工验收 " + "x" * 120 + " 2025-4-1 2025-4-2", None, None),
    ("没有", None, None),
])
def test_acceptance_range(spark, text, start, end):
    (r,) = summaries(spark, text)
    assert (r.acceptance_start, r.acceptance_end) == (start, end)
    assert r.invalid_range == (start is not None and end is not None and start > end)


def test_label_value_runs_over_repeats(spark):
    (r,) = summaries(spark, "项目编号 项目全称 a 项目编号 X-1 项目编号 2 报告日期")
    assert r.project_code == "X-1项目编号2"


def test_report_record(spark):
    pages = [("a", 2, "签字/盖章：林静 联系电话 x138-1234 5678 9 日期 16日 2025 年 4月"),
             ("a", 1, "报告 qhe-123456/a1 建设"),
             ("b", 1, "签字人姓名 签字/盖章 吴敏 电话 2380 日期 2025-4-31"), ("c", 1, "")]
    df = spark.createDataFrame(pages, "project_name string, page int, text string")
    rows = {r.project_name: r.report for r in report.report_records(report.joined_pages(df)).collect()}
    a = rows["a"]
    assert (a.project_code, a.signer_name, a.signer_phone) == ("QHE-123456/A1", "林静", "13812345678")
    assert a.sign_date == date(2025, 4, 16) and a.has_red_stamp is False
    assert (rows["b"].signer_name, rows["b"].signer_phone, rows["b"].sign_date) == ("吴敏", "", None)
    assert rows["c"].signer_name == "" and rows["c"].project_code == ""


def test_web_text_round_trip(spark):
    df = spark.createDataFrame([("qhe-1/a", "北山")], "code string, name string")
    text = web.info_text(F.col("code"), F.col("name"), F.lit("c"), F.lit("/d"), F.lit("7"), "https://p")
    other = spark.createDataFrame([("y", " 说明\r\n　项目编号：q-2 \r\n项目名称:\n项目名称: z")], "project_name string, text string")
    both = df.select(F.lit("x").alias("project_name"), text.alias("text")).unionByName(other)
    rows = {r.project_name: r.web for r in web.web_records(both).collect()}
    assert tuple(rows["x"]) == ("QHE-1/A", "北山") and tuple(rows["y"]) == ("Q-2", "")


SHEETS = {
    # project: {sheet: {(row, col): text}}
    "header": {0: {(0, 0): "封面"}, 1: {
        (1, 0): "字段名称", (1, 4): "内容", (2, 0): "项目编号", (2, 4): "A", (3, 0): "项目编号", (3, 4): "B",
        (4, 0): "备注", (4, 4): "r", (5, 0): "注：x", (5, 4): "n", (6, 0): "自定", (6, 4): "c", (7, 0): "核实人"}},
    "far": {0: {(1, 0): "字段名称", (1, 5): "内容", (2, 0): "项目编号", (2, 5): "R"}},
    "right": {0: {(0, 0): "项目编号：", (0, 1): "备注", (0, 2): "项目 全称", (0, 4): "N", (1, 2): "M"}},
    "below": {0: {(0, 0): "核实人", (0, 6): "no", (3, 0): "D", (4, 0): "E"}},
    "gap": {0: {(0, 0): "字段名称", (0, 1): "内容", (1, 0): "核实人", (5, 5): "项目经理", (5, 6): "P", (1, 2): "H"}},
    "none": {0: {(0, 0): "x"}},
    "late": {0: {(25, 0): "字段名称", (25, 1): "内容", (26, 0): "自定", (26, 1): "v", (30, 0): "产品线", (30, 1): "L"}},
}
WANT = {
    ("header", "项目编号"): "B", ("header", "自定"): "c",
    ("far", "项目编号"): "R",
    ("right", "项目编号"): "N", ("right", "项目全称"): "N",
    ("below", "核实人"): "D",
    ("gap", "项目经理"): "P", ("gap", "核实人"): "H",
    ("late", "自定"): "v", ("late", "产品线"): "L",
}


def test_registry_sheets(spark):
    rows = [(p, i, str(i), r, c, "string", s, None)
            for p, sh in SHEETS.items() for i, cs in sh.items() for (r, c), s in cs.items()]
    df = spark.createDataFrame(rows, "project_name string, sheet_idx int, sheet string, row int, col int, kind string, s string, n double")
    got = {(r.project_name, r.label): r.value.s for r in sheets.registry_fields(df).collect()}
    assert got == WANT


def test_detail_page(spark):
    html = (
        '<td><label>项目编号</label></td><td> qhe-9/k <script>var a="</b>"</script></td>'
        "<td>项目名称</td><td>&nbsp;北山<b>厂</b></td>关闭依据附件"
        'addDoc("竣工\\u603b结报告.doc","0a",true,"m","1","k","v");addDoc("x.zip","0b",false,"m","1","k","v") ;'
        'addDoc("y.zip","0a",true,"m","1","k","v");addDoc("b.eml","0c",true,"m","1","k","v");'
        'addDoc("说明.txt","0d",true,"message/rfc822","1","k","v");addDoc("1关闭移交登记表.XLS","0e",true,"m","1","k","v");'
        'addDoc("c.txt","0f",true,"m","1","k","v");addDoc("d.txt","10",true,"m","1","k","v");'
    )
    data = [("1", "s", html), ("2", "项目号：q-3", "<td>项目名称</td><td>n</td>"), ("3", "", "<td></td>"),
            ("4", "", "<title>登录</title>"), ("5", "q-1", "x")]
    df = spark.createDataFrame(data, "fd_id string, subject string, html string")
    rows = {r.fd_id: r for r in portal.with_choice(portal.detail_records(df)).collect()}
    one = rows["1"]
    assert (one.project_code, one.project_name, one.error) == ("QHE-9/K", "北山 厂", None)
    assert [a.fd_id for a in one.attachments] == ["0a", "0c", "0d", "0e", "0f", "10"]
    assert [a.name for a in one.chosen] == ["1关闭移交登记表.XLS", "竣工总结报告.doc", "c.txt"]
    assert rows["2"].project_code == "Q-3"
    assert [rows[i].error for i in "2345"] == [None, "no_code", "session_expired", "no_name"]


def todo(spark, pages):
    return spark.createDataFrame(pages, "category string, page_no int, body string")


def item(i, path="/p"):
    return f'[{{"col":"fdId","value":"{i}"}},{{"col":"_tr_href","value":"{path}{i}"}},{{"col":"fdId","value":"{i}"}}]'


def test_todo_rows_and_paging(spark):
    def body(items, extra=""):
        return '{"datas":[' + ",".join(items) + "]" + extra + "}"

    pages = [
        ("a", 1, body([item(1), item(2), "7", '[{"col":"fdId","value":"x"}]'], ',"total":3')),
        ("a", 2, body([item(2), item(3)], ',"total":3')), ("a", 3, body([item(4)], ',"total":3')),
        ("b", 1, body([item(1)])), ("b", 2, body([item(1)])), ("b", 3, body([item(5)])),
        ("c", 1, body([item("", "/q"), item("", "/q"), item("", "/r")], ',"totalPages":"1"')), ("c", 2, body([item(9)])),
        ("d", 1, body([item(1)], ',"totalPage":0,"pageCount":2.5')), ("d", 2, body([item(2)])), ("d", 201, body([item(3)])),
    ]
    rows = portal.collected_items(todo(spark, pages)).collect()
    got = sorted((r.category, r.detail_path) for r in rows)
    assert got == [("a", "/p1"), ("a", "/p2"), ("a", "/p3"), ("b", "/p1"),
                   ("c", "/q"), ("c", "/r"), ("d", "/p1"), ("d", "/p2")]


def test_paging_ends_at_bad_and_missing_pages(spark):
    def body(i):
        return '{"datas":[' + item(i) + "]}"

    login = "<html><head><title>登录</title></head></html>"
    pages = [("a", 1, body(1)), ("a", 2, login), ("a", 3, body(3)), ("b", 1, body(1)), ("b", 3, body(3)),
             ("c", 1, login), ("d", 2, body(2))] + [("e", n, body(n)) for n in range(1, 2301)]
    items, ends = portal.collected(todo(spark, pages))
    got = {r.category: (r.stop_page, r.end_reason) for r in ends.collect()}
    assert got == {"a": (1, "login_page"), "b": (1, "missing_page"), "c": (0, "login_page"), "d": (0, "missing_page"), "e": (2300, "open")}
    counts = {r["category"]: r["count"] for r in items.groupBy("category").count().collect()}
    assert counts == {"a": 1, "b": 1, "e": 2300}


def test_todo_rejects(spark):
    bodies = ["<title>Login</title>", "<html>", '{"datas":{}}', '{"datas":[],"m":"会话失效"}', '{"datas":[]} ', '{"datas":[]} x']
    df = todo(spark, [("a", i, b) for i, b in enumerate(bodies)])
    got = df.orderBy("page_no").select(portal.reject_reason(F.col("body")).alias("r")).collect()
    assert [r.r for r in got] == ["login_page", "not_json", "no_datas", "session_expired", None, "not_json"]


AI = '{{"choices":[{{"message":{{"content":{}}}}}]}}'


def test_payloads(spark):
    import json

    fields = '{"signer_name":" 林  静 ","matched_phone":"138 0000 0001","sign_date":"2025/1/2","name_confidence":"88%","signer_phone_confidence":93,"matched_date_confidence":7000}'
    bodies = [
        ("a", "ai", AI.format(json.dumps("好的 " + fields + " 完"))),
        ("b", "ai", AI.format(json.dumps([{"type": "x"}, {"text": "{"}, {"text": '"signer_name":5}'}]))),
        ("c", "ai", '{"choices":[]}'),
        ("d", "ocr", '{"success":false}'), ("e", "ocr", '{"success":"false","data":{"sign_date":"20250102"}}'),
        ("f", "ocr", '{"result":{"text":"签字人姓名 吴敏 电话 13800000002"}}'), ("g", "ocr", '{"data":"日期 2025-01-02"}'),
        ("h", "ocr", '{"text":5,"signer_name":null,"matched_name":"周"}'),
    ]
    df = spark.createDataFrame(bodies, "project_name string, kind string, body string")
    rows = {r.project_name: r for r in recognition.payload_records(df).collect()}
    a = rows["a"].report
    assert (a.signer_name, a.signer_phone, a.sign_date) == ("林 静", "13800000001", date(2025, 1, 2))
    assert (a.name_conf, a.phone_conf, a.date_conf) == (0.88, 0.93, None)
    assert rows["b"].report.signer_name == "5" and rows["c"].report.signer_name == ""
    assert rows["d"].error == "OCR 服务返回失败" and rows["d"].report is None
    assert rows["e"].report.sign_date == date(2025, 1, 2)
    assert (rows["f"].report.signer_name, rows["f"].report.signer_phone) == ("吴敏", "13800000002")
    assert rows["g"].report.sign_date == date(2025, 1, 2) and rows["h"].report.signer_name == "周"


def test_confirmation_and_merge(spark):
    def row(name, phone, day=None):
        return report.report_struct(F.lit(""), F.lit(name), F.lit(phone), F.lit(day).cast("date"))

    df = spark.range(1).select(
        recognition.confirm(row("张珊", "138-1"), F.array(F.lit("王"), F.lit("章 山")), F.array(F.lit("1381"))).alias("sound"),
        recognition.confirm(row("赵 六", "1 2"), F.array(F.lit("章山")), F.array().cast("array<string>")).alias("kept"),
        recognition.merge_reports(row("", "1", None), row("n", "2", "2025-01-02")).alias("m"),
    ).first()
    assert df.sound.signer_name == "章 山" and df.sound.signer_phone == "1381"
    assert df.kept.signer_name == "赵 六" and df.kept.signer_phone == "12"
    assert (df.m.signer_name, df.m.signer_phone, df.m.sign_date) == ("n", "1", date(2025, 1, 2))


def test_best_text(spark):
    df = spark.createDataFrame(
        [("a", 0, "xxxxxxxx"), ("a", 1, "项目编号"), ("b", 0, "é"), ("b", 1, "ab"), ("c", 0, "xy"), ("c", 1, "zw")],
        "project_name string, ord int, text string")
    got = {r.project_name: r.text for r in summary.best_texts(df).collect()}
    assert got["a"] == "项目编号" and got["b"] == "é" and got["c"] == "xy"


def test_sheets_are_shuffled_once_per_reading(spark):
    rows = [(p, i, str(i), r, c, "string", s, None)
            for p, sh in SHEETS.items() for i, cs in sh.items() for (r, c), s in cs.items()]
    df = spark.createDataFrame(rows, "project_name string, sheet_idx int, sheet string, row int, col int, kind string, s string, n double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = sheets.registry_fields(df)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2


def test_payload_parser_compiles(spark):
    """Generated code that doesn't compile raises instead of being interpreted."""
    df = spark.createDataFrame([("a", "ai", "{}"), ("a", "ocr", '{"data":{"signer_name":"x"}}')], "project_name string, kind string, body string")
    spark.conf.set("spark.sql.codegen.fallback", "false")
    spark.conf.set("spark.sql.codegen.factoryMode", "CODEGEN_ONLY")
    try:
        rows = recognition.payload_records(df.repartition(1)).collect()
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
        spark.conf.unset("spark.sql.codegen.factoryMode")
    assert {r.report.signer_name for r in rows} == {"", "x"}
