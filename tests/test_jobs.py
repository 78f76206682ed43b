"""Rules, verdicts, state tables, sources and streams."""

import os
import struct
import zlib
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetcheck.operators import stamps
from packetcheck.operators.report import report_records, report_struct
from packetcheck.operators.rules import CandidateRule, FieldRule, packet_rules, reconcile
from packetcheck.operators.verdict import assemble, judge, until_first_fatal
from packetcheck.operators.summary import summary_records
from packetcheck.operators.web import web_records
from packetcheck.plans import journal, logs, report, state
from packetcheck.plans.packets import PacketTables, compare_reports
from packetcheck.sources import tables
from packetcheck.sources.packets import discover_projects, packets
from packetcheck.streaming.incremental import current_verdicts, stream_reconcile
from packetcheck.streaming.logs import stream_class_counts

SIDE = dict(
    project_name="p", reg_code="q-1 ／ a", reg_name="北 山", reg_contact="林静", reg_phone="138-0000-0001",
    reg_date=date(2025, 4, 5), reg_amount="60", amount=60.0, doc_code="Q-1/A", doc_name="北山",
    doc_names=["x", "林静"], doc_phones=["13800000001"], doc_start=date(2025, 4, 1), doc_end=date(2025, 4, 9),
    doc_invalid=False, rep_name="林进", rep_phone="13800000001", rep_date=date(2025, 4, 9), has_red_stamp=True,
    has_web=True, web_code="q-1/a", web_name="北山",
)
SIDE_TYPE = (
    "project_name string, reg_code string, reg_name string, reg_contact string, reg_phone string, reg_date date, "
    "reg_amount string, amount double, doc_code string, doc_name string, doc_names array<string>, "
    "doc_phones array<string>, doc_start date, doc_end date, doc_invalid boolean, rep_name string, rep_phone string, "
    "rep_date date, has_red_stamp boolean, has_web boolean, web_code string, web_name string"
)
D = date
RULE_CASES = [
    ({}, []),
    ({"reg_code": None, "reg_name": " ", "reg_contact": "", "reg_phone": "无"}, []),
    ({"doc_code": "Q-2", "web_code": "Q-3"}, ["项目编号:xlsx 与 docx 不一致", "项目编号:xlsx 与 web 不一致"]),
    ({"web_code": "Q-3", "has_web": False}, []),
    ({"doc_names": []}, ["用户姓名:xlsx 与 docx 不一致"]),
    ({"doc_names": None, "rep_name": "周"}, ["用户姓名:xlsx 与 docx 不一致", "用户姓名:xlsx 与 pdf 不一致"]),
    ({"rep_phone": ""}, ["联系电话:xlsx 与 pdf 不一致"]),
    ({"doc_start": D(2025, 5, 1), "doc_invalid": True},
     ["竣工验收时间区间:开始时间晚于完成时间", "验收时间:Word 开始/完成时间区间无效，无法校验验收时间"]),
    ({"doc_start": None}, ["竣工验收时间区间:Word 开始时间未识别", "验收时间:Word 开始时间未识别，无法校验验收时间区间"]),
    ({"doc_end": None}, ["竣工验收时间区间:Word 完成时间未识别", "验收时间:Word 完成时间未识别，无法校验验收时间区间"]),
    ({"reg_date": None}, ["验收时间:Excel 验收日期未识别"]),
    ({"rep_date": None}, ["验收时间:PDF 手写日期未识别"]),
    ({"reg_date": D(2025, 3, 31), "rep_date": D(2025, 4, 10)}, ["验收时间:Excel、PDF 验收时间不在 Word 开始/完成时间区间内"]),
    ({"rep_date": D(2025, 4, 10)}, ["验收时间:PDF 验收时间不在 Word 开始/完成时间区间内"]),
    ({"has_red_stamp": False}, ["盖章检查:合同额超过 50 万但 pdf 未识别到红章"]),
    ({"has_red_stamp": False, "amount": 50.0}, []), ({"has_red_stamp": False, "amount": None}, []),
    ({"has_red_stamp": False, "amount": float("nan")}, []),
]


def test_rule_suite(spark):
    fields = [f.strip().split(" ")[0] for f in SIDE_TYPE.split(", ")]
    rows = [tuple({**SIDE, **change, "project_name": str(i)}[f] for f in fields)
            for i, (change, _) in enumerate(RULE_CASES)]
    got = reconcile(spark.createDataFrame(rows, SIDE_TYPE), packet_rules()).collect()
    for row in got:
        found = [f"{f.field_name}:{f.message}" for f in row.failures]
        assert found == RULE_CASES[int(row.project_name)][1], row.project_name
        assert row.passed == (not found)


def test_evidence(spark):
    df = spark.createDataFrame([("a", ["b", "c"], None)], "l string, many array<string>, none array<string>")
    rules = [CandidateRule("f", F.col("l"), F.col("many")), CandidateRule("g", F.col("l"), F.col("none")),
             FieldRule("h", F.col("l"), F.lit(None).cast("string"))]
    row = reconcile(df, rules).first()
    assert [dict(f["values"]) for f in row.failures] == [
        {"left": "a", "right": "b | c"}, {"left": "a", "right": "<空>"}, {"left": "a", "right": None}]


def test_verdict_ladder(spark):
    names = ["ok", "noreg", "badreg", "nosum", "badsum", "norep", "badrep", "noweb", "badweb", "lost"]
    value = "struct<kind:string,s:string>"
    base = spark.createDataFrame([(n,) for n in names], "project_name string")
    name = F.col("project_name")

    def path(missing):
        return F.when(name != missing, F.lit("/x"))

    pk = base.select("project_name", path("noreg").alias("registry_path"), path("nosum").alias("summary_path"),
                     path("norep").alias("report_path"), path("noweb").alias("web_path"))
    err = lambda bad: F.when(name == bad, "E").alias("error")
    registry = base.select("project_name", F.when(name == "noweb", F.create_map().cast(f"map<string,{value}>")).otherwise(
        F.create_map(F.lit("项目编号"), F.struct(F.lit("string").alias("kind"), F.lit("R-1").alias("s")))).alias("fields"), err("badreg"))
    summary = base.select("project_name", F.struct(
        F.lit("R-1").alias("project_code"), F.lit("n").alias("project_name"),
        F.array().cast("array<string>").alias("contact_names"), F.array().cast("array<string>").alias("contact_phones"),
        F.lit("2025-01-01").cast("date").alias("acceptance_start"), F.lit("2025-01-09").cast("date").alias("acceptance_end"),
        F.lit(False).alias("invalid_range")).alias("summary"), err("badsum"))
    rep = base.filter(name != "lost").select("project_name", report_struct(
        F.lit(""), F.lit("x"), F.lit("1"), F.lit("2025-01-02").cast("date")).alias("report"), err("badrep"))
    web = base.select("project_name", F.struct(F.lit("R-1").alias("project_code"), F.lit("n").alias("project_name")).alias("web"), err("badweb"))
    verdicts = judge(assemble(pk, registry, summary, rep, web))
    rows = {r.project_name: r for r in verdicts.collect()}
    status = {n: rows[n].status for n in names}
    assert status == {
        "ok": "比对失败，1 个问题", "noreg": "缺少 Excel 文件", "badreg": "Excel 读取失败", "nosum": "缺少 Word 文件",
        "badsum": "Word 读取失败", "norep": "缺少竣工验收报告文件", "badrep": "验收报告读取失败",
        "noweb": "比对失败，2 个问题", "badweb": "比对失败，2 个问题", "lost": "验收报告读取失败"}
    assert rows["noreg"].project_code == "R-1" and rows["noweb"].project_code == "R-1"
    assert [d.message for d in rows["noweb"].details] == ["缺少 网页详情文件", "Excel 验收日期未识别"]
    fatal = {n for n in names if rows[n].fatal_reason}
    assert fatal == {"badreg", "badrep", "badweb", "lost"}
    assert rows["badreg"].fatal_reason == "badreg | xlsx读取 | E，已停止后续任务"
    kept = {r.project_name for r in until_first_fatal(verdicts).collect()}
    assert kept == {n for n in names if n <= "badreg"}
    shown = {(r.packet, r.pos): r for r in report.exploded_rows(report.report_rows(verdicts)).collect()}
    assert len(shown) == 50
    assert shown[("badrep", 4)].project_code == "—" and shown[("ok", 4)].acceptance_time == "❌"
    assert shown[("nosum", 1)].contact_name == "未识别" and shown[("ok", 4)].start_time == "❌"
    assert shown[("noreg", 0)].project_name == "noreg"


# --- stamps -----------------------------------------------------------------


def brute_red(pixels):
    hit = [r >= 180 and r > min(g + 40, 255) and r > min(b + 40, 255) for r, g, b in pixels]
    return len(pixels), sum(hit)


def write_png(path, raster):
    h, w, _ = raster.shape
    raw = b"".join(b"\0" + raster[y].tobytes() for y in range(h))

    def chunk(tag, data):
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))

    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0))
                + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_images_and_pixels(spark, tmp_path):
    rng = np.random.default_rng(3)
    want = {}
    pixel_rows = []
    for project, size, share in [("a", (130, 120), 0.02), ("b", (20, 10), 0.0), ("c", (5, 7), 0.5)]:
        os.makedirs(tmp_path / project)
        raster = rng.integers(0, 170, (*size, 3), dtype=np.uint8)
        flat = raster.reshape(-1, 3)
        red = rng.random(len(flat)) < share
        flat[red] = [230, 20, 30]
        flat[~red, 0] //= 2
        write_png(str(tmp_path / project / "1.png"), raster)
        pixels = [tuple(int(v) for v in p) for p in flat]
        want[project] = brute_red(pixels)
        pixel_rows += [(project, 1, i, *p) for i, p in enumerate(pixels)]
    images = tables.page_images(spark, str(tmp_path))
    got = {r.project_name: (r.counted, r.red) for r in stamps.image_ratios(images).collect()}
    assert got == want
    df = spark.createDataFrame(pixel_rows, tables.SCHEMAS["pixels"])
    assert {r.project_name: (r.counted, r.red) for r in stamps.page_ratios(df).collect()} == want
    amounts = spark.createDataFrame([("a", 51.0), ("b", 60.0), ("c", 50.0), ("d", 99.0), ("e", None)], "project_name string, amount double")
    needed = {r.project_name: r.has_red_stamp for r in stamps.stamps_where_needed(amounts, df).collect()}
    assert needed == {"a": True, "b": False, "c": False, "d": False, "e": False}


# --- sources ----------------------------------------------------------------


def test_packet_discovery(spark, tmp_path):
    layout = {
        "Q_1": ["B竣工总结报告.DOC", "A竣工总结报告.docx", "竣工总结报告.txt", "无关.xlsx", "其他.txt", "说明+1.txt"],
        "Q-2": ["关闭移交登记表.xlsx", "x竣工验收报告.Jpg", "q_2.txt", "project_compare_state.sqlite3"],
        "cache": ["关闭移交登记表.xlsx"], ".h": ["a.txt"],
    }
    for folder, names in layout.items():
        os.makedirs(tmp_path / folder)
        for n in names:
            text = " 项目编号：\n项目编号： q-1 \n" if n == "说明+1.txt" else "x"
            (tmp_path / folder / n).write_text(text, encoding="utf-8")
    files = tables.listed_files(spark, str(tmp_path))
    found = packets(files, tables.whole_texts(spark, str(tmp_path)))
    rows = {r.project_name: r for r in found.collect()}
    base = lambda p: p and os.path.basename(p)
    assert set(rows) == {"Q_1", "Q-2"}
    assert base(rows["Q_1"].summary_path) == "A竣工总结报告.docx" and base(rows["Q_1"].web_path) == "说明+1.txt"
    assert rows["Q_1"].missing == ["xlsx/xls", "pdf/jpg/jpeg/png"]
    assert base(rows["Q-2"].report_path) == "x竣工验收报告.Jpg" and base(rows["Q-2"].web_path) == "q_2.txt"
    assert [r.project_name for r in discover_projects(files).collect()] == ["Q-2", "Q_1"]


def test_folders_without_files_are_found(spark):
    files = spark.createDataFrame([("/d/P1/关闭移交登记表.xls",), ("/d/P3/project_compare_state.sqlite3",)], "path string")
    folders = spark.createDataFrame([("P1",), ("P2",), ("cache",), (".x",)], "project_name string")
    rows = {r.project_name: (r.registry_path is not None, len(r.missing)) for r in packets(files, folders=folders).collect()}
    assert rows == {"P1": (True, 2), "P2": (False, 3), "P3": (False, 3)}
    assert [r.project_name for r in discover_projects(files, folders).collect()] == ["P1", "P2", "P3"]


def test_only_the_chosen_text_is_compared(spark):
    """Two texts in a folder: the packet stays one row, with the record of its chosen path."""
    found = packets(spark.createDataFrame([("/d/P/P-a.txt",), ("/d/P/P-b.txt",), ("/d/Q/Q.txt",)], "path string"))
    texts = spark.createDataFrame(
        [("P", "/d/P/P-b.txt", "项目编号: B"), ("P", "/d/P/P-a.txt", "项目编号: A"), ("Q", "/d/Q/Q.txt", "项目编号: Q")],
        "project_name string, path string, text string")
    none = spark.createDataFrame([], "project_name string, x string")
    rows = assemble(
        found, none.selectExpr("project_name", "cast(null as map<string,struct<kind:string,s:string>>) as fields"),
        summary_records(none.withColumnRenamed("x", "text")), report_records(none.withColumnRenamed("x", "text")), web_records(texts))
    assert sorted((r.project_name, r.web.project_code) for r in rows.collect()) == [("P", "A"), ("Q", "Q")]


def test_optional_tables_may_be_absent(spark, tmp_path):
    root, packet = str(tmp_path), "project_name string, registry_path string, summary_path string, report_path string, web_path string, missing array<string>"
    for name in ("cells", "summary_texts", "report_pages", "web_texts"):
        spark.createDataFrame([], tables.SCHEMAS[name]).write.parquet(f"{root}/{name}")
    one = spark.createDataFrame([("P", None, None, None, None, ["xlsx/xls"])], packet)
    read = PacketTables.read(spark, root, one)
    assert read.pixels is None and read.payloads is None
    row = compare_reports(read, "2026-01-01 00:00:00").first()
    assert (row.project_name, row.passed, row.status) == ("P", False, "缺少 Excel 文件")


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv"])
def test_table_formats(spark, tmp_path, fmt):
    df = spark.createDataFrame([("a", "/d/a/a.txt", "x\ny,\"z\"")], tables.SCHEMAS["web_texts"])
    writer = df.write.options(header=True, escape='"') if fmt == "csv" else df.write
    writer.format(fmt).save(str(tmp_path / fmt))
    assert tables.read_table(spark, "web_texts", str(tmp_path / fmt), fmt).collect() == df.collect()


# --- state ------------------------------------------------------------------


def test_runs(spark, tmp_path):
    root = str(tmp_path)
    kind = "project_name string, project_code string, passed boolean, log_json string"
    first = spark.createDataFrame([("a", "A", False, "{}"), ("b", "B", False, "{}")], kind)
    second = spark.createDataFrame([("b", "B", False, '{"n":1}'), ("a", "A", True, "{}")], kind)
    for run_id, df in [("20250101000000000", first), ("20250101000001000", second), ("20250101000001000", second)]:
        state.save_run(state.ordered_results(df), root, run_id, "2025-01-01 00:00:00")
    results, runs = spark.read.parquet(f"{root}/compare_results"), spark.read.parquet(f"{root}/compare_runs")
    assert state.failed_count(results, runs).first().failed_count == 1
    assert [r.value for r in state.failure_lines(results, runs).collect()] == ['[项目比对] {"n":1}']
    state.export_failures(results, runs, f"{root}/out")
    assert [r.value for r in spark.read.text(f"{root}/out").collect()] == ['[项目比对] {"n":1}']
    # results of a run that is not in the runs table stay unseen
    second.select(F.lit(0).alias("item_order"), "*").write.parquet(f"{root}/compare_results/run_id=20250102000000000")
    assert state.failed_count(spark.read.parquet(f"{root}/compare_results"), runs).first().failed_count == 1


def test_success_state(spark):
    events = [(1, "A", "a1", "{}", "exported"), (2, "A", "a2", "{}", "pending"), (3, "B", "b1", "{}", "pending"),
              (4, "B", "b1", "{}", "exported"), (5, "A", "a3", "{}", "pending"), (6, "C", "c", "{}", "exported")]
    df = spark.createDataFrame([(*e, None) for e in events], tables.SCHEMAS["success_events"])
    got = {r.project_code: (r.project_name, r.status, r.first_seq) for r in state.success_state(df).collect()}
    assert got == {"A": ("a3", "pending", 2), "B": ("b1", "exported", 3)}


def test_ledger_export_is_repeatable(spark, tmp_path):
    root, ledger = str(tmp_path / "state"), str(tmp_path / "ledger")
    rows = [(1, "A", "a", '{"项目编码":"A","项目全称":"x","别的":"n"}', "pending", None),
            (2, "B", "b", '{"项目编码":"B"}', "pending", None), (3, "", "c", '{"项目全称":"z"}', "pending", None)]
    journal.write_part(spark.createDataFrame(rows, tables.SCHEMAS["success_events"]), root, state.EVENTS, "r")
    journal.commit(spark, root, "r")
    spark.createDataFrame([("B", "old")], "`项目编码` string, `项目全称` string").write.parquet(f"{ledger}/batch=0")
    counts = state.export_pending(spark, root, ledger, "1", "2025-01-01 00:00:00").first()
    assert tuple(counts) == ("exported", 3, 2, 1)
    # the same batch again writes what it wrote
    assert state.export_pending(spark, root, ledger, "1", "2025-01-01 00:00:00").first() == counts
    got = sorted(((r[0] or ""), r[1] or "") for r in spark.read.parquet(ledger).select("项目编码", "项目全称").collect())
    assert got == [("", "z"), ("A", "x"), ("B", "old")]
    after = state.success_records(spark, root)
    assert {r.status for r in after.collect()} == {"exported"}
    again = state.export_pending(spark, root, ledger, "2", "2025-01-02 00:00:00").first()
    assert tuple(again) == ("empty", 0, 0, 0)


def test_export_without_a_ledger_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "state")
    journal.write_part(spark.createDataFrame([(1, "A", "a", "{}", "pending", None)], tables.SCHEMAS["success_events"]), root, state.EVENTS, "r")
    journal.commit(spark, root, "r")
    counts = state.export_pending(spark, root, str(tmp_path / "none"), "1", "2025-01-01 00:00:00").first()
    assert tuple(counts) == ("missing_workbook", 1, 0, 0)
    assert journal.committed(spark, root) == ["r"]
    assert spark.read.parquet(f"{root}/{state.EVENTS}").count() == 1


def test_passes_become_events(spark, tmp_path):
    root = str(tmp_path / "state")
    for day, rows in enumerate([[("b", "B", True), ("a", "A", True), ("c", "C", False)], [("c", "C", True)]], 1):
        df = spark.createDataFrame(rows, "project_name string, project_code string, passed boolean")
        for _ in range(2):  # a run that failed before its commit is repeated
            state.add_success_events(df.withColumn("row", F.struct("project_code")), root, f"r{day}", f"2025-01-0{day} 00:00:00")
        journal.commit(spark, root, f"r{day}")
    got = journal.visible(spark, root, state.EVENTS, tables.SCHEMAS["success_events"]).orderBy("seq").collect()
    assert [(r.project_code, r.state, r.row_json) for r in got] == [(x, "pending", f'{{"project_code":"{x}"}}') for x in "ABC"]
    assert len({r.seq for r in got}) == 3
    assert {r.status for r in state.success_records(spark, root).collect()} == {"pending"}


def test_split_is_disjoint_and_total(spark):
    rng = np.random.default_rng(1)
    rows = [(["", "H", f"C{i % 40}"][int(rng.integers(0, 3))], i) for i in range(3000)]
    df = spark.createDataFrame(rows, "project_code string, first_seq bigint").repartition(7)
    ledger = spark.createDataFrame([(f"C{i}",) for i in range(10)], "project_code string")
    marked = state.marked_pending(df, ledger)
    appended, duplicate = (marked.filter(F.col("appended") == x).drop("appended") for x in (True, False))
    seen = {f"C{i}" for i in range(10)}
    want = []
    for code, seq in rows:
        if code == "" or code not in seen:
            want.append((code, seq))
        seen.add(code)
    got = sorted(tuple(r) for r in appended.collect())
    assert got == sorted(want)
    assert sorted(got + [tuple(r) for r in duplicate.collect()]) == sorted(rows)


def test_log_epochs(spark, tmp_path):
    path = str(tmp_path / "logs")
    lines = spark.createDataFrame([(1, "default", "a", None), (2, "default", "b", None)],
                                  "id bigint, bucket string, message string, created_at timestamp")
    logs.append_lines(lines, path, 0)
    logs.clear_lines(spark, path, 0)
    stored = lambda: logs.current_lines(spark.read.parquet(path))
    assert stored().count() == 0
    logs.append_lines(lines.filter("id = 2"), path, 1)
    assert [r.message for r in stored().collect()] == ["b"]
    empty = lines.limit(0).select(F.col("id").alias("seq"), F.lit("error").alias("outcome"), F.lit("").alias("item"))
    got = sorted((r.part, r.message) for r in logs.collection_lines(empty).collect())
    assert got[0][1] == "[网页阶段] 完成: 下载=0 | 跳过=0 | 错误=0" and got[1][0] == 4


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "id bigint, message string, project_name string"
    good = '[项目比对] {"passed":true,"rows":[]}'

    def run():
        stream = spark.readStream.schema(schema).parquet(src)
        stream_class_counts(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        judge_keys = lambda keys: keys.select("project_name", F.length("project_name").alias("n"))
        stream_reconcile(stream, judge_keys, str(tmp_path / "v"), str(tmp_path / "cp2")).awaitTermination()
        counts = {r["class"]: r.lines for r in spark.read.parquet(str(tmp_path / "out")).collect()}
        return counts, sorted(tuple(r) for r in current_verdicts(spark, str(tmp_path / "v")).collect())

    spark.createDataFrame([(1, good, "a"), (2, "[缓存] x", "bb"), (3, good[:-1], "a")], schema).write.parquet(src)
    assert run() == ({"success": 1, "system": 1}, [("a", 1), ("bb", 2)])
    spark.createDataFrame([(4, good, "a"), (5, good.replace("true", "false"), "c")], schema).write.mode("append").parquet(src)
    want = ({"success": 2, "failed": 1, "system": 1}, [("a", 1), ("bb", 2), ("c", 1)])
    assert run() == want
    assert run() == want


def test_arrow_normalisers_run_once(spark):
    """One pass through Python for all rules, candidates and nulls too; as plain functions give."""
    from packetcheck.operators.rules import ArrowNormalizer

    rows = [("a 1", "A1", ["x", None, "a1"]), ("b", None, None), (None, "q", []), ("c", "d", ["d"]), ("", "", [""])]
    df = spark.createDataFrame(rows, "l string, r string, many array<string>")
    arrow = ArrowNormalizer(lambda s: s.str.replace(" ", "").str.lower())

    def rules(normalizer):
        return [FieldRule("f", F.col("l"), F.col("r"), normalizer), CandidateRule("g", F.col("l"), F.col("many"), normalizer),
                FieldRule("h", F.col("l"), F.lit("A 1"), normalizer, applies=F.col("r").isNotNull())]
    plain = reconcile(df, rules(lambda c: F.lower(F.replace(c, F.lit(" "))))).collect()
    found = reconcile(df, rules(arrow))
    assert found.collect() == plain
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
