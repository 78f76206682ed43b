"""From folders on disk to verdicts: listing, pictures, runs, layout, reuse."""

import os
import random
import struct
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetcheck.catalog import storing
from packetcheck.operators.stamps import stamps_where_needed
from packetcheck.operators.verdict import assemble, judge
from packetcheck.plans import journal, logs, run, state
from packetcheck.plans.layout import Records, of_projects, open_table, write_table
from packetcheck.plans.packets import PacketTables, compare
from packetcheck.session import scratch, shared_dir, stored
from packetcheck.sources import folders as folders_source, images, tables
from packetcheck.sources.folders import list_folders
from packetcheck.sources.packets import packets
from packetcheck.streaming import reuse


def write(path, content=b""):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(content if isinstance(content, bytes) else content.encode())


def png(picture, colour=2, depth=8, filters=(0,), interlaced=False, palette=None):
    """Encode height x width x channels samples, with the filters of the lines in turn."""
    height, width, channels = picture.shape

    def plane(part):
        h, w, _ = part.shape
        if depth < 8:
            bits = (part.reshape(h, w, 1) >> np.arange(depth - 1, -1, -1)) & 1
            lines = np.packbits(bits.reshape(h, -1).astype(np.uint8), axis=1)
        else:
            lines = part.astype(">u2").view(np.uint8).reshape(h, -1) if depth == 16 else part.astype(np.uint8).reshape(h, -1)
        step, out, above = max(1, channels * depth // 8), b"", np.zeros(lines.shape[1], int)
        for y, line in enumerate(lines.astype(int)):
            kind = filters[y % len(filters)]
            left = np.r_[np.zeros(step, int), line[:-step]][:len(line)]
            corner = np.r_[np.zeros(step, int), above[:-step]][:len(line)]
            guess = left + above - corner
            a, b, c = abs(guess - left), abs(guess - above), abs(guess - corner)
            paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))
            part = line - [0 * line, left, above, (left + above) // 2, paeth][kind]
            out += bytes([kind]) + (part % 256).astype(np.uint8).tobytes()
            above = line
        return out

    if interlaced:
        raw = b"".join(plane(picture[y::dy, x::dx]) for x, y, dx, dy in images._PASSES if picture[y::dy, x::dx].size)
    else:
        raw = plane(picture)

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, int(interlaced))
    extra = chunk(b"PLTE", palette.astype(np.uint8).tobytes()) if palette is not None else b""
    data = zlib.compress(raw)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + extra + chunk(b"IDAT", data[:5]) + chunk(b"IDAT", data[5:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("interlaced", [False, True])
def test_png_is_decoded(interlaced):
    rng = np.random.default_rng(1)
    for colour, channels in images._CHANNELS.items():
        for depth in (8, 16) if colour in (2, 4, 6) else (1, 2, 4, 8) if colour == 3 else (1, 2, 4, 8, 16):
            samples = rng.integers(0, 1 << depth, (13, 11, channels))
            palette = rng.integers(0, 256, (1 << depth, 3)) if colour == 3 else None
            got = images.decode(png(samples, colour, depth, (0, 1, 2, 3, 4), interlaced, palette))
            plain = samples >> 8 if depth == 16 else samples * (255 // ((1 << depth) - 1))
            want = palette[samples[:, :, 0]] if colour == 3 else np.repeat(plain[:, :, :1], 3, axis=2) if channels < 3 else plain[:, :, :3]
            assert (got == want).all(), (colour, depth)


def red_picture(share, size=40):
    picture = np.full((size, size, 3), 200)
    picture.reshape(-1, 3)[:int(round(share * size * size))] = (200, 20, 20)
    return png(picture)


def test_pictures_that_cannot_be_read_are_errors(spark, tmp_path):
    root = str(tmp_path)
    for name, content in {"a": red_picture(0.01), "b": red_picture(0.009), "c": b"no picture", "d": red_picture(1)[:60], "e": b"", "f": b"\x89PNG\r\n\x1a\n"}.items():
        write(f"{root}/{name}.png", content)
    rows = spark.createDataFrame([(x, f"{root}/{x}.png") for x in "abcdefg"], "project_name string, path string")
    got = {r.project_name: r for r in images.file_ratios(rows).collect()}
    assert {x: r.stamped for x, r in got.items()} == {"a": True, **dict.fromkeys("bcdefg", False)}
    assert {x for x, r in got.items() if r.error} == set("cdefg") and got["a"].counted == 1600


def test_only_needed_pictures_are_opened(spark, tmp_path):
    """A picture of a small contract isn't there at all, and nobody misses it."""
    write(f"{tmp_path}/a.png", red_picture(0.5))
    amounts = spark.createDataFrame([("a", 60.0), ("b", 10.0), ("c", 70.0)], "project_name string, amount double")
    files = spark.createDataFrame([("a", f"{tmp_path}/a.png"), ("b", f"{tmp_path}/gone.png"), ("c", f"{tmp_path}/gone.png")], "project_name string, path string")
    got = {r.project_name: r.has_red_stamp for r in stamps_where_needed(amounts, None, files).collect()}
    assert got == {"a": True, "b": False, "c": False}


TEXT = "项目编号: {}\n项目名称: 北山\n"


@pytest.fixture
def folders(tmp_path):
    root = str(tmp_path / "root")
    write(f"{root}/QHE-1-A/QHE-1-A.txt", TEXT.format("QHE-1/A"))
    write(f"{root}/QHE-1-A/QHE-1-A-2.txt", TEXT.format("other"))
    write(f"{root}/QHE-1-A/关闭移交登记表.xlsx")
    write(f"{root}/QHE-1-A/竣工总结报告.docx")
    write(f"{root}/QHE-1-A/竣工验收报告.png", red_picture(0.3))
    write(f"{root}/by code/notes.txt", "说明\n项目编号：by code\n项目名称: x")
    write(f"{root}/bad/bad.txt", b"\xff\xfe\x00")
    write(f"{root}/state/project_compare_state.sqlite3")
    os.makedirs(f"{root}/empty")
    os.makedirs(f"{root}/deep/inner")
    write(f"{root}/deep/inner/deep.txt", "x")
    for name in (".hidden", "cache", "success_projects"):
        write(f"{root}/{name}/a.txt", "x")
    write(f"{root}/loose.txt", "x")
    return root


@pytest.mark.parametrize("batch", ["1", "100"])
def test_folders_are_listed(spark, folders, batch):
    listing = list_folders(spark, folders, batch=batch)
    assert {r.project_name for r in listing.folders.collect()} == {"QHE-1-A", "by code", "bad", "state", "empty", "deep"}
    assert {r.path[len(folders) + 1:] for r in listing.files.collect()} == {
        "QHE-1-A/QHE-1-A.txt", "QHE-1-A/QHE-1-A-2.txt", "QHE-1-A/关闭移交登记表.xlsx", "QHE-1-A/竣工总结报告.docx",
        "QHE-1-A/竣工验收报告.png", "by code/notes.txt", "bad/bad.txt", "state/project_compare_state.sqlite3"}
    assert all(r.length == os.path.getsize(r.path) and r.mtime for r in listing.files.collect())
    texts = {r.path[len(folders) + 1:]: (r.text, r.error) for r in listing.texts.collect()}
    assert texts["by code/notes.txt"][0].startswith("说明") and texts["bad/bad.txt"] == (None, "无法读取网页详情文件: bad.txt")
    assert list_folders(spark, folders, texts="").texts.count() == 0
    assert list_folders(spark, folders + "/none").folders.count() == 0


def records_of(spark, root):
    """Cells and summary of the one whole project."""
    def cell(row, col, s, kind="string"):
        return ("QHE-1-A", 0, "S", row, col, kind, s, None)
    labels = {"项目编号": "QHE-1/A", "项目全称": "北山", "用户联系人": "林静", "用户联系方式": "13800000001", "验收日期": "2025-04-05", "合同额（万元）": "60"}
    cells = [cell(0, 0, "字段名称"), cell(0, 1, "内容"), *[c for i, (k, v) in enumerate(labels.items(), 1) for c in (cell(i, 0, k), cell(i, 1, v))]]
    summary = "项目编号：QHE-1/A 报告日期 项目全称 北山 项目类型 x 用户姓名 林静 用户职务 联系电话 13800000001 电子邮件 竣工验收 2025年04月01日 2025年04月09日"
    ai = '{"choices":[{"message":{"content":"{\\"signer_name\\":\\"林静\\",\\"signer_phone\\":\\"13800000001\\",\\"sign_date\\":\\"2025-04-06\\"}"}}]}'
    return {
        "cells": spark.createDataFrame(cells, tables.SCHEMAS["cells"]),
        "summary_texts": spark.createDataFrame([("QHE-1-A", f"{root}/QHE-1-A/竣工总结报告.docx", summary)], tables.SCHEMAS["summary_texts"]),
        "report_pages": spark.createDataFrame([], tables.SCHEMAS["report_pages"]),
        "payloads": spark.createDataFrame([("QHE-1-A", "ai", ai), ("QHE-1-A", "ocr", "down")], tables.SCHEMAS["payloads"]),
    }


def test_folder_to_verdicts(spark, folders):
    """One verdict for each folder, empty ones too; a picture is a report; one of two texts counts."""
    listing = list_folders(spark, folders)
    found = packets(listing.files, listing.texts, listing.folders)
    for name, table in records_of(spark, folders).items():
        table.write.parquet(f"{folders}-tables/{name}")
    rest = PacketTables.read(spark, f"{folders}-tables", found, web_texts=listing.texts, files=listing.files)
    assert rest.pixels is None and rest.payloads is not None
    rows = {r.project_name: r for r in compare(rest).collect()}
    assert len(rows) == 6 and compare(rest).count() == 6
    whole = rows["QHE-1-A"]
    assert whole.web_path.endswith("QHE-1-A-2.txt") and whole.web.project_code == "OTHER"
    assert [f.message for f in whole.failures] == ["xlsx 与 web 不一致"]
    assert whole.report.has_red_stamp and whole.report.signer_name == "林静"
    assert rows["empty"].status == "缺少 Excel 文件" and rows["by code"].web.project_code == "BYCODE"
    assert rows["bad"].web_error == "无法读取网页详情文件: bad.txt" and rows["bad"].web is None


@pytest.mark.parametrize("body,kind,failed", [("not json", "ai", True), (None, "ai", True), ("{}", "ai", False), ("not json", "ocr", False)])
def test_recognition_errors(spark, folders, body, kind, failed):
    """The first service has to answer, the second one need not."""
    listing, records = list_folders(spark, folders), records_of(spark, folders)
    records["payloads"] = records["payloads"].where(F.col("kind") != kind).unionByName(
        spark.createDataFrame([("QHE-1-A", kind, body)], tables.SCHEMAS["payloads"]))
    found = packets(listing.files, listing.texts, listing.folders)
    row = compare(PacketTables(found, web_texts=listing.texts, files=listing.files, **records)).where("project_name = 'QHE-1-A'").first()
    assert (row.report_error == "AI 识别不可用") == failed
    assert (row.status == "验收报告读取失败") == failed and bool(row.fatal_reason) == failed


# --- runs and tables --------------------------------------------------------


class Broken(Exception):
    pass


@pytest.mark.parametrize("step", ["add_success_events", "write_part", "commit"])
def test_a_run_that_fails_between_its_writes_is_not_seen(spark, folders, tmp_path, monkeypatch, step):
    listing, root = list_folders(spark, folders), str(tmp_path / "state")
    found = packets(listing.files, listing.texts, listing.folders)
    whole = PacketTables(found, web_texts=listing.texts.where("path not like '%-2.txt'"), files=listing.files, **records_of(spark, folders))
    whole = PacketTables(**{**whole.__dict__, "packets": found.withColumn("web_path", F.regexp_replace("web_path", "-2.txt", ".txt"))})

    def fail(*_, **__):
        raise Broken
    with monkeypatch.context() as m:
        m.setattr(run, step, fail)
        with pytest.raises(Broken):
            run.run_comparison(whole, root, "1", "2026-01-01 00:00:00")
    assert journal.committed(spark, root) == [] and run.archived(spark, root).count() == 0
    assert state.success_records(spark, root).count() == 0
    run.run_comparison(whole, root, "1", "2026-01-01 00:00:00")
    events = journal.visible(spark, root, state.EVENTS, tables.SCHEMAS["success_events"])
    assert events.count() == 1 and [r.project_name for r in run.archived(spark, root).collect()] == ["QHE-1-A"]
    # passed packets are not compared again, and a stopped run ends at the first unreadable one
    again = run.run_comparison(whole, root, "2", "2026-01-01 00:00:00", on_fatal="stop")
    assert {r.project_name for r in again.collect()} == {"bad"}
    assert journal.visible(spark, root, state.EVENTS, tables.SCHEMAS["success_events"]).count() == 1


def test_snapshot_and_tail_equal_all_events(spark, tmp_path):
    rnd, root, events = random.Random(3), str(tmp_path), []
    versions = []
    for part in range(6):
        rows = []
        for _ in range(40):
            seq = len(events) + len(rows)
            rows.append((seq, f"C{rnd.randrange(25)}", f"n{seq}", "{}", rnd.choice(["pending", "exported"]), None))
        events += rows
        journal.write_part(spark.createDataFrame(rows, tables.SCHEMAS["success_events"]), root, state.EVENTS, f"r{part}")
        unseen = state.success_records(spark, root).count()
        journal.commit(spark, root, f"r{part}")
        assert part or not unseen
        if part in (1, 2, 4):
            versions.append(state.compact_success(spark, root))
            assert state.compact_success(spark, root) == versions[-1]
        want = state.success_state(spark.createDataFrame(events, tables.SCHEMAS["success_events"]))
        assert sorted(state.success_records(spark, root).collect()) == sorted(want.collect())
    assert versions == [1, 2, 3]
    # a version without its pointer is not read
    journal._write(spark.createDataFrame([(1,)], "x int"), f"{root}/{state.EVENTS}_snapshots/version=9", None)
    gone = {x[len(root) + 1:] for x in journal.prune(spark, root, state.EVENTS)}
    assert gone == {f"{state.EVENTS}/run_id=r{k}" for k in range(5)} | {f"{state.EVENTS}_{x}/version={k}" for x in ("snapshots", "pointers") for k in (1, 2)}
    assert sorted(state.success_records(spark, root).collect()) == sorted(want.collect())
    assert journal.prune(spark, root, state.EVENTS) == []


def test_scratch_folders_end_with_their_block(spark):
    with scratch(spark) as base:
        df = stored(spark.range(5), "x")
        assert df.count() == 5 and os.listdir(base)
        with scratch(spark) as inner:
            assert shared_dir(spark, "y").startswith(inner) and inner.startswith(base)
    assert not os.path.exists(base) and not shared_dir(spark, "z").startswith(base)


# --- layout -----------------------------------------------------------------


def records(spark, n=60):
    def of(columns, **more):
        return spark.range(n).select(F.concat(F.lit("P"), F.col("id").cast("string")).alias("project_name"), *columns)
    value = F.struct(F.lit("string").alias("kind"), F.lit("v").alias("s"), F.lit(1.0).alias("n"))
    path = F.concat(F.lit("/"), F.col("id").cast("string"))
    date = F.lit("2025-01-02").cast("date")
    from packetcheck.operators.report import report_struct
    return Records(
        of([path.alias(f"{role}_path") for role in ("registry", "summary", "report", "web")]),
        of([F.create_map(F.lit("项目编号"), value).alias("fields")]),
        of([path.alias("path"), F.struct(F.lit("v").alias("project_code"), F.lit("n").alias("project_name"), F.array(F.lit("a")).alias("contact_names"),
                                         F.array(F.lit("1")).alias("contact_phones"), date.alias("acceptance_start"), date.alias("acceptance_end"),
                                         F.lit(False).alias("invalid_range")).alias("summary")]),
        of([report_struct(F.lit(""), F.lit("x"), F.lit("1"), date).alias("report")]),
        of([path.alias("path"), F.struct(F.lit("V").alias("project_code"), F.lit("n").alias("project_name")).alias("web")]),
    )


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_records_are_assembled_without_exchange(spark, tmp_path):
    made, root = records(spark), str(tmp_path)
    made.write(root, buckets=8)
    opened = Records.open(spark, root)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        loose, plan = plan_of(judge(assemble(*made.sides()))), plan_of(judge(assemble(*opened.sides())))
        verdicts = judge(assemble(*opened.sides())).select("project_name", "status").collect()
        # one project lies in one bucket of each table
        one = opened.only(spark.createDataFrame([("P7",)], "project_name string"))
        joined = judge(assemble(*one.sides()))
        assert joined._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")).count("SelectedBucketsCount: 1 out of 8") == 5
        assert joined.count() == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" in loose and "Exchange" not in plan and plan.count("SortMergeJoin") == 4
    assert sorted(verdicts) == sorted(judge(assemble(*made.sides())).select("project_name", "status").collect()) and len(verdicts) == 60
    # written again, it is replaced
    write_table(made.web.limit(3), f"{root}/web", 8)
    assert open_table(spark, f"{root}/web").count() == 3
    assert of_projects(open_table(spark, f"{root}/packets"), made.packets.limit(0)).count() == 0


# --- reuse ------------------------------------------------------------------


def test_unchanged_documents_are_not_read_again(spark, folders, tmp_path):
    listing, content = list_folders(spark, folders), records_of(spark, folders)
    content["web_texts"] = listing.texts
    root, src, check = (str(tmp_path / x) for x in ("state", "in", "check"))
    roles = F.when(F.col("path").endswith(".xlsx"), "registry").when(F.col("path").endswith(".docx"), "summary") \
        .when(F.col("path").endswith(".png"), "report").when(F.col("path").endswith("QHE-1-A.txt"), "web")
    documents = listing.files.withColumn("role", roles).where("role is not null").select("project_name", "role", "path", "length", "mtime")

    def load(table, docs):
        if table == "pixels":
            return None
        on = ["project_name", "path"] if "path" in content[table].columns else "project_name"
        return content[table].join(docs.select(*([on] if isinstance(on, str) else on)), on, "left_semi")

    def step(rows):
        rows.write.mode("append").parquet(src)
        changes = spark.readStream.schema(reuse.DOCUMENTS).parquet(src)
        reuse.stream_documents(changes, load, root, check, {"ai_enabled": True}).awaitTermination()
        store = reuse.DocumentStore(spark, root)
        last = store.extracted().agg(F.max("seq")).first()[0]
        counts = {r.role: r.documents for r in store.extracted().where(F.col("seq") == last).collect() if r.documents}
        return counts, {r.project_name: (r.passed, r.status) for r in store.verdicts().collect()}

    counts, verdicts = step(documents)
    assert counts == {"registry": 1, "summary": 1, "web": 1, "report": 1} and verdicts == {"QHE-1-A": (True, "比对成功")}
    # named again, but unchanged
    assert step(documents) == ({}, verdicts)
    # another web text: only it is read
    content["web_texts"] = content["web_texts"].withColumn("text", F.replace("text", F.lit("QHE-1/A"), F.lit("QHE-2/A")))
    later = documents.withColumn("mtime", F.col("mtime") + F.expr("interval 1 hour"))
    counts, verdicts = step(later.where("role = 'web'"))
    assert counts == {"web": 1} and verdicts == {"QHE-1-A": (False, "比对失败，1 个问题")}
    reuse.DocumentStore(spark, root).compact()
    # another contact: the report's candidates change, so it is resolved again
    content["cells"] = content["cells"].withColumn("s", F.replace("s", F.lit("林静"), F.lit("林进")))
    counts, verdicts = step(later.where("role = 'registry'"))
    assert counts == {"registry": 1, "report": 1} and verdicts == {"QHE-1-A": (False, "比对失败，2 个问题")}
    # the report is gone
    counts, verdicts = step(later.where("role = 'report'").withColumn("length", F.lit(None).cast("bigint")))
    assert counts == {} and verdicts == {"QHE-1-A": (False, "缺少竣工验收报告文件")}
    counts, verdicts = step(later.where("role = 'report'").withColumn("mtime", F.col("mtime") + F.expr("interval 1 hour")))
    assert counts == {"report": 1} and verdicts["QHE-1-A"][1] == "比对失败，2 个问题"


def test_logs_and_cache_are_compacted(spark, tmp_path):
    root, kind = str(tmp_path), "id bigint, bucket string, message string, created_at timestamp"

    def lines(*ids):
        return spark.createDataFrame([(i, "default", f"m{i}" if i else None, None) for i in ids], kind)

    def shown():
        return sorted(r.message for r in logs.journal_lines(spark, root).collect())
    logs.write_lines(lines(1, 2), root, "a", 0)
    logs.write_lines(lines(1, 2), root, "a", 0)
    assert shown() == ["m1", "m2"] and logs.compact_lines(spark, root) == 1 and shown() == ["m1", "m2"]
    logs.write_lines(lines(0), root, "clear", 1)
    assert shown() == []
    logs.write_lines(lines(3), root, "b", 1)
    assert shown() == ["m3"] and logs.compact_lines(spark, root) == 2 and shown() == ["m3"]
    assert spark.read.parquet(f"{root}/runtime_logs_snapshots/version=2").where("epoch = 0").count() == 0
    entries = [("p", f"f{k % 3}", f"d{k}", k) for k in range(6)] + [("q", "f", "d", 9)]
    for k in range(3):
        state.save_recognition(spark.createDataFrame([e for e in entries if e[3] % 3 == k], tables.SCHEMAS["recognition_cache"]), root, f"c{k}")
        if k == 1:
            state.compact_recognition(spark, root)
    assert sorted(tuple(r) for r in state.saved_recognition(spark, root).collect()) == [("p", "f2", "d5"), ("q", "f", "d")]


def test_tasks_for_very_many_folders_stay_few(spark, tmp_path, monkeypatch):
    """Each task leaves a file, and the planner holds the names alone (F7)."""
    made = [f"QXA-{k:08d}-01" for k in range(1000)]
    for name in [*made, ".hidden", "cache"]:
        os.mkdir(tmp_path / name)
    (tmp_path / "file").write_text("x")
    monkeypatch.setattr(folders_source, "FOLDERS", 10)
    monkeypatch.setattr(folders_source, "TASKS", 7)
    for options, most in ({}, 7), ({"batch": "300"}, 4):
        tasks = folders_source.FolderReader({"path": str(tmp_path), **options}).partitions()
        assert len(tasks) <= most and max(len(x.names) for x in tasks) < 300 * 17
        assert sorted(name for x in tasks for name in x.names.split("/")) == made
    assert [x.names for x in folders_source.FolderReader({"path": f"{tmp_path}/absent"}).partitions()] == [""]


def test_equal_files_of_many_customers_are_one_file(spark, tmp_path):
    """A disk has room for so many files; names of equal contents needn't be files of their own (F7)."""
    root = f"{tmp_path}/projects"
    keys = [*range(1, 400), 5, 6, 6]
    count = storing.write_folders(spark.createDataFrame([(k,) for k in keys], "key long").coalesce(1), root)
    assert count == sum(len(storing._files(k)) for k in keys)
    files = {}
    for k in set(keys):
        folder = f"{root}/QXA-{k:08d}-01"
        assert sorted(os.listdir(folder)) == sorted(storing._files(k))
        for name, content in storing._files(k).items():
            assert open(f"{folder}/{name}", "rb").read() == content
            files.setdefault(name.endswith(".txt"), []).append(os.stat(f"{folder}/{name}").st_ino)
    assert len(set(files[True])) == len(files[True])
    # empty ones, four pictures and what is none; a name written again begins anew
    assert len(files[False]) > 600 and len(set(files[False])) < 20
