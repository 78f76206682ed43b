"""What keeps work on large tables in proportion: how rows are dealt out, and the session's settings."""

import datetime as dt
import glob

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrameWriter, functions as F

from packetcheck import session, vocab
from packetcheck.catalog import comparing, extracting, storing
from packetcheck.catalog.derived import Tables
from packetcheck.functions.text import field_label
from packetcheck.functions.values import cell_text
from packetcheck.operators.cells import _WORDS, _bare, marker_cells
from packetcheck.operators.report import REPORT_TYPE
from packetcheck.operators.stamps import stamps_where_needed
from packetcheck.operators.verdict import SIDES, with_sides
from packetcheck.plans.run import run_comparison
from packetcheck.streaming import reuse


def write_orders(spark, folder, keys):
    day = dt.datetime(2024, 1, 2)
    spark.createDataFrame(
        [(k, k, "O", 100.0 * k, day, "1-URGENT") for k in keys],
        "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    ).write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame(
        [(k, day, "R", 1, k) for k in keys],
        "l_orderkey long, l_shipdate timestamp_ntz, l_returnflag string, l_linenumber int, l_partkey long",
    ).write.parquet(f"{folder}/lineitem.parquet")


def test_documents_are_stored_as_they_are_dealt(spark, tmp_path, monkeypatch):
    """Rendered rows are many and wide: dealing them out in turn sorted and spilled them all."""
    write_orders(spark, tmp_path, range(1, 40))
    plans, write = [], DataFrameWriter.parquet

    def seen(self, path, *rest, **options):
        plans.append(self._df._jdf.queryExecution().toString())
        return write(self, path, *rest, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", seen)
    tables = Tables(spark, str(tmp_path))
    assert tables.cells.select("project_name").distinct().count() == 39
    assert tables.packets.count() == 39
    assert len(plans) == 3 and not any("RoundRobin" in plan for plan in plans)


def test_queries_set_what_a_plain_session_lacks(spark, monkeypatch):
    monkeypatch.setitem(session.DEFAULTS, "spark.sql.codegen.maxFields", "77")
    monkeypatch.setitem(session.DEFAULTS, "spark.sql.shuffle.partitions", "9")
    plain = session.tuned(spark.newSession())
    assert plain.conf.get("spark.sql.codegen.maxFields") == "77"
    assert plain.conf.get("spark.sql.shuffle.partitions") == "8", "given by the session itself"


def test_marks_are_found_as_their_cleaned_texts_are(spark):
    """One pattern finds the labels and headers that cleaning each text would find."""
    ends = ["", " ", "\t", "\n", "\u00a0", "\u0085", ":", "：", "\u3000", "\t:\t", "\u2003：\n", "\x1f", "\u200b"]
    words = [*vocab.REGISTRY_LABELS, vocab.FIELD_HEADER, vocab.CONTENT_HEADER, vocab.REMARK, "项目", "内容编号"]
    texts = [a + w + b for w in words for a in ends for b in ends]
    texts += [w[:1] + x + w[1:] for w in words for x in ends] + [w.lower() for w in words] + ["", "项目编号项目全称"]
    kinds = ["string", "bool", "datetime", "int", "float", "empty", "error", None]
    rows = [("p", 0, i, 50, kind, s, 5.0) for i, (s, kind) in enumerate((s, kind) for s in texts for kind in kinds)]
    schema = "project_name string, sheet_idx int, row int, col int, kind string, s string, n double"
    cells = spark.createDataFrame([*rows, ("p", 0, len(rows), 50, "string", None, 1.0)], schema)
    text = F.col("text")
    known = [_bare(label) for label in vocab.REGISTRY_LABELS]
    cleaned = cells.where("s is not null").select("row", cell_text(F.col("kind"), F.col("s"), F.col("n")).alias("text"))
    want = {
        (r["row"], r["label"], r["field"], r["content"]) for r in cleaned.select(
            "row", field_label(text).alias("label"), (text == vocab.FIELD_HEADER).alias("field"),
            (text == vocab.CONTENT_HEADER).alias("content")).collect()
        if r["label"] in known or r["field"] or r["content"]
    }
    got = {(r["row"], _WORDS[r["label"] - 1], r["is_field"], r["value_col"] is not None) for r in marker_cells(cells).collect()}
    assert len(want) > 1000 and got == want


def test_pixels_are_dealt_out_as_flags(spark):
    """What goes to the join and the counts is whether a pixel is red, from shares of files of a set size (F20)."""
    pixels = spark.createDataFrame([("p", 1, 200, 60, 60)], "project_name string, page int, r int, g int, b int")
    amounts = spark.createDataFrame([("p", 1e9)], "project_name string, amount double")
    found = stamps_where_needed(amounts, pixels)
    lines = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    semi = next(k for k, line in enumerate(lines) if "LeftSemi" in line)
    first = next(line for line in lines[semi:] if "Project [" in line)
    assert " AS red#" in first
    assert [r.has_red_stamp for r in found.collect()] == [True]
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") in ("16MB", str(16 << 20), f"{16 << 20}b")


def test_batches_for_workers_are_bounded_by_their_bytes(spark):
    texts = spark.range(0, 6000, 1, 1).select(F.concat(F.repeat(F.lit("word "), 1600), F.col("id").cast("string")).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.get_total_buffer_size()])], ["n"])

    # Arrow's buffers grow by doubling
    assert max(r.n for r in texts.mapInArrow(sizes, "n long").collect()) <= 20 << 20


def test_only_open_reports_have_their_other_documents_taken_apart(spark, tmp_path, monkeypatch):
    """Recognition that isn't used needs no sheet, summary or answer of the project (F6)."""
    write_orders(spark, tmp_path, range(30, 95))
    read = {}
    for name in ("registry_fields", "summary_records", "payload_records"):
        def seen(rows, *, name=name, real=getattr(extracting, name)):
            read[name] = {r[0] for r in rows.select("project_name").distinct().collect()}
            return real(rows)
        monkeypatch.setattr(extracting, name, seen)
    assert extracting.reports_where_needed(Tables(spark, str(tmp_path))).count() == 65
    without_date = {"QXA-00000043-01", "QXA-00000086-01"}
    assert read == {"registry_fields": without_date, "summary_records": without_date, "payload_records": without_date}


def encodings(folder):
    """Encodings of the columns of a folder's files."""
    found = set()
    for path in glob.glob(f"{folder}/**/*.parquet", recursive=True):
        meta = pq.ParquetFile(path).metadata
        for group in range(meta.num_row_groups):
            found |= {x for k in range(meta.num_columns) for x in meta.row_group(group).column(k).encodings}
    return found


def test_a_run_stores_reports_without_repeats_and_dictionaries(spark, tmp_path, monkeypatch):
    """Writing the reports took as long as making them (F2)."""
    write_orders(spark, tmp_path, range(30, 60))
    roots = []
    monkeypatch.setattr(comparing, "run_comparison", lambda tables, root, *rest: (roots.append(root), run_comparison(tables, root, *rest)))
    assert comparing.whole_run(Tables(spark, str(tmp_path))).count() == 30
    reports = spark.read.parquet(f"{roots[0]}/reports/run_id=1")
    assert not set(SIDES) & set(reports.columns)
    assert {"project_name", "project_code", "passed", "status", "failures", "details", "fatal_reason", "fields", "summary", "report", "web",
            "rows", "log_json"} <= set(reports.columns)
    found = encodings(f"{roots[0]}/reports/run_id=1")
    assert found and not any("DICTIONARY" in x for x in found)


def test_the_rules_flat_columns_are_those_that_runs_leave_out(spark):
    sides = with_sides(spark.createDataFrame([], (
        "fields map<string,struct<kind:string,s:string>>, "
        "summary struct<project_code:string,project_name:string,contact_names:array<string>,contact_phones:array<string>,"
        "acceptance_start:date,acceptance_end:date,invalid_range:boolean>, "
        f"report {REPORT_TYPE}, web struct<project_code:string,project_name:string>")))
    assert sides.columns == ["fields", "summary", "report", "web", *SIDES]


def test_a_batch_stores_each_record_once_on_the_way(spark, tmp_path, monkeypatch):
    """Kept and fresh records are stored apart; storing what unites them wrote every record again (F1, F3)."""
    write_orders(spark, tmp_path, range(30, 60))
    purposes, found = [], set()

    def seen(df, purpose, **options):
        rows = session.stored(df, purpose, **options)
        purposes.append(purpose)
        if purpose.startswith(("asked-", "read-")):
            found.update(encodings(rows.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]) if rows.inputFiles() else ())
        return rows

    monkeypatch.setattr(reuse, "stored", seen)
    assert storing.stream_documents_query(Tables(spark, str(tmp_path))).count() == 30
    batch = ["told", "keys", "packets"] + [f"{step}-{role}" for role in reuse.ROLES for step in ("asked", "read")]
    assert sorted(purposes) == sorted(batch * 3)
    assert found and not any("DICTIONARY" in x for x in found)
