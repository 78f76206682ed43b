"""Documents rendered from packet sides, as the sources would deliver them.

Extraction queries run over these; since every document is written from known
sides, the check is simply the side it was written from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from packetcheck import vocab
from packetcheck.operators.web import info_text

BASE_URL = "https://portal.example.org"
REGISTRY_ROLE_NAMES = ["项目编号", "项目全称", "用户联系人", "用户联系方式", "验收日期", "合同额（万元）"]


def packets(sides: DataFrame) -> DataFrame:
    """File listing result per packet; a few lack a file."""
    k = F.col("k")

    def path(missing: Column, suffix: str) -> Column:
        return F.when(~missing, F.concat(F.lit("/data/"), "project_name", F.lit(suffix)))

    return sides.select(
        "project_name",
        path(k % 101 == 0, "/关闭移交登记表.xlsx").alias("registry_path"),
        path(k % 103 == 0, "/竣工总结报告.docx").alias("summary_path"),
        path(k % 107 == 0, "/竣工验收报告.pdf").alias("report_path"),
        path(~F.col("has_web"), "/web.txt").alias("web_path"),
    )


def _split_digits(day: Column) -> Column:
    year = F.date_format(day, "yyyy")
    return F.concat(
        F.substring(year, 1, 2), F.lit(" "), F.substring(year, 3, 2),
        F.date_format(day, "' - 'M' - 'dd"),
    )


def summary_texts(sides: DataFrame) -> DataFrame:
    k, start, end = F.col("k"), F.col("doc_start"), F.col("doc_end")
    people = F.transform(
        F.arrays_zip("doc_names", "doc_phones"),
        lambda p: F.concat(
            F.lit("用户姓名 "), p["doc_names"], F.lit(" 用户职务 项目经理 联系电话 "),
            p["doc_phones"], F.lit(" 电子邮件 a@example.org "),
        ),
    )
    people = F.when(F.size(people) > 0, F.array_join(people, "")).otherwise("用户姓名 用户职务 ")
    plain = "yyyy'年'MM'月'dd'日'"
    dates = (
        F.when(start.isNull(), "竣工验收 未定")
        .when(
            k % 5 == 1,
            F.concat(F.lit("竣工验收 "), _split_digits(start), F.lit(" "), _split_digits(end)),
        )
        .when(
            k % 5 == 2,
            F.concat(
                F.lit("竣工验收(完成时间) "), F.date_format(end, "yyyy.MM.dd"),
                F.lit(" 竣工验收（开始时间） "), F.date_format(start, "yyyy.M.d"),
            ),
        )
        .otherwise(
            F.concat(
                F.lit("竣工验收　"), F.date_format(start, plain), F.lit("\n"),
                F.date_format(end, plain),
            )
        )
    )
    text = F.concat(
        F.lit("项目编号： "), "doc_code", F.lit(" 报告日期：2026年05月06日\n一、项目信息 项目全称 "),
        "doc_name", F.lit(" 项目类型 工程 "), people,
        F.lit("三、项目总结 任务名称 开始时间 完成时间 参与人 "), dates, F.lit(" 参与者"),
    )
    path = F.concat(F.lit("/data/"), "project_name", F.lit("/竣工总结报告.docx"))
    return sides.select("project_name", path.alias("path"), text.alias("text"))


def report_pages(sides: DataFrame) -> DataFrame:
    k, day = F.col("k"), F.col("rep_date")
    date = (
        F.when(day.isNull(), "")
        .when(k % 4 == 3, F.date_format(day, "d'日 'yyyy' 年 'M'月'"))
        .when(k % 2 == 0, F.date_format(day, "yyyy'年'M'月'd'日'"))
        .otherwise(F.date_format(day, "yyyy-MM-dd"))
    )
    first = F.concat(F.lit("竣工验收报告 项目编号 "), F.lower("code"), F.lit(" 建设单位"))
    second = F.concat(
        F.when(k % 3 == 0, "签字人姓名：").otherwise("签字/盖章：").cast("string"),
        F.col("rep_name"),
        F.when(k % 2 == 0, " 联系电话 ").otherwise(" 电话：").cast("string"),
        F.when(k % 59 == 2, F.repeat(F.lit("（移动 手机）"), 9)).otherwise(""),
        "rep_phone", F.lit("\n日期 "), date,
    )
    pages = F.array(
        F.struct(F.lit(2).alias("page"), second.alias("text")),
        F.struct(F.lit(1).alias("page"), first.alias("text")),
    )
    return sides.select("project_name", F.inline_outer(pages))


def web_texts(sides: DataFrame) -> DataFrame:
    text = info_text(
        F.col("web_code"), F.col("web_name"), F.col("category"), F.concat(F.lit("/d/"), F.col("k")),
        F.md5(F.col("k").cast("string")), BASE_URL,
    )
    wide = F.regexp_replace(text, "(?m)^(项目..): ", "$1： ")
    path = F.concat(F.lit("/data/"), "project_name", F.lit("/web.txt"))
    return sides.filter("has_web").select(
        "project_name", path.alias("path"), F.when(F.col("k") % 2 == 0, wide).otherwise(text).alias("text")
    )


def cells(sides: DataFrame) -> DataFrame:
    """Registry sheets: a cover without labels, then labels in one of three layouts.

    With a header, values stand up to four columns right of the labels; without
    one (two packets in seven), right of or below each label.
    """
    k = F.col("k")
    mode = k % 7
    serial = F.datediff(F.col("d"), F.lit("1899-12-30").cast("date")).cast("double")
    compact = F.date_format("d", "yyyyMMdd").cast("double")
    amount = F.col("cents") / 100
    none = F.lit(None)

    def value(kind, s, n) -> Column:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return F.struct(
            kind.cast("string").alias("kind"), s.cast("string").alias("s"),
            n.cast("double").alias("n"),
        )

    dated = F.col("reg_date_text") != "待定"
    values = [
        value("string", F.col("reg_code"), none),
        value("string", F.col("reg_name"), none),
        value("string", F.col("reg_contact"), none),
        value("string", F.col("reg_phone"), none),
        F.when(dated & (k % 3 == 1), value("int", none, compact))
        .when(dated & (k % 3 == 2), value("float", none, serial))
        .otherwise(value("string", F.col("reg_date_text"), none)),
        F.when(k % 2 == 0, value("string", F.col("reg_amount"), none)).otherwise(
            value("float", none, amount)
        ),
    ]

    def cell(sheet: int, row: Column, col: Column, v: Column) -> Column:
        return F.struct(
            F.lit(sheet).alias("sheet_idx"), F.lit(f"S{sheet}").alias("sheet"),
            row.cast("int").alias("row"), col.cast("int").alias("col"), v.alias("v"),
        )

    def word(w: str) -> Column:
        return value("string", F.lit(w), none)

    # some headers stand far down the sheet
    head, one = F.when(k % 101 == 7, 30 + k % 4).otherwise(k % 4), F.lit(1)
    placed = [cell(0, F.lit(0), F.lit(0), word("封面"))]
    header = mode >= 2
    placed += [
        F.when(header, cell(1, head, one, word(vocab.FIELD_HEADER))),
        F.when(header, cell(1, head, 2 + k % 4, word(" 内\n容 "))),
        F.when(header, cell(1, head + 1, one, word("注：以下必填"))),
        F.when(header, cell(1, head + 1, 2 + k % 4, word("说明"))),
        # an earlier row with the same label; the later one below must win
        F.when(header, cell(1, head + 2, one, word("项目全称"))),
        F.when(header, cell(1, head + 2, 2 + k % 4, word("旧名称"))),
    ]
    for i, (label, v) in enumerate(zip(REGISTRY_ROLE_NAMES, values)):
        row = F.when(header, head + 3 + i).when(mode == 0, F.lit(2 * i)).otherwise(F.lit(5 * i))
        shown = label if i % 2 else label + "："
        placed.append(cell(1, row, one, F.when(header, word(label)).otherwise(word(shown))))
        vr = F.when(header, row).when(mode == 0, row).otherwise(row + 1 + k % 3)
        vc = F.when(header, 2 + k % 4).when(mode == 0, 2 + k % 5).otherwise(one)
        placed.append(cell(1, vr, vc, v))
        if i == 0:
            # a reserved word between label and value must be passed over
            placed.append(
                F.when((mode == 0) & (k % 5 == 4), cell(1, row, F.lit(2), word(vocab.REMARK)))
            )
    return (
        sides.select("project_name", F.array(*placed).alias("placed"))
        .select("project_name", F.explode_outer("placed").alias("c"))
        .filter(F.col("c").isNotNull())
        .select("project_name", "c.sheet_idx", "c.sheet", "c.row", "c.col", "c.v.*")
    )


def payloads(sides: DataFrame) -> DataFrame:
    """Stored service responses: chat envelopes and OCR answers in all their shapes."""
    k = F.col("k")
    ai_name = F.when(k % 7 == 0, "").otherwise(F.col("rep_name"))
    conf = F.when(k % 4 == 0, "0.9").when(k % 4 == 1, '"90%"').when(k % 4 == 2, "91").otherwise("250")
    day = F.coalesce(F.date_format("rep_date", "yyyy-MM-dd"), F.lit(""))
    fields = F.concat(
        F.lit('{"signer_name":"'), ai_name, F.lit('","matched_phone":"'), F.col("reg_phone"),
        F.lit('","sign_date":"'), day, F.lit('","name_confidence":'), conf, F.lit("}"),
    )
    fenced = F.concat(F.lit("结果如下:\n```json\n"), fields, F.lit("\n```"))

    def chat(content: Column) -> Column:
        message = F.struct(F.struct(content.alias("content")).alias("message"))
        return F.to_json(F.struct(F.array(message).alias("choices")))

    part = F.array(F.struct(F.lit("text").alias("type"), fields.alias("text")))
    ai = F.when(k % 3 == 0, chat(fields)).when(k % 3 == 1, chat(part)).otherwise(chat(fenced))
    ocr_fields = F.struct(
        F.col("rep_name").alias("matched_name"), F.col("rep_phone").alias("signer_phone")
    )
    ocr = (
        F.when(k % 4 == 0, F.to_json(ocr_fields))
        .when(k % 4 == 1, F.to_json(F.struct(ocr_fields.alias("data"))))
        .when(
            k % 4 == 2,
            F.to_json(F.struct(F.struct(F.concat(
                F.lit("签字人姓名 "), F.col("rep_name"), F.lit(" 电话 "), F.col("rep_phone")
            ).alias("text")).alias("result"))),
        )
        .otherwise('{"success":false,"error":" 识别  失败 "}')
    )
    rows = F.array(
        F.when(k % 5 < 3, F.struct(F.lit("ai").alias("kind"), ai.alias("body"))),
        F.when(k % 5 > 0, F.struct(F.lit("ocr").alias("kind"), ocr.alias("body"))),
    )
    shown = sides.select("project_name", rows.alias("rows")).select("project_name", F.explode_outer("rows").alias("p"))
    return shown.filter(F.col("p").isNotNull()).select("project_name", "p.*")


PAGE_SPAN = 500


def todo_pages(base: DataFrame, with_bad: bool) -> DataFrame:
    """To-do list responses per category, about a hundred items each.

    Every hundredth item shows up again on the next page. How paging ends
    differs by category; with ``with_bad`` some responses are unusable.
    """
    k = F.col("k")
    own = F.floor(k / PAGE_SPAN).cast("int") + 1
    category = F.col("category")
    # in one category page 3 only repeats page 2
    shifted = F.when((category == "4-NOT SPECIFIED") & (own == 3), F.lit(None)).otherwise(own)
    also = F.when((k % 100 == 0) | ((category == "4-NOT SPECIFIED") & (own == 2)), own + 1)
    item = F.array(
        _pair("fdId", F.when(k % 10 == 3, "").otherwise(F.concat(F.lit("t"), k.cast("string")))),
        _pair("todo.subject4View", F.concat(F.lit("<span>项目号：QXA-"), k.cast("string"), F.lit("&nbsp;</span>"))),
        F.when(k % 11 == 5, _pair("other", F.lit("x"))).otherwise(_href(k)),
    )
    shown = base.select(
        "category", "k", F.to_json(item).alias("item"),
        F.explode_outer(F.array(shifted, also)).alias("page_no"),
    ).filter(F.col("page_no").isNotNull())
    totals = (
        F.when(category == "1-URGENT", '"totalPage":20,')
        .when(category == "2-HIGH", '"pageCount":" 25 ",')
        .when(category == "3-MEDIUM", '"total":"1000",')
        .otherwise('"total":0,')
    )
    body = F.concat(F.lit("{"), totals, F.lit('"datas":['), F.array_join("items", ","), F.lit("]}"))
    pages = shown.groupBy("category", "page_no").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("k", "item"))), lambda x: x["item"]).alias("items")
    )
    if with_bad:
        no = F.col("page_no")
        body = (
            F.when(no % 6 == 1, "<html><head><title>登录</title></head></html>")
            .when(no % 6 == 2, '{"success":true}')
            .when(no % 6 == 3, '{"datas":[],"message":"请先\\u767b录"}')
            .when(no % 6 == 4, "not json")
            .otherwise(body)
        )
    return pages.select("category", "page_no", body.alias("body"))


def _pair(col: str, value: Column) -> Column:
    return F.struct(F.lit(col).alias("col"), value.cast("string").alias("value"))


def _href(k: Column) -> Column:
    path = F.concat(F.lit("/d/"), k.cast("string"))
    return F.when(k % 2 == 0, _pair("tr_href", path)).otherwise(_pair("_tr_href", path))


ATTACHMENT_NAMES = ["关闭移交登记表.xlsx", "竣工总结报告.docx", "竣工验收报告.PDF", "来往.eml", "其他.zip"]


def detail_pages(sides: DataFrame) -> DataFrame:
    """Portal detail pages with up to six announced attachments."""
    k = F.col("k")

    def call(i: Column) -> Column:
        kind = ((k + i) % 5).cast("int")
        escaped = [
            "".join(f"\\u{ord(ch):04x}" if ord(ch) > 127 else ch for ch in n) for n in ATTACHMENT_NAMES
        ]
        names = F.when(
            i % 2 == 0, F.get(F.array(*[F.lit(n) for n in escaped]), kind)
        ).otherwise(F.get(F.array(*[F.lit(n) for n in ATTACHMENT_NAMES]), kind))
        same = F.when((k % 9 == 0) & (i == 1), F.lit(0)).otherwise(i)
        return F.concat(
            F.lit('addDoc("'), i.cast("string"), F.lit("-"), names, F.lit('","'),
            F.md5(F.concat_ws("-", k.cast("string"), same.cast("string"))),
            F.lit('",true,"application/octet-stream","10","key","v" );\n'),
        )

    calls = F.when(k % 7 == 0, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(0), (k % 7 - 1).cast("int")), call)
    )
    code_cell = F.when(k % 12 == 5, " ").otherwise(
        F.concat("code", F.lit(" <script>//noise alert('x')</script>"))
    )
    name_cell = F.when(k % 14 == 6, "").otherwise(F.col("title"))
    html = F.concat(
        F.lit("<html><body><table><tr><td><label>项目编号</label></td>\n<td>"), code_cell,
        F.lit("</td></tr><tr><td>项目名称</td><td> <b>"), name_cell,
        F.lit("</b>&nbsp;</td></tr></table><p>关闭依据附件</p><script>\n"),
        # in some pages the attachments stand far behind their heading
        F.when(k % 499 == 3, F.repeat(F.lit("x"), 40_000)).otherwise(""),
        F.array_join(calls, ""), F.lit("</script></body></html>"),
    )
    subject = F.when(k % 24 == 5, "无").otherwise(F.concat(F.lit("项目号："), F.lower("code")))
    return sides.select(
        F.md5(k.cast("string")).alias("fd_id"), subject.alias("subject"),
        html.alias("html"),
    )


def files(sides: DataFrame) -> DataFrame:
    """File listing with decoys, mixed-case extensions and reserved folders."""
    k = F.col("k")
    folder = F.when(k % 50 == 0, F.get(
        F.array(*[F.lit(d) for d in [*vocab.RESERVED_DIRS, ".hidden"]]), (k / 50 % 9).cast("int")
    )).otherwise(F.translate("project_name", "-", "_"))
    names = F.array(
        F.when(k % 6 != 0, "b关闭移交登记表.XLSX"), F.when(k % 6 == 1, "a关闭移交登记表.xls"),
        F.lit("关闭移交登记表.pdf"),
        F.when(k % 5 != 0, "竣工总结报告.doc"),
        F.when(k % 4 != 0, "竣工验收报告.JPeG"), F.lit("扫描件.png"),
        F.when(k % 3 == 0, F.concat("project_name", F.lit(".txt")))
        .when(k % 3 == 1, F.lit("说明.txt")),
        F.lit("project_compare_state.sqlite3"),
    )
    return sides.select(
        "k", "project_name", folder.alias("folder"), F.explode_outer(names).alias("name")
    ).filter(F.col("name").isNotNull()).select(
        F.concat(F.lit("/data/"), "folder", F.lit("/"), "name").alias("path"),
        F.length("name").cast("bigint").alias("length"), F.lit(None).cast("timestamp").alias("mtime"),
        F.when(F.col("name") == "说明.txt", F.concat(
            F.lit("说明\n项目编号：\n 项目编号: "), F.lower("project_name"), F.lit("\n")
        )).alias("text"),
    )
