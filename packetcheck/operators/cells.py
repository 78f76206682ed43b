"""Registry sheets: from a long table of cells to one typed record per project.

Cells come as ``project_name, sheet_idx, sheet, row, col, kind, s, n`` and are
read twice: once for the few marker cells that give a sheet its layout, once to
pick the cells the layout points at. Both readings are dealt out by project, which
all later keys begin with; no sheet is gathered into one value.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from packetcheck import vocab
from packetcheck.functions.arrays import present
from packetcheck.functions.dates import first_date
from packetcheck.functions.text import WS
from packetcheck.functions.values import (
    cell_kind, cell_string, cell_text, is_meaningful, make_value, value_text, with_cell_value,
)

SHEET = ["project_name", "sheet_idx"]
# a content header may stand this far right of its field header, a label's value
# this far right of the label or else this far below; all are arguments
HEADER_REACH = 4
RIGHT_REACH = 5
DOWN_REACH = 3
COLUMNS = 1 << 20  # more than any sheet format has


def _bare(label: str) -> str:
    return label.translate(str.maketrans("", "", "\n\r 　:：")).strip()


#: What goes from the ends of a label: white space and colons.
_LOOSE_ENDS = r"[\s\x{0085}\p{Z}:：]"


def _marks(words: list[str], between: str, ends: str) -> str:
    """Pattern of texts that are one of some words, but for ``ends`` around and ``between`` in them."""
    spaced = "|".join(between.join(map(re.escape, word)) for word in words)
    return rf"\A{ends}*(?:{spaced}){ends}*\z"


#: Words of marks in the order of their texts. Marks carry a word's place in it: the maximum of
#: numbers is found by hashing, that of texts by sorting.
_WORDS = sorted({_bare(label) for label in vocab.REGISTRY_LABELS} | {vocab.FIELD_HEADER, vocab.CONTENT_HEADER})


def label_number(label: Column) -> Column:
    return F.array_position(F.array(*[F.lit(word) for word in _WORDS]), label)


def marker_cells(cells: DataFrame, header_reach: int = HEADER_REACH) -> DataFrame:
    """Cells that are a known label, a field header or a content header.

    A content header is repeated at the addresses left of it in reach, where it
    would serve a field header; ``value_col`` says where it really stands.
    """
    known = [_bare(label) for label in vocab.REGISTRY_LABELS]
    shown, label_marks = F.col("shown"), _marks(known, "[\\n\\r \\x{3000}:：]*", _LOOSE_ENDS)
    field_mark, content_mark = (_marks([x], "\\n*", WS) for x in (vocab.FIELD_HEADER, vocab.CONTENT_HEADER))
    # numbers are no labels, and bools are compared in lower case, as cell texts are
    text = F.when(F.col("kind") == "bool", F.lower("s")).when(~F.col("kind").isin("int", "float", "empty"), F.col("s"))
    # one search settles which cells are marks; only those are taken apart
    kept = cells.select(*SHEET, "row", "col", text.alias("shown")).filter(
        shown.rlike(f"{label_marks}|{field_mark}|{content_mark}")
    ).select(
        *SHEET, "row", "col", label_number(F.regexp_replace(shown, f"{_LOOSE_ENDS}+", "")).alias("label"),
        shown.rlike(field_mark).alias("is_field"), shown.rlike(content_mark).alias("is_content"),
    )
    at = F.when(
        F.col("is_content"),
        F.sequence(F.col("col") - header_reach, F.col("col") - 1),
    ).otherwise(F.array("col"))
    return kept.select(
        *SHEET, "row", F.explode_outer(at).alias("at"), "label", "is_field",
        F.when(F.col("is_content"), F.col("col")).alias("value_col"),
    ).repartition("project_name")


def sheet_layouts(cells: DataFrame, header_reach: int = HEADER_REACH) -> DataFrame:
    """Header and label positions of each sheet; ``labels`` maps place to label.

    The header is the topmost-leftmost field header with a content header in
    reach; of each known label the first cell, row by row, counts.
    """
    places = marker_cells(cells, header_reach).groupBy(*SHEET, "row", "at").agg(
        F.bool_or("is_field").alias("is_field"),
        F.min("value_col").alias("value_col"),
        F.max(F.when(F.col("value_col").isNull(), F.col("label"))).alias("label"),
    )
    # positions as one number each: minima of numbers aggregate by hashing,
    # minima of structs would sort
    place = F.col("row").cast("bigint") * COLUMNS + F.col("at")
    offset = F.col("value_col") - F.col("at")
    is_header = F.col("is_field") & F.col("value_col").isNotNull()
    labels = vocab.REGISTRY_LABELS
    found = places.groupBy(*SHEET).agg(
        F.min(F.when(is_header, place * (header_reach + 1) + offset)).alias("header"),
        *[F.min(F.when(F.col("label") == _WORDS.index(_bare(x)) + 1, place)).alias(x) for x in labels],
    )
    at = F.floor(F.col("header") / (header_reach + 1)).cast("bigint")
    header = F.when(
        F.col("header").isNotNull(),
        F.struct(
            _row_of(at).alias("row"), _col_of(at).alias("col"),
            (_col_of(at) + F.col("header") % (header_reach + 1)).cast("int").alias("value_col"),
        ),
    )
    places = F.filter(
        F.array(*[F.struct(F.col(x).alias("place"), F.lit(x).alias("label")) for x in labels]),
        lambda p: p["place"].isNotNull(),
    )
    return found.select(
        *SHEET, header.alias("header"), F.map_from_entries(places).alias("labels")
    )


def _row_of(place: Column) -> Column:
    return F.floor(place / COLUMNS).cast("int")


def _col_of(place: Column) -> Column:
    return (place % COLUMNS).cast("int")


def chosen_layouts(layouts: DataFrame) -> DataFrame:
    """First sheet of each project with a header or any known label."""
    useful = F.col("header").isNotNull() | (F.size("labels") > 0)
    chosen = F.min_by(F.struct(*SHEET[1:], "header", "labels"), F.when(useful, F.col("sheet_idx")))
    return (
        layouts.groupBy("project_name")
        .agg(chosen.alias("l"))
        .filter(F.col("l").isNotNull())
        .select("project_name", "l.*")
    )


HIT = "struct<row:int,label:string,rank:int,is_label:boolean>"


def layout_hits(
    cells: DataFrame, layouts: DataFrame, right_reach: int = RIGHT_REACH, down_reach: int = DOWN_REACH
) -> DataFrame:
    """Cells the layouts point at: under the header, or next to a label.

    Under the header a hit belongs to a row, next to a label to that label;
    ``rank`` orders neighbours, right ones before lower ones; only meaningful
    cells count as neighbours.
    """
    c, row, col = F.col, F.col("row"), F.col("col")
    # whether a cell can be a value at all does not depend on the label, so it
    # is settled once per cell and spares the other cells' hits
    value = make_value(cell_kind(c("kind"), c("n")), cell_string(c("kind"), c("s"), c("n")))
    typed = cells.select(*SHEET, "row", "col", "kind", "s", "n", is_meaningful(value).alias("ok"))
    typed = typed.repartition("project_name")
    # joined by project alone, as the cells are dealt out; the sheet is compared
    # in the conditions below, since a filter would widen the join key
    joined = typed.join(layouts.withColumnRenamed("sheet_idx", "layout_sheet"), "project_name")
    here = c("sheet_idx") == c("layout_sheet")
    under = (row > c("header.row")) & ((col == c("header.col")) | (col == c("header.value_col")))
    none, place = F.lit(None), row.cast("bigint") * COLUMNS + col
    found = [(
        here & F.coalesce(under, F.lit(False)), F.struct(row, none, none, col == c("header.col")),
    )]
    # look for a label at each place this cell would be a neighbour of
    back = [*range(1, right_reach + 1), *(COLUMNS * d for d in range(1, down_reach + 1))]
    for rank, distance in enumerate(back):
        label = F.try_element_at("labels", place - distance)
        found.append((here & c("ok") & label.isNotNull(), F.struct(none, label, F.lit(rank), none)))
    pointed = present(*found, kind=HIT)
    # a projection of its own is compiled; inside the explode the hits would be interpreted
    aimed = joined.select("project_name", "kind", "s", "n", pointed.alias("pointed"))
    # the outer form keeps the optimizer from evaluating the hits twice
    hits = aimed.select("project_name", "kind", "s", "n", F.explode_outer("pointed").alias("hit"))
    return hits.filter(F.col("hit").isNotNull()).select("project_name", "kind", "s", "n", "hit.*")


def registry_fields(
    cells: DataFrame, header_reach: int = HEADER_REACH, right_reach: int = RIGHT_REACH,
    down_reach: int = DOWN_REACH,
) -> DataFrame:
    """``project_name, label, value`` of each project's registry sheet.

    Rows under the header come first, the last one of a label winning; labels
    they leave open take the first meaningful neighbour.

    The cells are dealt out by project once for each of their two readings, and
    every step after that keeps to the project. One project's cells meet in a
    task; a workbook bounds them, and the aggregates hold its labels only.
    """
    c = F.col
    layouts = chosen_layouts(sheet_layouts(cells, header_reach))
    hits = layout_hits(cells, layouts, right_reach, down_reach)
    valued = with_cell_value(hits, c("label"), c("kind"), c("s"), c("n"))
    cell = F.struct("kind", "s", "n")
    paired = valued.groupBy("project_name", "row", "label").agg(
        F.max(F.when(c("is_label"), cell)).alias("l"),
        F.max(F.when(~c("is_label"), cell)).alias("v"),
        F.min_by("value", "rank").alias("near"),
    )
    named = paired.select(
        "project_name", "row", "near",
        F.coalesce("label", cell_text(c("l.kind"), c("l.s"), c("l.n"))).alias("label"),
        F.when(c("l").isNotNull(), c("v.kind")).alias("kind"), c("v.s").alias("s"), c("v.n").alias("n"),
    )
    under = with_cell_value(named, c("label"), c("kind"), c("s"), c("n"))
    skipped = ["", vocab.SHEET_TITLE, vocab.FIELD_HEADER, vocab.CONTENT_HEADER, vocab.REMARK]
    counts = c("value").isNotNull() & c("kind").isNotNull()
    merged = under.groupBy("project_name", "label").agg(
        F.max_by("value", F.when(counts, c("row"))).alias("header_value"),
        F.max("near").alias("near"),
    )
    by_header = ~c("label").isin(skipped) & ~c("label").startswith(vocab.NOTE_PREFIX)
    value = F.coalesce(F.when(by_header, c("header_value")), c("near"))
    return merged.select("project_name", "label", value.alias("value")).filter(
        c("value").isNotNull()
    )


def registry_columns(fields: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """One row per project with a value column per label."""
    labels = labels or sorted(
        {*vocab.REGISTRY_LABELS, *vocab.NAME_ALIASES, *vocab.PHONE_ALIASES}
    )
    return fields.groupBy("project_name").agg(
        *[F.max(F.when(F.col("label") == label, F.col("value"))).alias(label) for label in labels]
    )


def registry_records(fields: DataFrame) -> DataFrame:
    """One row per project with the known labels as a map."""
    wide = registry_columns(fields)
    labels = [c for c in wide.columns if c != "project_name"]
    pairs = [x for label in labels for x in (F.lit(label), F.col(label))]
    known = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())
    return wide.select("project_name", known.alias("fields"))


def field_value(fields: Column, label: str) -> Column:
    return F.try_element_at(fields, F.lit(label))


def registry_date(fields: Column) -> Column:
    """Acceptance date, or else completion or verification date."""
    return first_date(*[value_text(field_value(fields, label)) for label in vocab.DATE_LABELS])
