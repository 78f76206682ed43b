"""Portal info texts: reading and writing the ``label: value`` lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from packetcheck.functions.pages import detail_url, filled_url
from packetcheck.functions.text import normalize_text, project_code


def line_value(content: Column, label: str) -> Column:
    """Value of the first line that starts with the label and a colon."""
    pattern = rf"(?md)^[\s\x{{0085}}\p{{Z}}&&[^\n]]*{label}[:：](.*)$"
    return normalize_text(F.regexp_extract(content, pattern, 1))


def web_records(texts: DataFrame) -> DataFrame:
    """``project_name, text`` (and ``path`` and ``error``, if there) to one ``web`` struct per text."""
    record = F.struct(
        project_code(line_value(F.col("text"), "项目编号")).alias("project_code"),
        line_value(F.col("text"), "项目名称").alias("project_name"),
    )
    keys = [c for c in texts.columns if c in ("path", "error")]
    return texts.select("project_name", *keys, record.alias("web"))


def info_text(
    code: Column, name: Column, category: Column, path: Column, item_id: Column, base_url: str,
    item_path: str = "/items/{id}", suffix: str = "",
) -> Column:
    """Info text of a portal record; ``web_records`` reads it back.

    ``item_path`` is the portal's path of an item, ``suffix`` what it adds to pages.
    """
    return F.concat(
        F.lit("项目编号: "), code, F.lit("\n项目名称: "), name,
        F.lit("\n来源分类: "), category,
        F.lit("\n详情页: "), detail_url(path, base_url, suffix),
        F.lit("\n待办页: "), filled_url(item_path, base_url, id=item_id), F.lit("\n"),
    )
