"""Packet discovery: which project folders exist and which file plays which role."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from packetcheck import vocab
from packetcheck.functions.text import project_code, trim_text


def is_project_dir(name: Column) -> Column:
    return ~name.startswith(".") & ~name.isin(vocab.RESERVED_DIRS)


def split_paths(files: DataFrame) -> DataFrame:
    """Add ``project_name`` and ``name``; drop reserved folders."""
    parts = F.split("path", "/")
    return (
        files.withColumn("project_name", F.element_at(parts, -2))
        .withColumn("name", F.element_at(parts, -1))
        .filter(is_project_dir(F.col("project_name")))
    )


def project_folders(files: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """Distinct project folders: those that hold any file, the state file too, and
    those of a listing ``folders(project_name)``, which may be empty."""
    names = split_paths(files).select("project_name")
    if folders is not None:
        listed = folders.select("project_name").filter(is_project_dir(F.col("project_name")))
        names = names.unionByName(listed)
    return names.distinct()


def discover_projects(files: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """Project folders in name order."""
    return project_folders(files, folders).orderBy("project_name")


def has_file_role(name: Column, role: tuple[str, list[str]]) -> Column:
    """File name holds the role's keyword and has one of its extensions."""
    keyword, extensions = role
    return name.contains(keyword) & F.lower(name).rlike(r"\.(" + "|".join(extensions) + ")$")


def _folder_form(c: Column) -> Column:
    return F.translate(project_code(c), "_", "-")


def text_code(content: Column) -> Column:
    """First non-empty project code line of a text; null if there is none."""
    blank = r"[\s\x{0085}\p{Z}&&[^\n]]"
    line = rf"(?md)^{blank}*项目编号[:：]{blank}*+([^\n]+)$"
    found = trim_text(F.regexp_extract(content, line, 1))
    return F.nullif(found, F.lit(""))


def is_web_text(name: Column, project: Column, content: Column) -> Column:
    """Text file that belongs to the project by its name or its code line."""
    expected = _folder_form(project)
    stem = F.regexp_replace(name, r"(\.txt)+$", "")
    by_name = name.startswith(project) | ((expected != "") & (_folder_form(stem) == expected))
    by_code = F.coalesce(_folder_form(text_code(content)) == expected, F.lit(False))
    return F.lower(name).endswith(".txt") & (by_name | by_code)


def packets(
    files: DataFrame, contents: DataFrame | None = None, folders: DataFrame | None = None
) -> DataFrame:
    """One row per project: the first file by name of each role, and missing roles.

    A folder without files, or with the state file only, lacks every role.

    ``contents(path, text)`` adds the texts that are recognised only by their
    code line. ``min`` picks the first name and combines before the shuffle.
    """
    named = split_paths(files).filter(F.col("name") != vocab.STATE_FILE)
    if contents is None:
        named = named.withColumn("text", F.lit(None).cast("string"))
    else:
        named = named.join(contents.select("path", "text"), "path", "left")
    name = F.col("name")
    role_paths = {
        "registry_path": has_file_role(name, vocab.REGISTRY_ROLE),
        "summary_path": has_file_role(name, vocab.SUMMARY_ROLE),
        "report_path": has_file_role(name, vocab.REPORT_ROLE),
        "web_path": is_web_text(name, F.col("project_name"), F.col("text")),
    }
    rows = named.groupBy("project_name").agg(
        *[F.min(F.when(role, F.col("path"))).alias(column) for column, role in role_paths.items()]
    )
    missing = F.array(
        F.when(F.col("registry_path").isNull(), "xlsx/xls"),
        F.when(F.col("summary_path").isNull(), "docx/doc"),
        F.when(F.col("report_path").isNull(), "pdf/jpg/jpeg/png"),
    )
    every = project_folders(files, folders).join(rows, "project_name", "left")
    return every.withColumn("missing", F.array_compact(missing))
