"""Record tables laid out by project, so that packets are assembled where the records are.

Each table is bucketed and sorted by ``project_name`` into the same number of buckets: joins by
project, and by project and path, need no exchange, and a batch of projects reads the buckets
they are in. How a table is laid out is written beside it, so any session can open it.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession, functions as F

KEY = "project_name"
BUCKETS = 64
#: Up to so many projects are named in a filter, by which buckets and row groups are skipped.
NAMED = 10_000


def _opened(spark: SparkSession, path: str, schema: str, buckets: int) -> str:
    """Name of the table at ``path`` in this session's catalog."""
    name = "layout_" + hashlib.md5(path.encode()).hexdigest()
    spark.sql(
        f"create table if not exists {name} ({schema}) using parquet clustered by ({KEY}) "
        f"sorted by ({KEY}) into {buckets} buckets location '{path}'"
    )
    return name


def write_table(rows: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Store a table by project; what was there is replaced."""
    spark = rows.sparkSession
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    name = _opened(spark, path, schema, buckets)
    rows.repartition(buckets, KEY).write.insertInto(name, overwrite=True)
    spark.range(1).select(F.lit(schema).alias("schema"), F.lit(buckets).alias("buckets")).write.mode(
        "overwrite"
    ).parquet(f"{path}_layout")


def open_table(spark: SparkSession, path: str) -> DataFrame:
    layout = spark.read.parquet(f"{path}_layout").first()
    return spark.table(_opened(spark, path, layout["schema"], layout["buckets"]))


def of_projects(table: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of some projects of a stored table.

    Few projects are named in a filter, so that only their buckets are read; for many, which are
    in nearly all buckets, the names stay a table.
    """
    names = [r[KEY] for r in keys.select(KEY).distinct().limit(NAMED + 1).collect()]
    if len(names) <= NAMED:
        return table.where(F.col(KEY).isin(names))
    return table.join(keys.select(KEY).distinct(), KEY, "left_semi")


@dataclass(frozen=True)
class Records:
    """Packets and their four records, as ``assemble`` takes them."""

    packets: DataFrame
    registry: DataFrame
    summary: DataFrame
    report: DataFrame
    web: DataFrame

    def sides(self) -> tuple[DataFrame, ...]:
        return tuple(getattr(self, f.name) for f in fields(self))

    def write(self, root: str, buckets: int = BUCKETS) -> None:
        for f in fields(self):
            write_table(getattr(self, f.name), f"{root}/{f.name}", buckets)

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> "Records":
        return cls(**{f.name: open_table(spark, f"{root}/{f.name}") for f in fields(cls)})

    def only(self, keys: DataFrame) -> "Records":
        return Records(**{f.name: of_projects(getattr(self, f.name), keys) for f in fields(self)})
