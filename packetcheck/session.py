"""Session defaults and shared folders."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

#: A batch of rows on the way to a Python worker or back.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Writer's option for tables whose texts nearly all differ: a dictionary of each column would only cost time.
NO_DICTIONARY = {"parquet.enable.dictionary": "false"}

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # join by hashing instead of sorting, but only where each partition is small
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    # tables laid out by project join on project and path without being dealt out again
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # rows are many times larger in memory than compressed in an exchange: let the number of partitions
    # grow with the data instead, so that sorts stay in memory
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16MB",
    # nor may a task's share of a file grow with the file: what a task holds back for its exchange grows with its rows
    "spark.sql.files.maxPartitionBytes": "16MB",
    # 10,000 rows of texts may take any size; a task and its worker each hold a batch or two
    BATCH_BYTES: "8MB",
    # rule suites compile to long methods; beyond this size the JIT gives up, so
    # let Spark split the expressions into small methods instead
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(app: str, master: str | None = None, **settings: str) -> SparkSession:
    """Session with the engine's defaults; any setting can be overridden."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tuned(spark: SparkSession, *keys: str) -> SparkSession:
    """The engine's settings (or the named ones) for a session that was built without them, but for what it was given itself."""
    given = spark.sparkContext.getConf()
    for key in keys or DEFAULTS:
        if not given.contains(key) and spark.conf.isModifiable(key):
            spark.conf.set(key, DEFAULTS[key])
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """Fresh folder all executors can reach.

    It lies under ``spark.checkpoint.dir``. Where that is unset, a local session
    (one process) sets a temporary folder, which ends with the process; a cluster
    has no such folder and must name one.
    """
    if getattr(_scratch, "folders", None):
        return f"{_scratch.folders[-1]}/{purpose}-{uuid.uuid4().hex}"
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="packetcheck-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


#: Folders of the running ``scratch`` blocks of a thread.
_scratch = threading.local()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Everything stored inside lies below one folder, which is removed at the end.

    What is to be read later must have been written elsewhere by then.
    """
    base = shared_dir(spark, "scratch")
    outer = getattr(_scratch, "folders", [])
    _scratch.folders = [*outer, base]
    try:
        yield base
    finally:
        _scratch.folders = outer
        remove_dir(spark, base)


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def remove_dir(spark: SparkSession, path: str) -> bool:
    """Remove a folder in whatever store Spark reaches; whether it was there."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(own, True)


def stored(df: DataFrame, purpose: str, **options: str) -> DataFrame:
    """Write a result that several branches read, with the writer's options, and read it back.

    A table in the shared folder survives lost executors and is computed once,
    which neither a cache nor exchange reuse can promise.
    """
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
