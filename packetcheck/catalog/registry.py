"""Collecting registered queries with their checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from packetcheck.catalog.derived import Tables, with_derived
from packetcheck.session import tuned

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    """Register ``build(tables)`` under ``name``; ``check`` is the same in SQL."""

    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Tables(tuned(spark), sf_dir))
        if check is not None:
            CHECKS[name] = with_derived(check)
        return build

    return register
