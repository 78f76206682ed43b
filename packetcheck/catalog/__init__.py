"""Registered queries over the given tables, each with its SQL check."""

from packetcheck.catalog import (  # noqa: F401
    collecting, comparing, extracting, keeping, scalars, storing, streams,
)
from packetcheck.catalog.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
