"""Array building that stays inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def present(*items: tuple[Column, Column], kind: str) -> Column:
    """Array of the items whose condition holds, in order.

    Equal to dropping nulls from an array, but without a lambda: the item
    expressions keep compiling together and share common parts.
    """
    none = F.array().cast(f"array<{kind}>")
    return F.flatten(
        F.array(*[F.when(cond, F.array(item.cast(kind))).otherwise(none) for cond, item in items])
    )
