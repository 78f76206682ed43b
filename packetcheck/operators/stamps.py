"""Red stamps: share of red-dominant pixels per page."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from packetcheck import vocab
from packetcheck.functions.values import parse_amount
from packetcheck.sources.images import file_ratios

PAGE = ["project_name", "page"]
NO_PICTURE = "no picture"


def needs_stamp(amount: Column) -> Column:
    """Only contracts above the threshold must carry a stamp."""
    return F.coalesce(amount > vocab.STAMP_THRESHOLD, F.lit(False)) & ~F.isnan(
        F.coalesce(amount, F.lit(0.0))
    )


def is_red(r: Column, g: Column, b: Column) -> Column:
    """Red channel strong and at least 41 above the saturated others."""
    return (r >= 180) & (r > F.least(g + 40, F.lit(255))) & (r > F.least(b + 40, F.lit(255)))


def page_ratios(pixels: DataFrame) -> DataFrame:
    """``counted, red, stamped`` per page of ``project_name, page, r, g, b``.

    Every pixel counts; the counts combine before their only shuffle.
    """
    return _counted(_flags(pixels))


def _flags(pixels: DataFrame) -> DataFrame:
    """Each pixel's page and whether it is red, which is all that need be dealt out of it."""
    return pixels.select(*PAGE, is_red(F.col("r"), F.col("g"), F.col("b")).alias("red"))


def _counted(flags: DataFrame) -> DataFrame:
    counts = flags.groupBy(*PAGE).agg(F.count("*").alias("counted"), F.count_if("red").alias("red"))
    return counts.withColumn("stamped", F.col("red") / F.col("counted") >= vocab.RED_RATIO)


def image_ratios(images: DataFrame) -> DataFrame:
    """As ``page_ratios`` for ``project_name, page, image`` rows of the image source; ``error`` says
    what isn't a picture.

    One image is one row, so the count is a map over Arrow batches and no
    shuffle is needed. The image source stores channels as blue, green, red.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counted, red = [], []
            for height, width, channels, data in zip(
                batch["height"], batch["width"], batch["channels"], batch["data"]
            ):
                if height < 0:
                    counted.append(0)
                    red.append(0)
                    continue
                n = height * width
                raster = np.frombuffer(data, np.uint8).reshape(n, channels).astype(np.int16)
                blue, green, rd = (raster[:, min(i, channels - 1)] for i in range(3))
                hit = (
                    (rd >= 180)
                    & (rd > np.minimum(green + 40, 255))
                    & (rd > np.minimum(blue + 40, 255))
                )
                counted.append(n)
                red.append(int(hit.sum()))
            yield batch[PAGE].assign(counted=counted, red=red)

    flat = images.select(
        *PAGE, "image.height", "image.width",
        F.col("image.nChannels").alias("channels"), "image.data",
    )
    kinds = {f.name: f.dataType.simpleString() for f in images.schema}
    schema = f"project_name {kinds['project_name']}, page {kinds['page']}, counted bigint, red bigint"
    ratio = F.try_divide("red", "counted") >= vocab.RED_RATIO
    counts = flat.mapInPandas(count, schema).withColumn("stamped", F.coalesce(ratio, F.lit(False)))
    return counts.withColumn("error", F.when(F.col("counted") == 0, NO_PICTURE))


def stamped_projects(ratios: DataFrame) -> DataFrame:
    """Whether any page of a project carries a stamp."""
    return ratios.groupBy("project_name").agg(F.bool_or("stamped").alias("has_red_stamp"))


def amount_of(fields: Column) -> Column:
    value = F.try_element_at(fields, F.lit(vocab.AMOUNT_LABEL))
    return parse_amount(value["kind"], value["s"])


def stamps_where_needed(
    amounts: DataFrame, pixels: DataFrame | None, pictures: DataFrame | None = None
) -> DataFrame:
    """``has_red_stamp`` for every project of ``project_name, amount``.

    Pixels and pictures (``project_name, path`` of image reports) of projects below
    the threshold are dropped before anything else touches them, so those files are never
    opened; their stamp is false without looking. So is that of a picture that can't be read.
    """
    wanted = amounts.filter(needs_stamp(F.col("amount"))).select("project_name")
    sides = []
    if pixels is not None:
        sides.append(_counted(_flags(pixels).join(wanted, "project_name", "left_semi")))
    if pictures is not None:
        sides.append(file_ratios(pictures.join(wanted, "project_name", "left_semi")))
    pages = reduce(DataFrame.unionByName, [s.select("project_name", "stamped") for s in sides])
    found = stamped_projects(pages)
    stamp = F.coalesce("has_red_stamp", F.lit(False)).alias("has_red_stamp")
    return amounts.join(found, "project_name", "left").select("project_name", stamp)
