"""Near-equal vectors of one label, by int8 tiles with error bounds.

Equal vectors are collapsed first. The vectors of a label are dealt out to blocks;
every two blocks meet in a task. There, unit vectors are rounded to int8 with a
scale of their own, and tiles of them are multiplied exactly (products of int8
values add up to whole numbers that float32 holds). With x = s q + e, the product of
two unit vectors lies within |e1| + (1 + |e1|) |e2| of its rounded value; pairs that
this bound leaves possibly at the threshold are computed again in double precision,
and that decides. A task returns, per vector, how many vectors it is linked to, and a
spanning forest of the links; no pairs leave it.

Defined cases: vectors that are null, empty or zero, or hold a null or a non-finite
component, and rows without a label link with nothing; vectors of different
lengths never link; rows with equal vec_id are separate vectors; a null vec_id is
its own component if nothing else names it; an empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetcheck.llm.common import Forest, components
from packetcheck.session import stored

THRESHOLD = 0.98
BLOCK = 8192
TILE = 1024


def link_block(vectors: np.ndarray, weight: np.ndarray, split: int | None, threshold: float, tile: int = TILE) -> tuple[np.ndarray, Forest, int]:
    """Weight linked to each row, forest of the links, pairs computed in full.

    With ``split``, rows before it meet rows from it on; else all rows meet.
    """
    n = len(vectors)
    norm = np.sqrt((vectors * vectors).sum(axis=1))
    unit = vectors / norm[:, None]
    scale = np.abs(unit).max(axis=1) / 127
    rounded = np.rint(unit / scale[:, None])
    error = np.sqrt(((unit - rounded * scale[:, None]) ** 2).sum(axis=1)) + 1e-12
    small = rounded.astype(np.int8)
    linked, forest, exact = np.zeros(n, dtype=np.int64), Forest(n), 0
    # sums of more products than these need not be whole in float32
    kind = np.float32 if vectors.shape[1] * 127 * 127 < 1 << 24 else np.float64
    for s in range(0, n if split is None else split, tile):
        e = min(s + tile, n if split is None else split)
        left = small[s:e].astype(kind)
        for t in range(s if split is None else split, n, tile):
            u = min(t + tile, n)
            product = (left @ small[t:u].astype(kind).T).astype(np.float64) * scale[s:e, None] * scale[None, t:u]
            bound = error[s:e, None] + (1 + error[s:e, None]) * error[None, t:u]
            possible = product + bound >= threshold - 1e-9
            if split is None and t == s:
                possible &= np.arange(s, e)[:, None] < np.arange(t, u)[None, :]
            i, j = np.nonzero(possible)
            for at in range(0, len(i), 1 << 17):
                a, b = i[at:at + (1 << 17)] + s, j[at:at + (1 << 17)] + t
                exact += len(a)
                near = np.einsum("ij,ij->i", vectors[a], vectors[b]) / (norm[a] * norm[b]) >= threshold
                a, b = a[near], b[near]
                linked += np.bincount(a, weights=weight[b], minlength=n).astype(np.int64)
                linked += np.bincount(b, weights=weight[a], minlength=n).astype(np.int64)
                forest.link(a, b)
    return linked, forest, exact


def _usable(vector) -> F.Column:
    fine = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def link(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept; see the module."""
    vector = F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", "label", vector.alias("v"))
    rows = rows.withColumn("usable", F.col("label").isNotNull() & _usable(F.col("v")))
    # equal vectors have equal hashes; rows are told apart by hash and label alone
    rows = stored(rows.withColumn("same", F.when(F.col("usable"), F.sha2(F.array_join(F.transform("v", lambda x: (x + 0.0).cast("string")), " "), 256))), "vectors")
    distinct = rows.where("usable").groupBy("label", "same").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"), F.any_value("v").alias("v"))
    # the nodes are hashes, so that null or repeated vec_ids don't matter
    distinct = stored(distinct.withColumn("node", F.xxhash64("label", "same")).withColumn("dims", F.size("v")), "distinct")
    sizes = distinct.groupBy("label", "dims").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    own = distinct.join(sizes, ["label", "dims"]).withColumn("mine", F.pmod("node", "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = own.select("label", "dims", "node", "n", "v", "mine", other).select(
        "label", "dims", "node", "n", "v", F.least("mine", "other").alias("b1"), F.greatest("mine", "other").alias("b2"), (F.col("mine") > F.col("other")).alias("second"))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("second", kind="stable")
        alone = frame["b1"].iloc[0] == frame["b2"].iloc[0]
        split = None if alone else int((~frame["second"]).sum())
        matrix = np.array(frame["v"].tolist(), dtype=np.float64)
        linked, forest, _ = link_block(matrix, frame["n"].to_numpy(), split, threshold)
        nodes = frame["node"].to_numpy()
        out = pd.DataFrame({"a": nodes, "b": nodes[forest.root], "links": linked})
        return out[(out["links"] > 0) | (out["a"] != out["b"])]

    links = stored(dealt.groupBy("label", "dims", "b1", "b2").applyInPandas(compare, "a long, b long, links long"), "tiles")
    roots = components(links.select("a", "b"), "links").withColumnsRenamed({"node": "node", "component": "root"})
    counts = links.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    known = distinct.select("label", "same", "node", "n", "first").join(counts, "node", "left").join(roots, "node", "left") \
        .withColumn("root", F.coalesce("root", "node"))
    known = stored(known, "known")
    named = known.join(known.groupBy("root").agg(F.min("first").alias("component")), "root").select(
        "label", "same", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component")
    joined = rows.select("vec_id", "label", "same").join(named, ["label", "same"], "left")
    component = F.coalesce("component", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                         F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
