"""Exact comparison of bit fingerprints, tile against tile.

Two ways to deal fingerprints out to tasks, both complete:

- ``shared_bits``: fingerprints within a small radius agree on one of radius + 1
  bit ranges, so they meet where that range is equal. Where too many agree, the
  remaining bits are divided in the same way, until the groups are small: that many
  different fingerprints can't agree on nearly all bits.
- ``sized_blocks``: for a wide radius no bit range need be equal; documents are then
  dealt out by their size, of which similar ones have nearly the same, and
  large size classes are cut into blocks that meet pairwise.

In a task the rows are sorted by population count and compared in tiles by
exclusive-or and bit counts; tiles whose population counts lie further apart than
the radius are skipped. What a task returns is a spanning forest of its links.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetcheck.llm.common import Forest
from packetcheck.session import stored

TILE = 256
#: Fingerprints that agree on a bit range are compared as they are up to this many.
GROUP = 8192
#: Rows of a block; a task compares two blocks.
BLOCK = 32768


def link_tiles(words: np.ndarray, group: np.ndarray, count: np.ndarray, radius: int, forest: Forest,
               first: int = 0, split: int | None = None) -> None:
    """Link rows of one group within the radius; rows are sorted by (group, count).

    ``words`` has a row of unsigned 64-bit words per fingerprint. With ``split``,
    only rows before it are compared, and only with rows from it on (two sorted
    blocks, one after the other, of one group).
    """
    n = len(words)
    ends = n if split is None else split
    for s in range(0, ends, TILE):
        e = min(s + TILE, ends)
        for t in range(s if split is None else split, n, TILE):
            u = min(t + TILE, n)
            if split is None:
                if group[t] != group[e - 1] and t != s:
                    break
                if t != s and count[t] - count[e - 1] > radius:
                    break
            elif count[t] - count[e - 1] > radius:
                break
            elif count[s] - count[u - 1] > radius:
                continue
            apart = np.bitwise_count(words[s:e, None, 0] ^ words[None, t:u, 0])
            for k in range(1, words.shape[1]):
                apart = apart + np.bitwise_count(words[s:e, None, k] ^ words[None, t:u, k]).astype(np.uint16)
            near = apart <= radius
            if not near.any():
                continue
            if split is None:
                near &= group[s:e, None] == group[None, t:u]
            i, j = np.nonzero(near)
            forest.link(first + s + i, first + t + j)


def _parts(mask: int, bits: int, parts: int) -> list[int]:
    """The bits outside ``mask`` in ``parts`` ranges of nearly equal size."""
    free = [b for b in range(bits) if not mask >> b & 1]
    return [sum(1 << int(b) for b in x) for x in np.array_split(free, parts)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shared_bits(prints: DataFrame, radius: int, group_size: int = GROUP) -> DataFrame:
    """Forest edges (a, b) between the different values of the bigint column fp
    that differ in at most ``radius`` bits."""
    masks = _parts(0, 64, radius + 1)
    todo = prints.select("fp").distinct().select("fp", F.explode(F.array([F.lit(_signed(m)) for m in masks])).alias("mask"))
    ready = None
    while True:
        keyed = todo.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        keyed = stored(keyed, "ranges")
        full = keyed.groupBy("mask", "key").count().where(F.col("count") > group_size).select("mask", "key", F.lit(True).alias("full"))
        marked = keyed.join(full, ["mask", "key"], "left")
        small = marked.where("full is null").drop("full")
        ready = small if ready is None else ready.unionByName(small)
        if max(64 - m.bit_count() for m in masks) < group_size.bit_length() or full.isEmpty():
            break
        finer = {m: [m | x for x in _parts(m, 64, radius + 1)] for m in masks}
        masks = [x for m in masks for x in finer[m]]
        choice = F.create_map([y for m, xs in finer.items() for y in (F.lit(_signed(m)), F.array([F.lit(_signed(x)) for x in xs]))])
        todo = marked.where("full").select("fp", F.explode(choice[F.col("mask")]).alias("mask"))
    dealt = ready.repartition("mask", "key").sortWithinPartitions("mask", "key")
    return dealt.mapInArrow(lambda batches: _compare_sorted(batches, radius), "a long, b long")


def _compare_sorted(batches: Iterable[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Compare within the groups of rows sorted by (mask, key)."""
    held: list[np.ndarray] = []

    def compare(rows: np.ndarray) -> pa.RecordBatch:
        fp = rows[0].view(np.uint64)
        new = np.r_[True, (rows[1, 1:] != rows[1, :-1]) | (rows[2, 1:] != rows[2, :-1])]
        group = np.cumsum(new)
        size = np.bincount(group)[group]
        shared = size > 1
        fp, group = fp[shared], group[shared]
        count = np.bitwise_count(fp).astype(np.int64)
        order = np.lexsort((count, group))
        fp, group, count = fp[order], group[order], count[order]
        forest = Forest(len(fp))
        link_tiles(fp[:, None], group, count, radius, forest)
        tied = np.flatnonzero(forest.root != np.arange(len(fp)))
        values = fp.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(values[tied]), pa.array(values[forest.root[tied]])], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([np.asarray(batch.column(x)) for x in ("fp", "mask", "key")])
        new = np.flatnonzero((rows[1, 1:] != rows[1, :-1]) | (rows[2, 1:] != rows[2, :-1]))
        if held and not (held[-1][1:, -1] == rows[1:, 0]).all():
            yield compare(np.concatenate(held, axis=1))
            held = []
        if len(new):
            cut = new[-1] + 1
            yield compare(np.concatenate([*held, rows[:, :cut]], axis=1))
            held = []
            rows = rows[:, cut:]
        held.append(rows)
    if held:
        yield compare(np.concatenate(held, axis=1))


def sized_blocks(prints: DataFrame, words: list[str], radius: int, similarity: float, block: int = BLOCK) -> DataFrame:
    """Forest edges (a, b) between ids whose fingerprints differ in at most
    ``radius`` bits and whose sizes lie in the same or in neighbouring classes.

    ``prints``: id bigint, size bigint, and the fingerprint's bigint ``words``.
    Sizes are those of sets (of distinct shingles). Classes grow by the ratio
    ``similarity``, so no pair of at least that ratio of sizes is missed. Sets that are so
    small that one more element makes them dissimilar link only with equal fingerprints.
    """
    least = similarity / (1 - similarity) - 1e-9
    base = float(np.log(1 / similarity))
    rows = stored(prints.select("id", "size", *words, F.when(F.col("size") > 0, F.floor(F.log("size") / base + 1e-9)).otherwise(-9).cast("int").alias("cls")), "prints")
    blocks = stored(rows.groupBy("cls").agg(F.ceil(F.count("*") / block).cast("int").alias("n")), "classes")
    near = blocks.join(blocks.select((F.col("cls") + 1).alias("cls"), F.col("n").alias("below")), "cls", "left") \
        .join(blocks.select((F.col("cls") - 1).alias("cls"), F.col("n").alias("above")), "cls", "left")
    own = rows.join(near, "cls").withColumn("mine", F.pmod(F.xxhash64("id"), "n").cast("int"))

    def pairs(n, key):
        return F.transform(F.sequence(F.lit(0), F.coalesce(n, F.lit(0)) - 1), key)

    def pair(low_cls, low, high_cls, high, side):
        return F.struct(low_cls.alias("c1"), low.alias("b1"), high_cls.alias("c2"), high.alias("b2"), side.alias("side"))

    cls, mine = F.col("cls"), F.col("mine")
    same = pairs(F.col("n"), lambda x: pair(cls, F.least(mine, x), cls, F.greatest(mine, x), (mine > x).cast("int")))
    up = F.when(F.col("above").isNotNull(), pairs(F.col("above"), lambda x: pair(cls, mine, cls + 1, x, F.lit(0))))
    down = F.when(F.col("below").isNotNull(), pairs(F.col("below"), lambda x: pair(cls - 1, x, cls, mine, F.lit(1))))
    dealt = own.select("id", "size", *words, F.explode(F.concat(same, *(F.coalesce(x, F.array().cast("array<struct<c1:int,b1:int,c2:int,b2:int,side:int>>")) for x in (up, down)))).alias("p"))
    dealt = dealt.select("id", "size", *words, "p.*")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        fp = frame[words].to_numpy().astype(np.int64).view(np.uint64)
        count = np.bitwise_count(fp).sum(axis=1).astype(np.int64)
        side = frame["side"].to_numpy()
        order = np.lexsort((count, side))
        fp, count, side, ids, size = fp[order], count[order], side[order], frame["id"].to_numpy()[order], frame["size"].to_numpy()[order]
        split = int((side == 0).sum())
        alone = bool(frame["c1"].iloc[0] == frame["c2"].iloc[0] and frame["b1"].iloc[0] == frame["b2"].iloc[0])
        forest = Forest(len(fp))
        link_tiles(fp, np.zeros(len(fp), dtype=np.int8), count, radius if size.max() >= least else 0, forest, split=None if alone else split)
        tied = np.flatnonzero(forest.root != np.arange(len(fp)))
        return pd.DataFrame({"a": ids[tied], "b": ids[forest.root[tied]]})

    return dealt.groupBy("c1", "b1", "c2", "b2").applyInPandas(compare, "a long, b long")
