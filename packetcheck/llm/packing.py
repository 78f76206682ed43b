"""Best-fit packing of token pieces into sequences of one capacity.

Pieces over a third of the capacity can share a sequence with at most one other
such piece; they are matched greedily, the longest with the longest that fits.
The smaller ones then go, longest first, to the smallest gap that holds them.
The packing needs only how many pieces have each length, so it is solved on
that histogram (one row per length, at most ``capacity`` rows); the pieces then
look up their place by their length and their number among equal lengths.

Defined cases: a null text is empty and still has its end id; rows with equal
ids or texts are separate documents; a null doc_id is kept; an empty table
gives an empty result; other columns of the input are not looked at.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from packetcheck.llm.common import slices
from packetcheck.llm.tokens import encoder
from packetcheck.session import stored

CAPACITY = 2048
END_ID = 0
#: Texts cut at a time; words, ids and pieces of a slice take many times its bytes.
SLICE_BYTES = 4 << 20


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
               with_ids: bool = False) -> DataFrame:
    """Token pieces of documents: doc_id, piece, start, length, ids_crc32 (and ids).

    ``part`` and ``nth`` number the pieces of one length within a task; they only
    mean something once the result is written.
    """
    fields = "doc_id {}, piece int, start long, length long, ids_crc32 long, part int, nth long"
    fields = fields.format(docs.schema["doc_id"].dataType.simpleString()) + (", ids array<int>" if with_ids else "")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, keeps_space=False)
        part = TaskContext.get().partitionId()
        met = np.zeros(capacity + 1, dtype=np.int64)
        for batch in slices(batches, "text", SLICE_BYTES):
            ids, at = encode.encode(batch.column("text"))
            rows, piece, start, crc, pieces = [], [], [], [], []
            for row in range(batch.num_rows):
                own = np.append(ids[at[row]:at[row + 1]], np.uint32(end_id)).astype("<u4")
                for k, s in enumerate(range(0, len(own), capacity)):
                    cutting = own[s:s + capacity]
                    rows.append(row)
                    piece.append(k)
                    start.append(s)
                    crc.append(zlib.crc32(cutting.tobytes()))
                    pieces.append(cutting)
            length = np.array([len(x) for x in pieces], dtype=np.int64)
            nth = met[length] + _running(length)
            met += np.bincount(length, minlength=capacity + 1)
            out = [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()),
                   pa.array(start, pa.int64()), pa.array(length), pa.array(crc, pa.int64()),
                   pa.array(np.full(len(rows), part, dtype=np.int32)), pa.array(nth)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
            if with_ids:
                ends = np.zeros(len(length) + 1, dtype=np.int32)
                np.cumsum(length, out=ends[1:])
                out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(pieces).view("<i4"))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)

    return docs.select("doc_id", "text").mapInArrow(cut, fields)


def _running(keys: np.ndarray) -> np.ndarray:
    """How many equal keys stand before each."""
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    first = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]) if len(keys) else np.zeros(0, int)
    sizes = np.diff(np.r_[first, len(keys)])
    out = np.empty(len(keys), dtype=np.int64)
    out[order] = np.arange(len(keys)) - np.repeat(first, sizes)
    return out


class Plan:
    """Where the pieces of each length go, as runs of equal treatment.

    A run places the pieces ``first`` .. of a length: ``per`` of them in a row in
    each sequence from ``sequence`` on, the first of them at ``offset``.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.runs: list[tuple[int, int, int, int, int]] = []
        self.used: dict[int, int] = {}
        self.sequences = 0
        self.gaps: dict[int, list[tuple[int, int]]] = {}
        self.sizes: list[int] = []

    def open(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def put(self, length: int, count: int, sequence: int, per: int, offset: int) -> None:
        first = self.used.get(length, 0)
        self.runs.append((length, first, sequence, per, offset))
        self.used[length] = first + count

    def leave(self, gap: int, sequence: int, n: int) -> None:
        if gap and n:
            if gap not in self.gaps:
                self.gaps[gap] = []
                self.sizes.insert(bisect_left(self.sizes, gap), gap)
            self.gaps[gap].append((sequence, n))

    def smallest_gap(self, length: int) -> tuple[int, int, int] | None:
        at = bisect_left(self.sizes, length)
        if at == len(self.sizes):
            return None
        gap = self.sizes[at]
        sequence, n = self.gaps[gap].pop()
        if not self.gaps[gap]:
            del self.gaps[gap], self.sizes[at]
        return gap, sequence, n

    def match_large(self, counts: dict[int, int]) -> None:
        left = {x: n for x, n in counts.items() if n}
        lengths = sorted(left)
        while lengths:
            a = lengths[-1]
            at = bisect_right(lengths, self.capacity - a) - 1
            b = lengths[at] if at >= 0 else None
            if b == a and left[a] == 1:
                b = lengths[at - 1] if at else None
            if b is None:
                n = left.pop(a)
                lengths.pop()
                sequence = self.open(n)
                self.put(a, n, sequence, 1, 0)
                self.leave(self.capacity - a, sequence, n)
                continue
            n = left[a] // 2 if a == b else min(left[a], left[b])
            sequence = self.open(n)
            if a == b:
                self.put(a, 2 * n, sequence, 2, 0)
            else:
                self.put(a, n, sequence, 1, 0)
                self.put(b, n, sequence, 1, a)
            self.leave(self.capacity - a - b, sequence, n)
            for x in (a, b):
                left[x] -= n
            for x in {a, b}:
                if not left[x]:
                    del left[x]
                    lengths.remove(x)

    def fit_small(self, counts: dict[int, int]) -> None:
        for length in sorted(counts, reverse=True):
            left = counts[length]
            while left:
                found = self.smallest_gap(length)
                if found is None:
                    n = -(-left // (self.capacity // length))
                    found = self.capacity, self.open(n), n
                gap, sequence, n = found
                per = gap // length
                full = min(n, left // per)
                if full:
                    self.put(length, full * per, sequence, per, self.capacity - gap)
                    self.leave(gap - per * length, sequence, full)
                    left -= full * per
                    sequence, n = sequence + full, n - full
                if n and left:
                    self.put(length, left, sequence, left, self.capacity - gap)
                    self.leave(gap - left * length, sequence, 1)
                    sequence, n, left = sequence + 1, n - 1, 0
                self.leave(gap, sequence, n)


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Plan for ``counts`` pieces of each length from 1 to ``capacity``."""
    plan = Plan(capacity)
    plan.match_large({x: n for x, n in counts.items() if 3 * x > capacity})
    plan.fit_small({x: n for x, n in counts.items() if 3 * x <= capacity})
    return plan


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Written pieces with their sequence_id and offset."""
    tally = stored(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "tally")
    counts = {r["length"]: r["n"] for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = best_fit(counts, capacity)
    runs = sorted(plan.runs)
    length, first, sequence, per, offset = (np.array(x, dtype=np.int64) for x in zip(*runs)) if runs else [np.zeros(0, np.int64)] * 5
    # a length's runs are found by one search over (length, first)
    starts = np.searchsorted(length, np.arange(capacity + 2))

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = tally.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    joined = pieces.join(base, ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth")).drop("part", "nth", "base")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema if f.name != "rank"]

    def look_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = np.asarray(batch.column("length")), np.asarray(batch.column("rank"))
            run = np.empty(len(size), dtype=np.int64)
            for x in np.unique(size):
                own = size == x
                run[own] = starts[x] + np.searchsorted(first[starts[x]:starts[x + 1]], rank[own], side="right") - 1
            step = rank - first[run]
            kept = [i for i, name in enumerate(batch.schema.names) if name != "rank"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in kept] + [pa.array(sequence[run] + step // per[run]), pa.array(offset[run] + step % per[run] * size)],
                [batch.schema.names[i] for i in kept] + ["sequence_id", "offset"])

    return joined.mapInArrow(look_up, ", ".join([*fields, "sequence_id long", "offset long"]))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their places; see the module."""
    return place(stored(cut_pieces(docs, tokenizer, capacity, end_id, with_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """Token ids of each sequence, from pieces packed with their ids; at most
    ``capacity`` ids meet in a group."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
