"""Benchmark passages in documents, found by spaced-seed hashing.

A seed is a fixed mask over consecutive tokens; the tokens at its set positions
are hashed, the others ignored, so that a hit survives substitutions there. Hashes
of the benchmark's tokens are joined with those of every document's; each hit
fixes how an item lies over the document, and along that diagonal the tokens are
compared: a passage is a stretch of ``span`` item tokens (or the whole item, if
shorter) of which the share ``similarity`` is equal.

The benchmark is the stated query set: it goes to the tasks in blocks of at most
``block`` tokens, every document being compared with all of them. A block's result is
written before the next one is read, so that driver and tasks hold one at a time.

Items shorter than the masks have a seed of their own: of so few tokens as must stand unchanged next
to each other however the substitutions allowed are placed.

Tokens are runs of letters, digits and underscores, lower-cased. Defined cases: null
and empty texts have no passages; items without tokens are never found; items
with equal text are all reported, those without an id as null; rows with equal doc_id get a result each; an
empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetcheck.llm.common import slices, strings
from packetcheck.session import stored

#: 1: the token counts for the hash.
MASKS = ("11011", "1010011", "1100101")
SPAN = 20
SIMILARITY = 0.8
#: Benchmark tokens that one pass over the documents compares with.
BLOCK = 1 << 20

_TOKEN = re.compile(r"\w+")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


class Seeds:
    """The benchmark's tokens and the hashes of its seeds.

    Tokens are numbered; a document's token that no item has is 0 and can't be
    part of a hit.
    """

    def __init__(self, items: list[tuple[int | None, str]], masks: tuple[str, ...] = MASKS, similarity: float = SIMILARITY):
        self.number: dict[str, int] = {}
        self.items: list[tuple[int | None, np.ndarray]] = []
        for item, text in items:
            ids = [self.number.setdefault(x, len(self.number) + 1) for x in tokens(text)]
            if ids:
                self.items.append((item, np.array(ids, dtype=np.int64)))
        longest = max(map(len, masks))
        shapes: dict[str, list[int]] = {}
        for k, (_, ids) in enumerate(self.items):
            for shape in masks if len(ids) >= longest else [self.short_seed(len(ids), similarity)]:
                shapes.setdefault(shape, []).append(k)
        self.tables = []
        for shape, own in shapes.items():
            offsets = np.array([k for k, x in enumerate(shape) if x == "1"])
            hashes, owner, at = [], [], []
            for k in own:
                ids = self.items[k][1]
                n = len(ids) - len(shape) + 1
                if n > 0:
                    hashes.append(self.hash(ids, offsets, n))
                    owner += [k] * n
                    at += range(n)
            if hashes:
                joined = np.concatenate(hashes)
                order = np.argsort(joined, kind="stable")
                self.tables.append((len(shape), offsets, joined[order], np.array(owner)[order], np.array(at)[order]))

    @staticmethod
    def short_seed(n: int, similarity: float) -> str:
        """The longest run of equal tokens that n tokens have in any case."""
        free = n - math.ceil(similarity * n - 1e-9)
        return "1" * max(1, -(-(n - free) // (free + 1)))

    @staticmethod
    def hash(ids: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(n, dtype=np.uint64)
        for o in offsets:
            out = (out ^ ids[o:o + n].astype(np.uint64)) * _MULTIPLIER
            out ^= out >> np.uint64(31)
        return out

    def number_all(self, text: str) -> np.ndarray:
        get = self.number.get
        return np.array([get(x, 0) for x in tokens(text)], dtype=np.int64)

    def diagonals(self, ids: np.ndarray) -> set[tuple[int, int]]:
        """(item, token where it would begin) of all hits in a document's tokens."""
        known = ids > 0
        found: set[tuple[int, int]] = set()
        for width, offsets, hashes, owner, at in self.tables:
            n = len(ids) - width + 1
            if n <= 0:
                continue
            full = known[offsets[0]:offsets[0] + n].copy()
            for o in offsets[1:]:
                full &= known[o:o + n]
            places = np.flatnonzero(full)
            if not len(places):
                continue
            own = self.hash(ids, offsets, n)[places]
            low, high = np.searchsorted(hashes, own, "left"), np.searchsorted(hashes, own, "right")
            for p, a, b in zip(places[low < high], low[low < high], high[low < high]):
                found.update((int(owner[k]), int(p) - int(at[k])) for k in range(a, b))
        return found

    def passages(self, ids: np.ndarray, span: int, similarity: float) -> list[tuple[int | None, float, int, int]]:
        """(item id, share of equal tokens in its best stretch, first token, tokens)."""
        out = []
        for k, begin in sorted(self.diagonals(ids)):
            item, own = self.items[k]
            width = min(span, len(own))
            low, high = max(0, -begin), min(len(own), len(ids) - begin)
            if high - low < width:
                continue
            equal = np.r_[0, np.cumsum(own[low:high] == ids[begin + low:begin + high])]
            score = equal[width:] - equal[:-width]
            good = np.flatnonzero(score >= similarity * width - 1e-9)
            if len(good):
                out.append((item, float(score.max()) / width, begin + low + int(good[0]), int(good[-1] - good[0]) + width))
        return out


def blocks_of(benchmark: DataFrame, block: int = BLOCK, similarity: float = SIMILARITY) -> Iterator[tuple[Seeds, bool]]:
    """The benchmark's items with their seeds, in blocks of about ``block`` tokens, and whether it is the last."""
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").dropDuplicates()
    size = items.agg(F.sum(F.size(F.split("text", r"(?U)\W+")) + 1)).first()[0] or 0
    blocks = -(-size // block) or 1
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        yield Seeds([(r["item_id"], r["text"]) for r in part], similarity=similarity), k == blocks - 1


def find(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """Per document: doc_id, contaminated, item_ids (sorted), similarity (of the best
    passage, else 0) and passages (item_id, similarity, token, n_tokens)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    passage = "struct<item_id:bigint,similarity:double,token:int,n_tokens:int>"
    found = None
    for seeds, last in blocks_of(benchmark, block, similarity):

        def search(batches: Iterable[pa.RecordBatch], seeds: Seeds = seeds) -> Iterator[pa.RecordBatch]:
            # each pass adds its block's passages to those of the passes before
            for batch in slices(batches, "text"):
                out = []
                for text in strings(batch.column("text")):
                    own = seeds.passages(seeds.number_all(text), span, similarity)
                    out.append([dict(zip(("item_id", "similarity", "token", "n_tokens"), p)) for p in own])
                struct = pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("token", pa.int32()), ("n_tokens", pa.int32())])
                held = pa.array(out, pa.list_(struct))
                if "passages" in batch.schema.names:
                    before = batch.column("passages").to_pylist()
                    held = pa.array([a + b for a, b in zip(before, out)], pa.list_(struct))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), held], ["doc_id", "text", "passages"])

        source = docs.select("doc_id", "text") if found is None else found
        found = source.mapInArrow(search, f"doc_id {kind}, text string, passages array<{passage}>")
        found = found if last else stored(found, "passages")
    return found.select(
        "doc_id", (F.size("passages") > 0).alias("contaminated"), F.array_sort(F.array_distinct("passages.item_id")).alias("item_ids"),
        F.coalesce(F.array_max("passages.similarity"), F.lit(0.0)).alias("similarity"), "passages")


def clean(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """The documents without any passage of the benchmark, with all their columns.

    A block at a time filters the rows where they are; nothing is shuffled.
    """
    for seeds, last in blocks_of(benchmark, block, similarity):

        def each(batches: Iterable[pa.RecordBatch], seeds: Seeds = seeds) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                yield batch.filter(pa.array([not seeds.passages(seeds.number_all(x), span, similarity) for x in strings(batch.column("text"))], pa.bool_()))

        docs = docs.mapInArrow(each, docs.schema)
        docs = docs if last else stored(docs, "clean")
    return docs
