"""Removal of repeated passages, byte by byte, over the whole corpus.

A byte goes if a string of ``WINDOW`` bytes that covers it also starts earlier (in
a smaller doc_id, or earlier in the same document).

1. Every window has an anchor: of the 16-byte strings in it the one with the least
   hash, the leftmost if tied. Equal windows have equal anchors at the same
   place in them, so windows need only be compared where their anchors are equal.
   The windows of one anchor follow each other; together they are its stretch.
2. Anchors meet by hash. The bytes of all stretches that share an anchor are compared. Only
   of very common ones (more than ``LOCAL`` equal stretches in a batch of texts, more than ``UNITED``
   stretches of an anchor) equal ones are united before, by two 64-bit hashes: all but the first are repeats.
3. There, the occurrences are sorted by what follows, which gives the common
   prefix lengths of neighbours, and the interval of each anchor is extended
   backward, breadth-first, by the byte before it (the Burrows-Wheeler column of
   that order). One step back, the common prefix needed behind the anchor is one
   shorter; intervals that have one row are dropped, and the extension stops at
   the minimum length, when the whole window has been compared.
4. The repeats found are gathered per document and cut out.

Defined cases: a null text is empty; texts shorter than a window stay; rows equal
in doc_id and text are one document (each row gets its result); different texts of
one doc_id are ordered by a hash; a null doc_id comes before all others; an empty
table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetcheck.llm.common import slices
from packetcheck.session import stored

WINDOW = 100
ANCHOR = 16
#: Places for an anchor in a window.
PLACES = WINDOW - ANCHOR + 1
#: Different stretches of one anchor that are compared in one task; more are dealt out by window.
GROUP = 50_000
#: Stretches of an anchor, and equal ones in a batch of texts, that are compared as they are; of
#: more, equal ones are united first.
UNITED, LOCAL = 512, 16

FIRST_ID = -(1 << 63)
ROW = "doc long, tag int, start int, n int, off int"
# odd multipliers without a pattern
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc (doc_id, null as the smallest), tag (hash of the text) and text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST_ID)).alias("doc"), F.hash(text).alias("tag"), text.alias("text"))


def _packed(docs: DataFrame, least: int = 0) -> DataFrame:
    """doc, tag and the compressed text of at least that many bytes; what is joined by
    document moves through a shuffle, and compressed it takes half the disk."""
    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=3).compress
        for batch in slices(batches, "text"):
            packed = [compress(x) for x in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("tag"), pa.array(packed, pa.binary())], ["doc", "tag", "packed"])

    return _keyed(docs).where(F.octet_length("text") >= least).mapInArrow(pack, "doc long, tag int, packed binary")


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x *= _C
    x ^= x >> np.uint64(32)
    return x


def _buffer(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in a row with room behind them, and where they begin."""
    at = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(x) for x in texts], out=at[1:])
    return np.frombuffer(b"".join(texts) + bytes(WINDOW + 16), dtype=np.uint8), at


def stretches(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of all windows' anchors: hash, hash of the stretch, text number, first window's
    start in it, number of windows, and the anchor's distance from that start."""
    buffer, at = _buffer(texts)
    n = int(at[-1])
    starts = np.zeros(n + 1, dtype=np.int32)
    long = np.diff(at) >= WINDOW
    np.add.at(starts, at[:-1][long], 1)
    np.add.at(starts, at[1:][long] - WINDOW + 1, -1)
    windows = np.flatnonzero(np.cumsum(starts[:n], dtype=np.int32))
    if not len(windows):
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(6))
    raw = buffer.tobytes()
    low = np.ndarray(n + PLACES, dtype="<u8", buffer=raw, strides=(1,))
    high = np.ndarray(n + PLACES, dtype="<u8", buffer=raw, offset=8, strides=(1,))
    hashes = _mix((low * _A) ^ ((high ^ (high >> np.uint64(31))) * _B))
    least = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    reach = 1
    while 2 * reach <= PLACES:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    least = np.minimum(least[:n], least[PLACES - reach:n + PLACES - reach])
    owner = (least[windows] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    change = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    count = np.diff(np.r_[change, len(owner)])
    first, anchor = windows[change], owner[change]
    # hash of the 16-byte strings of each stretch in their order: a difference of prefix sums
    powers = np.full(n + 1, _D, dtype=np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    inverse = np.uint64(pow(int(_D), -1, 1 << 64))
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(hashes[:n] * powers[:n], out=sums[1:])
    back = np.full(n + 1, inverse, dtype=np.uint64)
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    whole = (sums[first + count - 1 + PLACES] - sums[first]) * back[first]
    whole = _mix(whole ^ (count.astype(np.uint64) * _A) ^ ((anchor - first).astype(np.uint64) * _B))
    text = np.searchsorted(at, first, side="right") - 1
    return hashes[anchor].view(np.int64), whole.view(np.int64), text, first - at[text], count, anchor - first


def _anchors(batches: Iterable[pa.RecordBatch], local: int) -> Iterator[pa.RecordBatch]:
    """The stretches of all texts. Of more than ``local`` equal stretches in a batch only the
    first goes on to meet others; the rest are ``known`` repeats and are dealt out by document,
    so that a very common passage doesn't fill the task of its anchors."""
    for batch in slices(batches, "text", 1 << 20):
        anchor, whole, text, start, n, off = stretches(batch.column("text").cast(pa.binary()).to_pylist())
        doc, tag = (np.asarray(batch.column(x)).astype(np.int64)[text] for x in ("doc", "tag"))
        rows = [anchor, whole, doc, tag, start, n, off]
        by_anchor = np.argsort(anchor, kind="stable")
        same = anchor[by_anchor[1:]] == anchor[by_anchor[:-1]]
        several = by_anchor[np.r_[False, same] | np.r_[same, False]]
        # few anchors occur more than once in a batch; only their rows are sorted
        order = several[np.lexsort([x[several] for x in (start, tag, doc, whole, anchor)])]
        equal = [np.r_[False, x[order[1:]] == x[order[:-1]]] for x in rows[:5]] if len(order) else [np.zeros(0, dtype=bool)] * 5
        known = np.zeros(len(anchor), dtype=bool)
        alike = equal[0] & equal[1]
        run = np.cumsum(~alike)
        known[order] = alike & (np.bincount(run, minlength=1)[run] > local)
        stay = np.ones(len(anchor), dtype=bool)
        stay[order] = ~np.logical_and.reduce(equal)
        rows, known = [x[stay] for x in rows], known[stay]
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(x) for x in rows[:3]), *(pa.array(x.astype(np.int32)) for x in rows[3:]), pa.array(known)],
            ["anchor", "whole", "doc", "tag", "start", "n", "off", "known"])


class _Meeting:
    """Rows sorted by (anchor, whole, doc, tag, start), an anchor's rows together.

    Of an anchor with several rows each is ``open``: its bytes are to be compared. An anchor with more than
    ``united`` is hot, and its equal stretches are united before: the first of them is open, the
    rest are repeats of a whole stretch.
    """

    def __init__(self, united: int):
        self.united = united
        self.held = [np.zeros(0, dtype=np.int64)] * 7  # rows of the last anchor, while they are few
        self.hot: list[int] | None = None  # the last row of a hot anchor that may go on

    def feed(self, rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if self.hot is not None:
            n = int((rows[0] == self.hot[0]).sum())
            if n:
                yield from self._unite([x[:n] for x in rows])
            rows = [x[n:] for x in rows]
            if not len(rows[0]):
                return
            self.hot = None
        rows = [np.r_[x, y] for x, y in zip(self.held, rows)]
        others = np.flatnonzero(rows[0] != rows[0][-1])
        cut = int(others[-1]) + 1 if len(others) else 0
        yield from self._whole([x[:cut] for x in rows])
        self.held = [x[cut:] for x in rows]
        if len(self.held[0]) > self.united:
            yield from self._unite(self.held)
            self.held = [x[:0] for x in self.held]

    def end(self) -> Iterator[pa.RecordBatch]:
        yield from self._whole(self.held)

    def _whole(self, rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Anchors whose rows are all there."""
        if not len(rows[0]):
            return
        twin = np.r_[False, np.logical_and.reduce([x[1:] == x[:-1] for x in rows[:5]])]
        number = np.cumsum(np.r_[False, rows[0][1:] != rows[0][:-1]])
        size = np.bincount(number, weights=~twin)[number]
        yield _met(rows, ~twin & (size > 1) & (size <= self.united), True)
        for k in np.unique(number[size > self.united]):
            self.hot = None
            yield from self._unite([x[number == k] for x in rows])
        self.hot = None

    def _unite(self, rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Rows of a hot anchor, which go on from ``hot``."""
        last = self.hot
        before = [np.r_[last[k] if last else 0, x[:-1]] for k, x in enumerate(rows)]
        new = before[1] != rows[1]
        twin = np.logical_and.reduce([before[k] == rows[k] for k in range(5)])
        if last is None:
            new[0], twin[0] = True, False
        yield _met(rows, new, True)
        yield _met(rows, ~new & ~twin, False)
        self.hot = [int(x[-1]) for x in rows]


def _met(rows: list[np.ndarray], which: np.ndarray, is_open: bool) -> pa.RecordBatch:
    """The chosen ones of rows of anchor, whole, doc, tag, start, n, off."""
    kinds = [np.int64, np.int64, np.int64, np.int32, np.int32, np.int32, np.int32]
    return pa.RecordBatch.from_arrays(
        [pa.array(rows[k][which].astype(kinds[k])) for k in (0, 2, 3, 4, 5, 6)] + [pa.array(np.full(int(which.sum()), is_open))],
        ["anchor", "doc", "tag", "start", "n", "off", "open"])


def _meet(batches: Iterable[pa.RecordBatch], united: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (anchor, whole, doc, tag, start) -> those whose bytes are to be
    compared (``open``), and repeats of a whole stretch."""
    meeting = _Meeting(united)
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [np.asarray(batch.column(x)).astype(np.int64) for x in ("anchor", "whole", "doc", "tag", "start", "n", "off")]
        known = np.asarray(batch.column("known"))
        yield _met(rows, known, False)
        if not known.all():
            yield from meeting.feed([x[~known] for x in rows])
    yield from meeting.end()


def _regions(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each open stretch, out of the texts."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in slices(batches, "packed"):
        rows: list[list] = [[] for _ in range(7)]
        for row in batch.to_pylist():
            text = unpack(row["packed"])
            for x in row["open"]:
                region = text[x["start"]:x["start"] + x["n"] - 1 + WINDOW]
                for out, value in zip(rows, (x["anchor"], row["doc"], row["tag"], x["start"], x["n"], x["off"], region)):
                    out.append(value)
        kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds)], ["anchor", "doc", "tag", "start", "n", "off", "region"])


def extend_backward(anchor: np.ndarray, rank: np.ndarray, n: np.ndarray, off: np.ndarray, regions: list[bytes]) -> np.ndarray:
    """Which windows of which stretches start earlier in another row.

    ``rank`` orders the rows; the result has a row per stretch and a column per
    distance of the window's start before the anchor.
    """
    m = len(anchor)
    repeated = np.zeros((m, PLACES), dtype=bool)
    behind = np.zeros((m, WINDOW), dtype=np.uint8)
    ahead = np.zeros((m, PLACES), dtype=np.uint8)
    for k, region in enumerate(regions):
        own = np.frombuffer(region, dtype=np.uint8)
        o = int(off[k])
        part = own[o:o + WINDOW]
        behind[k, :len(part)] = part
        ahead[k, :o] = own[:o][::-1]
    order = np.lexsort((np.ascontiguousarray(behind).view(f"S{WINDOW}")[:, 0], anchor))
    anchor, rank, n, off, behind, ahead = (x[order] for x in (anchor, rank, n, off, behind, ahead))
    differ = behind[1:] != behind[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), WINDOW)
    common = np.r_[-1, np.where(anchor[1:] != anchor[:-1], -1, common)]
    rows = np.arange(m)
    interval = np.cumsum(common < 0)
    for back in range(PLACES):
        if back:
            rows, interval = rows[off[rows] >= back], interval[off[rows] >= back]
            interval = np.unique(interval.astype(np.int64) << 8 | ahead[rows, back - 1], return_inverse=True)[1]
        if not len(rows):
            break
        shared = np.bincount(interval)[interval] > 1
        rows, interval = rows[shared], interval[shared]
        follows = np.cumsum(common < WINDOW - back)
        asked = off[rows] - n[rows] < back
        own, key = rows[asked], interval[asked].astype(np.int64) << 32 | follows[rows[asked]]
        sort = np.lexsort((rank[own], key))
        own, key = own[sort], key[sort]
        if len(own):
            repeated[order[own[1:][key[1:] == key[:-1]]], back] = True
    return repeated


def _compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open stretches sorted by anchor -> runs of repeated windows."""
    held: list[pa.RecordBatch] = []

    def compare(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks()
        anchor, doc, tag, start, n, off = (np.asarray(rows[x]).astype(np.int64) for x in ("anchor", "doc", "tag", "start", "n", "off"))
        order = np.lexsort((start, tag, doc, anchor))
        a, d, t, s = (x[order] for x in (anchor, doc, tag, start))
        twin = np.r_[False, (a[1:] == a[:-1]) & (d[1:] == d[:-1]) & (t[1:] == t[:-1]) & (s[1:] == s[:-1])]
        once = np.sort(order[~twin])
        anchor, doc, tag, start, n, off = (x[once] for x in (anchor, doc, tag, start, n, off))
        rank = np.empty(len(anchor), dtype=np.int64)
        rank[np.lexsort((start + off, tag, doc))] = np.arange(len(anchor))
        repeated = extend_backward(anchor, rank, n, off, rows["region"].take(pa.array(once)).to_pylist())
        edge = np.diff(np.pad(repeated, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        which, low = np.nonzero(edge == 1)
        high = np.nonzero(edge == -1)[1]
        return _marks(doc[which], tag[which], (start + off)[which] - high + 1, high - low)

    for batch in batches:
        if not batch.num_rows:
            continue
        anchor = np.asarray(batch.column("anchor"))
        if held and held[-1].column("anchor")[-1].as_py() != anchor[0]:
            yield compare(held)
            held = []
        new = np.flatnonzero(anchor[1:] != anchor[:-1])
        if len(new):
            cut = int(new[-1]) + 1
            yield compare([*held, batch.slice(0, cut)])
            held, batch = [], batch.slice(cut)
        held.append(batch)
    if held:
        yield compare(held)


def _marks(doc, tag, start, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(doc), *(pa.array(np.asarray(x).astype(np.int32)) for x in (tag, start, n))], ["doc", "tag", "start", "n"])


def _by_window(regions: DataFrame) -> DataFrame:
    """Repeats among the stretches of very common anchors, window by window: the first
    row of each window by an aggregate that combines before its shuffle."""
    step = F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k")
    each = regions.select("anchor", "doc", "tag", "start", "off", "region", step).select(
        "doc", "tag", (F.col("start") + F.col("k")).alias("start"),
        F.col("anchor"), (F.col("off") - F.col("k")).alias("back"), F.substring("region", F.col("k") + 1, F.lit(WINDOW)).alias("bytes"))
    key = ["anchor", "back", "bytes"]
    first = each.groupBy(*key).agg(F.min(F.struct("doc", "tag", "start")).alias("first"))
    later: Column = F.struct("doc", "tag", "start") > F.col("first")
    return each.join(first, key).where(later).select("doc", "tag", "start", F.lit(1).alias("n"))


def marks(docs: DataFrame, group_size: int = GROUP, united: int = UNITED, local: int = LOCAL) -> DataFrame:
    """Runs of repeated windows: doc, tag, start of the first one, n windows."""
    texts = _keyed(docs).where(F.octet_length("text") >= WINDOW)
    anchors = texts.mapInArrow(lambda batches: _anchors(batches, local), f"anchor long, whole long, {ROW}, known boolean")
    # repeats that are known already meet no others and go by document
    place = F.when(F.col("known"), F.xxhash64("doc")).otherwise(F.col("anchor"))
    dealt = anchors.repartition(place).sortWithinPartitions("anchor", "whole", "doc", "tag", "start")
    met = stored(dealt.mapInArrow(lambda batches: _meet(batches, united), f"anchor long, {ROW}, open boolean"), "met", compression="zstd")
    opened = met.where("open").groupBy("doc", "tag").agg(F.collect_list(F.struct("anchor", "start", "n", "off")).alias("open"))
    regions = stored(_packed(docs, WINDOW).join(opened, ["doc", "tag"]).mapInArrow(_regions, f"anchor long, {ROW}, region binary"), "regions", compression="zstd")
    common = stored(regions.groupBy("anchor").count().where(F.col("count") > group_size).select("anchor"), "common")
    found = met.where("not open").select("doc", "tag", "start", "n")
    rare = regions
    if not common.isEmpty():
        found = found.unionByName(_by_window(regions.join(common, "anchor", "left_semi")))
        rare = regions.join(common, "anchor", "left_anti")
    compared = rare.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_compare, "doc long, tag int, start int, n int")
    return found.unionByName(compared)


def cut(docs: DataFrame, found: DataFrame, with_text: bool = False) -> DataFrame:
    """Per document what ``marks`` makes of it: doc_id, n_bytes, n_removed, n_spans,
    kept_sha256 (and the kept bytes)."""
    gathered = found.groupBy("doc", "tag").agg(F.collect_set(F.struct("start", "n")).alias("marks"))
    joined = _packed(docs).join(gathered, ["doc", "tag"], "left").drop("tag")

    def clean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in slices(batches, "packed"):
            ids = batch.column("doc").to_pylist()
            lists = batch.column("marks")
            out = []
            for k, text in enumerate(map(unpack, batch.column("packed").to_pylist())):
                removed = spans = 0
                if lists[k].is_valid:
                    runs = lists[k].values
                    start, n = (np.asarray(runs.field(x)).astype(np.int64) for x in ("start", "n"))
                    gone = np.zeros(len(text) + 1, dtype=np.int64)
                    np.add.at(gone, start, 1)
                    np.add.at(gone, start + n - 1 + WINDOW, -1)
                    gone = np.cumsum(gone) > 0
                    removed = int(gone.sum())
                    spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
                    kept = np.frombuffer(text, dtype=np.uint8)[~gone[:-1]].tobytes()
                else:
                    kept = text
                out.append((len(text), removed, spans, hashlib.sha256(kept).hexdigest(), kept))
            lengths, removed, spans, digest, kept = zip(*out)
            arrays = [pa.array([None if x == FIRST_ID else x for x in ids], pa.int64()), *(pa.array(x, pa.int64()) for x in (lengths, removed, spans)), pa.array(digest)]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                arrays.append(pa.array(kept, pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return joined.mapInArrow(clean, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)


def remove_repeats(docs: DataFrame, with_text: bool = False, group_size: int = GROUP, united: int = UNITED, local: int = LOCAL) -> DataFrame:
    """The documents without their repeated passages; see the module."""
    return cut(docs, marks(docs, group_size, united, local), with_text)
