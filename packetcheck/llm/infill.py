"""Fill-in-middle: texts cut into prefix, middle and suffix, and put together in another order.

A text's units are words with the blanks before them (blanks at the end are a unit of their
own). Its UTF-8 bytes are divided into blocks of a fixed size; a Fenwick tree over the blocks
holds how many units end in each and how many code points begin in it. Where the k-th unit
ends is found by binary-lifting descent to its block and a look into that block alone; the
same descent gives the code points before it.

Where a text is cut, whether and how it is put together are drawn from the hash of seed and doc_id,
so a row's result depends on nothing else.

Defined cases: a null text is empty, and empty texts stay plain, as do those that hold one of
the markers; a null doc_id draws like an empty number, so rows without an id draw alike; repeated rows
get the same result each; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetcheck.llm.common import slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
SEED = 42
#: Of a hundred texts so many are transformed, and of a hundred of those so many suffix first.
SHARE, SUFFIX_FIRST = 50, 80
BLOCK = 4096

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, *range(9, 14)]] = True


class Blocks:
    """Fenwick tree over a text's blocks: units that end, code points that begin in each."""

    def __init__(self, text: np.ndarray, block: int = BLOCK):
        """``text``: the bytes as unsigned 8-bit numbers."""
        self.text, self.block = text, block
        self.ends = self._unit_ends(0, len(text))
        starts = np.arange(0, len(text), block)
        points = ((text & 0xC0) != 0x80).astype(np.int64)
        n = len(starts)
        self.tree = np.zeros((n + 1, 2), dtype=np.int64)
        if n:
            self.tree[1:, 0] = np.bincount((np.flatnonzero(self.ends)) // block, minlength=n)
            self.tree[1:, 1] = np.add.reduceat(points, starts)
        self.units = int(self.tree[:, 0].sum())
        for k in range(1, n + 1):
            above = k + (k & -k)
            if above <= n:
                self.tree[above] += self.tree[k]

    def _unit_ends(self, low: int, high: int) -> np.ndarray:
        """Whether a unit ends with each byte: after a run that isn't blank, and at the text's end."""
        blank = _BLANK[self.text[low:min(high + 1, len(self.text))]]
        ends = np.zeros(high - low, dtype=bool)
        ends[:len(blank) - 1] = ~blank[:-1] & blank[1:]
        if high == len(self.text) and high > low:
            ends[-1] = True
        return ends

    def cut(self, k: int) -> tuple[int, int]:
        """Bytes and code points that the first k units take."""
        if k <= 0:
            return 0, 0
        at, left, points = 0, k, 0
        step = 1 << (len(self.tree) - 1).bit_length()
        while step:
            if at + step < len(self.tree) and self.tree[at + step, 0] < left:
                at += step
                left -= int(self.tree[at, 0])
                points += int(self.tree[at, 1])
            step >>= 1
        low = at * self.block
        high = min(low + self.block, len(self.text))
        end = low + int(np.flatnonzero(self.ends[low:high])[left - 1]) + 1
        return end, points + int(((self.text[low:end] & 0xC0) != 0x80).sum())


def _drawn(doc_id: Column, seed: int, group: int) -> Column:
    """The group-th 8 hexadecimal digits of the hash of seed and doc_id, as a number."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(text, 256), 8 * group + 1, 8), 16, 10).cast("long")


def transform(docs: DataFrame, seed: int = SEED, share: int = SHARE, suffix_first: int = SUFFIX_FIRST, block: int = BLOCK) -> DataFrame:
    """Per row: doc_id, text (null as empty), n (units), form, prefix_chars, middle_chars (null if
    plain) and output."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    drawn = [_drawn(F.col("doc_id"), seed, k).alias(f"h{k + 1}") for k in range(4)]
    marks = [x.encode() for x in (PREFIX, SUFFIX, MIDDLE)]

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            h = np.stack([np.asarray(batch.column(f"h{k}")) for k in range(1, 5)], axis=1)
            units, forms, before, middle, output = [], [], [], [], []
            for text, (h1, h2, h3, h4) in zip(texts, h.tolist()):
                blocks = Blocks(np.frombuffer(text, dtype=np.uint8), block)
                units.append(blocks.units)
                if not text or h3 % 100 >= share or any(x in text for x in marks):
                    forms.append(PLAIN)
                    before.append(None)
                    middle.append(None)
                    output.append(text)
                    continue
                low, high = sorted((h1 % (blocks.units + 1), h2 % (blocks.units + 1)))
                (a, chars), (b, to) = blocks.cut(low), blocks.cut(high)
                before.append(chars)
                middle.append(to - chars)
                if h4 % 100 < suffix_first:
                    forms.append(SPM)
                    output.append(b"".join((marks[1], text[b:], marks[0], text[:a], marks[2], text[a:b])))
                else:
                    forms.append(PSM)
                    output.append(b"".join((marks[0], text[:a], marks[1], text[b:], marks[2], text[a:b])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text"), pa.array(units, pa.int64()), pa.array(forms, pa.string()),
                 pa.array(before, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())],
                ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *drawn)
    return rows.mapInArrow(each, f"doc_id {kind}, text string, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(output: Column, form: Column) -> Column:
    """The text an output was made of."""
    head = F.substring_index(output, MIDDLE, 1)
    middle = F.substr(output, F.length(head) + len(MIDDLE) + 1)

    def halves(second: str, first: str) -> tuple[Column, Column]:
        own = F.substring_index(head, second, 1)
        return F.substr(own, F.lit(len(first) + 1)), F.substr(head, F.length(own) + len(second) + 1)

    prefix, suffix = halves(SUFFIX, PREFIX)
    last, first = halves(PREFIX, SUFFIX)
    return F.when(form == PSM, F.concat(prefix, middle, suffix)).when(form == SPM, F.concat(first, middle, last)).otherwise(output)


def digests(transformed: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the hashes of the output and of the text
    rebuilt from it."""
    return transformed.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
