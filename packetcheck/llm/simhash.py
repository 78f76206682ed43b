"""SimHash near-duplicates: fingerprints of word shingles, compared tile by tile.

Words are what stands between ASCII white space, A-Z lower-cased; shingles are
runs of words with repeats, a shorter text being one shingle. A bit of the
fingerprint is set if over half the shingles' hashes have it.

Defined cases: a null, empty or blank text has fingerprint zero, linked like any
other; rows with equal doc_id are separate documents; null doc_ids never name a
component unless it has no other, but their texts link and are near copies like others; an empty table gives an empty result; other
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetcheck.llm import tiles
from packetcheck.llm.common import Forest, as_row, components, slices
from packetcheck.session import stored

SEED = 42
#: Shingles of a block in which near copies are verified; a task compares two blocks.
BLOCK_SHINGLES = 1 << 21


def _shingles(text: bytes, shingle: int) -> list[bytes]:
    own = text.lower().split()
    if len(own) > shingle:
        return list(map(b" ".join, zip(*(own[k:] for k in range(shingle)))))
    return [b" ".join(own)] if own else []


def fingerprints(docs: DataFrame, shingle: int, words: int = 1, distinct: bool = False) -> DataFrame:
    """doc_id, text_key (hash of the text), n_shingles and the fingerprint's 64-bit words fp0, fp1, ... (by seeds from 42 on).

    With ``distinct``, a shingle counts once however often its text repeats it.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = [f"fp{k}" for k in range(words)]

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in slices(batches, "text", 2 << 20):
            found: list[list[int]] = [[] for _ in names]
            sizes = []
            for text in batch.column("text").cast(pa.binary()).fill_null(b"").to_pylist():
                own = _shingles(text, shingle)
                if distinct:
                    own = list(set(own))
                sizes.append(len(own))
                for k in range(words):
                    found[k] += [xxh64_intdigest(x, SEED + k) for x in own]
            size = np.array(sizes, dtype=np.int64)
            full = np.flatnonzero(size)
            starts = (np.cumsum(size) - size)[full]
            prints = []
            for k in range(words):
                out = np.zeros(len(size), dtype=np.uint64)
                if len(full):
                    bits = np.unpackbits(np.array(found[k], dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    most = np.add.reduceat(bits, starts, axis=0, dtype=np.int32) * 2 > size[full, None]
                    out[full] = np.packbits(most, axis=1, bitorder="little").view("<u8")[:, 0]
                prints.append(pa.array(out.view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(size), *prints], ["doc_id", "text_key", "n_shingles", *names])

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    return keyed.mapInArrow(hashed, f"doc_id {kind}, text_key long, n_shingles long, " + ", ".join(f"{x} long" for x in names))


def classes(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """Per document: doc_id, fp (bigint) and component_id, the smallest doc_id
    reachable over links between fingerprints at most ``radius`` bits apart."""
    prints = stored(fingerprints(docs, shingle).select("doc_id", F.col("fp0").alias("fp")), "prints")
    members = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "members")
    edges = tiles.shared_bits(members, radius)
    roots = components(edges, "links").withColumnsRenamed({"node": "fp", "component": "root"})
    rooted = stored(members.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "roots")
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(named, "fp")


def near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, words: int = 4, radius: int = 80) -> DataFrame:
    """Per row: doc_id, text_key, root (of its component), component_id, the smallest doc_id reachable over links
    between texts of which at least ``similarity`` of the distinct shingles are common
    (Jaccard); null where nothing in the component has an id.

    Fingerprints, of distinct shingles too, only find candidates. At similarity 0.8 the angle of
    two sets makes 15 % of the bits differ, 39 of 256 with a deviation of 5.7 (48 at most,
    for texts of four and five shingles); unrelated texts differ in 128 with a deviation of 8.
    The radius of 80 stands five to seven deviations from the one and six from the other.
    Texts whose fingerprints hang together are then compared by their shingles, and that decides.
    """
    names = [f"fp{k}" for k in range(words)]
    prints = stored(fingerprints(docs, shingle, words, distinct=True).withColumn("node", F.xxhash64("n_shingles", *names)), "prints")
    members = prints.groupBy(F.col("node").alias("id"), F.col("n_shingles").alias("size"), *names).agg(F.count("*").alias("n")).drop("n")
    edges = tiles.sized_blocks(members, names, radius, similarity)
    hung = components(edges, "links").withColumnsRenamed({"component": "cluster"})
    texts = prints.groupBy("text_key", "node", "n_shingles", *names).agg(F.min("doc_id").alias("first")).join(hung, "node", "left")
    texts = stored(texts.withColumn("cluster", F.coalesce("cluster", "node")).drop("node"), "texts")
    roots = components(_verified(docs, texts, names, shingle, similarity, radius), "copies").withColumnsRenamed({"node": "text_key", "component": "root"})
    rooted = stored(texts.select("text_key", "first").join(roots, "text_key", "left").withColumn("root", F.coalesce("root", "text_key")), "roots")
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("text_key", "root", "component_id")
    return prints.join(named, "text_key").select("doc_id", "text_key", "root", "component_id")


def _verified(docs: DataFrame, texts: DataFrame, names: list[str], shingle: int, similarity: float, radius: int) -> DataFrame:
    """Forest edges (a, b) between the text_keys of a cluster whose fingerprints lie
    within the radius and whose sets of shingles are similar.

    Only texts of clusters with several are hashed again. The texts of a cluster are dealt
    out to blocks by their shingles; every two blocks meet in a task.
    """
    blocks = F.greatest(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES), F.ceil(F.count("*") / tiles.GROUP)).cast("int")
    sizes = stored(texts.groupBy("cluster").agg(blocks.alias("blocks"), F.count("*").alias("n")).where("n > 1").drop("n"), "clusters")
    mine = F.pmod(F.xxhash64("text_key", F.lit(1)), "blocks").cast("int")
    own = stored(texts.join(sizes, "cluster").select("text_key", "cluster", *names, "blocks", mine.alias("mine")), "doubtful")
    needed = docs.select("text", F.xxhash64("text").alias("text_key")).join(own.select("text_key"), "text_key", "left_semi")
    needed = needed.groupBy("text_key").agg(F.any_value("text").alias("text"))
    sets = stored(needed.mapInArrow(lambda batches: _shingle_sets(batches, shingle), "text_key long, shingles binary"), "shingles")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = sets.join(own, "text_key").select("text_key", "shingles", "cluster", *names, "mine", other).select(
        "text_key", "shingles", "cluster", *names, F.least("mine", "other").alias("b1"), F.greatest("mine", "other").alias("b2"), (F.col("mine") > F.col("other")).alias("second"))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        fp = frame[names].to_numpy().astype(np.int64).view(np.uint64)
        count = np.bitwise_count(fp).sum(axis=1).astype(np.int64)
        second = frame["second"].to_numpy()
        order = np.lexsort((count, second))
        fp, count, keys = fp[order], count[order], frame["text_key"].to_numpy()[order]
        forest = SimilarSets([np.frombuffer(frame["shingles"].iloc[k], dtype=np.uint64) for k in order], similarity)
        split = None if frame["b1"].iloc[0] == frame["b2"].iloc[0] else int((~second).sum())
        tiles.link_tiles(fp, np.zeros(len(fp), dtype=np.int8), count, radius, forest, split=split)
        tied = np.flatnonzero(forest.root != np.arange(len(fp)))
        return pd.DataFrame({"a": keys[tied], "b": keys[forest.root[tied]]})

    return dealt.groupBy("cluster", "b1", "b2").applyInPandas(compare, "a long, b long")


def _shingle_sets(batches: Iterable[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """text_key and the distinct 64-bit hashes of its text's shingles."""
    from xxhash import xxh64_intdigest

    for batch in slices(batches, "text", 2 << 20):
        sets = [np.unique(np.array([xxh64_intdigest(x, SEED) for x in set(_shingles(text, shingle))], dtype=np.uint64)).tobytes()
                for text in batch.column("text").cast(pa.binary()).fill_null(b"").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("text_key"), pa.array(sets, pa.binary())], ["text_key", "shingles"])


class SimilarSets(Forest):
    """A forest that takes up a link only if the sets of its ends are similar (Jaccard);
    sets that hang together already aren't compared again."""

    def __init__(self, sets: list[np.ndarray], similarity: float):
        super().__init__(len(sets))
        self.similarity = similarity
        self.size = np.array([len(x) for x in sets], dtype=np.int64)
        values, ids = np.unique(np.concatenate([*sets, np.empty(0, dtype=np.uint64)]), return_inverse=True)
        self.sets = np.split(ids.astype(np.int32), np.cumsum(self.size)[:-1])
        self.marked = np.zeros(len(values), dtype=bool)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        """Pairs come with equal ``i`` next to each other."""
        for own in np.split(np.arange(len(i)), np.flatnonzero(np.diff(i)) + 1) if len(i) else []:
            a, others = i[own[0]], j[own]
            least, most = np.minimum(self.size[a], self.size[others]), np.maximum(self.size[a], self.size[others])
            others = others[(self.root[others] != self.root[a]) & (least >= self.similarity * most - 1e-9)]
            if not len(others):
                continue
            self.marked[self.sets[a]] = True
            common = np.array([np.count_nonzero(self.marked[self.sets[b]]) for b in others], dtype=np.int64)
            self.marked[self.sets[a]] = False
            # two empty sets are equal
            found = others[common >= self.similarity * (self.size[a] + self.size[others] - common) - 1e-9]
            super().link(np.full(len(found), a), found)


def keep_first(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """One row of each class: the first by doc_id (nulls last), text_key and, where several
    rows are equal in both, the hash of the whole row."""
    each = classes.groupBy("root", "doc_id", "text_key").agg(F.count("*").alias("n"))
    first = each.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "n")).alias("own"))
    first = stored(first.select(F.col("own.doc_id").alias("own_id"), F.col("own.text_key").alias("own_key"), F.col("own.n").alias("n")), "first")
    # stored apart, so that its true size is known and the second reading of docs need not be dealt out
    repeated = stored(first.where("n > 1"), "repeated")
    # the documents' columns stay in a struct, so their names meet no others
    rows = docs.select(as_row(docs), F.xxhash64("text").alias("text_key"))
    match = F.col("row.doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_key") == F.col("own_key"))
    single = rows.join(first.where("n = 1"), match, "left_semi").select("row")
    several = rows.join(repeated, match).groupBy("own_id", "own_key").agg(F.min_by("row", F.md5(F.to_json("row"))).alias("row"))
    return single.unionByName(several.select("row")).select("row.*")
