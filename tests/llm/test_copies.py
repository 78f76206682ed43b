import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from packetcheck.llm import repeats, simhash, tiles
from packetcheck.llm.common import Forest, components


def reachable(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, j in pairs:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rnd = random.Random(2)
    for n, m in ((30, 20), (200, 150), (50, 0)):
        pairs = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)] + ([(i, i + 1) for i in range(20)] if m else [])
        df = spark.createDataFrame(pairs + pairs[:3], "a long, b long")
        got = {r["node"]: r["component"] for r in components(df, "test").collect()}
        want = reachable(n, pairs)
        touched = {x for p in pairs if p[0] != p[1] for x in p}
        assert got == {x: want[x] for x in touched}


def test_forest():
    rnd = np.random.default_rng(1)
    i, j = rnd.integers(0, 300, 200), rnd.integers(0, 300, 200)
    forest = Forest(300)
    for k in range(0, 200, 50):
        forest.link(i[k:k + 50], j[k:k + 50])
    assert forest.root.tolist() == reachable(300, zip(i.tolist(), j.tolist()))


def plain_fingerprint(text, k=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash_classes(spark, docs_of, awkward):
    rnd = random.Random(4)
    texts = [(20 + i, " ".join(rnd.choice("a b c d".split()) for _ in range(rnd.randint(1, 6)))) for i in range(150)]
    rows = awkward + texts
    got = sorted((str(r["doc_id"]), r["fp"] % (1 << 64), r["component_id"]) for r in simhash.classes(docs_of(rows)).collect())
    prints = [plain_fingerprint(t) for _, t in rows]
    root = reachable(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 2])
    least = {}
    for (i, _), r in zip(rows, root):
        least[r] = min([x for x in (least.get(r), i) if x is not None], default=None)
    assert got == sorted((str(i), p, least[r]) for (i, _), p, r in zip(rows, prints, root))


def test_full_bit_ranges_are_divided(spark):
    """Many fingerprints that agree on whole ranges: the groups get smaller, the links stay."""
    rnd = random.Random(5)
    base = rnd.getrandbits(64)
    prints = sorted({base ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(12)) for _ in range(300)} | {rnd.getrandbits(64) for _ in range(200)})
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    edges = tiles.shared_bits(spark.createDataFrame([(x,) for x in signed], "fp long"), 2, group_size=16)
    got = {r["node"]: r["component"] for r in components(edges, "test").collect()}
    order = sorted(range(len(prints)), key=lambda k: signed[k])
    rank = {k: n for n, k in enumerate(order)}
    pairs = [(rank[i], rank[j]) for i in range(len(prints)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 2]
    want = reachable(len(prints), pairs)
    assert {x: got.get(x, x) for x in signed} == {signed[order[n]]: signed[order[want[n]]] for n in range(len(prints))}


def test_near_copies(spark, docs_of, awkward):
    rnd = random.Random(6)
    rows = []
    for g in range(12):
        words = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randint(60, 400))]
        for c in range(4):
            own = list(words)
            if c:
                own[rnd.randrange(len(own))] = "changed"
            rows.append((100 * g + c, " ".join(own)))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs_of(rows)).collect()}
    assert got == {i: i - i % 100 for i, _ in rows}
    names = ["fp0", "fp1", "fp2", "fp3"]
    prints = simhash.fingerprints(docs_of(rows), 5, 4).select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("size"), *names)
    split = {r["node"]: r["component"] for r in components(tiles.sized_blocks(prints, names, 50, 0.8, block=5), "test").collect()}
    assert split == got
    assert simhash.near_copies(docs_of(awkward)).count() == len(awkward)


def plain_repeats(docs, window=100):
    seen, out = set(), {}
    for i, text in sorted(docs):
        raw = text.encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - window + 1):
            if raw[s:s + window] in seen:
                gone[s:s + window] = b"\1" * window
            else:
                seen.add(raw[s:s + window])
        kept = bytes(x for x, y in zip(raw, gone) if not y)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def repeat_texts():
    rnd = random.Random(7)

    def text(n):
        return " ".join("".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 7))) for _ in range(n))
    passages = [text(k) for k in (15, 20, 30, 60, 200)]
    docs = []
    for i in range(200):
        parts = []
        for _ in range(rnd.randint(0, 4)):
            r = rnd.random()
            if r < 0.5:
                parts.append(text(rnd.randint(1, 40)))
            elif r < 0.9:
                p = rnd.choice(passages)
                a = rnd.randint(0, len(p) // 2)
                parts.append(p[a:a + rnd.randint(50, len(p))])
            else:
                parts.append(rnd.choice(["a", "ab c", "\x00"]) * rnd.randint(50, 150))
        docs.append((i, rnd.choice(["", " "]).join(parts)))
    return docs + [(1000 + i, rnd.choice(docs)[1]) for i in range(30)]


def test_repeats_equal_brute_force(spark, docs_of):
    docs = repeat_texts()
    want = plain_repeats(docs)
    # all compared; some united first; nearly all united, and windows dealt out
    for group_size, united, local in ((50_000, 50_000, 64), (50_000, 12, 1), (3, 3, 64), (3, 1, 1)):
        rows = repeats.remove_repeats(docs_of(docs), group_size=group_size, united=united, local=local).collect()
        assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows} == want


def test_repeats_of_awkward_rows(spark, docs_of, awkward):
    rows = repeats.remove_repeats(docs_of(awkward), with_text=True).collect()
    assert len(rows) == len(awkward)
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    size = by_id[5]["n_bytes"]
    assert (by_id[5]["n_removed"], by_id[6]["n_removed"]) == (by_id[5]["n_removed"], size)
    assert by_id[10]["n_removed"] == 3000 - 1 and bytes(by_id[10]["kept"]) == b"a"
    assert {r["n_removed"] for r in rows if r["doc_id"] in (None, 1, 2, 3, 4, 7)} == {0}


def test_empty_tables(spark, docs_of):
    none = docs_of([]).limit(0)
    assert simhash.classes(none).count() == simhash.near_copies(none).count() == repeats.remove_repeats(none).count() == 0


def shingle_sets(texts, k=5):
    own = [(t or "").encode().lower().split() for t in texts]
    return [{tuple(w[i:i + k]) for i in range(max(len(w) - k, 0) + 1)} if w else set() for w in own]


def plain_copies(rows, similarity=0.8):
    """Smallest id of each row's component of exact shingle similarity."""
    sets = shingle_sets([t for _, t in rows])
    near = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9]
    root, least = reachable(len(rows), near), {}
    for (i, _), r in zip(rows, root):
        least[r] = min([x for x in (least.get(r), i) if x is not None], default=None)
    return [least[r] for r in root]


def test_near_copies_are_verified(spark, docs_of, monkeypatch):
    """Chains of texts from 0.6 to 1 similar: links are those of the exact similarity, in one block or several."""
    rnd = random.Random(8)
    rows = []
    for g in range(40):
        words = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randint(8, 300))]
        for c in range(5):
            own = list(words)
            for _ in range(rnd.randint(0, len(words) // 25 + 1)):
                own[rnd.randrange(len(own))] = "changed"
            rows.append((100 * g + c, " ".join(own)))
    want = plain_copies(rows)
    assert len(set(want)) > 45
    for shingles in (1 << 21, 200):
        monkeypatch.setattr(simhash, "BLOCK_SHINGLES", shingles)
        got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs_of(rows)).collect()}
        assert got == {i: w for (i, _), w in zip(rows, want)}


def test_near_copies_with_repeated_passages(spark, docs_of):
    """Sizes are those of distinct shingles: a passage may stand once or many times."""
    rnd = random.Random(9)
    rows = []
    for g in range(6):
        passage = " ".join(f"p{g}x{k}" for k in range(60))
        rest = " ".join(f"w{rnd.randrange(5000)}" for _ in range(200))
        rows += [(10 * g, f"{rest} {passage}"), (10 * g + 1, f"{rest} {passage} {passage} {passage} {passage} {passage} {passage} {passage}")]
    rows += [(100 + k, x) for k, x in enumerate(["one", "ONE", "a b c d e f", "a b c d e g", "a b c d e f g h", "a b c d e f g h i"])]
    want = plain_copies(rows)
    assert want[:4] == [0, 0, 10, 10] and want[-6:] == [100, 100, 102, 103, 104, 104]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs_of(rows)).collect()}
    assert got == {i: w for (i, _), w in zip(rows, want)}


def test_one_row_of_each_class_stays(spark, docs_of):
    """Texts without an id bridge others and go as copies; equal rows go but for one."""
    words = [f"w{k}" for k in range(100)]
    texts = [" ".join(["new"] * k + words[k:]) for k in (0, 10, 20)]
    ids = [(1, texts[0]), (None, texts[1]), (2, texts[2]), (3, "a b c d e f"), (3, "a b c d e f"), (None, "some text"), (None, "some  text"), (None, "some text"), (None, None)]
    docs = docs_of(ids).withColumn("n_chars", F.rand(1))
    kept = simhash.keep_first(docs, simhash.near_copies(docs))
    assert kept.columns == docs.columns
    got = sorted((str(r["doc_id"]), " ".join((r["text"] or "null").split())) for r in kept.collect())
    assert got == sorted([("1", texts[0]), ("3", "a b c d e f"), ("None", "some text"), ("None", "null")])


def test_stretches_meet_alike_however_they_are_dealt(spark):
    """Rows in batches of any size: few rows of an anchor are all open, of many the first of each stretch."""
    rnd = random.Random(4)
    places = {(a, rnd.randrange(6), rnd.randrange(5)) for a in range(40) for _ in range(rnd.choice([1, 2, 3, 30]))}
    rows = [(a, (7 * doc + 5 * start + a) % 4, doc, 0, start) for a, doc, start in places]
    rows += rnd.sample(rows, 30)
    rows.sort()
    names = ["anchor", "whole", "doc", "tag", "start"]
    sizes = collections.Counter(a for a, *_ in set(rows))
    for group_size in (1, 5, 20, 1000):
        want_open, want_closed = set(), set()
        for r in set(rows):
            same = min(x for x in rows if x[:2] == r[:2])
            if sizes[r[0]] > group_size:
                (want_open if r == same else want_closed).add((r[0], *r[2:]))
            elif sizes[r[0]] > 1:
                want_open.add((r[0], *r[2:]))
        for step in (1, 3, 17, 10_000):
            batches = []
            for k in range(0, len(rows), step):
                part = rows[k:k + step]
                columns = {x: [r[j] for r in part] for j, x in enumerate(names)} | {"n": [1] * len(part), "off": [0] * len(part), "known": [False] * len(part)}
                batches.append(pa.RecordBatch.from_pydict(columns))
            found = [tuple(x.values()) for b in repeats._meet(batches, group_size) for x in b.to_pylist()]
            is_open = [x[:4] for x in found if x[-1]]
            closed = [x[:4] for x in found if not x[-1]]
            if step == 10_000:
                assert sorted(is_open) == sorted(want_open) and sorted(closed) == sorted(want_closed), group_size
            # where an anchor turns out to be hot only counts repeated rows too, or an anchor has one row
            assert set(is_open) | set(closed) >= want_open | want_closed and not set(is_open) & set(closed)
            assert set(closed) <= {(r[0], *r[2:]) for r in rows if min(x for x in rows if x[:2] == r[:2]) < r}
            assert all(sizes[x[0]] == 1 for x in set(is_open) - want_open) and len(found) == len(set(found))
