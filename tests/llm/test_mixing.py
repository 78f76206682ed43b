"""Operators 11 to 13: mixing, whitening and fill-in-middle."""

import collections
import hashlib
import heapq
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetcheck.llm import infill, mixing, whitening
from packetcheck.llm.queries import QUERIES

WORD = re.compile("[^\x20\x09-\x0D]+")


def plain_targets(words, weights=(5, 2, 1), share=1.5, most=2):
    """Excess over a source's bound is shared again by weight until none is above."""
    names = sorted(words, key=lambda x: (x is None, x or ""))
    weight = {x: weights[k % len(weights)] for k, x in enumerate(names)}
    left, full = share * sum(words.values()), {}
    while True:
        open_ = [x for x in names if x not in full]
        total = sum(weight[x] for x in open_)
        given = {x: left * weight[x] / total for x in open_}
        above = [x for x in open_ if given[x] > most * words[x]]
        if not above:
            return {**full, **given}
        for x in above:
            full[x] = most * words[x]
            left -= full[x]


def plain_seats(weights, seats):
    """The highest quotients one after the other."""
    heap = [(-w, part, 1) for part, w in weights.items() if w > 0]
    heapq.heapify(heap)
    won = collections.Counter()
    for _ in range(seats):
        quotient, part, k = heapq.heappop(heap)
        won[part] += 1
        heapq.heappush(heap, (-weights[part] / (2 * k + 1), part, k + 1))
    return won


@pytest.mark.parametrize("words", [
    {"a": 100, "b": 100, "c": 100}, {"b": 10, "a": 1000, None: 5, "é": 700, "z": 0}, {"a": 7}, {None: 12},
    {f"s{k}": (k * 7919) % 501 + 1 for k in range(40)},
])
def test_targets(spark, words):
    rows = [(x, "+" + x if x is not None else "-", n) for x, n in words.items()]
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(rows, "source string, key string, words long")).collect()}
    want = plain_targets(words)
    assert set(got) == set(want) and all(abs(got[x] - want[x]) < 1e-6 for x in want)
    assert abs(sum(got.values()) - 1.5 * sum(words.values())) < 1e-6


def test_apportion_is_highest_quotients(spark):
    rnd = random.Random(5)
    owners = {"one": ({0: 3.5}, 7), "none": ({0: 2.0, 1: 1.0}, 0), "ties": ({k: 1.0 for k in range(10)}, 24), "zero": ({0: 0.0, 1: 5.0}, 4)}
    for n in (3, 50, 400):
        owners[f"many{n}"] = ({k: rnd.choice([rnd.random(), 10 ** rnd.uniform(-6, 6), 2.0]) for k in range(n)}, rnd.choice([2, n, 7 * n]))
    parts = spark.createDataFrame([(o, p, w) for o, (ws, _) in owners.items() for p, w in ws.items()], "owner string, part long, weight double")
    seats = spark.createDataFrame([(o, n) for o, (_, n) in owners.items()], "owner string, seats long")
    got = collections.defaultdict(dict)
    for r in mixing.apportion(parts, seats, "test").collect():
        got[r["owner"]][r["part"]] = r["quota"]
    for owner, (weights, n) in owners.items():
        want = plain_seats(weights, n)
        assert got[owner] == {p: want[p] for p in weights}, owner


@pytest.mark.parametrize("block,shard", [(16, 1 << 17), (7, 300), (1, 50)])
def test_mix_is_near_its_targets(spark, docs_of, awkward, block, shard):
    rnd = random.Random(6)
    rows = [x for x in awkward if x[0] != 6] + [(100 + i, " ".join("w" * rnd.randint(1, 5) for _ in range(rnd.randint(0, 300)))) for i in range(300)]
    docs = docs_of(rows).withColumn("source", F.when(F.col("doc_id") % 7 == 0, None).when(F.col("doc_id") < 150, "hot").otherwise(F.concat(F.lit("s"), F.col("doc_id") % 3)))
    mixed = mixing.mix(docs, block=block, shard=shard, keep=("source", "text"))
    found = mixed.collect()
    assert len(found) == len(rows)
    words, taken, target, shards = collections.Counter(), collections.Counter(), {}, collections.Counter()
    for r in found:
        assert r["size"] == len(WORD.findall(r["kept"]["text"] or "")) and 0 <= r["taken"] <= 2 * r["size"]
        words[r["kept"]["source"]] += r["size"]
        taken[r["kept"]["source"]] += r["taken"]
        shards[r["kept"]["source"], r["shard"]] += 1
        target[r["kept"]["source"]] = r["target"]
    want = plain_targets(words)
    for x in words:
        assert abs(target[x] - want[x]) < 1e-6
        cells = sum(k[0] == x for k in shards)
        assert abs(taken[x] - target[x]) <= 2 * block * cells
    assert all(r["source_size"] == words[r["kept"]["source"]] for r in found)
    # the pieces hold the words that are counted
    held = collections.Counter()
    for r in mixing.pieces(mixed, block).collect():
        held[str(r["doc_id"])] += len(WORD.findall(r["text"]))
    counted = collections.Counter()
    for r in found:
        counted[str(r["doc_id"])] += r["taken"]
    assert held == +counted
    if block != 16:
        return
    again = mixing.mix(docs.repartition(5), block=block, shard=shard).select("doc_id", "taken").collect()
    assert collections.Counter(again) == collections.Counter((r["doc_id"], r["taken"]) for r in found)


def test_mix_of_awkward_tables(spark, docs_of):
    assert mixing.mix(docs_of([(1, "a")]).limit(0)).count() == 0
    alone = mixing.mix(spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in alone] == [(0, 0.0, 0)] * 2
    same = mixing.mix(docs_of([(1, "a b c")] * 40)).collect()
    assert sum(r["taken"] for r in same) in range(160, 201) and all(r["taken"] <= 6 for r in same)


def test_cholesky_and_jacobi():
    rng = np.random.default_rng(3)
    for d, rank in ((1, 1), (2, 2), (7, 7), (30, 30), (30, 11), (9, 0)):
        a = rng.normal(0, 1, (d, rank)) * 10.0 ** rng.uniform(-3, 3, rank)
        a = a @ a.T
        factor = whitening.pivoted_cholesky(a)
        assert factor.shape[1] <= rank and np.allclose(factor @ factor.T, a, rtol=1e-10, atol=1e-10 * max(a.max(initial=0), 1e-300))
        u, e = whitening.one_sided_jacobi(factor)
        assert np.allclose(u.T @ u, np.eye(len(e)), atol=1e-12) and (np.diff(e) <= 0).all()
        assert np.allclose(a @ u, u * e, atol=1e-12 * np.abs(a).max(initial=1))
    # a graded factor keeps its small eigenvalues
    small = np.diag([1e10, 1.0, 1e-10])
    q = np.linalg.qr(rng.normal(0, 1, (3, 3)))[0]
    assert np.allclose(np.sqrt(whitening.one_sided_jacobi(np.sqrt(small) @ q)[1]), [1e5, 1, 1e-5], rtol=1e-8)


def whitened_rows(df, **settings):
    out = collections.defaultdict(list)
    for r in whitening.whiten(df, **settings).orderBy("vec_id", "component").collect():
        out[r["vec_id"]].append(r)
    return out


def test_whitening_equals_plain(spark):
    rng = np.random.default_rng(4)
    plain = rng.normal(0, 1, (300, 12)) @ rng.normal(0, 1, (12, 12)) + 3
    rows = [(i, [float(np.float32(x)) for x in v], 1) for i, v in enumerate(plain)]
    rows += [(300, rows[5][1], None), (400, None, 1), (401, [1.0, None], 1), (402, [float("nan")] * 12, 2), (403, [float("inf")] + [0.0] * 11, 1), (404, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({x: F.lit(1) for x in ("v", "dims", "n", "w", "deviation")}).repartition(5)
    got = whitened_rows(df)
    x = np.array([[int(np.floor(1024 * c)) + 100000 for c in v] for i, v, _ in rows[:301]], dtype=np.int64)
    n, s = len(x), x.sum(axis=0)
    z = (x - s / n)
    e, u = np.linalg.eigh(z.T @ z / n)
    e, u = e[::-1], u[:, ::-1]
    assert set(got) == set(range(301))
    white = np.array([[r["whitened"] for r in got[i]] for i in range(301)])
    plain = (z @ u / np.sqrt(e))[:, :8]
    for k in range(8):
        assert np.allclose(white[:, k], plain[:, k], atol=1e-8) or np.allclose(white[:, k], -plain[:, k], atol=1e-8)
    for i in range(301):
        assert [r["component"] for r in got[i]] == list(range(1, 9)) and {r["n"] for r in got[i]} == {n}
        assert {r["deviation"] for r in got[i]} == {int(((n * x[i].astype(object) - s) ** 2).sum())}
        assert np.allclose([r["explained"] for r in got[i]], e[:8] / e.sum(), rtol=1e-10)
    error = np.abs(white.T @ white / n - np.eye(8)).max()
    assert error < 1e-9 and abs({r["identity_error"] for rows in got.values() for r in rows}.pop()) < 1e-9


def test_whitening_of_awkward_tables(spark):
    kind = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, kind)).count() == 0
    rows = [(None, [0.0, 1.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [5.0]), (3, [7.0]), (4, [1e300, -1e300, 1.0]), (5, [0.0, 0.0, 1.0]), (6, [2e-3, 0.0, 1.0])]
    found = whitening.whiten(spark.createDataFrame(rows, kind)).collect()
    counts = collections.Counter((r["vec_id"], r["n"], r["deviation"]) for r in found)
    # two points make one component; each length has its own fit
    assert {k: v for k, v in counts.items() if k[0] in (None, 1, 2, 3)} == {
        (None, 3, 2 * 2048 ** 2): 1, (1, 3, 2 * 1024 ** 2): 2, (2, 2, 2048 ** 2): 1, (3, 2, 2048 ** 2): 1}
    assert {r["deviation"] for r in found if r["vec_id"] == 4} == {None}
    assert all(np.isfinite(r["whitened"]) and r["identity_error"] < 1e-4 for r in found)


UNIT = re.compile("[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_infill(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    units = UNIT.findall(text)
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < 80:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("block", [4096, 5, 1])
def test_infill_equals_plain(spark, docs_of, awkward, block):
    rnd = random.Random(9)
    parts = [" ", "\n", "\x0b", "a", "é", "\U0001f600", "word", "\x00", "<", "<S", "P>", "S>", "M>", "\x85", "\xa0", " "]
    rows = awkward + [(1000 + i, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40)))) for i in range(400)] + [(2000 + i, f"a <{'PSM'[i % 3]}> b") for i in range(30)]
    rows += [(3000 + i, "the same text in many rows \n") for i in range(200)]
    found = infill.transform(docs_of(rows), block=block)
    got = sorted((str(r["doc_id"]), r["n"], r["form"], str(r["prefix_chars"]), str(r["middle_chars"]), r["output"]) for r in found.collect())
    want = []
    for i, t in rows:
        n, form, prefix, middle, output = plain_infill(i, t)
        want.append((str(i), n, form, str(prefix), str(middle), output))
    assert got == sorted(want)
    assert {x[2] for x in got} == {"plain", "psm", "spm"}
    back = found.select("text", infill.restore(F.col("output"), F.col("form")).alias("back")).collect()
    assert all(r["text"] == r["back"] for r in back)
    assert infill.transform(docs_of(rows).limit(0)).count() == 0


def test_tree_finds_every_cut():
    rnd = random.Random(10)
    for _ in range(200):
        text = "".join(rnd.choice([" ", "\t", "ab", "é", "日本", "\U0001f600 "]) for _ in range(rnd.randint(0, 60)))
        units = UNIT.findall(text)
        blocks = infill.Blocks(np.frombuffer(text.encode(), dtype=np.uint8), rnd.choice([1, 2, 3, 8, 64]))
        assert blocks.units == len(units)
        for k in range(len(units) + 1):
            own = "".join(units[:k])
            assert blocks.cut(k) == (len(own.encode()), len(own))


def test_whitening_query_of_the_given_table(spark):
    rows = QUERIES["op12_embedding_whitening"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 8 * 500 and max(r["identity_error"] for r in rows) < 1e-9
