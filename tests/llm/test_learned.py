import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetcheck.llm import decontamination, language, quality


def plain_passages(text, items, span=20, similarity=0.8):
    """Items that lie over the text with enough equal tokens, at any place."""
    own, found = decontamination.tokens(text or ""), []
    for item, other in items:
        words = decontamination.tokens(other or "")
        width = min(span, len(words))
        for begin in range(-len(words), len(own)):
            equal = [0 <= begin + k < len(own) and own[begin + k] == w for k, w in enumerate(words)]
            inside = [0 <= begin + k < len(own) for k in range(len(words))]
            if any(all(inside[k:k + width]) and sum(equal[k:k + width]) >= similarity * width - 1e-9 for k in range(len(words) - width + 1) if words):
                found.append(item)
                break
    return sorted(set(found), key=lambda x: (x is None, x))


def test_passages_equal_brute_force(spark, docs_of, awkward):
    rnd = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([3, 5, 6, 8, 18, 25, 50])))) for i in range(30)]
    items += [(40, items[0][1]), (41, ""), (42, None), (None, "x y z"), (None, "a passage without any number of its own")]
    rows = []
    for i in range(120):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 80))]
        if rnd.random() < 0.6:
            passage = rnd.choice([*items[:30], items[-1]])[1].split()
            # two substitutions in a long passage leave seeds between them, one in a short one
            for _ in range(2 if len(passage) > 17 else rnd.randint(0, 1)):
                passage[rnd.randrange(len(passage))] = "other"
            at = rnd.randint(0, len(words))
            words[at:at] = passage if rnd.random() < 0.8 else passage[:len(passage) // 2]
        rows.append((100 + i, " ".join(words).upper() if i % 5 == 0 else ", ".join(words)))
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    want = sorted(((str(i), plain_passages(t, items)) for i, t in rows + awkward), key=repr)
    assert any(None in x for _, x in want)
    for n in (5, 6):
        short = {i for i, t in items if len((t or "").split()) == n}
        assert short and any(short & set(x) for _, x in want)
    for block in (1 << 20, 150):
        got = decontamination.find(docs_of(rows + awkward), benchmark, block=block)
        assert sorted(((str(r["doc_id"]), r["item_ids"]) for r in got.collect()), key=repr) == want
        kept = decontamination.clean(docs_of(rows + awkward), benchmark, block=block)
        assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(i for i, x in want if not x)
    assert got.where("contaminated").count() > 40
    assert decontamination.find(docs_of(rows), benchmark.limit(0)).where("contaminated").count() == 0
    assert decontamination.find(docs_of([]).limit(0), benchmark).count() == 0


def quality_rows(n=400):
    rnd = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(rnd.randint(20, 200))]
        good = rnd.random() < 0.7
        rows.append((i, " ".join(words) + "." if good else "!! ".join(w.upper() for w in words)))
        labels.append((i, int(good), 0))
    return rows, labels


def test_quality(spark, docs_of, awkward):
    rows, labels = quality_rows()
    known = spark.createDataFrame(labels + [(None, 1, 0), (3, None, 0), (1, 1 - labels[1][1], 0)], "doc_id long, quality int, toxic int").withColumn("text", F.lit(""))
    docs = docs_of(rows + [(1000 + k, t) for k, (_, t) in enumerate(awkward)])
    got = {r["doc_id"]: r for r in quality.classify(docs, known).collect()}
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [(got[i]["predicted"], q) for i, q, _ in labels if got[i]["held_out"]]
    assert np.mean([p == q for p, q in held]) > 0.97
    kept = {r["doc_id"] for r in quality.keep_good(docs, known).collect()}
    assert kept == {i for i, r in got.items() if r["predicted"]}
    assert set(quality.keep_good(docs, known).columns) == set(docs.columns)


def test_discriminant_equals_the_formula():
    rng = np.random.default_rng(1)
    x = {0: rng.normal(0, 1, (200, 3)) @ rng.normal(0, 1, (3, 3)), 1: rng.normal(1, 2, (300, 3))}
    model = quality.Discriminant({k: (len(v), v.sum(0), v.T @ v) for k, v in x.items()}, to_pooled=0.2, to_identity=0.05)
    cov = {k: np.cov(v.T, bias=True) for k, v in x.items()}
    pooled = (200 * cov[0] + 300 * cov[1]) / 500
    rows = rng.normal(0, 2, (50, 3))
    density = {}
    for k in (0, 1):
        c = 0.8 * cov[k] + 0.2 * pooled
        c = 0.95 * c + 0.05 * np.trace(c) / 3 * np.eye(3)
        d = rows - x[k].mean(0)
        density[k] = np.log(len(x[k]) / 500) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d)
    assert np.allclose(model.score(rows), 1 / (1 + np.exp(density[0] - density[1])))


def plain_statistics(text):
    """The statistics of one text, one after the other."""
    raw, words, lines = text.encode(), text.split(), text.split("\n")
    marks = ".,;:'\"-()?"
    lower = sum(97 <= b <= 122 for b in raw)
    capitals = sum(65 <= b <= 90 for b in raw)
    wide = sum(b >= 128 for b in raw)
    digits, blank = sum(48 <= b <= 57 for b in raw), sum(b in (9, 10, 11, 12, 13, 32) for b in raw)
    usual = sum(b < 128 and chr(b) in marks for b in raw)
    odd = len(raw) - lower - capitals - wide - digits - blank - usual
    letters, n = lower + capitals + wide, len(words)

    def odds(part, whole):
        return math.log((part + 0.5) / (max(whole - part, 0) + 0.5))
    total = max(len(raw), 1)
    lengths = [len(w) for w in words]
    mean = sum(lengths) / n if n else 0
    spread = math.sqrt(sum((x - mean) ** 2 for x in lengths) / n) if n else 0
    return [
        math.log1p(len(raw)), math.log1p(n), math.log((letters + 1) / (n + 1)), odds(capitals, letters), odds(digits, total), odds(blank, total),
        odds(usual, total), odds(odd, total), odds(wide, total), len(set(words)) / n if n else 1, len(set(lines)) / len(lines) if n else 1,
        math.log((max(words.count(w) for w in set(words)) / n if n else 0) + 1e-3), math.log1p(n / len(lines) if n else 0), math.log1p(spread)]


def test_statistics_equal_plain():
    rnd = random.Random(12)
    parts = ["a", "B", "é", "日本", " ", "\n", "\t", ".", "!", "7", "word ", "word ", "\x00", "\U0001f600"]
    texts = ["", " ", "\n\n", "one"] + ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 80))) for _ in range(300)]
    got = quality.statistics(texts)
    assert got.shape == (len(texts), len(quality.NAMES))
    for row, text in zip(got, texts):
        assert np.allclose(row, plain_statistics(text)), text


def test_quality_without_labels(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.classify(docs_of(["a", None]), none).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.classify(docs_of([f"text {i}" for i in range(10)]), one).collect()} == {1.0}
    assert quality.classify(docs_of([]).limit(0), none).count() == 0


@pytest.fixture(scope="module")
def language_rows():
    rnd = random.Random(10)
    syllables = {"xx": ["the", "ing", "and", "er"], "yy": ["sch", "ung", "der", "ü"], "zz": ["eau", "que", "é", "les"]}
    rows = []
    for i in range(300):
        lang = rnd.choice(sorted(syllables))
        words = ["".join(rnd.choice(syllables[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(5, 300))]
        rows.append((i, " ".join(words), None if i % 11 == 0 else lang, lang))
    return rows


def test_language(spark, awkward, language_rows):
    extra = [(1000 + k, t, None, None) for k, (_, t) in enumerate(awkward)] + [(None, None, "xx", "xx"), (2000, "123 !!", "yy", "yy")]
    docs = spark.createDataFrame([x[:3] for x in language_rows + extra], "doc_id long, text string, lang string").withColumn("score", F.lit(2))
    got = {r["doc_id"]: r for r in language.identify(docs).collect()}
    assert len(got) == len(language_rows) + len(extra)
    assert np.mean([got[i]["lang_pred"] == lang for i, _, _, lang in language_rows if got[i]["held_out"]]) > 0.95
    for i, text, *_ in extra:
        unknown = not any(map(str.isalpha, text or ""))
        assert (got[i]["lang_pred"] == "und") == unknown and (got[i]["score"] == 0) == unknown
        assert 0 <= got[i]["score"] <= 1
    nothing = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.identify(nothing).collect()} == {"und"}
    assert language.identify(docs.limit(0)).count() == 0


def test_whole_texts_are_read(spark, language_rows):
    """The language of a text whose beginning is of another one depends on its end."""
    examples = [(lang, t) for _, t, _, lang in language_rows]
    network = language.learn(examples)
    one, other = (" ".join(t for x, t in examples if x == lang) for lang in ("xx", "yy"))
    docs = spark.createDataFrame([(1, one[:2000] + " " + (other * 5)[:20000])], "doc_id long, text string")
    assert language.predict(docs, network).first()["lang_pred"] == "yy"


def test_training_gradient():
    """Each step's gradient is that of the loss (by small differences)."""
    rng = np.random.default_rng(2)
    windows, labels = rng.integers(97, 110, (16, language.WINDOW)).astype(np.uint8), rng.integers(0, 2, 16)
    network = language.ByteNetwork(["a", "b"])
    network.bias += 3
    names = ("embedding", "filters", "bias", "weights", "offset")
    for name in names:
        setattr(network, name, getattr(network, name).astype(np.float64))

    def loss():
        return -network.log_probabilities(windows)[np.arange(16), labels].mean()
    gradients = network.gradients(windows, labels)
    for name in names:
        value, known = getattr(network, name), gradients[name]
        places = [np.unravel_index(k, value.shape) for k in rng.permutation(value.size)[:40]]
        if name == "filters":
            places = [p for p in places if network.open[p]]
        if name == "embedding":
            places = [(int(b), int(e)) for b, e in zip(rng.integers(97, 110, 20), rng.integers(0, language.EMBEDDING, 20))]
        for p in places:
            old, step = value[p], 1e-6
            value[p] = old + step
            above = loss()
            value[p] = old - step
            below = loss()
            value[p] = old
            assert abs((above - below) / (2 * step) - known[p]) < 1e-5, (name, p)
    for name in names:
        setattr(network, name, getattr(network, name).astype(np.float32))
    before = loss()
    network.train(windows, labels, epochs=30, rate=0.01)
    after = -network.log_probabilities(windows)[np.arange(16), labels].mean()
    assert after < before / 3
