import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetcheck.llm import embeddings, secrets, url_rules
from packetcheck.llm.queries import URL_RULES


def plain_url(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")


def plain_rule(host, path):
    best = None
    for verdict, rule in URL_RULES:
        own, rest = rule.split("/", 1)
        if (host == own or host.endswith("." + own)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return best


@pytest.fixture(scope="module")
def urls():
    rnd = random.Random(11)
    rows = []
    for i in range(400):
        host = rnd.choice(["a.org", "www.b.org", "ads.c.org", "x.example.com", "www.example.com", "example.com", "d.net", "net", "notexample.com", "example.com:80"])
        path = rnd.choice(["", "/", f"/en/{i}", f"/es/{i}.html", f"/fr/{i}/", f"/shop/cheap/{i}"])
        rows.append((i, rnd.choice(["http", "HTTPS"]) + "://" + host.upper() * (i % 9 == 0) + host * (i % 9 != 0) + path + rnd.choice(["", "?page=2&ref=x", "#top", "?u=http://e.com/en/"])))
    return rows + [(900, None), (901, ""), (902, "no url"), (903, "http://"), (904, "x://com/\n/en"), (904, "x://com/\n/en"), (None, "http://q.net/fr/1")]


def test_urls_equal_brute_force(spark, urls):
    labels = [(i, int(not ("ads" in u or "cheap" in u) or i % 7 == 0), int(i % 50 == 0)) for i, u in urls[:400]] + [(5, None, None), (None, 0, 1)]
    pages = spark.createDataFrame(urls, "page_id long, url string").withColumns({"html": F.lit(""), "host": F.lit("h"), "rule": F.lit("r"), "key": F.lit(0), "tokens": F.lit(0)})
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = url_rules.judge(pages, known, URL_RULES, min_count=8, min_confidence=0.6, deviations=2.0).collect()
    tokens = {r["url"]: r["t"] for r in pages.select("url", url_rules.tokens_of(F.col("url")).alias("t")).collect()}
    bad = {}
    for i, q, t in labels:
        bad[i] = bad.get(i, False) or q == 0 or t == 1
    numbered = {}
    for _, u in urls:
        m = re.search(r"/(\d{1,18})(?=[/.]|$)", plain_url(u)[1])
        numbered[u] = int(m[1]) if m else None
    learned = [(set(tokens[u]), bad[numbered[u]]) for _, u in urls if numbered[u] in bad and numbered[u] is not None and tokens[u]]
    counts = collections.Counter(), collections.Counter()
    for own, is_bad in learned:
        for size in range(1, len(own) + 1):
            for x in itertools.combinations(sorted(own), size):
                counts[0][x] += 1
                counts[1][x] += is_bad
    base = sum(x for _, x in learned) / len(learned)

    def least(share, n, d=2.0):
        return (share + d * d / (2 * n) - d * (share * (1 - share) / n + d * d / (4 * n * n)) ** 0.5) / (1 + d * d / n)
    rules = [set(x) for x, n in counts[1].items() if n >= 8 and n / counts[0][x] >= 0.6 and least(n / counts[0][x], counts[0][x]) > base]
    assert rules
    got = collections.Counter((str(r["page_id"]), r["host"], r["path"], r["rule"], r["verdict"]) for r in rows)
    want = collections.Counter()
    for i, u in urls:
        host, path = plain_url(u)
        fixed = plain_rule(host, path)
        mined = "block" if any(x <= set(tokens[u]) for x in rules) else "allow"
        want[(str(i), host, path, fixed[1] if fixed else None, fixed[0] if fixed else mined)] += 1
    assert got == want
    assert {v for *_, r, v in got if r is None} == {"allow", "block"}


@pytest.mark.parametrize("n", [300, 3000])
def test_planted_urls_are_found_at_every_size(spark, n):
    """With the query's own parameters: one host is bad whatever the table's size, chance makes no rule."""
    rnd = random.Random(n)
    urls, labels = [], []
    for i in range(n):
        planted = i % 100 < 8
        host = "spam.example.org" if planted else rnd.choice(["a.org", "b.org", "www.c.org"])
        urls.append((i, f"http://{host}/{rnd.choice(['en', 'de', 'x'])}/{i}.html{'?ref=1' * (rnd.random() < 0.5)}"))
        labels.append((i, int(rnd.random() > (0.95 if planted else 0.2)), 0))
    pages, known = spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    blocked = {r["page_id"] for r in url_rules.judge(pages, known, URL_RULES).where("verdict = 'block'").collect()}
    assert blocked == {i for i, u in urls if "spam" in u}


def test_urls_without_labels(spark, urls):
    pages = spark.createDataFrame(urls, "page_id long, url string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = url_rules.judge(pages, none, URL_RULES).collect()
    assert len(rows) == len(urls) and {r["verdict"] for r in rows if r["rule"] is None} == {"allow"}
    assert url_rules.judge(pages.limit(0), none, URL_RULES).count() == 0


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end(), m[0]) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), m[0]) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def test_secrets_equal_brute_force(spark, docs_of, awkward):
    rnd = random.Random(12)
    values = ["".join(rnd.choice("0123456789abcdef") for _ in range(n)) for n in (7, 8, 31, 32, 40)] + ["AKIA" + "A1" * k for k in (5, 6, 9)]
    parts = ["é \U0001f600", "token = \"", "API_KEY:", "apikey='", "Passwd=short secret: ", "token=passwd:longvalue99", "AKIAAKIA", "\n", " word ", "secret  :  "]
    rows = awkward + [(100 + i, "".join(rnd.choice(values if rnd.random() < 0.5 else parts) for _ in range(rnd.randint(1, 12)))) for i in range(200)]
    sources = ["a", "a", "a", "b", None]
    docs = docs_of(rows).withColumn("source", F.when(F.col("doc_id") % 5 == 3, "b").when(F.col("doc_id") % 5 == 4, None).otherwise("a"))
    owners, texts = collections.defaultdict(set), collections.defaultdict(set)
    for i, t in rows:
        source = None if i is None else sources[i % 5]
        for x in plain_spans(t):
            owners[x[3]].add(source or f"doc {i}") if i is not None else owners[x[3]].add("a")
            texts[x[3]].add(t)
    assert any(len(owners[x]) > 3 and len(texts[x]) > 10 for x in owners)
    names = ["assign", "access", "hex", "live"]

    def listed(spans):
        return ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)
    want = []
    for i, t in rows:
        base = [x[:3] for x in plain_spans(t)]
        added = {(a, 3, b) for a, _, b, v in plain_spans(t) if len(owners[v]) <= 3 or len(texts[v]) <= 10}
        n = [sum(x[1] == k for x in base) for k in range(3)]
        want.append((str(i), *n, hashlib.sha256(listed(base).encode()).hexdigest(), listed(sorted([*base, *added]))))
    got = [(str(r["doc_id"]), r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"], r["spans"]) for r in secrets.report(secrets.scan(docs)).collect()]
    assert sorted(got) == sorted(want)
    assert any("live" in x[-1] for x in got) and any(x[1] and "live" not in x[-1] for x in got)
    clean = {str(r["doc_id"]): r["text"] for r in secrets.redact(docs).where("doc_id >= 100").collect()}
    for i, t in rows:
        live = [v for *_, v in plain_spans(t) if len(owners[v]) <= 3 or len(texts[v]) <= 10]
        if i and i >= 100:
            assert ("[SECRET]" in clean[str(i)]) == bool(live) and not any(v in clean[str(i)] for v in live)
    assert secrets.redact(docs).columns == docs.columns and secrets.redact(docs).count() == len(rows)
    assert secrets.report(secrets.scan(docs.drop("source"))).count() == len(rows)
    assert secrets.report(secrets.scan(docs.limit(0))).count() == 0


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(13)
    centers = rng.normal(0, 1, (12, 16))
    rows = []
    for i in range(300):
        v = centers[i % 12] + rng.normal(0, rng.choice([0.01, 0.1, 0.15, 0.5]), 16)
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(i % 4)))
    rows += [(300 + k, list(rows[5][1]), 1) for k in range(20)] + [(400, [0.0] * 16, 1), (401, None, 1), (402, [], 1), (403, [1.0, None], 1), (404, [float("nan")] * 16, 1)]
    rows += [(405, rows[5][1], None), (406, [1.0, 2.0], 1), (407, [2.0, 4.0], 1), (408, [float("inf")] + [0.0] * 15, 1), (None, rows[5][1], 1), (407, [2.0, 4.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"v": F.lit(1), "node": F.lit(2), "n": F.lit(3), "mine": F.lit(4)})
    fine = [r[2] is not None and bool(r[1]) and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]

    def near(i, j):
        if not (fine[i] and fine[j]) or rows[i][2] != rows[j][2] or len(rows[i][1]) != len(rows[j][1]):
            return False
        a, b = np.array(rows[i][1]), np.array(rows[j][1])
        return a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98
    links = [[j for j in range(len(rows)) if j != i and near(i, j)] for i in range(len(rows))]
    root = list(range(len(rows)))
    for _ in range(len(rows)):
        new = [min([root[i], *(root[j] for j in links[i])]) for i in range(len(rows))]
        if new == root:
            break
        root = new
    least = {}
    for i, r in enumerate(root):
        least[r] = min([x for x in (least.get(r), rows[i][0]) if x is not None], default=None)
    want = collections.Counter((rows[i][0], len(links[i]), least[root[i]], True if least[root[i]] is None else rows[i][0] == least[root[i]] if rows[i][0] is not None else None) for i in range(len(rows)))
    for block in (8192, 7):
        got = collections.Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"] if r["vec_id"] is not None else None) for r in embeddings.link(df, block=block).collect())
        assert got == want
    assert embeddings.link(df.limit(0)).count() == 0


def test_bounds_skip_most_pairs_and_miss_none():
    rng = np.random.default_rng(14)
    v = rng.normal(0, 1, (900, 64))
    v[450:] = v[:450] + rng.normal(0, 0.12, (450, 64))
    linked, forest, exact = embeddings.link_block(v, np.ones(900, dtype=np.int64), None, 0.98, tile=128)
    u = v / np.linalg.norm(v, axis=1)[:, None]
    assert linked.tolist() == ((u @ u.T >= 0.98).sum(axis=1) - 1).tolist()
    assert exact < 2000


def test_examples_have_many_texts_and_owners(spark, docs_of):
    """A value that few owners or few different texts have is live; copies of a text count once."""
    import corpus_pipeline

    value = {x: "AKIA" + x * 16 for x in "ABCD"}
    rows = [(i, f"key {value['A']} copied") for i in range(30)]
    rows += [(100 + i, f"own {i} {value['B']} text") for i in range(2)]
    rows += [(200 + i, f"own {i} {value['C']} text") for i in range(30)]
    rows += [(301 + 4 * i, f"own {i} {value['D']} text") for i in range(30)]
    docs = docs_of(rows).withColumn("source", (F.col("doc_id") % 4).cast("string"))
    clean = {r["doc_id"]: r["text"] for r in corpus_pipeline.hide_secrets(spark, docs, "").collect()}
    assert {i for i, t in clean.items() if "[SECRET]" not in t} == set(range(200, 230))
    spans = {r["doc_id"]: r["spans"] for r in secrets.report(secrets.scan(docs)).collect()}
    assert {i for i, x in spans.items() if "live" not in x} == set(range(200, 230))
    counts = {(r["texts"], r["owners"]) for r in secrets.ownership(secrets.found(docs)).collect()}
    assert counts == {(1, 4), (2, 2), (30, 4), (30, 1)}
