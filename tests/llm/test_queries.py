"""Every registered query over the small tables; those with SQL against it."""

import collections
import re

import public_tokenizers
import pytest
from checking import check_connection, compare_query

from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from packetcheck.llm.queries import CHECKS, QUERIES
from packetcheck.session import stored

SF = "/root/testdata/sf0.001"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def test_one_query_per_operator():
    assert sorted(int(x[2:].split("_")[0]) for x in QUERIES) == list(range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(entry.queries())
    assert set(CHECKS) <= set(entry.oracle_sql())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(CHECKS))
def test_queries_equal_their_sql(spark, name, sf):
    at = f"/root/testdata/{sf}"
    assert compare_query(spark, check_connection(at), QUERIES[name], CHECKS[name], at) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(CHECKS)))
def test_queries_return_all_rows(spark, name):
    key, table = {"op7": ("page_id", "pages"), "op12": ("vec_id", "embeddings")}.get(name.split("_")[0], ("doc_id", "documents"))
    found = QUERIES[name](spark, SF).select(key).distinct().count()
    assert found == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_pipeline(spark):
    """Each stage on what the one before left; what is dropped is what the operator says."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), "test")
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert docs.columns == columns
            counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[0] > counts[1] > counts[2] >= counts[3] == counts[4] > 0
    pieces = docs.select("doc_id").distinct().count()
    assert pieces == counts[-1]
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def plain_components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(x) for x in range(n)]


def test_pipeline_stages_equal_plain_ones(spark):
    """Each stage over what the one before left, against plain Python."""
    SF = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good, copies, leaks, hidden, packed = (stage for _, stage in corpus_pipeline.STAGES)

    def rows(df):
        return {r["doc_id"]: r["text"] or "" for r in df.select("doc_id", "text").collect()}

    # documents that the classifier predicts good
    kept = stored(good(spark, docs, SF), "test")
    predicted = QUERIES["op6_quality_classifier"](spark, SF).where("predicted = 1").select("doc_id").collect()
    assert set(rows(kept)) == {r["doc_id"] for r in predicted}
    # of texts with 0.8 of their distinct five-word shingles in common the smallest number
    before = rows(kept)
    ids = sorted(before)
    sets = []
    for i in ids:
        words = before[i].encode().lower().split()
        sets.append({b" ".join(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    links = [(a, b) for a in range(len(ids)) for b in range(a)
             if min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])) - 1e-9 and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    root = plain_components(len(ids), links)
    kept = stored(copies(spark, kept, SF), "test")
    assert set(rows(kept)) == {ids[x] for x in set(root)} and len(set(root)) < len(ids)
    # no benchmark passage: 16 of 20 tokens in their places, or of a shorter item 0.8
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    tokenized = [re.findall(r"\w+", (x or "").lower()) for x in items]
    before, clean = rows(kept), set()
    for i, text in before.items():
        own, found = re.findall(r"\w+", text.lower()), False
        places = {}
        for k, w in enumerate(own):
            places.setdefault(w, []).append(k)
        for item in tokenized:
            width = min(20, len(item))
            begins = collections.Counter(k - at for at, w in enumerate(item) for k in places.get(w, []))
            for begin, equal in begins.items():
                if equal < 0.8 * width - 1e-9:
                    continue
                same = [0 <= begin + k < len(own) and own[begin + k] == w for k, w in enumerate(item)]
                inside = [0 <= begin + k < len(own) for k in range(len(item))]
                found |= any(all(inside[k:k + width]) and sum(same[k:k + width]) >= 0.8 * width - 1e-9 for k in range(len(item) - width + 1))
        if not found:
            clean.add(i)
    kept = stored(leaks(spark, kept, SF), "test")
    assert set(rows(kept)) == clean and len(clean) < len(before)
    # values of few owners or few texts are replaced wherever they stand
    source = {r["doc_id"]: r["source"] for r in kept.select("doc_id", "source").collect()}
    before, owners, texts, held = rows(kept), collections.defaultdict(set), collections.defaultdict(set), {}
    for i, text in before.items():
        own = [m[2] for m in re.finditer(ASSIGN, text) if len(m[2]) >= 8]
        own += [m[0] for p, n in (("AKIA[A-Z0-9]+", 16), ("[0-9a-f]+", 32)) for m in re.finditer(p, text) if len(m[0]) >= n]
        held[i] = own
        for v in own:
            owners[v].add(source[i])
            texts[v].add(text)
    want = dict(before)
    for i, own in held.items():
        live = {v for v in own if len(owners[v]) <= 3 or len(texts[v]) <= 10}
        for v in sorted(live, key=lambda v: -len(v)):
            want[i] = want[i].replace(v, "[SECRET]")
    kept = stored(hidden(spark, kept, SF), "test")
    assert rows(kept) == want and want != before
    # every piece of at most 2048 ids has a place of its own in a sequence
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sizes = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in want.items()}
    found, sequences = collections.Counter(), collections.defaultdict(list)
    for r in packed(spark, kept, SF).collect():
        found[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert found == sizes
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), (None, "a text without an id", "en", None, 3), (2, "", "de", "s", 0), (2, "", "de", "s", 0)]])
def test_pipeline_of_awkward_tables(spark, tmp_path, rows):
    at = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    kept = corpus_pipeline.run(spark, at).collect()
    assert all(r["length"] >= 1 for r in kept) and len(kept) <= len(rows)
    assert bool(kept) == bool(rows)
