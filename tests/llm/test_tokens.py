import glob
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from packetcheck.llm import packing, token_files
from packetcheck.llm.tokens import WordEncoder
from packetcheck.session import shared_dir

WORD, BYTE = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ODD = [
    "", " ", "\n", "  a  b ", "a\n\nb", "a \n b", "x<|endoftext|> y  <|endoftext|>", "don't we'll 'tis ,'s \"'t", "É è Ωσς Σ",
    "İstanbul H̱ é ́x", "a\tb\r\nc", "\xa0 x\x85y\x1cz", "日本語 テ", "a1b2 3,4.5%", "ÀÉ.!! ñ,,, ...x", "²³ ½a ªº",
    "\U0001f600 a\U0001f600b", "x" * 3000, "'", "' '", "a.'s b!'t", "the. \nthe",
]


@pytest.mark.parametrize("path,keeps_space", [(WORD, False), (BYTE, True)])
def test_word_encoder_equals_the_library(path, keeps_space):
    rnd = random.Random(1)
    alphabet = " \n'.,aAsSt1éÉñ%|<>\t́Σ"
    texts = ODD + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 40))) for _ in range(2000)]
    coder, plain = WordEncoder(path, keeps_space, limit=500), Tokenizer.from_file(path)
    ids, at = coder.encode(pa.array([*texts, None]))
    for k, text in enumerate(texts):
        assert ids[at[k]:at[k + 1]].tolist() == plain.encode(text, add_special_tokens=False).ids, text
    assert at[-1] == at[-2]
    assert len(coder.known) <= 500


def test_packing_is_whole_and_gapless(spark, docs_of, awkward):
    docs = docs_of(awkward)
    plain = Tokenizer.from_file(WORD)
    packed = packing.pack(docs, WORD, with_ids=True)
    rows = packed.collect()
    expected = sorted((str(i), [*plain.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in awkward)
    by_crc = {}
    for r in rows:
        assert zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"]
        assert len(r["ids"]) == r["length"] <= 2048
        by_crc.setdefault((str(r["doc_id"]), r["piece"], r["start"], r["ids_crc32"]), []).append(r)
    wanted = [(i, k, s, zlib.crc32(np.array(ids[s:s + 2048], dtype="<u4").tobytes())) for i, ids in expected for k, s in enumerate(range(0, len(ids), 2048))]
    assert sorted(x for x, many in by_crc.items() for _ in many) == sorted(wanted)
    for own in packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("p")).collect():
        at = 0
        for p in own["p"]:
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048
    ids = {r["sequence_id"]: r["ids"] for r in packing.sequences(packed).collect()}
    for r in rows:
        assert ids[r["sequence_id"]][r["offset"]:r["offset"] + r["length"]] == r["ids"]


def test_best_fit_plan():
    rnd = random.Random(3)
    for capacity in (10, 30, 2048):
        for _ in range(20):
            lengths = [rnd.randint(1, capacity) for _ in range(rnd.randint(0, 400))]
            counts = {x: lengths.count(x) for x in set(lengths)}
            plan = packing.best_fit(counts, capacity)
            assert plan.used == counts
            large = [x for x in lengths if 3 * x > capacity]
            assert plan.sequences >= -(-sum(lengths) // capacity)
            # no worse than twice the bound, and close to it where there are small pieces
            assert plan.sequences <= max(len(large), -(-sum(lengths) * 2 // capacity) + 1)
    assert packing.best_fit({1024: 5}).sequences == 3
    assert packing.best_fit({2000: 3, 48: 3}).sequences == 3
    assert packing.best_fit({1400: 1, 700: 2, 648: 1}).sequences == 2


def test_token_files_round_trip(spark, docs_of, awkward):
    path = shared_dir(spark, "tokens")
    token_files.write(docs_of(awkward), path, BYTE, shards=3)
    plain = Tokenizer.from_file(BYTE)
    rows = sorted(token_files.digests(spark, path).collect(), key=lambda r: r["start"])
    ids = [None if r["doc_id"] is None else r["doc_id"] for r in rows]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    texts = sorted(zlib.crc32(np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4").tobytes()) for _, t in awkward)
    assert sorted(r["ids_crc32"] for r in rows) == texts
    stored = token_files.read(spark, path, "doc_id", "n_tokens")
    assert "ids" not in stored._jdf.queryExecution().executedPlan().toString()


def test_token_files_are_laid_out_as_said(spark, tmp_path):
    """Encodings, row groups and page indexes as the files' footers say, and pages that a filter skips."""
    path = str(tmp_path / "tokens")
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("some words of document"), F.col("id"), F.repeat(F.lit("more "), (F.col("id") % 50).cast("int"))).alias("text"))
    token_files.write(docs, path, BYTE, shards=2)
    files = sorted(glob.glob(f"{path}/*.parquet"))
    assert len(files) == 2
    for file in files:
        footer = pq.ParquetFile(file).metadata
        for g in range(footer.num_row_groups):
            group = footer.row_group(g)
            assert group.total_byte_size <= 40 << 20
            columns = {group.column(c).path_in_schema: group.column(c) for c in range(group.num_columns)}
            for name in ("doc_id", "start", "n_tokens"):
                assert "DELTA_BINARY_PACKED" in columns[name].encodings and not columns[name].has_dictionary_page, name
                assert columns[name].has_column_index and columns[name].has_offset_index
                assert columns[name].statistics.has_min_max
            ids = next(c for name, c in columns.items() if name.startswith("ids"))
            assert ids.has_dictionary_page and "RLE_DICTIONARY" in ids.encodings and ids.compression == "ZSTD"
    one = token_files.read(spark, path, "doc_id", "n_tokens").where("doc_id = 7777")
    assert one.count() == 1 and len(one.collect()) == 1
    plan = one._jdf.queryExecution().executedPlan()
    one._jdf.queryExecution().toRdd().count()
    leaf = plan.collectLeaves().head()
    assert 1 <= leaf.metrics().apply("numOutputRows").value() <= 2_000


def test_empty_tables(spark, docs_of):
    none = docs_of([]).limit(0)
    assert packing.pack(none, WORD).count() == 0
    path = shared_dir(spark, "tokens")
    token_files.write(none, path, BYTE, shards=2)
    assert token_files.digests(spark, path).count() == 0


def test_known_words_are_not_taken_apart_again():
    """Marks behind a known word join its ids; such words come as often as bare ones."""
    coder = WordEncoder(public_tokenizers.path("byte_bpe_50k.json"), keeps_space=True)
    texts = pa.array(["x house tree", "x house, tree. house.. , a\nb. é, 日, house\n, ."])
    first, _ = coder.encode(texts)
    asked = []
    plain = coder.chunk
    coder.chunk = lambda text: asked.append(text) or plain(text)
    again, at = coder.encode(texts)
    assert first.tolist() == again.tolist()
    assert " house," not in asked and " tree." not in asked and " house.." not in asked
    for k, text in enumerate(texts.to_pylist()):
        assert again[at[k]:at[k + 1]].tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids


def test_words_beside_line_feeds_are_looked_up_by_themselves():
    coder = WordEncoder(BYTE, keeps_space=True)
    asked = []
    plain = coder.chunk
    coder.chunk = lambda text: asked.append(text) or plain(text)
    texts = [f"x {a}\n{b}. y\n{b}\n{a}" for a in ("one", "two,", "é") for b in ("Three", "日本", "'s")]
    ids, at = coder.encode(pa.array(texts))
    assert not [x for x in asked if "\n" in x]
    for k, text in enumerate(texts):
        assert ids[at[k]:at[k + 1]].tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids


def test_words_met_again_stay_known():
    coder = WordEncoder(BYTE, keeps_space=True, limit=20)
    learnt = []
    plain = coder.model.tokenize

    class Model:
        def tokenize(self, text):
            learnt.append(text)
            return plain(text)

    coder.model = Model()
    for k in range(12):
        coder.encode(pa.array([f"the house {'a' * (k + 2)} {'b' * (k + 2)} {'c' * (k + 2)} {'d' * (k + 2)}"]))
        assert len(coder.known) <= 20 and len(coder.older) <= 20
    assert learnt.count("Ġhouse") == 1
