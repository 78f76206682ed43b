"""Secrets in texts, and which of them look live by who owns them.

Three kinds of spans are found by pattern: assigned values, access keys, long
hexadecimal strings. Each value is then looked up over the whole corpus: the
distinct texts (repositories; exact copies count once) and sources (owners) that have it. A
value that more than a given number of both have is a copied example; any other looks
live, also if one text is copied many times.
Live values add a span of kind ``live``; the spans found by pattern all stay.

Positions are code points, ends exclusive. Only DataFrame functions are used: the pieces
between matches and the matches themselves give the positions as running sums.

Defined cases: a null text is empty; a null source is an owner of its own for each
document; rows equal in doc_id and text share their live spans; an empty table gives
an empty result; other columns are not looked at (``source`` may be absent).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetcheck.llm.common import as_row
from packetcheck.session import stored

#: Kind, pattern, group that is the value, and the value's least length.
KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
LIVE = "live"
#: A copied example has more owners and more different texts than these.
OWNERS = 3
TEXTS = 10

_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _spans(text: Column, matches: Column, kind: int) -> Column:
    """Spans of one kind that keep their least length; ``matches`` are all matches."""
    _, pattern, group, least = KINDS[kind]
    pieces = F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    rows = F.zip_with(F.slice(pieces, 1, F.size(matches)), F.arrays_zip(matches.alias("m"), values.alias("v")),
                      lambda piece, x: F.struct(F.length(piece).alias("gap"), F.length(x["m"]).alias("size"), x["v"].alias("v")))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["size"]
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["v"].alias("value"))
        return F.struct(end.alias("at"), F.when(F.length(x["v"]) >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    none = F.array().cast(_SPAN)
    return F.when(F.size(matches) > 0, F.aggregate(rows, F.struct(F.lit(0).alias("at"), none.alias("out")), add)["out"]).otherwise(none)


def _listed(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    names = F.array(*(F.lit(x[0]) for x in KINDS), F.lit(LIVE))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def found(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, key (hash of the text), owner, and its spans by pattern."""
    text = F.coalesce("text", F.lit(""))
    owner = F.concat(F.lit("doc "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    if "source" in docs.columns:
        owner = F.coalesce(F.concat(F.lit("source "), F.col("source").cast("string")), owner)
    rows = docs.select("doc_id", text.alias("text"), owner.alias("owner"))
    rows = rows.select("*", *(F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(name) for name, p, _, _ in KINDS))
    spans = [_spans(F.col("text"), F.col(name), k) for k, (name, *_) in enumerate(KINDS)]
    return rows.select("doc_id", F.xxhash64("text").alias("key"), "owner", F.array_sort(F.concat(*spans)).alias("spans"))


def ownership(rows: DataFrame) -> DataFrame:
    """Per value: its hash, in how many different texts and with how many owners it is.

    Values are made distinct by text and by owner before they are counted, so the rows of
    a very common value are combined where they are and spread over both.
    """
    each = rows.select("key", "owner", F.explode("spans.value").alias("value")).select(F.sha2("value", 256).alias("value"), "owner", "key")
    return each.groupBy("value").agg(F.count_distinct("key").alias("texts"), F.count_distinct("owner").alias("owners"))


def scan(docs: DataFrame, owners: int = OWNERS, texts: int = TEXTS) -> DataFrame:
    """Per document: doc_id, key, spans by pattern, and ``all_spans`` with the live ones:
    values that no more than ``owners`` owners or no more than ``texts`` texts have."""
    rows = stored(found(docs), "spans")
    live = ownership(rows).where((F.col("owners") <= owners) | (F.col("texts") <= texts)).select("value")
    each = rows.where(F.size("spans") > 0).select("doc_id", "key", F.explode("spans").alias("s"))
    each = each.withColumn("value", F.sha2("s.value", 256)).join(live, "value", "left_semi")
    span = F.struct(F.col("s.start").alias("start"), F.lit(len(KINDS)).alias("kind"), F.col("s.end").alias("end"), F.col("s.value").alias("value"))
    added = each.groupBy(F.col("doc_id").alias("own_id"), F.col("key").alias("own_key")).agg(F.collect_set(span).alias("added"))
    joined = rows.join(added, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("key") == F.col("own_key")), "left")
    return joined.select("doc_id", "key", "spans", F.array_sort(F.concat("spans", F.coalesce("added", F.array().cast(_SPAN)))).alias("all_spans"))


def report(scanned: DataFrame) -> DataFrame:
    """Counts per kind and the spans as text."""
    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")

    return scanned.select("doc_id", *(count(k).alias("n_" + name) for k, (name, *_) in enumerate(KINDS)),
                          F.sha2(_listed(F.col("spans")), 256).alias("base_sha256"), _listed(F.col("all_spans")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]", owners: int = OWNERS, texts: int = TEXTS) -> DataFrame:
    """The documents with live values replaced; texts without one stay as they are.

    A value is a plain string of at least eight characters, replaced wherever it stands
    in its document.
    """
    live = scan(docs, owners, texts).where(F.size("all_spans") > F.size("spans"))
    values = live.select("doc_id", "key", F.array_distinct(F.transform(
        F.filter("all_spans", lambda x: x["kind"] == len(KINDS)), lambda x: x["value"])).alias("values"))
    # longest first, so that a value inside another is not cut out of it
    longest = F.array_sort(F.col("values"), lambda a, b: F.length(b) - F.length(a))
    values = values.groupBy(F.col("doc_id").alias("own_id"), F.col("key").alias("own_key")).agg(F.first(longest).alias("values"))
    # the documents' columns stay in a struct, so their names meet no others
    keyed = docs.select(as_row(docs), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))
    joined = keyed.join(values, F.col("row.doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_key") == F.col("own_key")), "left")
    text = F.col("row.text")
    clean = F.when(F.col("values").isNull(), text).otherwise(F.aggregate("values", text, lambda t, v: F.replace(t, v, F.lit(mark))))
    return joined.select(F.col("row").withField("text", clean).alias("row")).select("row.*")
