"""Mixing sources to target weights by Sainte-Lague apportionment.

Sources weigh by their place in the order of their names and share a multiple of all words;
no target passes a multiple of its source's words, and what that leaves is shared again by
weight. The mix is made of blocks of equally many words. Blocks are allocated to
the sources by highest quotients target / (2 k - 1), and a source's blocks in the same way to
its shards, by their words: every shard has a whole-numbered quota of blocks. A shard holds the
documents that a seeded hash puts there, one after the other in the order of that hash, cut into
blocks; a quota of several times all blocks takes them all, and what remains is picked evenly spaced
from a seeded start. How many words of a document are taken then follows from its place alone.

Only DataFrame functions are used. No group is unbounded: a source has as many shards as its
words need, and whatever runs over all sources or all shards (order, shares, quotients) is a running sum over
ranges. Of the quotients only those near the last one allocated are formed.

Defined cases: a null text has no words; a null source, or none at all, is a source of its own and the last;
documents without words take nothing; a null doc_id is drawn by its text; rows equal in doc_id and text may be
taken differently, but each within its bound; an empty table gives an empty result;
other columns are not looked at unless ``keep`` names them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from packetcheck.session import stored

SEED = 42
WEIGHTS = (5, 2, 1)
#: Words of the mix, as a share of all words, and of a source, as a multiple of its own.
SHARE, MOST = 1.5, 2
#: Words of a block, and of a shard (one document more at most).
BLOCK, SHARD = 16, 1 << 17
WORD = r"[^\x20\x09-\x0D]+"


def _number(text: Column) -> Column:
    """The first 60 bits of a text's hash."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column], purpose: str) -> DataFrame:
    """``rows`` with, under each name, the sum up to and including the row in that order.

    Rows are dealt out by ranges; sums run within a range and then over the ranges.
    """
    ranged = stored(rows.withColumns(sums).repartitionByRange(*order).withColumn("range", F.spark_partition_id()), purpose)
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("range").agg(*(F.sum(x).alias(x) for x in sums))
    base = totals.select("range", *(F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"{x}_before") for x in sums))
    upto = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = ranged.withColumns({x: F.sum(x).over(upto) for x in sums}).join(base, "range")
    return own.withColumns({x: F.col(x) + F.col(f"{x}_before") for x in sums}).drop("range", *(f"{x}_before" for x in sums))


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sources`` (source, key, words) with the target of each.

    Sources reach their bound in the order of bound by weight, each as long as the
    share that it would have of what is left isn't below its bound.
    """
    placed = running(sources, [F.col("source").asc_nulls_last()], {"place": F.lit(1)}, "sources")
    weight = F.get(F.array(*(F.lit(float(x)) for x in weights)), F.pmod(F.col("place") - 1, F.lit(len(weights))).cast("int"))
    bound = F.col("words") * float(most)
    weighed = placed.select("source", "key", "words", weight.alias("weight"), bound.alias("bound"))
    full = running(weighed, [F.col("bound") / F.col("weight"), F.col("key")], {"bounds": F.col("bound"), "weights": F.col("weight")}, "shares")
    all_words, all_weights = sources.agg(F.sum("words")).first()[0] or 0, weighed.agg(F.sum("weight")).first()[0] or 0.0
    total = F.lit(share * all_words)
    others = F.lit(all_weights) - F.col("weights") + F.col("weight")
    reached = full.withColumn("reached", F.col("bound") * others <= F.col("weight") * (total - F.col("bounds") + F.col("bound")))
    bounds, weighing = reached.where("reached").agg(F.sum("bound"), F.sum("weight")).first()
    left = F.lit(share * all_words - (bounds or 0.0)) / F.lit(max(all_weights - (weighing or 0.0), 1e-300))
    return reached.select("source", "key", "words", F.when(F.col("reached"), F.col("bound")).otherwise(F.col("weight") * left).alias("target"))


def apportion(parts: DataFrame, seats: DataFrame, purpose: str) -> DataFrame:
    """Sainte-Lague: ``parts`` (owner, part, weight) with the ``quota`` each has of its owner's seats.

    ``seats``: owner, seats. The n highest quotients weight / (2 k - 1) of an owner get a seat;
    of equal ones the smaller part. With m parts of weight w in all, quotients from
    w / (n - m/2) / 2 on have a seat in any case and those below w / (n + m/2) / 2 have none, so only the
    2 m or so between are formed and ordered.
    """
    some = parts.where("weight > 0")
    totals = some.groupBy("owner").agg(F.sum("weight").alias("w"), F.count("*").alias("m")).join(seats, "owner").where("seats > 0")
    share = F.col("weight") / F.col("w")
    # a seat to each side for what doubles round
    sure = F.greatest(F.lit(0), F.floor(share * (F.col("seats") - F.col("m") / 2) + 0.5).cast("long") - 1)
    reach = F.floor(share * (F.col("seats") + F.col("m") / 2) + 0.5).cast("long") + 1
    near = stored(some.join(totals, "owner").select("owner", "part", "weight", "seats", sure.alias("sure"), reach.alias("reach")), purpose)
    seat = near.select("owner", "part", "weight", F.explode(F.sequence(F.col("sure") + 1, "reach")).alias("k"))
    seat = seat.withColumn("quotient", F.col("weight") / (2 * F.col("k") - 1))
    placed = stored(running(seat, [F.col("owner"), F.col("quotient").desc(), F.col("part"), F.col("k")], {"place": F.lit(1)}, purpose), purpose)
    first = placed.groupBy("owner").agg((F.min("place") - 1).alias("first"))
    left = near.groupBy("owner").agg((F.max("seats") - F.sum("sure")).alias("left")).join(first, "owner")
    won = placed.join(left, "owner").where(F.col("place") - F.col("first") <= F.col("left")).groupBy("owner", "part").agg(F.count("*").alias("won"))
    quota = near.join(won, ["owner", "part"], "left").select("owner", "part", (F.col("sure") + F.coalesce("won", F.lit(0))).alias("quota"))
    return parts.join(quota, ["owner", "part"], "left").withColumn("quota", F.coalesce("quota", F.lit(0)).cast("long"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK,
        shard: int = SHARD, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken, and where the words lie that are taken.

    Those are ``passes`` (times that the whole row is taken), ``start`` (of the row in its shard) and, of the shard,
    ``blocks``, ``picked`` (of them) and ``phase``; ``kept`` holds the columns named in ``keep``.
    """
    text = F.coalesce("text", F.lit(""))
    name = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    drawn = _number(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(text)))
    kept = F.struct(*(F.col(x) for x in keep)) if keep else F.lit(None).cast("string")
    rows = stored(docs.select(
        "doc_id", name.alias("source"), F.coalesce(F.concat(F.lit("+"), name), F.lit("-")).alias("key"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), drawn.alias("drawn"), kept.alias("kept")), "sizes")
    sources = stored(rows.groupBy("source", "key").agg(F.sum("size").alias("words")), "sources")
    aimed = stored(targets(sources, weights, share, most), "targets")
    aimed = aimed.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("words") / shard)).cast("long"))
    whole = aimed.agg(F.sum("target")).first()[0] or 0.0
    one = F.lit("all")
    seats = aimed.sparkSession.range(1).select(one.alias("owner"), F.lit(round(whole / block)).cast("long").alias("seats"))
    quotas = stored(apportion(aimed.select(one.alias("owner"), F.col("key").alias("part"), F.col("target").alias("weight")), seats, "seats")
                    .select(F.col("part").alias("owner"), F.col("quota").alias("seats")), "quotas")

    dealt = stored(rows.join(aimed.select("key", F.col("words").alias("source_size"), "target", "shards"), "key")
                   .withColumn("shard", F.pmod("drawn", "shards")).drop("shards"), "dealt")
    cells = stored(dealt.groupBy("key", "shard").agg(F.sum("size").alias("words")), "cells")
    given = apportion(cells.select(F.col("key").alias("owner"), F.col("shard").alias("part"), F.col("words").cast("double").alias("weight")), quotas, "shards") \
        .withColumnsRenamed({"owner": "key", "part": "shard"})
    blocks = F.greatest(F.lit(1), F.ceil(F.col("weight") / block).cast("long"))
    phase = F.pmod(_number(F.concat_ws(":", F.lit(seed), "key", "shard")), "blocks")
    given = given.withColumn("blocks", blocks).withColumn("quota", F.least("quota", most * F.col("blocks"))) \
        .select("key", "shard", "blocks", _div(F.col("quota"), F.col("blocks")).alias("passes"), F.pmod("quota", "blocks").alias("picked"), phase.alias("phase"))

    upto = Window.partitionBy("key", "shard").orderBy("drawn", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.withColumn("start", F.sum("size").over(upto) - F.col("size")).join(given, ["key", "shard"])

    def before(position: Column) -> Column:
        """Words picked of those before a position in the shard."""
        at = _div(position, F.lit(block).cast("long"))
        return block * _picked(at) + (position - block * at) * (_picked(at + 1) - _picked(at))

    taken = F.col("passes") * F.col("size") + before(F.col("start") + F.col("size")) - before(F.col("start"))
    return placed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "shard", "start", "passes", "blocks", "picked", "phase", "kept")


def _picked(at: Column) -> Column:
    """Blocks picked of a shard's first ``at``: evenly spaced, from ``phase`` on."""
    return _div(at * F.col("picked") + F.col("phase"), F.col("blocks"))


def pieces(mixed: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix itself, of rows mixed with ``keep=("text",)``: doc_id, copy (from 0), first (word), text.

    A row that is taken as a whole is a piece as it stands; of others each picked block's words are,
    with single spaces between them.
    """
    whole = mixed.where("passes > 0 and size > 0").select(
        "doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes") - 1)).alias("copy"), F.lit(0).cast("long").alias("first"), F.col("kept.text").alias("text"))
    end = F.col("start") + F.col("size")
    numbers = F.sequence(_div(F.col("start"), F.lit(block).cast("long")), _div(end - 1, F.lit(block).cast("long")))
    worded = mixed.where("picked > 0 and size > 0").withColumn("words", F.regexp_extract_all("kept.text", F.lit(WORD), F.lit(0)))

    def piece(x: Column) -> Column:
        low = F.greatest(F.col("start"), block * x) - F.col("start")
        high = F.least(end, block * (x + 1)) - F.col("start")
        return F.struct(low.alias("first"), F.array_join(F.slice("words", (low + 1).cast("int"), (high - low).cast("int")), " ").alias("text"))

    # the pieces are cut before they become rows, so that no row carries all words
    cut = F.transform(F.filter(numbers, lambda x: _picked(x + 1) > _picked(x)), piece)
    parts = worded.select("doc_id", F.col("passes").alias("copy"), F.explode(cut).alias("p")).select("doc_id", "copy", "p.*")
    return whole.unionByName(parts)
