"""URL verdicts: fixed rules first, then association rules mined from labels.

A url's tokens are its host labels, path segments, file extension, query keys
and the presence of a fragment (segments of digits only are left out). Spark's
FP-growth finds the token combinations that are frequent among the labelled urls;
those that enough bad urls hold, and whose urls are bad beyond what chance makes of the share of
bad urls, become rules. A rule is filed under its rarest token, so that a url meets only rules
that share that token with it.

Everything is DataFrame operations and Spark's own FP-growth. Defined cases: a null url
or one without ``://`` has an empty host and path, no token, and is allowed unless
labelled rules say otherwise (none can); a label is bad if any row of its doc_id says
so; without labelled urls nothing is mined; repeated page_ids get a row each; an
empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetcheck.session import stored

ALLOW, BLOCK = "allow", "block"
#: Bad urls that hold a rule's tokens, whatever the table's size.
MIN_COUNT = 5
MIN_CONFIDENCE = 0.5
#: So many deviations below the confidence it still has to be above the share of bad urls.
DEVIATIONS = 4.0
_BAD = "=block"
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?(#)?"


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, k)


def host_of(url: Column) -> Column:
    return F.translate(_part(url, 1), _CAPITALS, _SMALL)


def path_of(url: Column) -> Column:
    return _part(url, 2)


def tokens_of(url: Column) -> Column:
    """The tokens of a url, each with its kind before it."""
    path = F.lower(path_of(url))

    def marked(mark: str, values: Column) -> Column:
        return F.transform(F.filter(values, lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))

    segments = F.transform(F.split(path, "/"), lambda x: F.regexp_replace(x, r"\.[a-z0-9]+$", ""))
    keys = F.transform(F.split(F.lower(_part(url, 3)), "&"), lambda x: F.regexp_extract(x, r"^([^=]*)", 1))
    return F.array_distinct(F.concat(
        marked("host ", F.split(host_of(url), r"\.")), marked("path ", F.filter(segments, lambda x: ~x.rlike(r"^\d*$"))),
        marked("file ", F.array(F.regexp_extract(path, r"\.([a-z0-9]+)$", 1))), marked("key ", keys), marked("mark ", F.array(_part(url, 4)))))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest of the (verdict, host/path) rules that fits, as a struct of rule and
    verdict; null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda x: len(x[1])):
        own, _, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def lower_bound(share: Column, n: Column, deviations: float) -> Column:
    """What a share of n draws is at least, by Wilson's interval."""
    d2 = deviations * deviations
    return (share + d2 / (2 * n) - deviations * F.sqrt(share * (1 - share) / n + d2 / (4 * n * n))) / (1 + d2 / n)


def mine(labelled: DataFrame, min_count: int = MIN_COUNT, min_confidence: float = MIN_CONFIDENCE, deviations: float = DEVIATIONS) -> DataFrame:
    """Block rules (tokens, n, n_bad) from rows of tokens and bad.

    Of the labelled urls n hold a rule's tokens, and n_bad of those are bad.
    """
    items = F.when(F.col("bad"), F.concat("tokens", F.array(F.lit(_BAD)))).otherwise(F.col("tokens"))
    rows = stored(labelled.where(F.size("tokens") > 0).select(items.alias("items"), "bad"), "labelled")
    total, bad = rows.agg(F.count("*"), F.count_if("bad")).first()
    if bad < min_count:
        return labelled.sparkSession.createDataFrame([], "tokens array<string>, n long, n_bad long")
    # the count needed is this support rounded up
    model = FPGrowth(itemsCol="items", minSupport=(min_count - 0.5) / total, minConfidence=min_confidence).fit(rows)
    found = model.associationRules.where(F.col("consequent")[0] == _BAD)
    n_bad = F.round(F.col("support") * total).cast("long")
    counted = found.select(F.array_sort("antecedent").alias("tokens"), F.round(n_bad / F.col("confidence")).cast("long").alias("n"), n_bad.alias("n_bad"))
    return counted.where(lower_bound(F.col("n_bad") / F.col("n"), F.col("n"), deviations) > bad / total)


def matches(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Keys (column ``key``) of the rows of key and tokens that have all tokens of a rule."""
    # how often a token stands in rules' urls isn't known to the rules, so count it here
    often = pages.select(F.explode("tokens").alias("token")).groupBy("token").count()
    ranked = rules.withColumn("rule", F.xxhash64("tokens")).select("rule", "tokens", F.explode("tokens").alias("token")).join(often, "token")
    filed = ranked.groupBy("rule").agg(F.min_by("token", F.struct("count", "token")).alias("token"), F.first("tokens").alias("needed"))
    # one row a token, so that a page meets it once however many rules are filed there
    index = filed.groupBy("token").agg(F.collect_list("needed").alias("rules"))
    met = pages.select("key", "tokens", F.explode("tokens").alias("token")).join(index, "token")
    return met.where(F.exists("rules", lambda x: F.size(F.array_except(x, F.col("tokens"))) == 0)).select("key").distinct()


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]], min_count: int = MIN_COUNT,
          min_confidence: float = MIN_CONFIDENCE, deviations: float = DEVIATIONS) -> DataFrame:
    """page_id, host, path, rule, verdict for every page.

    A page is labelled by the document its url numbers (the first segment of digits):
    bad is low quality or toxic.
    """
    url = F.col("url")
    rows = pages.select("page_id", "url")
    different = stored(rows.where("url is not null").select("url").distinct().select(
        F.col("url").alias("key"), tokens_of(url).alias("tokens"),
        F.regexp_extract(path_of(url), r"/(\d{1,18})(?=[/.]|$)", 1).try_cast("long").alias("doc_id")), "urls")
    known = labels.groupBy("doc_id").agg(F.max((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("bad"))
    numbered = rows.join(different.select(F.col("key").alias("url"), "tokens", "doc_id"), "url")
    mined = stored(mine(numbered.join(known, "doc_id").select("tokens", "bad"), min_count, min_confidence, deviations), "mined")
    blocked = matches(different, mined).select(F.col("key").alias("url"), F.lit(BLOCK).alias("mined"))
    fixed = longest_rule(F.col("host"), F.col("path"), rules)
    return rows.join(blocked, "url", "left").select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), "mined") \
        .withColumn("fixed", fixed) \
        .select("page_id", "host", "path", F.col("fixed.rule").alias("rule"), F.coalesce("fixed.verdict", "mined", F.lit(ALLOW)).alias("verdict"))
