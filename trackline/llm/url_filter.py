"""URL verdicts from host and path rules, and from mined token associations where no rule fits.

Rules first: a rule fits its host and all subdomains if the url's path starts with the rule's; the longest wins.

Association rules: each labelled page is a transaction of its url's tokens and, if its label is bad (low quality or
toxic), a label item. FP-growth finds the frequent combinations; those with the label whose confidence is high enough
block. A rule stands in an inverted index under its rarest token, so a url meets only the rules of its own tokens.

Null urls and urls without ``://`` have an empty host and path, no tokens and the verdict ``allow``. Equal urls share
one verdict; each input row gets one row. Labels of a page are those of the document with its id; of several labels any
bad one counts. With no labels nothing is mined. Urls of any length are taken whole. An empty table gives no rows. Only
page_id and url are read, so columns of other names cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BAD = "label:bad"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Mining:
    min_support: float = 0.002  # share of labelled urls that hold the combination and the label
    min_texts: int = 5  # and their least number
    min_confidence: float = 0.6
    max_length: int = 4  # tokens of a rule


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest (verdict, rule) that fits; null if none does."""
    fits = []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), -len(r[1].split("/")[0]), r[1])):
        name, slash, tail = rule.partition("/")
        test = (host == name) | host.endswith("." + name)
        if slash:
            test &= path.startswith("/" + tail)
        fits.append(F.when(test, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def tokens_of(url: Column) -> Column:
    """Distinct tokens: host labels, path pieces (digits as their number), file ending, query keys, fragment."""
    host, path = host_of(url), path_of(url)
    named = lambda kind, values: F.transform(values, lambda v: F.concat(F.lit(kind + ":"), v))
    pieces = F.transform(F.split(path, "/"), lambda v: F.when(F.regexp_like(v, F.lit(r"^[0-9]+(\.[a-z]+)?$")), F.lit("0")).otherwise(F.lower(v)))
    query = F.regexp_extract_all(F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1), F.lit(r"(?:^|&)([^=&]+)"), F.lit(1))
    ending = F.array(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1))
    fragment = F.array(F.regexp_extract(_rest(url), r"#(.*)$", 1))
    every = F.concat(named("host", F.split(host, r"\.")), named("path", pieces), named("key", query), named("end", ending), named("frag", fragment))
    return F.coalesce(F.array_distinct(F.filter(every, lambda t: ~t.endswith(":"))), F.array().cast("array<string>"))


def mine(pages: DataFrame, labels: DataFrame, how: Mining = Mining()) -> DataFrame:
    """``items, confidence, support, anchor``: token combinations that mark bad pages, and each one's rarest token."""
    spark = pages.sparkSession
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    judged = labels.filter(F.col("quality").isNotNull() | F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max(bad.cast("int")).alias("bad"))
    urls = pages.select(F.col("page_id").alias("doc_id"), tokens_of(F.col("url")).alias("items")).filter(F.size("items") > 0)
    baskets = urls.join(judged, "doc_id").select(F.when(F.col("bad") == 1, F.concat("items", F.array(F.lit(BAD)))).otherwise(F.col("items")).alias("items"))
    n = baskets.count()
    if n == 0:
        return spark.createDataFrame([], "items array<string>, confidence double, support long, anchor string")
    least = min(1.0, max(how.min_support, how.min_texts / n))
    frequent = FPGrowth(itemsCol="items", minSupport=least).fit(baskets).freqItemsets.select(F.array_sort("items").alias("items"), "freq")
    frequent = frequent.filter(F.size("items") <= how.max_length + 1).persist()
    with_label = frequent.filter(F.array_contains("items", BAD) & (F.size("items") > 1)).select(F.array_remove("items", BAD).alias("items"), F.col("freq").alias("support"))
    rules = with_label.join(frequent, "items").select("items", "support", (F.col("support") / F.col("freq")).alias("confidence")).filter(F.col("confidence") >= how.min_confidence)
    single = frequent.filter(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    anchors = rules.select("items", F.explode("items").alias("token")).join(single, "token").groupBy("items").agg(F.min_by("token", F.struct("freq", "token")).alias("anchor"))
    return rules.join(anchors, "items").select("items", "confidence", "support", "anchor")


def mined_verdicts(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``url, confidence`` of the urls that some mined rule fits."""
    urls = pages.filter(F.col("url").isNotNull()).select("url").distinct().withColumn("own", tokens_of(F.col("url")))
    met = urls.withColumn("anchor", F.explode("own")).join(rules.groupBy("anchor").agg(F.collect_set(F.struct("items", "confidence")).alias("rules")), "anchor")
    fitting = F.filter("rules", lambda r: F.size(F.array_except(r["items"], F.col("own"))) == 0)
    best = F.array_max(F.transform(fitting, lambda r: r["confidence"]))
    return met.select("url", best.alias("confidence")).filter(F.col("confidence").isNotNull()).groupBy("url").agg(F.max("confidence").alias("confidence"))


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]], how: Mining = Mining()) -> DataFrame:
    """One row per page row: page_id, host, path, rule, verdict, and the confidence of the mined rule if one fits."""
    pages = pages.select("page_id", "url")
    mined = mined_verdicts(pages, mine(pages, labels, how))
    url = F.coalesce("url", F.lit(""))
    fit = rule_for(F.col("host"), F.col("path"), rules)
    return (
        pages.join(mined, "url", "left")
        .select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), "confidence")
        .withColumn("fit", fit)
        .select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.verdict"), F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "confidence")
    )
