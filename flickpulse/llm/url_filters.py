"""URL filters: written rules first, then association rules mined from labels by FP-growth.

A URL is a set of tokens: the parts of its host and each of the host's endings, the words of its path (numbers apart), and
the names of its query. Labelled URLs, with an item for a bad label, go through Spark's FP-growth. Rules "these tokens, so
bad" stay if they reach ``SUPPORT`` (and ``LEAST_URLS`` bad URLs) and ``CONFIDENCE`` and no part of their tokens has as good a rule. They are matched
through an inverted index: each rule is listed under its rarest token only, a distinct URL meets the rules of its tokens,
and what meets is checked to hold all of a rule's tokens.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flickpulse.llm.frames import own, without
from flickpulse.operators.scale import stage

SUPPORT, LEAST_URLS, CONFIDENCE = 0.0005, 10, 0.6
BAD = "label:bad"
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), upper, upper.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def written_rule(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """``verdict`` and ``rule`` (host and path) of the longest rule that fits, else null. A rule fits its host and all
    subdomains if the path starts with the rule's."""
    best = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, on, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # the longest is asked first
        fits = ((host == on) | host.endswith(f".{on}")) & path.startswith(start)
        best = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(on + start).alias("rule"))).otherwise(best)
    return best


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL; none for null or a string without ``://``."""
    host, path = host_of(url), path_of(url)
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    endings = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    words = F.filter(F.split(F.lower(path), r"[^\p{L}]+"), lambda x: x != "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    names = F.filter(F.transform(F.split(query, "&"), lambda x: F.split(x, "=")[0]), lambda x: x != "")
    tagged = [F.transform(F.filter(F.flatten(F.transform(labels, lambda x: F.split(x, "-"))), lambda x: x != ""), lambda x: F.concat(F.lit("host:"), x)),
              F.when(F.size(labels) > 0, F.transform(endings, lambda x: F.concat(F.lit("under:"), x))),
              F.transform(words, lambda x: F.concat(F.lit("path:"), x)),
              F.transform(names, lambda x: F.concat(F.lit("query:"), x))]
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*[F.coalesce(t, none) for t in tagged]))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """``tokens, confidence, support`` of the pruned rules, from ``url, bad``; rows with null ``bad`` are no labels.

    Without labelled URLs, or without any rule that reaches both bounds, there are no rules.
    """
    baskets = stage(labelled.filter("bad is not null").select(
        F.when(F.col("bad"), F.array_append(tokens(F.col("url")), BAD)).otherwise(tokens(F.col("url"))).alias("items")))
    if baskets.filter(F.array_contains("items", BAD)).isEmpty():
        return baskets.select(F.col("items").alias("tokens"), F.lit(0.0).alias("confidence"), F.lit(0.0).alias("support")).limit(0)
    support = min(1.0, max(support, LEAST_URLS / baskets.count()))
    rules = (FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets).associationRules
             .filter(F.col("consequent") == F.array(F.lit(BAD)))
             .select(F.array_sort("antecedent").alias("tokens"), "confidence", "support"))
    rules = stage(rules)
    # a rule that holds all tokens of another, smaller one with as high a confidence says nothing new
    small = rules.select(F.col("tokens").alias("fewer"), F.col("confidence").alias("as_good"))
    wider = (rules.select("tokens", "confidence", F.explode("tokens").alias("token"))
             .join(small.select("fewer", "as_good", F.explode("fewer").alias("token")), "token")
             .filter((F.size("fewer") < F.size("tokens")) & (F.col("as_good") >= F.col("confidence"))
                     & (F.size(F.array_except("fewer", "tokens")) == 0)).select("tokens").distinct())
    return rules.join(wider, "tokens", "left_anti")


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``url, mined_rule, confidence``: the surest rule that each distinct non-null URL holds all tokens of."""
    held = stage(urls.select("url").filter("url is not null").distinct().select("url", tokens(F.col("url")).alias("held")))
    listed = held.select("url", F.explode("held").alias("token"))
    often = listed.groupBy("token").agg(F.count(F.lit(1)).alias("urls"))
    rule = rules.select("tokens", "confidence", F.explode("tokens").alias("token"))
    index = (rule.join(often, "token").groupBy("tokens", "confidence")
             .agg(F.min(F.struct("urls", "token"))["token"].alias("token")))
    met = (held.select("url", "held", F.explode("held").alias("token")).join(index, "token")
           .filter(F.size(F.array_except("tokens", "held")) == 0))
    return met.groupBy("url").agg(F.max(F.struct("confidence", F.array_join("tokens", " ").alias("mined_rule"))).alias("m")).select(
        "url", "m.mined_rule", "m.confidence")


def judge(urls: DataFrame, mined: DataFrame, url_col: str = "url", rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """All rows and columns of ``urls`` with ``host_, path_, rule_, verdict_, mined_rule_``.

    A written rule decides where one fits; else a URL that a mined rule matches is blocked, and any other allowed. Defined
    cases: null and strings without ``://`` have empty host and path, no tokens, and are allowed; repeated rows are judged
    alike; further columns are kept, but replaced where they have the name of a result, ``mined_rule`` or ``url_``. Empty tables give empty
    results.
    """
    urls = without(urls, "host_ path_ rule_ verdict_ mined_rule_ mined_rule url_")
    keyed = urls.withColumn("url_", F.col(url_col))
    found = matches(keyed.select(F.col("url_").alias("url")), mined).withColumnRenamed("url", "url_")
    host, path = host_of(F.col("url_")), path_of(F.col("url_"))
    written = written_rule(host, path, rules)
    return (keyed.join(found.select("url_", "mined_rule"), "url_", "left")
            .select(*own(urls), host.alias("host_"), path.alias("path_"), written["rule"].alias("rule_"),
                    F.coalesce(written["verdict"], F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow")).alias("verdict_"),
                    F.col("mined_rule").alias("mined_rule_")))
