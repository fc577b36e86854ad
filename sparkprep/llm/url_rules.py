"""URL filters by association rules.

Labelled urls become baskets of url tokens plus their label, Spark's FP-growth mines
the frequent combinations, and rules "tokens -> bad" that pass the support and
confidence limits are kept. Rules match by an inverted index: each rule is listed
under its rarest token, a url looks up its tokens, and a listed rule fits if the url
has all its tokens. Given host and path rules are judged first; the longest wins.

A url without ``://`` and a null url have empty host and path, no tokens, and are
allowed. Repeated rows are judged alike. Without labelled urls, as from an empty table, no rule is
mined; an empty table of urls has no verdicts. Of given rules of equal length that fit, the one
of the greater code points wins, then block over allow. Very long urls are read whole. Extra columns
are kept, whatever their names; one that is called like an output is replaced.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkprep.llm import common as c

#: The contract's rules, (verdict, host, path).
GIVEN = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
BAD = "label:bad"


def host_of(url: Column) -> Column:
    return c.ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(url: Column) -> Column:
    """Distinct tokens: host labels, path segments (digits as one token), query keys, a fragment."""

    def tagged(tag: str, parts: Column) -> Column:
        return F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.concat(F.lit(tag), F.regexp_replace(p, "[0-9]+", "0")))

    query = F.coalesce(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), F.lit(""))
    keys = F.transform(F.split(query, "&"), lambda p: F.substring_index(p, "=", 1))
    mark = F.when(F.coalesce(F.contains(url, F.lit("#")), F.lit(False)), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(tagged("host:", F.split(host_of(url), "[.]")), tagged("path:", F.split(path_of(url), "/")), tagged("query:", keys), mark))


def given_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """struct(size, rule, verdict) of the longest given rule that fits, or null. The list is a parameter, so it is an expression."""
    listed = F.array(*[F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"), F.lit(h).alias("h"), F.lit(p).alias("p")) for v, h, p in rules])
    fits = F.filter(listed, lambda r: ((host == r["h"]) | F.endswith(host, F.concat(F.lit("."), r["h"]))) & F.startswith(path, r["p"]))
    return F.array_max(fits)


def mine_rules(labelled: DataFrame, min_support: float = 0.01, min_count: int = 25, min_confidence: float = 0.6) -> DataFrame:
    """(anchor, tokens, confidence, support) from (tokens, bad).

    A rule needs ``min_support`` of the labelled urls and ``min_count`` of them. A rule is
    pruned if another rule of at least its confidence has only tokens of its own, since that
    one fits wherever it does.
    """
    baskets = c.durable(labelled.select(F.when(F.col("bad"), F.concat("tokens", F.array(F.lit(BAD)))).otherwise(F.col("tokens")).alias("items")))
    n = baskets.count()
    if not n:
        return baskets.sparkSession.createDataFrame([], "anchor string, tokens array<string>, confidence double, support double")
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(min_support, min_count / max(1, n))), minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.where(F.col("consequent") == F.array(F.lit(BAD))).select(F.array_sort("antecedent").alias("tokens"), "confidence", "support")
    counts = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    rules = c.durable(rules)
    wide = rules.where(F.size("tokens") > 1).select(F.col("tokens").alias("of"), F.col("confidence").alias("own"), F.explode("tokens").alias("token"))
    held = wide.join(rules.select("tokens", "confidence", F.col("tokens")[0].alias("token")), "token")
    covered = held.where((F.size("tokens") < F.size("of")) & (F.col("confidence") >= F.col("own")) & (F.size(F.array_except("tokens", "of")) == 0)).select(F.col("of").alias("tokens"))
    rules = rules.join(covered, "tokens", "left_anti")
    anchored = rules.select("tokens", "confidence", "support", F.explode("tokens").alias("token")).join(counts, "token")
    return anchored.groupBy("tokens", "confidence", "support").agg(F.min(F.struct("freq", "token")).alias("rarest")).select(F.col("rarest.token").alias("anchor"), "tokens", "confidence", "support")


def match_rules(urls: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """(url, confidence) of the urls that some rule fits, with the best rule's confidence."""
    held = urls.select(F.col(url_col).alias("url"), url_tokens(F.col(url_col)).alias("have")).withColumn("anchor", F.explode("have"))
    fits = held.join(rules, "anchor").where(F.size(F.array_except("tokens", "have")) == 0)
    return fits.groupBy("url").agg(F.max("confidence").alias("confidence"))


def filter_urls(urls: DataFrame, rules: DataFrame, given: tuple[tuple[str, str, str], ...] = (), url_col: str = "url") -> DataFrame:
    """urls with host, path, rule (the given rule that decided, or null), confidence and verdict."""
    sealed = c.Sealed(urls)
    url = sealed[url_col]
    best = match_rules(sealed.df, rules, url).select(F.col("url").alias("_url"), "confidence")
    judged = sealed.df.withColumn("_host", host_of(F.col(url))).withColumn("_path", path_of(F.col(url)))
    judged = judged.withColumn("_given", given_rule(F.col("_host"), F.col("_path"), given) if given else F.lit(None).cast("struct<rule:string,verdict:string>"))
    judged = judged.join(best, F.col(url) == F.col("_url"), "left")
    verdict = F.coalesce(F.col("_given.verdict"), F.when(F.col("confidence").isNotNull(), "block").otherwise("allow"))
    return sealed.reopen(judged, added={"host": F.col("_host"), "path": F.col("_path"), "rule": F.col("_given.rule"), "verdict": verdict, "confidence": F.col("confidence")})


def op3_url_rules(spark, sf_dir: str) -> DataFrame:
    """A page's label is its document's: bad where quality is 0 or toxic is 1."""
    pages = c.read(spark, sf_dir, "pages").select("page_id", "url")
    labels = c.read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    labelled = pages.join(labels.where("bad is not null"), "page_id").select(url_tokens(F.col("url")).alias("tokens"), "bad")
    return filter_urls(pages, mine_rules(labelled), GIVEN).select("page_id", "host", "path", "rule", "verdict", "confidence")
