"""URL filters by mined association rules.

Explicit rules (host and path prefix) come first; the longest that fits decides.  For
other urls, FP-growth over the tokens of labelled urls gives combinations that go with
bad labels.  A rule needs enough support and confidence, a least number of bad urls, and a
share of them so far above that of all labelled urls that chance does not explain it
(``MIN_DEVIATIONS``).  A rule is left out if a part of its tokens is a rule of at least its
confidence.  Every kept rule is filed under its rarest token; a url looks up its tokens
there and must hold all tokens of a rule.

Defined results: a null url, or one without ``://``, has an empty host and path, fits
no explicit rule and is allowed; repeated rows are judged each; without labelled urls
no rules are mined; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import string
from typing import NamedTuple

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm.tables import stage

MIN_SUPPORT, MIN_CONFIDENCE = 0.005, 0.8
#: Bad urls that a rule needs at least.
MIN_BAD = 10
#: Standard deviations by which they exceed what the share of all urls lets expect.
MIN_DEVIATIONS = 5.0
BAD = "label:bad"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    found = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.coalesce(
        F.translate(found, string.ascii_uppercase, string.ascii_lowercase), F.lit("")
    )


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(url: Column) -> Column:
    """Distinct host labels, path segments and query keys; numbers become ``#``."""
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    lower = F.lower(path(url))
    pieces = F.concat(
        F.transform(F.split(host(url), r"\."), lambda x: F.concat(F.lit("h:"), x)),
        F.transform(F.split(lower, r"[/._-]+"), lambda x: F.concat(F.lit("p:"), x)),
        F.transform(
            F.split(query, "&"), lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1))
        ),
    )
    plain = F.transform(pieces, lambda x: F.regexp_replace(x, r"[0-9]+", "#"))
    return F.array_distinct(F.filter(plain, lambda x: F.length(x) > 2))


def _covered(rules: DataFrame) -> DataFrame:
    """Names of the rules of which a part is a rule of at least their confidence."""
    part = rules.select(
        F.col("rarest").alias("token"), F.col("tokens").alias("part"), F.col("confidence").alias("by_part")
    )
    each = rules.select("rule", "tokens", "confidence", F.explode("tokens").alias("token"))
    held = each.join(part, "token").filter(
        (F.size("part") < F.size("tokens"))
        & (F.col("by_part") >= F.col("confidence"))
        & (F.size(F.array_except("part", "tokens")) == 0)
    )
    return held.select("rule").distinct()


def mine_rules(
    labelled: DataFrame,
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
    min_bad: int = MIN_BAD,
    min_deviations: float = MIN_DEVIATIONS,
) -> DataFrame:
    """Rules from ``tokens`` and ``bad``: rule, tokens, rarest, confidence, support."""
    spark = labelled.sparkSession
    bad = F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))
    baskets = stage(labelled.select(F.concat("tokens", bad).alias("items")), "url_baskets")
    empty = "rule string, tokens array<string>, rarest string, confidence double, support double"
    if baskets.isEmpty():
        return spark.createDataFrame([], empty)
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(
        baskets
    )
    counts = baskets.agg(
        F.count("items").alias("n"), F.count_if(F.array_contains("items", BAD)).alias("n_bad")
    ).first()
    share = counts["n_bad"] / max(counts["n"], 1)
    n_bad = F.round(F.col("support") * counts["n"])
    n_held = F.round(n_bad / F.col("confidence"))
    excess = n_bad - share * n_held
    stands_out = (n_bad >= min_bad) & (
        excess >= min_deviations * F.sqrt(n_held * F.lit(share * (1 - share)))
    )
    rules = model.associationRules.filter(F.col("consequent") == F.array(F.lit(BAD))).filter(stands_out)
    rules = rules.select(F.array_sort("antecedent").alias("tokens"), "confidence", "support")
    rules = stage(rules.withColumn("rule", F.array_join("tokens", " ")), "url_rules")
    single = model.freqItemsets.filter(F.size("items") == 1).select(
        F.col("items")[0].alias("token"), "freq"
    )
    filed = rules.select("rule", F.explode("tokens").alias("token")).join(single, "token")
    rarest = filed.groupBy("rule").agg(F.min(F.struct("freq", "token"))["token"].alias("rarest"))
    index = rules.join(rarest, "rule").select("rule", "tokens", "rarest", "confidence", "support")
    index = stage(index, "url_rule_index")
    return stage(index.join(_covered(index), "rule", "left_anti"), "url_rules_kept")


def matching(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct urls that hold all tokens of a rule, with the most confident rule."""
    tokens = urls.select("url").distinct().withColumn("tokens", url_tokens(F.col("url")))
    each = tokens.select("url", "tokens", F.explode("tokens").alias("rarest"))
    index = rules.select("rarest", "rule", F.col("tokens").alias("needs"), "confidence")
    held = each.join(index, "rarest").filter(F.size(F.array_except("needs", "tokens")) == 0)
    best = F.max(F.struct("confidence", "rule"))
    return held.groupBy("url").agg(best.alias("best")).select(
        "url", F.col("best.rule").alias("mined_rule")
    )


def explicit(rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Name and verdict of the longest explicit rule that fits host and path."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = (F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)
        fits &= F.col("path").startswith(rule.path)
        name = F.when(fits, rule.host + rule.path).otherwise(name)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def filter_urls(
    pages: DataFrame, mined: DataFrame, rules: tuple[Rule, ...], id_col: str = "page_id"
) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict and the mined rule, if any."""
    name, verdict = explicit(rules)
    parts = pages.select(
        id_col, "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path")
    )
    judged = parts.select("*", name.alias("rule"), verdict.alias("by_rule"))
    found = stage(matching(pages, mined), "url_matches")
    return judged.join(found, "url", "left").select(
        id_col,
        "host",
        "path",
        "rule",
        F.coalesce(
            "by_rule", F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow")
        ).alias("verdict"),
        "mined_rule",
    )
