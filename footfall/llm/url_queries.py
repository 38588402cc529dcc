"""op8: verdicts on the urls of all pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from footfall.llm.tables import table
from footfall.llm.url_filter import Rule, filter_urls, mine_rules, path, url_tokens

RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def labelled_urls(spark, sf_dir):
    """Urls whose number names a labelled document; bad: of low quality, or toxic."""
    number = F.regexp_extract(path(F.col("url")), r"/([0-9]{1,18})(?:[^0-9].*)?$", 1)
    pages = table(spark, sf_dir, "pages").select(
        url_tokens(F.col("url")).alias("tokens"), number.try_cast("long").alias("doc_id")
    )
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(
        F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad")
    )
    return pages.join(labels, "doc_id").select("tokens", F.coalesce("bad", F.lit(False)).alias("bad"))


def op8_url_filter(spark, sf_dir):
    mined = mine_rules(labelled_urls(spark, sf_dir))
    return filter_urls(table(spark, sf_dir, "pages"), mined, RULES)


QUERIES = {"op8_url_filter": op8_url_filter}

ORACLES: dict[str, str] = {}
