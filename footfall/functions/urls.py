"""URL, referrer and campaign-tag columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from footfall.config import DEFAULT, Config

# --- Fixed values -----------------------------------------------------------
# Patterns that must equal the reference's for equal results.
DOMAIN = r"^(?:\w+://)?(?:[^:/?]+\.)*([^:/?]+\.[^:/?]+)"
HOST = r"https?://([^/?#]+)"
UTM_FIELDS = ("source", "medium", "campaign", "content", "term", "id")
CAMPAIGN_TAGS = "utm_[a-z]+"
QUERY_LEFT_EMPTY = r"(\?$|\?&)"
QUERY_BEFORE_FRAGMENT = r"\?#"
# ----------------------------------------------------------------------------


def extract(text: Column, pattern: str) -> Column:
    """First capture group, or NULL where the pattern does not match."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def domain(url: Column) -> Column:
    """Last two dot-separated labels of the host."""
    return extract(url, DOMAIN)


def host(url: Column) -> Column:
    """Host with port."""
    return extract(url, HOST)


def is_pageview(event_name: Column, url: Column, cfg: Config = DEFAULT) -> Column:
    """A pageview event or, if enabled, a backend request for a page."""
    explicit = event_name == "pageview"
    if not cfg.request_pageviews:
        return explicit
    return explicit | ((event_name == "text/html") & url.rlike(cfg.request_pageview_pattern))


def is_ext_referrer(referrer: Column, url: Column, cfg: Config = DEFAULT) -> Column:
    """The referrer is on another domain and is not one of our own services."""
    elsewhere = domain(referrer) != domain(url)
    return F.coalesce(
        referrer.isNotNull() & elsewhere & ~referrer.rlike(f"({cfg.internal_referrers})"),
        F.lit(False),
    )


def click_id(url: Column, cfg: Config = DEFAULT) -> Column:
    """First ad click id, as struct<parameter, value>; NULL without one.

    ``parameter`` is the first one present, ``value`` the first non-empty one,
    so the two can disagree when the first is empty.
    """
    names = cfg.click_id_pattern
    # A plain text search is far cheaper than a pattern that will not match.
    return F.when(
        url.contains("=") & url.rlike(f"({names})=([^&#]+)"),
        F.struct(
            extract(url, f"({names})=").alias("parameter"),
            extract(url, f"(?:{names})=([^&#]+)").alias("value"),
        ),
    )


def utm(url: Column) -> Column:
    """Campaign tags as struct<source, medium, campaign, content, term, id>."""
    names = "|".join(f"utm_{f}" for f in UTM_FIELDS)
    return F.when(
        url.contains("utm_") & url.rlike(f"({names})=([^&#]+)"),
        F.struct(*[extract(url, f"utm_{f}=([^&#]+)").alias(f) for f in UTM_FIELDS]),
    )


def page_location(url: Column, cfg: Config = DEFAULT) -> Column:
    """The url without host, campaign tags and click ids; other parameters stay."""
    tags = f"({CAMPAIGN_TAGS}|{cfg.click_id_pattern})=[^&#]*&?"
    path = F.regexp_replace(url, cfg.page_cleanup, "")
    out = path
    for pattern, replacement in ((tags, ""), (QUERY_LEFT_EMPTY, ""), (QUERY_BEFORE_FRAGMENT, "#")):
        out = F.regexp_replace(out, pattern, replacement)
    # Without these characters none of the later patterns can match.
    return F.when(url.contains("?") | url.contains("="), out).otherwise(path)
