"""Tracking results in the layout of an ad report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AD_COSTS = ("spend", "impressions", "reach", "clicks", "engagement")


def daily_performance(
    table: DataFrame,
    date_column: str,
    utm: str,
    metrics: Sequence[str],
    ads: DataFrame,
) -> DataFrame:
    """Metrics per day and ad, with zero costs.

    ``utm`` names a utm struct column of ``table``; ``ads`` is the ad
    hierarchy, matched on its ``ad_id``.  Rows are grouped by the utm fields as
    well, which the output does not show, so a visible key can repeat.
    """
    names = ("source", "medium", "campaign", "term", "content", "id")
    # Reduced before the join: most rows share few tags, and many have no id.
    daily = table.groupBy(
        F.to_date(date_column).alias("date"), *[F.col(f"{utm}.{n}").alias(f"utm_{n}") for n in names]
    ).agg(*[F.sum(m).alias(m) for m in metrics])
    columns = {
        "account_name": F.col("account_name"),
        "campaign_name": F.coalesce("campaign_name", "utm_campaign"),
        "adset_name": F.coalesce("adset_name", "utm_term"),
        "ad_name": F.coalesce("ad_name", "utm_content"),
        "ad_id": F.coalesce("ad_key", "utm_id"),
        "channel": F.coalesce("channel", "utm_medium"),
        "platform": F.coalesce("platform", "utm_source"),
        "data_source": F.lit("tracking"),
    }
    keyed = ads.withColumn("ad_key", F.col("ad_id").cast("string")).drop("ad_id")
    return (
        daily.join(keyed, F.col("utm_id") == F.col("ad_key"), "left")
        .groupBy(
            "date",
            *[f"utm_{n}" for n in names],
            *[c.alias(name) for name, c in columns.items()],
        )
        .agg(*[F.sum(m).alias(m) for m in metrics])
        .select("date", *columns, *[F.lit(0).alias(c) for c in AD_COSTS], *metrics)
    )
