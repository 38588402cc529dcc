"""Table schemas."""

from __future__ import annotations

from pyspark.sql import types as T


def strings(*names: str) -> list[T.StructField]:
    return [T.StructField(name, T.StringType()) for name in names]


DEVICE = T.StructType(
    strings("type", "brand", "model", "browser", "browser_version", "os", "os_version")
    + [T.StructField("is_bot", T.BooleanType())]
)
LOCATION = T.StructType(strings("ip_trunc", "continent", "country", "country_code", "city"))
AB_TEST = T.ArrayType(T.StructType(strings("name", "variant", "def")))

# The raw events table: append-only, partitioned by event_date.
EVENTS = T.StructType(
    [T.StructField("timestamp", T.TimestampType())]
    + strings(
        "event_type",
        "event_name",
        "parameters",
        "user_agent",
        "url",
        "referrer",
        "client_id",
        "hash",
        "user_id",
    )
    + [
        T.StructField("consent_given", T.BooleanType()),
        T.StructField("device", DEVICE),
        T.StructField("ab_test", AB_TEST),
        T.StructField("location", LOCATION),
    ]
)

# One landed hit: what the request carried, before merging and defaults.
_TEXT_MAP = T.MapType(T.StringType(), T.StringType())
HITS = T.StructType(
    [
        T.StructField("received_at", T.TimestampType()),
        T.StructField("remote_addr", T.StringType()),
        T.StructField("headers", _TEXT_MAP),
        T.StructField("cookies", _TEXT_MAP),
        T.StructField("query", _TEXT_MAP),
        T.StructField("form", _TEXT_MAP),
        T.StructField("json", T.StringType()),
    ]
)

CLICK_ID = T.StructType(strings("parameter", "value"))
UTM = T.StructType(strings("source", "medium", "campaign", "content", "term", "id"))

SALTS = T.StructType([T.StructField("salt_date", T.DateType())] + strings("salt"))
GEO = T.StructType(
    strings("ip_mask", "continent", "country", "country_code", "city")
    + [T.StructField("updated_at", T.TimestampType())]
)
ADS = T.StructType(
    [T.StructField("ad_id", T.LongType())]
    + strings("account_name", "campaign_name", "adset_name", "ad_name", "channel", "platform")
)
