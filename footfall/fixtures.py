"""Tracking events derived from generic ``events`` and ``pages`` tables.

Lets every model run on the provided test tables; see FIXTURES.md section 5.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall import schema

GENERIC_EVENTS = (
    "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
)

# FIXTURES.md section 5, as Spark SQL over event_id, ts, user_id, kind, value,
# visitor, purl and sep; later entries use event_name.
EVENT_NAME = """
CASE kind
  WHEN 'view' THEN 'pageview'
  WHEN 'click' THEN element_at(array('text/html', 'scroll', 'view_item', 'add_to_cart'), int(event_id % 4) + 1)
  WHEN 'signup' THEN element_at(array('sign_up', 'login', 'generate_lead'), int(event_id % 3) + 1)
  WHEN 'purchase' THEN element_at(array('purchase', 'begin_checkout'), int(event_id % 2) + 1)
  WHEN 'error' THEN element_at(array('video_start', 'page_view', 'consent', 'custom_x'), int(event_id % 4) + 1)
END"""
TRACKED = {
    "timestamp": "CAST(ts AS TIMESTAMP)",
    "event_type": "IF(event_name = 'text/html', 'request', 'event')",
    "event_name": "event_name",
    "parameters": """concat(
        '{"currency":"', IF(event_id % 5 = 0, 'XXX', 'USD'), '","value":', money,
        ',"method":"m', event_id % 3, '","percent_scrolled":', event_id % 101,
        ',"engagement_time_msec":', event_id % 5000, ',"item_id":"i', event_id % 17,
        '","custom_dimension1":"d', event_id % 9, '","items":[{"item_id":"i', event_id % 17,
        '","price":', money, ',"quantity":', 1 + event_id % 3, '}]}')""",
    "user_agent": """IF(visitor % 8 = 7, 'Mozilla/5.0 (compatible; examplebot/1.0)',
        concat('Mozilla/5.0 (X11; Linux) Firefox/', 100 + visitor % 20))""",
    "url": """concat(purl, CASE event_id % 11
        WHEN 0 THEN concat(sep, 'utm_source=news&utm_medium=email&utm_campaign=c', event_id % 3)
        WHEN 1 THEN concat(sep, 'gclid=g', event_id)
        WHEN 2 THEN concat(sep, 'fbclid=f', event_id)
        ELSE '' END)""",
    "referrer": """CASE event_id % 13
        WHEN 0 THEN 'https://www.google.com/'
        WHEN 1 THEN 'https://blog.partner.io/x'
        WHEN 2 THEN 'https://checkout.stripe.com/p'
        WHEN 3 THEN purl
        WHEN 4 THEN NULL
        ELSE '' END""",
    "client_id": "IF(has_id, concat('c', visitor, IF(event_id % 97 = 0, 'b', '')), NULL)",
    "hash": "sha2(concat(visitor, '|', date_format(ts, 'yyyy-MM-dd')), 256)",
    "user_id": "IF(visitor % 3 = 0 AND kind = 'signup', concat('u', user_id), NULL)",
    "consent_given": "has_id",
    "device": """CAST(named_struct(
        'type', element_at(array('mobile', 'desktop', 'Other'), int(visitor % 3) + 1),
        'brand', element_at(array('Samsung', 'Apple', 'iPhone', NULL), int(visitor % 4) + 1),
        'model', NULL, 'browser', NULL, 'browser_version', NULL, 'os', NULL, 'os_version', NULL,
        'is_bot', NULL) AS {device})""",
    "ab_test": "CAST(NULL AS {ab_test})",
    "location": """CAST(named_struct(
        'ip_trunc', NULL, 'continent', NULL,
        'country', element_at(array('Germany', 'France', NULL, 'United States'), int(visitor % 4) + 1),
        'country_code', NULL, 'city', NULL) AS {location})""",
}


def tracking_events(
    events: DataFrame, pages: DataFrame, basis: DataFrame | None = None
) -> DataFrame:
    """The raw events schema plus ``event_id``.

    ``basis`` is the table that users are counted on where ``events`` is a
    stream.
    """
    np = pages.select(F.count(F.lit(1))).scalar()
    counted = events if basis is None else basis
    users = counted.select(F.count_distinct("user_id")).scalar()
    types = {
        "device": schema.DEVICE.simpleString(),
        "ab_test": schema.AB_TEST.simpleString(),
        "location": schema.LOCATION.simpleString(),
    }
    return (
        events.withColumns({"page_id": F.col("event_id") % np, "users": users})
        .join(pages.selectExpr("page_id", "url AS purl"), "page_id")
        .selectExpr(
            "event_id", "ts", "user_id", "event_type AS kind", "purl",
            "user_id % greatest(3L, users div 18) AS visitor",
            "IF(contains(purl, '?'), '&', '?') AS sep",
            "CAST(CAST(value AS DECIMAL(18,2)) AS STRING) AS money",
        )
        .selectExpr(
            "*", f"{EVENT_NAME} AS event_name",
            "visitor % 3 = 0 AND event_id % 5 <> 0 AS has_id",
        )
        .selectExpr(
            "event_id",
            *[f"{sql.format(**types) if name in types else sql} AS {name}" for name, sql in TRACKED.items()],
        )
    )


def load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracking events over the tables in ``sf_dir``."""
    events = spark.read.schema(GENERIC_EVENTS).parquet(f"{sf_dir}/events.parquet")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return tracking_events(events, pages)


def load_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream over the events file."""
    events = spark.readStream.schema(GENERIC_EVENTS).parquet(f"{sf_dir}/events.parque[t]")
    basis = spark.read.schema(GENERIC_EVENTS).parquet(f"{sf_dir}/events.parquet")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return tracking_events(events, pages, basis)


def _choose(key: Column, options: list[str | None]) -> Column:
    """Option number ``key``."""
    return F.element_at(F.array(*[F.lit(o) for o in options]), (key + 1).cast("int"))


# --- Fixed values: user agents dealt out to landed hits ----------------------
AGENTS = [
    "Mozilla/5.0 (iPhone; CPU iPhone OS 17_2 like Mac OS X) Version/17.2 Mobile Safari/604.1",
    "Mozilla/5.0 (iPad; CPU OS 16_6 like Mac OS X) Version/16.6 Mobile Safari/604.1",
    "Mozilla/5.0 (Linux; Android 14; SM-S918B) Chrome/120.0.6099.43 Mobile Safari/537.36",
    "Mozilla/5.0 (Windows NT 10.0; Win64) Chrome/120.0.0.0 Safari/537.36 Edg/120.0.2210.61",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) Version/17.1 Safari/605.1.15",
    "Mozilla/5.0 (compatible; Googlebot/2.1)",
    "Mozilla/5.0 (X11; Linux x86_64; rv:121.0) Gecko/20100101 Firefox/121.0",
    "",
]
# -----------------------------------------------------------------------------


def _digits(value: Column, below: int) -> Column:
    return (value % below).cast("string")


def landed_hits(tracked: DataFrame) -> DataFrame:
    """Hits as landed (``schema.HITS``), plus ``event_id``.

    By event_id, the payload is spread over query, form and JSON body.
    """
    eid = F.col("event_id")
    turn = eid % 3
    no_text = F.lit(None).cast("string")
    empty = F.create_map().cast("map<string,string>")
    forwarded = F.when(
        eid % 4 == 0, F.concat(F.lit("93.184."), _digits(eid, 5), F.lit("."), _digits(eid, 100))
    )
    peer = (
        F.when(eid % 6 == 0, "")
        .when(eid % 6 == 1, F.concat(F.lit("2001:db8::"), _digits(eid, 50)))
        .when(eid % 6 == 2, "::1")
        .otherwise(F.concat(F.lit("10.0."), _digits(eid, 7), F.lit("."), _digits(eid, 40)))
    )
    given = [F.lit("en"), F.col("event_name"), F.lit("url"), F.col("url"), F.lit("r"), F.col("referrer")]
    params = (
        F.when(eid % 37 == 0, F.lit('"text"'))
        .when(
            F.col("event_name") == "consent",
            F.concat(F.lit('{"id":'), F.when(eid % 8 == 2, "true").otherwise("false"), F.lit("}")),
        )
        .otherwise(F.concat(F.lit('{"n":'), eid.cast("string"), F.lit(',"tag":"a b"}')))
    )
    quoted = F.concat(F.lit('"'), F.col("referrer"), F.lit('"'))
    body = F.concat(
        F.lit('{"en":"'),
        F.when(eid % 31 == 0, "").otherwise(F.col("event_name")),
        F.lit('","url":"'),
        F.col("url"),
        F.lit('","r":'),
        F.coalesce(quoted, F.lit("null")),
        F.lit(',"p":'),
        params,
        # JSON values that count as not given, and a user id that is a number
        F.when(eid % 41 == 2, ',"c":false').otherwise(""),
        F.when(eid % 47 == 2, ',"et":0,"ua":null').otherwise(""),
        F.when(eid % 43 == 2, ',"u":0,"h1":0.0').otherwise(""),
        F.lit("}"),
    )
    return tracked.select(
        "event_id",
        F.col("timestamp").alias("received_at"),
        peer.alias("remote_addr"),
        F.create_map(
            F.lit("user-agent"), _choose(eid % 8, AGENTS), F.lit("x-forwarded-for"), forwarded
        ).alias("headers"),
        F.create_map(
            F.lit("_ms_cid"),
            F.col("client_id"),
            F.lit("_ms_h"),
            F.when(eid % 9 == 0, F.col("hash")).otherwise(no_text),
        ).alias("cookies"),
        F.when(turn == 0, F.create_map(*given))
        .otherwise(F.create_map(F.lit("en"), F.lit("from-query")))
        .alias("query"),
        F.when(turn == 1, F.create_map(*given, F.lit("p"), F.lit('{"a":1}')))
        .when(turn == 2, F.create_map(F.lit("en"), F.lit("from-form"), F.lit("et"), F.lit("form")))
        .otherwise(empty)
        .alias("form"),
        F.when(turn == 2, body).alias("json"),
    )


def salts(tracked: DataFrame) -> DataFrame:
    """A fixed salt for each day that has events."""
    day = F.to_date("timestamp")
    return tracked.select(day.alias("salt_date")).distinct().withColumn(
        "salt", F.sha2(F.concat(F.lit("salt"), F.date_format("salt_date", "yyyy-MM-dd")), 256)
    )


def geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locations of addresses, from customers and their nations."""
    customer, nation, region = (
        spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "nation", "region")
    )
    key = F.col("c_custkey")
    ip = F.concat(F.lit("10.0."), _digits(key, 7), F.lit("."), _digits(key, 40))
    return (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy(ip.alias("ip_mask"))
        .agg(F.min("r_name").alias("continent"), F.min("n_name").alias("country"))
        .withColumns(
            {
                "country_code": F.substring("country", 1, 2),
                "city": F.lit(""),
                "updated_at": F.lit(None).cast("timestamp"),
            }
        )
    )


def geo_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested networks: two large ones, those of nations inside, and single customers'."""
    customer, nation = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "nation"))
    key = F.col("n_nationkey")
    v4 = F.concat(F.lit("10.0."), _digits(key, 7), F.lit("."), (16 * F.pmod(key, F.lit(4))).cast("string"), F.lit("/28"))
    v6 = F.concat(F.lit("2A02:3100:"), F.lower(F.hex(key + 0x1DA0)), F.lit("::/48"))
    one = F.concat(F.lit("10.0."), _digits(F.col("c_custkey"), 7), F.lit("."), _digits(F.col("c_custkey"), 40))
    own = customer.filter(F.col("c_custkey") % 3 == 0).select(one.alias("network"), F.lit("customer").alias("country"))
    large = spark.range(1).select(F.explode(F.array(F.lit("10.0.0.0/13"), F.lit("2a02::/16"), F.lit("no/8"))).alias("network"))
    rows = [nation.groupBy(n.alias("network")).agg(F.min("n_name").alias("country")) for n in (v4, v6)]
    rows += [own.distinct(), large.withColumn("country", F.lit("wide"))]
    found = rows[0]
    for more in rows[1:]:
        found = found.unionByName(more)
    none = F.lit(None).cast("string")
    return found.withColumns(
        {"continent": none, "country_code": F.substring("country", 1, 2), "city": F.lit(""), "updated_at": none.cast("timestamp")}
    )


def ads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ad hierarchy, from parts."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select(
        F.col("p_partkey").cast("long").alias("ad_id"),
        F.col("p_brand").alias("account_name"),
        F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).alias("campaign_name"),
        F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).alias("adset_name"),
        F.lit(None).cast("string").alias("ad_name"),
        F.when(F.col("p_partkey") % 5 == 0, "paid").alias("channel"),
        F.lit("ads").alias("platform"),
    )


def rich_parameters(tracked: DataFrame) -> DataFrame:
    """Parameters with custom, user and traffic fields, and awkward values."""
    eid = F.col("event_id")
    text = F.format_string(
        '{"custom_dimension1":"d%s","custom_dimension2":%s,"custom_metric1":"%s.5",'
        '"custom_metric2":%s,"engagement_time_msec":%s,"value":%s,"currency":%s,'
        '"user_properties":{"user_type":"t%s","user_tier":%s,"total_purchases":"%s"},'
        '"traffic_source":{"name":"n%s","medium":null,"gclid":"g%s"}}',
        _digits(eid, 9),
        F.when(eid % 4 == 0, F.lit('{"a":1}')).otherwise(F.lit('"{x"')),
        _digits(eid, 50),
        F.when(eid % 6 == 0, F.lit('"oops"')).otherwise(_digits(eid, 30)),
        F.when(eid % 5 == 0, F.lit("null")).otherwise(_digits(eid, 5000)),
        F.when(eid % 7 == 0, F.lit("null")).otherwise((eid % 11 - 3).cast("string")),
        F.when(eid % 3 == 0, F.lit("[1]")).otherwise(F.lit('"GBP"')),
        _digits(eid, 4),
        F.when(eid % 2 == 0, F.lit('"gold"')).otherwise(F.lit("[]")),
        _digits(eid, 12),
        _digits(eid, 3),
        eid.cast("string"),
    )
    return tracked.withColumn("parameters", text)
