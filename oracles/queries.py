"""One SQL statement per query, for DuckDB over the provided tables."""

from __future__ import annotations

from oracles import base as b

ORACLES: dict[str, str] = {}

_UTM = ("source", "medium", "campaign", "content", "term", "id")


def flat(struct: str, names: tuple[str, ...], prefix: str = "") -> str:
    return ", ".join(f"{struct}.{n} AS {prefix}{n}" for n in names)


UTM_COLS = flat("utm", _UTM, "utm_")
CLID_COLS = flat("clid", ("parameter", "value"), "clid_")


def add(key: str, stages: tuple[str, ...], select: str) -> None:
    ORACLES[key] = b.chain(*stages) + select


# --- Scans and columns of single events
add("events_scan", b.TO_EVENTS, """
SELECT event_id, "timestamp", event_type, event_name, parameters, user_agent, url, referrer, client_id, hash,
  user_id, consent_given, device_type, device_brand, country FROM tracked""")
add("event_ids", b.TO_EVENTS, """
SELECT event_id AS "position", hash, "timestamp",
  to_base64(unhex(sha256(hash || epoch_us("timestamp") || event_id))) AS event_id FROM tracked""")
add("event_ids_content", b.TO_EVENTS, """
SELECT hash, 2 * count(*) AS events, 2 * count(*) AS ids FROM tracked GROUP BY 1""")
add("bot_flag", b.TO_PARSED, "SELECT event_id, device_type, is_bot, NULL::BOOLEAN AS is_bot_old FROM parsed")
add("pageviews", b.TO_PARSED, "SELECT event_id, event_name, is_pageview FROM parsed")
add("ext_referrers", b.TO_PARSED, "SELECT event_id, referrer, is_ext_referrer FROM parsed")
add("referring_domain", b.TO_PARSED, "SELECT event_id, referring_domain FROM parsed")
add("click_ids", b.TO_PARSED, f"SELECT event_id, {flat('clid', ('parameter', 'value'))} FROM parsed")
add("utm_parse", b.TO_PARSED, f"SELECT event_id, {flat('utm', _UTM)} FROM parsed")
add("page_location", b.TO_PARSED, "SELECT event_id, page_location FROM parsed")
add("hostnames", b.TO_PARSED, r"""
SELECT event_id, hostname, nullif(regexp_extract(url, '^(?:\w+://)?(?:[^:/?]+\.)*([^:/?]+\.[^:/?]+)', 1), '') AS domain
FROM parsed""")

# --- Blocks and identity
add("block_starts", b.TO_BLOCKS, """
SELECT hash, "timestamp", before_ms AS time_diff_ms FROM gaps WHERE before_ms > 1800000 OR before_ms IS NULL""")
add("block_ends", b.TO_BLOCKS, """
SELECT hash, "timestamp", after_ms AS time_diff_ms FROM gaps WHERE after_ms > 1800000 OR after_ms IS NULL""")
add("blocks", b.TO_BLOCKS, """
SELECT hash, block_start, max("timestamp") AS block_end, count(*) AS events,
  count(*) FILTER (event_name = 'pageview') AS pageviews
FROM placed GROUP BY hash, block_start""")
add("event_block_starts", b.TO_BLOCKS, 'SELECT event_id, hash, "timestamp", block_start FROM placed')
add("event_blocks", b.TO_BLOCKS, 'SELECT event_id, hash, "timestamp", block_end FROM placed')
add("first_client_ids", b.TO_EVENTS, """
SELECT hash, client_id, min("timestamp") AS "timestamp" FROM tracked WHERE client_id IS NOT NULL GROUP BY 1, 2""")
add("first_client_ids_block", b.TO_MERGED, """
SELECT hash, block_start, client_id, seen_at AS "timestamp" FROM sightings""")
add("client_ids", b.TO_MERGED, "SELECT event_id, block_start, client_id, no_client_id FROM merged")
add("legacy_client_ids", (*b.TO_BLOCKS, b.merged("2024-01-16")),
    "SELECT event_id, block_start, client_id, no_client_id FROM merged")

BACKFILL = (*b.TO_BLOCKS, """
first_seen AS (
  SELECT hash, seen_at, min(client_id) AS next_id
  FROM (SELECT hash, client_id, min("timestamp") AS seen_at FROM placed WHERE client_id IS NOT NULL GROUP BY ALL)
  GROUP BY ALL
),
stays AS (
  SELECT hash, block_end, client_id, min("timestamp") AS came, max("timestamp") AS went
  FROM placed WHERE client_id IS NOT NULL GROUP BY ALL
),
sole AS (SELECT hash, block_end, min(client_id) AS only_id FROM stays GROUP BY ALL HAVING count(*) = 1),
repaired AS (
  SELECT hash, block_end, max_by(client_id, went) AS fixed_id
  FROM (
    SELECT *, coalesce(lag(went) OVER w < came, TRUE) AND coalesce(lead(came) OVER w > went, TRUE) AS apart
    FROM stays WINDOW w AS (PARTITION BY hash, block_end ORDER BY came, client_id)
  ) WHERE apart GROUP BY ALL HAVING count(*) = 2
),
p3 AS (
  SELECT * EXCLUDE (client_id), client_id AS tracked_client_id,
    coalesce(client_id, ahead) AS pass1,
    coalesce(client_id, ahead, only_id, hash) AS pass2,
    coalesce(fixed_id, client_id, ahead, only_id, hash) AS pass3,
    CAST(fixed_id IS NOT NULL AS INTEGER) AS cookiebot_fix
  FROM (
    SELECT e.*, CASE WHEN f.seen_at <= e.block_end THEN f.next_id END AS ahead
    FROM placed e ASOF LEFT JOIN first_seen f ON e.hash = f.hash AND e."timestamp" <= f.seen_at
  ) LEFT JOIN sole USING (hash, block_end) LEFT JOIN repaired USING (hash, block_end)
)""")
add("backfill_pass1", BACKFILL, "SELECT event_id, block_end, tracked_client_id, pass1 FROM p3")
add("backfill_pass2", BACKFILL, "SELECT event_id, pass2 FROM p3")
add("backfill_pass3", BACKFILL, "SELECT event_id, pass3, cookiebot_fix FROM p3")
add("event_blocks_model", BACKFILL, """
SELECT event_id, "timestamp", hash, event_name, url, block_end, tracked_client_id, pass3 AS client_id, cookiebot_fix
FROM p3""")

# --- Sources and sessions
add("source_candidates", b.TO_SOURCES, f"""
SELECT event_id, "timestamp", client_id, block_start, is_first_pageview, is_ext_referrer, landing_page, referrer,
  referring_domain, is_direct, {CLID_COLS}, {UTM_COLS} FROM candidates""")
add("ext_sources", b.TO_SOURCES, f"""
SELECT event_id, "timestamp", client_id, block_start, is_direct, first_source, landing_page, referrer,
  {CLID_COLS}, {UTM_COLS} FROM ext_sources""")
add("utm_rules", b.TO_PARSED, f"""
SELECT event_id, {b.RULED_SOURCE} AS source, {b.RULED_MEDIUM} AS medium FROM parsed WHERE is_pageview""")
_SESSION_FLAGS = "is_stub_session, is_ext_session, is_source_event"
add("sessionated", b.TO_SESSIONATED, f"""
SELECT event_id, client_id, block_id, session_id, source_referrer, landing_page, {_SESSION_FLAGS},
  {UTM_COLS}, {CLID_COLS} FROM sessionated""")


def js(path: str, cast: str = "VARCHAR", source: str = "parameters") -> str:
    text = f"json_extract_string({source}, '$.{path}')"
    return text if cast == "VARCHAR" else f"TRY_CAST({text} AS {cast})"


def gated(names: str, expr: str) -> str:
    return f"CASE WHEN event_name IN ({names}) THEN {expr} END"


add("events_sessionated", b.TO_SESSIONATED, f"""
SELECT event_id, "timestamp", event_type, event_name, parameters, user_agent, url, referrer, client_id, hash, user_id,
  is_pageview, is_ext_referrer, referring_domain, page_location, hostname, no_client_id, block_id, session_id,
  source_referrer, landing_page, {_SESSION_FLAGS}, device_type, is_bot, {UTM_COLS}, {CLID_COLS},
  {gated("'purchase'", js('value', 'DOUBLE'))} AS purchase_value,
  {gated("'view_item'", js('item_id'))} AS view_item_id,
  {gated("'add_to_cart'", js('item_id'))} AS cart_item_id,
  {gated("'begin_checkout'", js('currency'))} AS checkout_currency,
  {gated("'sign_up'", js('method'))} AS sign_up_method,
  {gated("'login'", js('method'))} AS login_method,
  {gated("'generate_lead'", js('value', 'DOUBLE'))} AS lead_value,
  {gated("'page_view'", js('page_title'))} AS page_title,
  {gated("'scroll'", js('percent_scrolled', 'DOUBLE'))} AS percent_scrolled,
  {gated("'video_start'", js('video_title'))} AS video_title,
  CAST(CASE WHEN event_name IN ('purchase','view_item_list','view_cart')
       THEN json_array_length(parameters, '$.items') ELSE 0 END AS BIGINT) AS items
FROM sessionated""")

_SESSION = """session_id, client_id, hash, start_ts, end_ts, user_agent, landing_page, source_referrer, is_external,
  is_stub, no_client_id, pageviews, events, hits, logged_in, activated, device_type, device_brand, country"""
add("sessions_agg", b.TO_SESSIONS, f"""
SELECT {_SESSION}, {UTM_COLS}, {CLID_COLS}
FROM (SELECT * EXCLUDE (head, src), unnest(head), unnest(src) FROM session_rows)""")
add("session_metrics", b.TO_SESSIONS, "SELECT session_id, hash, logged_in, activated FROM session_rows")
add("session_attribution", b.TO_SESSIONS, f"""
SELECT session_id, hash, start_ts, donor_start_ts, {UTM_COLS}, {CLID_COLS}
FROM (SELECT *, coalesce(lent.utm, own.utm) AS utm, coalesce(lent.clid, own.clid) AS clid FROM attributed)""")
add("sessions", b.TO_SESSIONS, f"SELECT {_SESSION}, {UTM_COLS}, {CLID_COLS}, donor_start_ts FROM sessions")


def roll_up(key: str, source: str) -> str:
    return f"""
rolled AS (
  SELECT {key}, min(start_ts) AS first_session_ts, max(end_ts) AS last_session_ts,
    min_by(utm, (start_ts, session_id)) AS first_utm, max_by(utm, (start_ts, session_id)) AS last_utm,
    string_agg(CASE WHEN is_external THEN coalesce(utm.source, '') || '/' || coalesce(utm.medium, '') || ':'
      || coalesce(utm.campaign, '') END, ' > ' ORDER BY start_ts, session_id) AS touchpoints,
    CAST(count(*) AS BIGINT) AS sessions,
    CAST(CASE WHEN sum(logged_in) > 0 THEN 1 ELSE 0 END AS BIGINT) AS logged_in,
    CAST(CASE WHEN sum(activated) > 0 THEN 1 ELSE 0 END AS BIGINT) AS activated,
    bool_and(no_client_id) AS no_client_id,
    CAST(count(*) FILTER (is_external AND utm.source IS NOT NULL) AS BIGINT) AS ext_sources
  FROM {source} GROUP BY {key}
)"""


_ROLLED = "first_session_ts, last_session_ts, touchpoints, sessions, logged_in, activated, no_client_id"
_ENDS = f"{flat('first_utm', _UTM, 'first_')}, {flat('last_utm', _UTM, 'last_')}"
TO_CLIENTS = (*b.TO_SESSIONS, roll_up("client_id", "sessions"))
add("clients", TO_CLIENTS, f"SELECT client_id, {_ROLLED}, {_ENDS} FROM rolled")
add("first_last_utm", TO_CLIENTS, f"SELECT client_id, {_ENDS} FROM rolled")
add("touchpoints", TO_CLIENTS, "SELECT client_id, touchpoints FROM rolled")
add("touchpoint_rows", b.TO_SESSIONS, """
SELECT client_id, start_ts, session_id, coalesce(utm.source, '') || '/' || coalesce(utm.medium, '') || ':'
  || coalesce(utm.campaign, '') AS touchpoint FROM sessions WHERE is_external""")


def segments(key: str, source: str) -> str:
    return f"""
SELECT {key}, segment, count(*) AS sessions, string_agg(touchpoint, ' > ' ORDER BY start_ts, session_id) AS path
FROM (
  SELECT {key}, start_ts, session_id, coalesce(utm.source, '') || '/' || coalesce(utm.medium, '') || ':'
      || coalesce(utm.campaign, '') AS touchpoint,
    (row_number() OVER (PARTITION BY {key} ORDER BY start_ts, session_id) - 1) // 3 AS segment
  FROM {source} WHERE is_external
) GROUP BY 1, 2"""


add("touchpoint_segments", b.TO_SESSIONS, segments("client_id", "sessions"))
add("user_map", b.TO_USERS, "SELECT session_id, user_id FROM user_map")
_MAPPED = (*b.TO_USERS, """
mapped AS (SELECT s.*, u.user_id FROM sessions s JOIN user_map u USING (session_id) WHERE u.user_id IS NOT NULL)""")
add("users", (*_MAPPED, roll_up("user_id", "mapped")),
    f"SELECT user_id, {_ROLLED}, {_ENDS}, ext_sources FROM rolled")
add("user_path_segments", _MAPPED, segments("user_id", "mapped"))
add("user_utm_lists", _MAPPED, f"""
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY start_ts, session_id) - 1 AS "position",
  {flat('utm', _UTM)}, start_ts
FROM mapped WHERE is_external AND utm.source IS NOT NULL""")
add("daily_performance", (*b.TO_SESSIONS, r"""
ads AS (
  SELECT CAST(p_partkey AS VARCHAR) AS ad_id, p_brand AS account_name,
    CASE WHEN p_partkey % 2 = 0 THEN p_type END AS campaign_name,
    CASE WHEN p_partkey % 3 = 0 THEN p_name END AS adset_name, NULL::VARCHAR AS ad_name,
    CASE WHEN p_partkey % 5 = 0 THEN 'paid' END AS channel, 'ads' AS platform FROM part
),
tagged AS (
  SELECT *, utm.source AS us, utm.medium AS um, utm.campaign AS uc, utm.content AS un, utm.term AS ut,
    regexp_extract(utm.campaign, '(\d+)', 1) AS ui FROM sessions
)"""), """
SELECT date, account_name, campaign_name, adset_name, ad_name, ad_id, channel, platform, data_source,
  0 AS spend, 0 AS impressions, 0 AS reach, 0 AS clicks, 0 AS engagement, hits, pageviews, activated
FROM (
  SELECT CAST(start_ts AS DATE) AS date, us, um, uc, ut, un, ui, account_name,
    coalesce(campaign_name, uc) AS campaign_name, coalesce(adset_name, ut) AS adset_name,
    coalesce(ad_name, un) AS ad_name, coalesce(ad_id, ui) AS ad_id, coalesce(channel, um) AS channel,
    coalesce(platform, us) AS platform, 'tracking' AS data_source,
    CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(pageviews) AS BIGINT) AS pageviews,
    CAST(sum(activated) AS BIGINT) AS activated
  FROM tagged LEFT JOIN ads ON tagged.ui = ads.ad_id GROUP BY ALL
)""")

# --- Parameters
# --- Fixed values: names and kinds of fields, event names, currencies -------
_ITEM = (
    ("currency", "VARCHAR"),
    ("value", "DOUBLE"),
    ("item_id", "VARCHAR"),
    ("item_name", "VARCHAR"),
    ("item_brand", "VARCHAR"),
    ("item_category", "VARCHAR"),
    ("item_category2", "VARCHAR"),
    ("item_category3", "VARCHAR"),
    ("item_category4", "VARCHAR"),
    ("item_category5", "VARCHAR"),
    ("price", "DOUBLE"),
    ("quantity", "BIGINT"),
    ("item_variant", "VARCHAR"),
    ("item_list_id", "VARCHAR"),
    ("item_list_name", "VARCHAR"),
    ("item_list_index", "BIGINT"),
)
_ITEMS = (
    ("item_id", "VARCHAR"),
    ("item_name", "VARCHAR"),
    ("item_brand", "VARCHAR"),
    ("item_variant", "VARCHAR"),
    ("item_category", "VARCHAR"),
    ("item_category2", "VARCHAR"),
    ("item_category3", "VARCHAR"),
    ("item_category4", "VARCHAR"),
    ("item_category5", "VARCHAR"),
    ("price", "DOUBLE"),
    ("quantity", "BIGINT"),
    ("item_revenue", "DOUBLE"),
    ("item_refund", "DOUBLE"),
    ("coupon", "VARCHAR"),
    ("affiliation", "VARCHAR"),
    ("location_id", "VARCHAR"),
    ("item_list_id", "VARCHAR"),
    ("item_list_name", "VARCHAR"),
    ("item_list_index", "BIGINT"),
    ("promotion_id", "VARCHAR"),
    ("promotion_name", "VARCHAR"),
    ("creative_name", "VARCHAR"),
    ("creative_slot", "VARCHAR"),
)
_PURCHASE = (
    ("currency", "VARCHAR"),
    ("value", "DOUBLE"),
    ("transaction_id", "VARCHAR"),
    ("coupon", "VARCHAR"),
    ("shipping", "DOUBLE"),
    ("tax", "DOUBLE"),
    ("affiliation", "VARCHAR"),
    ("shipping_tier", "VARCHAR"),
    ("payment_type", "VARCHAR"),
)
_CHECKOUT = (
    ("currency", "VARCHAR"),
    ("value", "DOUBLE"),
    ("coupon", "VARCHAR"),
    ("shipping_tier", "VARCHAR"),
    ("payment_type", "VARCHAR"),
)
_LEAD = (
    ("currency", "VARCHAR"),
    ("value", "DOUBLE"),
)
_PAGE = (
    ("page_title", "VARCHAR"),
    ("page_location", "VARCHAR"),
    ("page_referrer", "VARCHAR"),
)
_VIDEO = (
    ("video_title", "VARCHAR"),
    ("video_duration", "VARCHAR"),
    ("video_percent", "VARCHAR"),
    ("video_url", "VARCHAR"),
    ("video_provider", "VARCHAR"),
)
_STRUCTS = {
    "ga4_purchase": ("'purchase'", _PURCHASE),
    "ga4_view_item": ("'view_item'", _ITEM),
    "ga4_add_to_cart": ("'add_to_cart'", _ITEM),
    "ga4_begin_checkout": ("'begin_checkout'", _CHECKOUT),
    "ga4_sign_up": ("'sign_up'", (("method", "VARCHAR"),)),
    "ga4_login": ("'login'", (("method", "VARCHAR"),)),
    "ga4_generate_lead": ("'generate_lead'", _LEAD),
    "ga4_page_view": ("'page_view'", _PAGE),
    "ga4_scroll": ("'scroll'", (("percent_scrolled", "DOUBLE"),)),
    "ga4_video": ("'video_start','video_progress','video_complete'", _VIDEO),
}
_ITEM_EVENTS = "'purchase','view_item_list','view_cart'"
_CURRENCIES = "('USD','EUR','GBP','CAD','AUD','JPY','CNY','INR','BRL','MXN')"
_VALID_EVENTS = "'purchase','view_item','add_to_cart','begin_checkout'"
_ECOMMERCE = """'purchase','view_item','add_to_cart','begin_checkout','view_cart','remove_from_cart',
    'view_item_list','add_to_wishlist','view_promotion','select_promotion'"""
_ENGAGEMENT = """'page_view','scroll','video_start','video_progress','video_complete','file_download',
    'form_start','form_submit'"""
_LIFECYCLE = "'sign_up','login','logout','generate_lead','join_group','share','search'"
# ----------------------------------------------------------------------------
for key, (names, fields) in _STRUCTS.items():
    columns = ", ".join(f"{js(name, kind)} AS {name}" for name, kind in fields)
    add(key, b.TO_EVENTS, f"SELECT event_id, event_name, {columns} FROM tracked WHERE event_name IN ({names})")

_item_cols = ", ".join(f"{js(name, kind, 'item')} AS {name}" for name, kind in _ITEMS)
add("ga4_items", b.TO_EVENTS, f"""
SELECT event_id, "position", {_item_cols} FROM (
  SELECT event_id, unnest(items) AS item, unnest(range(len(items))) AS "position" FROM (
    SELECT event_id, CAST(json_extract(parameters, '$.items') AS JSON[]) AS items FROM tracked
    WHERE event_name IN ({_ITEM_EVENTS})))""")

add("ga4_currency", b.TO_EVENTS, f"""
SELECT event_id, CASE WHEN {js('currency')} IN {_CURRENCIES} THEN {js('currency')} ELSE 'EUR' END AS currency
FROM tracked""")
add("ga4_category", b.TO_EVENTS, f"""
SELECT event_id, CASE
  WHEN event_name IS NULL THEN 'other'
  WHEN event_name IN ({_ECOMMERCE}) THEN 'ecommerce'
  WHEN event_name IN ({_ENGAGEMENT}) THEN 'engagement'
  WHEN event_name IN ({_LIFECYCLE}) THEN 'user_lifecycle'
  ELSE 'custom' END AS category FROM tracked""")

RICH = (b.ADAPTER, r"""
rich AS (
  SELECT event_id, event_name,
    '{"custom_dimension1":"d' || (event_id % 9) || '","custom_dimension2":'
    || CASE WHEN event_id % 4 = 0 THEN '{"a":1}' ELSE '"{x"' END
    || ',"custom_metric1":"' || (event_id % 50) || '.5","custom_metric2":'
    || CASE WHEN event_id % 6 = 0 THEN '"oops"' ELSE CAST(event_id % 30 AS VARCHAR) END
    || ',"engagement_time_msec":' || CASE WHEN event_id % 5 = 0 THEN 'null' ELSE CAST(event_id % 5000 AS VARCHAR) END
    || ',"value":' || CASE WHEN event_id % 7 = 0 THEN 'null' ELSE CAST(event_id % 11 - 3 AS VARCHAR) END
    || ',"currency":' || CASE WHEN event_id % 3 = 0 THEN '[1]' ELSE '"GBP"' END
    || ',"user_properties":{"user_type":"t' || (event_id % 4) || '","user_tier":'
    || CASE WHEN event_id % 2 = 0 THEN '"gold"' ELSE '[]' END
    || ',"total_purchases":"' || (event_id % 12) || '"},"traffic_source":{"name":"n' || (event_id % 3)
    || '","medium":null,"gclid":"g' || event_id || '"}}' AS parameters
  FROM tracked
)""")


def scalar(path: str) -> str:
    kind = f"json_type(parameters, '$.{path}')"
    return f"CASE WHEN {kind} NOT IN ('OBJECT','ARRAY','NULL') THEN {js(path)} END"


add("ga4_valid", RICH, f"""
SELECT event_id, CASE WHEN event_name IN ({_VALID_EVENTS}) THEN
    CASE WHEN {scalar('currency')} IS NULL THEN FALSE WHEN {scalar('value')} IS NULL THEN FALSE
         WHEN CAST({scalar('value')} AS DOUBLE) <= 0 THEN FALSE ELSE TRUE END
  ELSE TRUE END AS is_valid FROM rich""")
add("ga4_value", RICH, f"""
SELECT event_id, CASE WHEN {scalar('value')} IS NOT NULL THEN CAST({scalar('value')} AS DOUBLE) ELSE 0.0 END AS value
FROM rich""")
add("ga4_custom_dims", RICH, "SELECT event_id, " + ", ".join(
    f"{scalar(f'custom_dimension{i}')} AS custom_dimension{i}" for i in (1, 2, 3)) + " FROM rich")
add("ga4_custom_metrics", RICH, "SELECT event_id, " + ", ".join(
    f"TRY_CAST({scalar(f'custom_metric{i}')} AS DOUBLE) AS custom_metric{i}" for i in (1, 2, 3)) + " FROM rich")
add("ga4_user_props", RICH, "SELECT event_id, " + ", ".join(
    f"{scalar('user_properties.' + n)} AS {n}" for n in (
        "user_type", "user_tier", "subscription_status", "account_age_days", "last_purchase_date",
        "total_purchases", "lifetime_value")) + " FROM rich")
add("ga4_traffic_source", RICH, "SELECT event_id, " + ", ".join(
    f"{scalar('traffic_source.' + n)} AS {n}" for n in (
        "name", "medium", "source", "campaign", "term", "content", "mcc_click_id", "gclid", "dclid",
        "srsltid")) + " FROM rich")
add("ga4_device_category", b.TO_EVENTS, """
SELECT event_id, CASE WHEN device_type IN ('mobile','tablet','desktop') THEN device_type
  WHEN device_brand IN ('iPhone','iPad','iPod') THEN 'mobile'
  WHEN device_brand IN ('Samsung','Huawei','Xiaomi','OnePlus','Google') THEN 'mobile'
  ELSE 'desktop' END AS device_category FROM tracked""")
add("ga4_engagement", RICH, f"""
SELECT event_id, CASE WHEN {scalar('engagement_time_msec')} IS NOT NULL
  THEN CAST({scalar('engagement_time_msec')} AS BIGINT) ELSE 0 END AS engagement_time FROM rich""")

# --- Reports
LENGTHS = (*b.TO_SESSIONATED, """
lengths AS (
  SELECT session_id, date_sub('second', min("timestamp"), max("timestamp")) AS session_duration
  FROM sessionated GROUP BY 1
),
timed AS (SELECT * FROM sessionated JOIN lengths USING (session_id)),
kpis AS (
  SELECT CAST("timestamp" AS DATE) AS date, count(DISTINCT client_id) AS daily_active_users,
    count(DISTINCT user_id) AS daily_active_registered_users, count(DISTINCT session_id) AS total_sessions,
    count(*) AS total_events, count(*) FILTER (event_name = 'pageview') AS pageviews,
    round(avg(session_duration), 6) AS avg_session_duration
  FROM timed GROUP BY 1
)""")
_AS_OF = '(SELECT max("timestamp") FROM tracked)'
add("daily_kpis", LENGTHS, "SELECT * FROM kpis")
add("dau_growth", LENGTHS, f"""
SELECT date, daily_active_users, lag(daily_active_users) OVER (ORDER BY date) AS prev_day_users,
  round((daily_active_users - lag(daily_active_users) OVER (ORDER BY date))
    / lag(daily_active_users) OVER (ORDER BY date) * 100, 6) AS growth_pct
FROM kpis WHERE date >= CAST({_AS_OF} AS DATE) - 20""")
add("duration_buckets", b.TO_SESSIONS, """
SELECT duration_bucket, count(*) AS session_count,
  round(CAST(count(*) AS DOUBLE) * 100.0 / sum(count(*)) OVER (), 6) AS percentage
FROM (
  SELECT CASE WHEN d < 60 THEN '0-1 min' WHEN d < 300 THEN '1-5 min' WHEN d < 900 THEN '5-15 min'
    WHEN d < 3600 THEN '15-60 min' ELSE '60+ min' END AS duration_bucket
  FROM (SELECT date_sub('second', start_ts, end_ts) AS d FROM sessions
        WHERE start_ts >= (SELECT max(start_ts) FROM sessions) - INTERVAL 7 DAY)
) GROUP BY 1""")
add("top_pages", b.TO_SESSIONATED, f"""
SELECT url, count(*) AS pageviews, count(DISTINCT client_id) AS unique_visitors,
  round(count(*) / count(DISTINCT client_id), 6) AS avg_views_per_visitor
FROM sessionated WHERE event_name = 'pageview' AND "timestamp" >= {_AS_OF} - INTERVAL 7 DAY
GROUP BY 1 ORDER BY pageviews DESC, url LIMIT 20""")
add("geo_traffic", b.TO_SESSIONATED, f"""
SELECT country, NULL::VARCHAR AS country_code, count(*) AS events, count(DISTINCT client_id) AS unique_users,
  count(DISTINCT session_id) AS sessions
FROM sessionated WHERE "timestamp" >= {_AS_OF} - INTERVAL 20 DAY AND country IS NOT NULL GROUP BY 1""")
add("freshness", b.TO_EVENTS, """
SELECT table_name, latest_record, date_sub('hour', latest_record, TIMESTAMP '2024-03-01 12:34:56') AS hours_behind
FROM (SELECT 'events' AS table_name, max("timestamp") AS latest_record FROM tracked
      UNION ALL SELECT 'daily_performance', CAST(max(CAST("timestamp" AS DATE)) AS TIMESTAMP) FROM tracked)""")
add("hourly_events", b.TO_EVENTS, """
SELECT CAST("timestamp" AS DATE) AS date, CAST(hour("timestamp") AS INTEGER) AS hour,
  date_trunc('hour', "timestamp") AS hour_block, count(*) AS event_count FROM tracked GROUP BY 1, 2, 3""")
add("client_user_map", b.TO_EVENTS, """
SELECT client_id, user_id, min("timestamp") AS first_seen, max("timestamp") AS last_seen
FROM tracked WHERE user_id IS NOT NULL GROUP BY 1, 2""")
add("user_activity", LENGTHS, """
SELECT client_id, user_id, min("timestamp") AS first_seen, max("timestamp") AS last_seen,
  count(DISTINCT CAST("timestamp" AS DATE)) AS days_active, count(*) AS total_events,
  count(DISTINCT session_id) AS total_sessions, round(avg(session_duration), 6) AS avg_session_duration
FROM timed GROUP BY 1, 2""")
add("session_summary", b.TO_SESSIONATED, """
SELECT session_id, client_id, user_id, min("timestamp") AS session_start, max("timestamp") AS session_end,
  date_sub('second', min("timestamp"), max("timestamp")) AS session_duration, count(*) AS pageviews,
  count(DISTINCT url) AS unique_pages, array_to_string(list_sort(list(DISTINCT event_name)), ',') AS events
FROM sessionated GROUP BY 1, 2, 3""")
add("anon_clients", b.TO_SESSIONATED, """
SELECT client_id, min("timestamp") AS first_seen, max("timestamp") AS last_seen,
  count(DISTINCT CAST("timestamp" AS DATE)) AS days_active, count(*) AS total_events,
  count(DISTINCT session_id) AS total_sessions
FROM sessionated WHERE user_id IS NULL GROUP BY 1""")
add("session_numbers", (*b.TO_EVENTS, """
flagged AS (
  SELECT event_id, client_id, "timestamp", CASE WHEN date_sub('minute', lag("timestamp") OVER (
    PARTITION BY client_id ORDER BY "timestamp", event_id), "timestamp") > 30 THEN 1 ELSE 0 END AS new_session
  FROM tracked
)"""), """
SELECT event_id, client_id, CAST(new_session AS BIGINT) AS new_session,
  CAST(sum(new_session) OVER (PARTITION BY client_id ORDER BY "timestamp") AS BIGINT) AS session_number
FROM flagged""")
add("daily_event_names", b.TO_EVENTS, f"""
SELECT CAST("timestamp" AS DATE) AS day, event_name, count(*) AS events, count(DISTINCT hash) AS unique_visitors
FROM tracked WHERE "timestamp" > {_AS_OF} - INTERVAL 7 DAY GROUP BY 1, 2""")
add("recent_events", b.TO_EVENTS, """
SELECT event_id, "timestamp", event_name, url, client_id, country FROM tracked
WHERE event_name = 'pageview' AND user_agent = 'Mozilla/5.0 (X11; Linux) Firefox/100'
ORDER BY "timestamp" DESC, event_id DESC LIMIT 20""")
add("quality_checks", b.TO_SESSIONS, """
SELECT 'events_sessionated.client_id not null' AS check_name,
  (SELECT count(*) FROM sessionated WHERE client_id IS NULL) AS failures
UNION ALL SELECT 'events_sessionated.timestamp not null', (SELECT count(*) FROM sessionated WHERE "timestamp" IS NULL)
UNION ALL SELECT 'events_sessionated.session_id not null', (SELECT count(*) FROM sessionated WHERE session_id IS NULL)
UNION ALL SELECT 'events_sessionated.event_id unique',
  (SELECT count(*) FROM (SELECT event_id FROM sessionated GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT 'sessions.session_id unique',
  (SELECT count(*) FROM (SELECT session_id FROM sessions GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT 'sessions.duration not negative', (SELECT count(*) FROM sessions WHERE end_ts < start_ts)""")
add("null_counts", b.TO_EVENTS, "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER (\"{c}\" IS NULL) AS nulls FROM tracked"
    for c in ("event_id", "timestamp", "event_type", "event_name", "parameters", "user_agent", "url", "referrer",
              "client_id", "hash", "user_id", "consent_given")) + """
UNION ALL SELECT unnest(['device', 'location']), 0
UNION ALL SELECT 'ab_test', count(*) FROM tracked""")
add("returning_visitors", b.TO_SESSIONATED, """
SELECT *, date > first_date AS is_returning FROM (
  SELECT client_id, date, min(date) OVER (PARTITION BY client_id) AS first_date
  FROM (SELECT DISTINCT client_id, CAST("timestamp" AS DATE) AS date FROM sessionated))""")
add("retention", b.TO_SESSIONATED, """
SELECT cohort, date_diff('day', cohort, week) // 7 AS week_offset, count(*) AS clients FROM (
  SELECT client_id, week, min(week) OVER (PARTITION BY client_id) AS cohort
  FROM (SELECT DISTINCT client_id, CAST(date_trunc('week', "timestamp") AS DATE) AS week FROM sessionated))
GROUP BY 1, 2""")
add("funnel", (*b.TO_SESSIONATED, """
s1 AS (SELECT client_id, min("timestamp") AS at FROM sessionated WHERE event_name = 'pageview' GROUP BY 1),
s2 AS (SELECT client_id, min("timestamp") AS at FROM sessionated JOIN s1 USING (client_id)
       WHERE event_name = 'add_to_cart' AND "timestamp" >= s1.at GROUP BY 1),
s3 AS (SELECT client_id, min("timestamp") AS at FROM sessionated JOIN s2 USING (client_id)
       WHERE event_name = 'begin_checkout' AND "timestamp" >= s2.at GROUP BY 1),
s4 AS (SELECT client_id, min("timestamp") AS at FROM sessionated JOIN s3 USING (client_id)
       WHERE event_name = 'purchase' AND "timestamp" >= s3.at GROUP BY 1)"""), """
SELECT CAST(1 AS BIGINT) AS step, 'pageview' AS event_name, (SELECT count(*) FROM s1) AS clients
UNION ALL SELECT 2, 'add_to_cart', (SELECT count(*) FROM s2)
UNION ALL SELECT 3, 'begin_checkout', (SELECT count(*) FROM s3)
UNION ALL SELECT 4, 'purchase', (SELECT count(*) FROM s4)""")
add("burst_flags", b.TO_EVENTS, """
SELECT hash, date_trunc('minute', "timestamp") AS window_start,
  date_trunc('minute', "timestamp") + INTERVAL 1 MINUTE AS window_end, count(*) AS events
FROM tracked GROUP BY 1, 2, 3 HAVING count(*) > 1""")
add("retention_purge", b.TO_EVENTS, """
SELECT CAST("timestamp" AS DATE) AS date, count(*) AS events FROM tracked
WHERE CAST("timestamp" AS DATE) >= DATE '2025-03-11' - INTERVAL 14 MONTH GROUP BY 1""")
add("users_incremental", b.TO_EVENTS, """
SELECT client_id, user_id, min("timestamp") AS first_seen, max("timestamp") AS last_seen,
  count(DISTINCT CAST("timestamp" AS DATE)) AS days_active FROM tracked GROUP BY 1, 2""")

ORACLES["sessions_incremental"] = ORACLES["sessions"]
_STATES = f"{_ROLLED.replace('touchpoints, ', '')}, ext_sources, {_ENDS}"
add("clients_incremental", TO_CLIENTS, f"SELECT client_id, {_STATES} FROM rolled")
add("users_model_incremental", (*_MAPPED, roll_up("user_id", "mapped")), f"SELECT user_id, {_STATES} FROM rolled")
ORACLES["daily_kpis_incremental"] = ORACLES["daily_kpis"]
ORACLES["published_views"] = ORACLES["published_tables"] = ORACLES["daily_kpis"]
for _key in ("sessionated_incremental", "sessionated_stream"):
    add(_key, b.TO_SESSIONATED, "SELECT event_id, client_id, block_id, session_id FROM sessionated")
add("events_append", b.TO_EVENTS, """
SELECT CAST("timestamp" AS DATE) AS date, event_name, count(*) AS events, CAST(0 AS BIGINT) AS ids_lacking,
  CAST(0 AS BIGINT) AS ids_changed
FROM tracked GROUP BY 1, 2""")
add("events_days", b.TO_EVENTS, """
SELECT event_id, "timestamp", event_name, url FROM tracked
WHERE CAST("timestamp" AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-09'""")
ORACLES["ga4_enrich"] = f"""
SELECT c.event_id, c.category, v.is_valid, a.value, e.engagement_time, d.device_category,
  custom_dimension1, custom_dimension2, custom_dimension3, custom_metric1, custom_metric2, custom_metric3,
  u.user_type, u.user_tier, t.gclid
FROM ({ORACLES["ga4_category"]}) c JOIN ({ORACLES["ga4_valid"]}) v USING (event_id)
  JOIN ({ORACLES["ga4_value"]}) a USING (event_id) JOIN ({ORACLES["ga4_engagement"]}) e USING (event_id)
  JOIN ({ORACLES["ga4_device_category"]}) d USING (event_id) JOIN ({ORACLES["ga4_custom_dims"]}) USING (event_id)
  JOIN ({ORACLES["ga4_custom_metrics"]}) USING (event_id) JOIN ({ORACLES["ga4_user_props"]}) u USING (event_id)
  JOIN ({ORACLES["ga4_traffic_source"]}) t USING (event_id)"""

# --- Ingest
_AGENTS = ", ".join(f"'{a}'" for a in (
    "Mozilla/5.0 (iPhone; CPU iPhone OS 17_2 like Mac OS X) Version/17.2 Mobile Safari/604.1",
    "Mozilla/5.0 (iPad; CPU OS 16_6 like Mac OS X) Version/16.6 Mobile Safari/604.1",
    "Mozilla/5.0 (Linux; Android 14; SM-S918B) Chrome/120.0.6099.43 Mobile Safari/537.36",
    "Mozilla/5.0 (Windows NT 10.0; Win64) Chrome/120.0.0.0 Safari/537.36 Edg/120.0.2210.61",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) Version/17.1 Safari/605.1.15",
    "Mozilla/5.0 (compatible; Googlebot/2.1)",
    "Mozilla/5.0 (X11; Linux x86_64; rv:121.0) Gecko/20100101 Firefox/121.0",
    "",
))
LANDED = (b.ADAPTER, f"""
landed AS (
  SELECT event_id, "timestamp" AS received_at, event_id % 3 AS turn, event_name, url, referrer, client_id, hash AS vhash,
    CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN '2001:db8::' || (event_id % 50) WHEN 2 THEN '::1'
      ELSE '10.0.' || (event_id % 7) || '.' || (event_id % 40) END AS peer,
    CASE WHEN event_id % 4 = 0 THEN '93.184.' || (event_id % 5) || '.' || (event_id % 100) END AS fwd,
    [{_AGENTS}][event_id % 8 + 1] AS agent,
    CASE WHEN event_id % 9 = 0 THEN hash END AS hash_cookie,
    CASE WHEN event_id % 31 = 0 THEN '' ELSE event_name END AS json_name,
    CASE WHEN event_id % 37 = 0 THEN '"text"'
      WHEN event_name = 'consent' THEN CASE WHEN event_id % 8 = 2 THEN '{{"id":true}}' ELSE '{{"id":false}}' END
      ELSE '{{"n":' || event_id || ',"tag":"a b"}}' END AS json_p
  FROM tracked
),
merged_hits AS (
  SELECT *,
    CASE turn WHEN 0 THEN event_name WHEN 1 THEN event_name ELSE json_name END AS en,
    url AS u_rl, referrer AS r, CASE WHEN turn = 2 AND event_id % 47 <> 2 THEN 'form' END AS et,
    CASE WHEN turn = 2 AND event_id % 43 = 2 THEN '0' END AS u,
    CASE turn WHEN 1 THEN '"{{\\"a\\":1}}"' WHEN 2 THEN json_p END AS p
  FROM landed
),
defaulted AS (
  SELECT m.*, coalesce(nullif(et, ''), 'event') AS et1,
    coalesce(nullif(fwd, ''), nullif(peer, ''), '127.0.0.1') AS ip0,
    CASE WHEN turn = 2 AND json_name = 'consent' AND json_p LIKE '%"id":%' THEN json_p = '{{"id":true}}' END AS consent
  FROM merged_hits m
),
hashed AS (
  SELECT *, sha256(ip0 || agent || sha256('salt' || strftime(received_at, '%Y-%m-%d'))) AS h,
    CASE WHEN contains(ip0, '127.0.0.1') OR ip0 = '::1'
      THEN '2a02:3100:1da8:1d00:d575:624d:f65a:e8ae' ELSE ip0 END AS ip
  FROM defaulted
),
granted AS (
  SELECT * EXCLUDE (client_id), CASE WHEN consent AND client_id IS NULL
    THEN regexp_replace(sha256(h || '|' || epoch_us(received_at) || '|' || url),
      '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}}).*$', '\\1-\\2-\\3-\\4-\\5')
    ELSE client_id END AS client_id
  FROM hashed
),
truncated AS (
  SELECT *, CASE WHEN contains(ip, '::')
      THEN array_to_string(list_filter(string_split(split_part(ip, '::', 1), ':'), lambda g: g <> '')[1:4], ':') || '::'
    WHEN contains(ip, ':') THEN array_to_string(string_split(ip, ':')[1:4], ':') || '::'
    ELSE array_to_string(string_split(ip, '.')[1:3], '.') || '.0' END AS ip_trunc
  FROM granted
),
geo AS (
  SELECT '10.0.' || (c_custkey % 7) || '.' || (c_custkey % 40) AS ip_mask, min(r_name) AS continent,
    min(n_name) AS country
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1
),
located AS (
  SELECT t.*, g.continent, g.country, substr(g.country, 1, 2) AS country_code, NULL::VARCHAR AS city
  FROM truncated t LEFT JOIN geo g ON t.ip = g.ip_mask
)""")
_EVENTS_OF_HITS = """
SELECT event_id, received_at AS "timestamp", et1 AS event_type, en AS event_name, agent AS user_agent, url,
  coalesce(r, '') AS referrer, client_id, h AS hash, u AS user_id, NULL::VARCHAR AS device_type,
  NULL::VARCHAR AS device_brand, country FROM located"""
add("ingest_merge", LANDED, "SELECT event_id, en, u_rl AS url, r, et, p FROM merged_hits")
add("ingest_defaults", LANDED, """
SELECT event_id, et1 AS et, agent AS ua, client_id AS c, h, coalesce(hash_cookie, h) AS h1, ip0 AS ch
FROM granted""")
add("client_ip", LANDED, "SELECT event_id, ip0 AS ip FROM defaulted")
add("ip_truncate", LANDED, "SELECT event_id, ip_trunc FROM truncated")
add("visitor_hash", LANDED, "SELECT event_id, h, sha256(agent) AS agent_hash FROM hashed")
add("salt_retention", b.TO_EVENTS, """
SELECT DISTINCT CAST("timestamp" AS DATE) AS salt_date, sha256('salt' || strftime("timestamp", '%Y-%m-%d')) AS salt
FROM tracked WHERE CAST("timestamp" AS DATE) >= CAST(TIMESTAMP '2024-01-20 06:00:00' - INTERVAL 24 HOUR AS DATE)""")
add("salt_upkeep", b.TO_EVENTS, """
SELECT DISTINCT CAST("timestamp" AS DATE) AS salt_date, CAST(36 AS BIGINT) AS salt_length FROM tracked
WHERE CAST("timestamp" AS DATE) >= DATE '2024-01-10'""")
add("geo_enrich", LANDED, "SELECT event_id, ip, continent, country, country_code, city FROM located")
add("geo_ranges", (*LANDED, """
networks AS (
  SELECT DISTINCT 1 AS family, (10 << 24) + ((c_custkey % 7) << 8) + c_custkey % 40 AS first,
    (10 << 24) + ((c_custkey % 7) << 8) + c_custkey % 40 AS last, 'customer' AS country
  FROM customer WHERE c_custkey % 3 = 0
  UNION ALL
  SELECT 1, (10 << 24) + ((n_nationkey % 7) << 8) + 16 * (n_nationkey % 4) AS first,
    (10 << 24) + ((n_nationkey % 7) << 8) + 16 * (n_nationkey % 4) + 15, min(n_name)
  FROM nation GROUP BY 2, 3
  UNION ALL SELECT 1, 10 << 24, (10 << 24) + (1 << 19) - 1, 'wide'
  UNION ALL SELECT 2, ((10754::HUGEINT * 65536 + 12544) * 65536 + 7584 + n_nationkey) * 65536,
    ((10754::HUGEINT * 65536 + 12544) * 65536 + 7584 + n_nationkey) * 65536 + 65535, n_name FROM nation
  UNION ALL SELECT 2, 10754::HUGEINT * 281474976710656, 10755::HUGEINT * 281474976710656 - 1, 'wide'
),
-- the highest 64 bits, 2a02:3100:1da8:1d00, of the one address of the second kind that lies in a network
placed AS (
  SELECT event_id, ip, if(contains(ip, ':'), 2, 1) AS family,
    CASE WHEN ip LIKE '2001:db8:%' THEN 0 WHEN contains(ip, ':') THEN ((10754::HUGEINT * 65536 + 12544) * 65536 + 7592) * 65536 + 7424
      ELSE CAST(split_part(ip, '.', 1) AS HUGEINT) * 16777216 + CAST(split_part(ip, '.', 2) AS HUGEINT) * 65536
        + CAST(split_part(ip, '.', 3) AS HUGEINT) * 256 + CAST(split_part(ip, '.', 4) AS HUGEINT) END AS number
  FROM located
)"""), """
SELECT event_id, ip, country, substr(country, 1, 2) AS country_code, NULL::VARCHAR AS city
FROM placed p LEFT JOIN networks n ON p.family = n.family AND p.number BETWEEN n.first AND n.last
QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY n.last - n.first) = 1""")
_PARSED_AGENT = """
parsed AS (
  SELECT *, regexp_matches(lower(agent), 'bot|crawl|spider|slurp') AS bot,
    regexp_extract(agent, '(iPad|iPhone|iPod|SM-|Samsung|Pixel|Macintosh)', 1) AS thing,
    regexp_extract(agent, 'Version/([0-9.]+)', 1) AS safari, regexp_extract(agent, 'Chrome/([0-9.]+)', 1) AS chrome,
    regexp_extract(agent, 'Edg/([0-9.]+)', 1) AS edge, regexp_extract(agent, 'Firefox/([0-9.]+)', 1) AS firefox,
    regexp_extract(agent, 'Android ([0-9.]+)', 1) AS android, regexp_extract(agent, 'Windows NT ([0-9.]+)', 1) AS windows,
    replace(regexp_extract(agent, 'OS ([0-9_]+) like Mac', 1), '_', '.') AS ios,
    replace(regexp_extract(agent, 'Mac OS X ([0-9_]+)', 1), '_', '.') AS mac
  FROM landed
),
device AS (
  SELECT *, CASE WHEN bot THEN 'Spider' WHEN thing IN ('SM-', 'Samsung') THEN 'Samsung'
      WHEN thing = 'Macintosh' THEN 'Mac' WHEN thing <> '' THEN thing ELSE 'Other' END AS "type",
    CASE WHEN edge <> '' THEN 'Edge' WHEN firefox <> '' THEN 'Firefox' WHEN chrome <> '' THEN 'Chrome'
      WHEN contains(agent, 'Safari/') THEN if(thing IN ('iPhone', 'iPad'), 'Mobile Safari', 'Safari')
      ELSE 'Other' END AS browser,
    CASE WHEN ios <> '' THEN 'iOS' WHEN android <> '' THEN 'Android' WHEN windows <> '' THEN 'Windows'
      WHEN mac <> '' THEN 'Mac OS X' WHEN contains(agent, 'Linux') THEN 'Linux' ELSE 'Other' END AS os
  FROM parsed
)"""
add("device_enrich", (*LANDED, _PARSED_AGENT), """
SELECT event_id, "type",
  CASE WHEN "type" = 'Samsung' THEN 'Samsung' WHEN "type" NOT IN ('Spider', 'Other') THEN 'Apple' END AS brand,
  CASE WHEN "type" NOT IN ('Spider', 'Other', 'Samsung') THEN "type" END AS model,
  browser, coalesce(nullif(CASE browser WHEN 'Edge' THEN edge WHEN 'Firefox' THEN firefox WHEN 'Chrome' THEN chrome
    WHEN 'Other' THEN '' ELSE safari END, ''), '0.0.0') AS browser_version,
  os, coalesce(nullif(CASE os WHEN 'iOS' THEN ios WHEN 'Android' THEN android WHEN 'Windows' THEN windows
    WHEN 'Mac OS X' THEN mac ELSE '' END, ''), '0.0.0') AS os_version,
  bot AS is_bot
FROM device""")
add("ingest_events", (*LANDED, _PARSED_AGENT), """
SELECT l.received_at AS "timestamp", et1 AS event_type, en AS event_name, coalesce(p, '{}') AS parameters,
  l.agent AS user_agent, l.url, coalesce(r, '') AS referrer, l.client_id, h AS hash, u AS user_id,
  l.client_id IS NOT NULL AS consent_given, os, ip_trunc, country
FROM located l JOIN device d ON d.event_id = l.event_id""")
add("consent_ledger", LANDED, """
SELECT h AS hash, received_at AS decided_at, consent, consent AS has_id FROM hashed WHERE consent IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY h ORDER BY received_at DESC) = 1""")
add("ingest_rejects", LANDED, """
SELECT CAST(received_at AS DATE) AS date, 'no_hash' AS reason, count(*) AS events FROM landed
WHERE received_at < TIMESTAMP '2024-01-10' GROUP BY 1""")
add("ingest_salted", LANDED, """
SELECT CAST(received_at AS DATE) AS date, count(*) AS events, count(DISTINCT ip0 || '|' || agent) AS visitors
FROM defaulted GROUP BY 1""")
add("ingest_stream", LANDED, """
SELECT CAST(received_at AS DATE) AS date, count(*) AS events, count(DISTINCT ip0 || '|' || agent) AS visitors,
  count(*) AS ids_kept
FROM defaulted GROUP BY 1""")
ORACLES["hits_to_sessions"] = f"""
WITH tracked AS ({b.chain(*LANDED)} {_EVENTS_OF_HITS}), {",".join(b.TO_SESSIONS[1:])}
SELECT client_id, hash, start_ts, end_ts, hits, pageviews, is_external FROM sessions"""
add("invalid_hits", LANDED, """
SELECT event_id, concat_ws('; ',
  CASE WHEN coalesce(en, '') = '' THEN 'event_name_missing' END,
  CASE WHEN turn = 1 OR (turn = 2 AND json_p = '"text"') THEN 'parameters_no_object' END) AS reasons
FROM merged_hits WHERE coalesce(en, '') = '' OR turn = 1 OR (turn = 2 AND json_p = '"text"')""")

# --- Streams: blocks closed by the end of the stream
add("live_sessions", b.TO_BLOCKS, """
SELECT hash, block_start, max("timestamp") AS block_end, count(*) AS events,
  count(*) FILTER (event_name = 'pageview') AS pageviews
FROM placed GROUP BY hash, block_start
HAVING max("timestamp") + INTERVAL 1800000999 MICROSECOND
  <= date_trunc('millisecond', (SELECT max("timestamp") FROM tracked)) - INTERVAL 10 MINUTE""")

add("live_bursts", b.TO_EVENTS, """
SELECT hash, date_trunc('hour', "timestamp") AS window_start,
  date_trunc('hour', "timestamp") + INTERVAL 1 HOUR AS window_end, count(*) AS events
FROM tracked GROUP BY 1, 2, 3
HAVING count(*) > 1 AND date_trunc('hour', "timestamp") + INTERVAL 1 HOUR
  <= date_trunc('millisecond', (SELECT max("timestamp") FROM tracked)) - INTERVAL 10 MINUTE""")
