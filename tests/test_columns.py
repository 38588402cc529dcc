"""Golden values of single-row functions."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from footfall import config
from footfall.functions import device, ga4, ids, network, urls

# url, page_location, host, domain, request pageview, click id, utm.source
URLS = [
    ("https://www.shop.example.com/a/b.html?utm_source=news&utm_medium=email&x=1",
     "/a/b.html?x=1", "www.shop.example.com", "example.com", False, None, "news"),
    ("https://example.com", "", "example.com", "example.com", True, None, None),
    ("https://example.com/?gclid=abc", "/", "example.com", "example.com", True, ("gclid", "abc"), None),
    ("https://example.com/p?x=1&utm_source=y", "/p?x=1&", "example.com", "example.com", True, None, "y"),
    ("https://example.com/p?utm_source=y#top", "/p#top", "example.com", "example.com", True, None, "y"),
    ("https://example.com/p?gclid=&fbclid=z", "/p", "example.com", "example.com", True, ("gclid", "z"), None),
    ("https://example.co.uk:8080/x?next=https://o.com/q", "/x?next=/q", "example.co.uk:8080", "co.uk",
     True, None, None),
    ("https://example.com/p?my_utm_source=1", "/p?my_", "example.com", "example.com", True, None, "1"),
    ("https://example.com/a?x=1&gclid=2&y=3#f", "/a?x=1&y=3#f", "example.com", "example.com", True,
     ("gclid", "2"), None),
    ("https://example.com/a#tblciGiA", "/a", "example.com", "example.com", True, None, None),
    ("/rel/path.pdf", "/rel/path.pdf", None, None, False, None, None),
    ("http://localhost/x", "/x", "localhost", None, True, None, None),
    ("https://example.com/p?utm_source_platform=a", "/p?utm_source_platform=a", "example.com",
     "example.com", True, None, None),
    ("", "", None, None, False, None, None),
]


def test_urls(spark):
    url = F.col("url")
    rows = (
        spark.createDataFrame([(i, u[0]) for i, u in enumerate(URLS)], "i int, url string")
        .select(
            "i",
            urls.page_location(url).alias("page"),
            urls.host(url).alias("host"),
            urls.domain(url).alias("domain"),
            urls.is_pageview(F.lit("text/html"), url).alias("view"),
            urls.click_id(url).alias("clid"),
            urls.utm(url).alias("utm"),
        )
        .orderBy("i")
        .collect()
    )
    for row, (url, page, host, domain, view, clid, source) in zip(rows, URLS, strict=True):
        assert (row.page, row.host, row.domain, row.view) == (page, host, domain, view), url
        assert (row.clid and tuple(row.clid)) == clid, url
        assert (row.utm and row.utm.source) == source, url


@pytest.mark.parametrize(
    ("referrer", "external"),
    [
        (None, False),
        ("", False),
        ("https://www.google.com/", True),
        ("https://checkout.stripe.com/p", False),
        ("https://sub.example.com/", False),
        ("https://accounts.google.com/x", False),
    ],
)
def test_external_referrer(spark, referrer, external):
    df = spark.createDataFrame([(referrer, "https://example.com/")], "r string, u string")
    assert df.select(urls.is_ext_referrer(F.col("r"), F.col("u"))).first()[0] is external


def test_request_pageviews_can_be_disabled(spark):
    cfg = config.Config(request_pageviews=False)
    flag = urls.is_pageview(F.lit("text/html"), F.lit("https://example.com/"), cfg)
    assert spark.range(1).select(flag).first()[0] is False


@pytest.mark.parametrize(
    ("ip", "short"),
    [
        ("192.168.1.77", "192.168.1.0"),
        ("10.0.0.1", "10.0.0.0"),
        ("2001:db8::1", "2001:db8::"),
        ("2a02:3100:1da8:1d00:d575:624d:f65a:e8ae", "2a02:3100:1da8:1d00::"),
        ("::1", "::"),
        ("::ffff:1.2.3.4", "::"),
        ("invalid", "invalid.0"),
        ("1.2.3.4, 5.6.7.8", "1.2.3.0"),
        ("", ""),
    ],
)
def test_truncate_ip(spark, ip, short):
    df = spark.createDataFrame([(ip,)], "ip string")
    assert df.select(network.truncate_ip(F.col("ip"))).first()[0] == short


def test_sanitize_ip(spark):
    df = spark.createDataFrame([("127.0.0.1",), ("::1",), ("8.8.8.8",)], "ip string")
    found = [r[0] for r in df.select(network.sanitize_ip(F.col("ip"))).collect()]
    assert found == [network.LOCALHOST_STAND_IN, network.LOCALHOST_STAND_IN, "8.8.8.8"]


def test_hashes(spark):
    row = spark.range(1).select(
        ids.visitor_hash(F.lit("1.2.3.4"), F.lit("agent"), F.lit("salt")).alias("visitor"),
        ids.visitor_hash(F.lit("1.2.3.4"), F.lit("agent"), F.lit("other")).alias("next_day"),
        ids.plain_hash(F.lit("x")).alias("plain"),
        ids.digest_id(F.lit("a"), F.lit(None).cast("string")).alias("missing"),
        ids.digest_id(F.lit("a"), F.lit(1)).alias("id"),
    ).first()
    assert row.visitor == hashlib.sha256(b"1.2.3.4agentsalt").hexdigest() != row.next_day
    assert row.plain == hashlib.sha256(b"x").hexdigest()
    assert row.missing is None and len(row.id) == 44


def test_bot_flag_is_three_valued(spark):
    rows = [("h", False), ("Googlebot", None), (None, False), (None, True)]
    df = spark.createDataFrame(rows, "ua string, b boolean")
    dev = F.struct(
        *[F.lit(None).cast("string").alias(n) for n in
          ("type", "brand", "model", "browser", "browser_version", "os", "os_version")],
        F.col("b").alias("is_bot"),
    )
    flagged = df.select(device.flag_bots(dev, F.col("ua")).alias("d"))
    assert [r.d.is_bot for r in flagged.collect()] == [False, True, None, True]


def _doc(spark, text, name="purchase", **kw):
    df = spark.createDataFrame([(name, text)], "event_name string, parameters string")
    return ga4.parse(df, **kw)


def test_scalars_from_json(spark):
    text = (
        '{"currency":{"a":1},"coupon":"{x","affiliation":"{\\"a\\":1}","value":"9.5","tax":1.50,'
        '"shipping":"bad","payment_type":null,"transaction_id":12,"method":true}'
    )
    df, doc = _doc(spark, text)
    row = df.select(
        ga4.purchase(doc, F.col("event_name")).alias("p"), doc.text("tax").alias("tax"),
        doc.text("method").alias("method"),
    ).first()
    assert row.p.currency is None  # an object is not a scalar
    assert row.p.coupon == "{x" and row.p.affiliation == '{"a":1}'  # but a text is
    assert (row.p.value, row.p.tax, row.p.shipping) == (9.5, 1.5, None)
    assert row.p.payment_type is None and row.p.transaction_id == "12"
    assert row.tax == "1.5" and row.method == "true"


def test_strict_numbers_raise(spark):
    df, doc = _doc(spark, '{"value":"bad"}', strict=True)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        df.select(ga4.value(doc)).collect()


@pytest.mark.parametrize("text", ["not json", "[1]", None, '{"user_properties":5,"items":{"a":1}}'])
def test_awkward_documents(spark, text):
    df, doc = _doc(spark, text)
    row = df.select(
        ga4.value(doc).alias("value"),
        ga4.items(doc, F.col("event_name")).alias("items"),
        ga4.user_properties(doc).alias("u"),
    ).first()
    assert row.value == 0 and row.items == [] and row.u.user_type is None


def test_items(spark):
    text = '{"items":[{"item_id":"a","price":"2.5","quantity":2,"coupon":[1]},7,{}],"value":1}'
    rows = spark.createDataFrame(
        [("purchase", text), ("view_cart", text), ("view_item", text), ("purchase", "{}")],
        "event_name string, parameters string",
    )
    found = [r.item for r in ga4.with_parameters(rows, ("item",)).select("item").collect()]
    assert [len(f) for f in found] == [3, 3, 0, 0]
    first = found[0][0]
    assert (first.item_id, first.price, first.quantity, first.coupon) == ("a", 2.5, 2, None)
    assert found[0][1].item_id is None


def test_nested_fields_next_to_a_bad_one(spark):
    df, doc = _doc(spark, '{"user_properties":5,"traffic_source":{"name":"n","medium":{"x":1}},"value":3}')
    row = df.select(ga4.traffic_source(doc).alias("t"), ga4.value(doc).alias("v")).first()
    assert (row.t["name"], row.t.medium, row.v) == ("n", None, 3.0)


@pytest.mark.parametrize(
    ("name", "text", "valid"),
    [
        ("purchase", '{"currency":"EUR","value":1}', True),
        ("purchase", '{"currency":"EUR","value":0}', False),
        ("add_to_cart", '{"value":1}', False),
        ("begin_checkout", '{"currency":"EUR"}', False),
        ("view_item", '{"currency":"EUR","value":1}', True),  # no item id needed
        ("scroll", "{}", True),
        (None, "{}", True),
    ],
)
def test_valid_ecommerce(spark, name, text, valid):
    df, doc = _doc(spark, text, name)
    assert df.select(ga4.is_valid_ecommerce(doc, F.col("event_name"))).first()[0] is valid


def test_small_lookups(spark):
    row = spark.range(1).select(
        *[ga4.currency(F.lit(c).cast("string")).alias(f"c{i}") for i, c in enumerate((None, "XXX", "USD"))],
        *[ga4.event_category(F.lit(n).cast("string")).alias(f"n{i}")
          for i, n in enumerate((None, "purchase", "scroll", "login", "zzz"))],
    ).first()
    assert row[:3] == ("EUR", "EUR", "USD")
    assert row[3:] == ("other", "ecommerce", "engagement", "user_lifecycle", "custom")


@pytest.mark.parametrize(
    ("kind", "brand", "model", "category"),
    [
        ("tablet", None, None, "tablet"),
        ("Other", "Samsung", None, "mobile"),
        ("Other", "Apple", None, "desktop"),
        ("Other", "iPhone", None, "mobile"),
        (None, "iPad", "iPad Air", "tablet"),
        (None, None, None, "desktop"),
    ],
)
def test_device_category(spark, kind, brand, model, category):
    df = spark.createDataFrame([(kind, brand, model)], "k string, b string, m string")
    assert df.select(ga4.device_category(F.col("k"), F.col("b"), F.col("m"))).first()[0] == category


def test_config_rejects_slices_longer_than_the_gap():
    with pytest.raises(ValueError, match="gap"):
        config.Config(bin_seconds=1801)


def test_referral_rule_can_use_the_domain():
    assert config.Config(referral_from_domain=True).rules[3].source == "referring_domain"
    assert config.DEFAULT.rules[3].source == "'referring_domain'"
