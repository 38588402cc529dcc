"""E-commerce and engagement parameters of events.

``with_parameters`` adds the typed structs to an event table in one parse per
row; the single builders are its parts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall.functions.json import Document, text_fields

Fields = tuple[tuple[str, str], ...]


def _texts(*names: str) -> Fields:
    return tuple((name, "string") for name in names)


# --- Fixed values -----------------------------------------------------------
# Field, event, currency, category and brand names must equal the reference's.
_ITEM: Fields = (
    ("currency", "string"),
    ("value", "double"),
    ("item_id", "string"),
    ("item_name", "string"),
    ("item_brand", "string"),
    ("item_category", "string"),
    ("item_category2", "string"),
    ("item_category3", "string"),
    ("item_category4", "string"),
    ("item_category5", "string"),
    ("price", "double"),
    ("quantity", "bigint"),
    ("item_variant", "string"),
    ("item_list_id", "string"),
    ("item_list_name", "string"),
    ("item_list_index", "bigint"),
)

# column -> (event names, fields)
STRUCTS: dict[str, tuple[tuple[str, ...], Fields]] = {
    "ecommerce": (
        ("purchase",),
        (
            ("currency", "string"),
            ("value", "double"),
            ("transaction_id", "string"),
            ("coupon", "string"),
            ("shipping", "double"),
            ("tax", "double"),
            ("affiliation", "string"),
            ("shipping_tier", "string"),
            ("payment_type", "string"),
        ),
    ),
    "view_item_data": (("view_item",), _ITEM),
    "add_to_cart_data": (("add_to_cart",), _ITEM),
    "begin_checkout_data": (
        ("begin_checkout",),
        (("currency", "string"), ("value", "double"), *_texts("coupon", "shipping_tier", "payment_type")),
    ),
    "sign_up_data": (("sign_up",), _texts("method")),
    "login_data": (("login",), _texts("method")),
    "generate_lead_data": (("generate_lead",), (("currency", "string"), ("value", "double"))),
    "page_view_data": (("page_view",), _texts("page_title", "page_location", "page_referrer")),
    "scroll_data": (("scroll",), (("percent_scrolled", "double"),)),
    "video_data": (
        ("video_start", "video_progress", "video_complete"),
        _texts("video_title", "video_duration", "video_percent", "video_url", "video_provider"),
    ),
}

ITEM_EVENTS = ("purchase", "view_item_list", "view_cart")
ITEMS: Fields = (
    ("item_id", "string"),
    ("item_name", "string"),
    ("item_brand", "string"),
    ("item_variant", "string"),
    ("item_category", "string"),
    ("item_category2", "string"),
    ("item_category3", "string"),
    ("item_category4", "string"),
    ("item_category5", "string"),
    ("price", "double"),
    ("quantity", "bigint"),
    ("item_revenue", "double"),
    ("item_refund", "double"),
    ("coupon", "string"),
    ("affiliation", "string"),
    ("location_id", "string"),
    ("item_list_id", "string"),
    ("item_list_name", "string"),
    ("item_list_index", "bigint"),
    ("promotion_id", "string"),
    ("promotion_name", "string"),
    ("creative_name", "string"),
    ("creative_slot", "string"),
)

USER_PROPERTIES = _texts(
    "user_type",
    "user_tier",
    "subscription_status",
    "account_age_days",
    "last_purchase_date",
    "total_purchases",
    "lifetime_value",
)
TRAFFIC_SOURCE = _texts(
    "name",
    "medium",
    "source",
    "campaign",
    "term",
    "content",
    "mcc_click_id",
    "gclid",
    "dclid",
    "srsltid",
)

CURRENCIES = ("USD", "EUR", "GBP", "CAD", "AUD", "JPY", "CNY", "INR", "BRL", "MXN")
DEFAULT_CURRENCY = "EUR"

CATEGORIES = {
    "ecommerce": (
        "purchase",
        "view_item",
        "add_to_cart",
        "begin_checkout",
        "view_cart",
        "remove_from_cart",
        "view_item_list",
        "add_to_wishlist",
        "view_promotion",
        "select_promotion",
    ),
    "engagement": (
        "page_view",
        "scroll",
        "video_start",
        "video_progress",
        "video_complete",
        "file_download",
        "form_start",
        "form_submit",
    ),
    "user_lifecycle": (
        "sign_up",
        "login",
        "logout",
        "generate_lead",
        "join_group",
        "share",
        "search",
    ),
}

VALUE_EVENTS = ("purchase", "view_item", "add_to_cart", "begin_checkout")

DEVICE_TYPES = ("mobile", "tablet", "desktop")
APPLE_HANDHELDS = ("iPhone", "iPad", "iPod")
MOBILE_BRANDS = ("Samsung", "Huawei", "Xiaomi", "OnePlus", "Google")
DESKTOP_BRANDS = ("Apple", "Dell", "HP", "Lenovo", "ASUS", "Acer")
# ----------------------------------------------------------------------------

_FLAT = [name for _, fields in STRUCTS.values() for name, _ in fields]
_FLAT += ["engagement_time_msec"]


def _names(fields: Fields) -> list[str]:
    return [name for name, _ in fields]


def document_schema(dimensions: int = 0, metrics: int = 0) -> T.StructType:
    """What is read from ``parameters``: leaves as text, items as JSON texts."""
    custom = [f"custom_dimension{i + 1}" for i in range(dimensions)]
    custom += [f"custom_metric{i + 1}" for i in range(metrics)]
    flat = text_fields([*_FLAT, *custom])
    return T.StructType(
        flat.fields
        + [
            T.StructField("items", T.ArrayType(T.StringType())),
            T.StructField("user_properties", text_fields(_names(USER_PROPERTIES))),
            T.StructField("traffic_source", text_fields(_names(TRAFFIC_SOURCE))),
        ]
    )


def event_struct(doc: Document, event_name: Column, column: str) -> Column:
    """One of ``STRUCTS``: filled for its event names, else NULL."""
    events, fields = STRUCTS[column]
    return F.when(event_name.isin(*events), F.expr(doc.struct_sql(fields)))


def purchase(doc: Document, event_name: Column) -> Column:
    return event_struct(doc, event_name, "ecommerce")


def view_item(doc: Document, event_name: Column) -> Column:
    return event_struct(doc, event_name, "view_item_data")


def add_to_cart(doc: Document, event_name: Column) -> Column:
    return event_struct(doc, event_name, "add_to_cart_data")


def begin_checkout(doc: Document, event_name: Column) -> Column:
    return event_struct(doc, event_name, "begin_checkout_data")


def sign_up(doc: Document, event_name: Column) -> Column:
    return event_struct(doc, event_name, "sign_up_data")


def login(doc: Document, event_name: Column) -> Column:
    return event_struct(doc, event_name, "login_data")


def generate_lead(doc: Document, event_name: Column) -> Column:
    return event_struct(doc, event_name, "generate_lead_data")


def page_view(doc: Document, event_name: Column) -> Column:
    """Gated on ``page_view``; the tracker's own ``pageview`` does not match."""
    return event_struct(doc, event_name, "page_view_data")


def scroll(doc: Document, event_name: Column) -> Column:
    return event_struct(doc, event_name, "scroll_data")


def video(doc: Document, event_name: Column) -> Column:
    return event_struct(doc, event_name, "video_data")


def items(doc: Document, event_name: Column) -> Column:
    """Array of item structs; empty for other events or without items."""
    schema = text_fields(_names(ITEMS)).simpleString()
    texts = f"coalesce({doc.parsed}.items, array())"
    # Two steps, so that each item is parsed once.
    parsed = f"transform({texts}, x -> struct(x AS raw, from_json(x, '{schema}') AS parsed))"
    one = Document("i.raw", "i.parsed", doc.strict).struct_sql(ITEMS)
    every = f"transform({parsed}, i -> {one})"
    kinds = ", ".join(f"{name}: {kind}" for name, kind in ITEMS)
    none = f"cast(array() AS array<struct<{kinds}>>)"
    return F.when(event_name.isin(*ITEM_EVENTS), F.expr(every)).otherwise(F.expr(none))


def currency(code: Column) -> Column:
    """A known currency code, else the default one."""
    return F.when(code.isin(*CURRENCIES), code).otherwise(DEFAULT_CURRENCY)


def event_category(event_name: Column) -> Column:
    out = F.when(event_name.isNull(), "other")
    for category, names in CATEGORIES.items():
        out = out.when(event_name.isin(*names), category)
    return out.otherwise("custom")


def is_valid_ecommerce(doc: Document, event_name: Column) -> Column:
    """Value events need a currency and a value above zero; others pass."""
    lacking = (
        doc.text("currency").isNull()
        | doc.text("value").isNull()
        | F.coalesce(doc.number("value") <= 0, F.lit(False))
    )
    return ~F.coalesce(event_name.isin(*VALUE_EVENTS) & lacking, F.lit(False))


def value(doc: Document) -> Column:
    """The event's value, 0 without one."""
    return F.when(doc.text("value").isNull(), F.lit(0.0)).otherwise(doc.number("value"))


def custom_dimensions(doc: Document, n: int) -> list[Column]:
    names = [f"custom_dimension{i + 1}" for i in range(n)]
    return [doc.text(name).alias(name) for name in names]


def custom_metrics(doc: Document, n: int) -> list[Column]:
    names = [f"custom_metric{i + 1}" for i in range(n)]
    return [doc.number(name).alias(name) for name in names]


def user_properties(doc: Document) -> Column:
    return F.expr(doc.struct_sql(USER_PROPERTIES, "user_properties."))


def traffic_source(doc: Document) -> Column:
    return F.expr(doc.struct_sql(TRAFFIC_SOURCE, "traffic_source."))


def device_category(kind: Column, brand: Column, model: Column) -> Column:
    """mobile, tablet or desktop: by type, else by brand."""
    handheld = F.when(model.contains("iPad"), "tablet").otherwise("mobile")
    return (
        F.when(kind.isin(*DEVICE_TYPES), kind)
        .when(brand.isin(*APPLE_HANDHELDS), handheld)
        .when(brand.isin(*MOBILE_BRANDS), "mobile")
        .when(brand.isin(*DESKTOP_BRANDS), "desktop")
        .otherwise("desktop")
    )


def engagement_time(doc: Document) -> Column:
    """Milliseconds of engagement, 0 without."""
    name = "engagement_time_msec"
    none = F.lit(0).cast("bigint")
    return F.when(doc.text(name).isNull(), none).otherwise(doc.integer(name))


def parse(
    events: DataFrame,
    only: Sequence[str] | None = None,
    dimensions: int = 0,
    metrics: int = 0,
    strict: bool = False,
    name: str = "_document",
) -> tuple[DataFrame, Document]:
    """The table with ``parameters`` parsed once, and a handle to read from it.

    ``only`` restricts parsing to rows with those event names.
    """
    raw = F.col("parameters")
    wanted = raw if only is None else F.when(F.col("event_name").isin(*only), raw)
    parsed = F.from_json(wanted, document_schema(dimensions, metrics))
    return events.withColumn(name, parsed), Document("parameters", name, strict)


def with_parameters(
    events: DataFrame, columns: Sequence[str] = (*STRUCTS, "item"), strict: bool = False
) -> DataFrame:
    """Add the chosen structs, and ``item`` for the item array."""
    gates = {e for c in columns for e in (ITEM_EVENTS if c == "item" else STRUCTS[c][0])}
    out, doc = parse(events, sorted(gates), strict=strict)
    name = F.col("event_name")
    built = {
        c: items(doc, name) if c == "item" else event_struct(doc, name, c) for c in columns
    }
    return out.withColumns(built).drop("_document")


def with_enrichment(
    events: DataFrame, dimensions: int = 0, metrics: int = 0, strict: bool = False
) -> DataFrame:
    """All that the parameters and the device tell of an event, parsed once.

    Adds the structs of ``with_parameters`` and ``item``; ``currency``,
    ``category``, ``is_valid_ecommerce``, ``value``, ``engagement_time``,
    ``device_category``; ``user_properties`` and ``traffic_source``; and as many
    custom dimensions and metrics as asked for.
    """
    out, doc = parse(events, None, dimensions, metrics, strict)
    name, device = F.col("event_name"), F.col("device")
    out = out.withColumns(
        {c: event_struct(doc, name, c) for c in STRUCTS}
        | {
            "item": items(doc, name),
            "currency": currency(doc.text("currency")),
            "category": event_category(name),
            "is_valid_ecommerce": is_valid_ecommerce(doc, name),
            "value": value(doc),
            "engagement_time": engagement_time(doc),
            "device_category": device_category(device["type"], device["brand"], device["model"]),
            "user_properties": user_properties(doc),
            "traffic_source": traffic_source(doc),
        }
    )
    numbered = [*custom_dimensions(doc, dimensions), *custom_metrics(doc, metrics)]
    return out.select("*", *numbered).drop("_document")
