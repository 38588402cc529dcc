"""Client address columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- Fixed values -----------------------------------------------------------
FALLBACK_IP = "127.0.0.1"
LOCALHOST_STAND_IN = "2a02:3100:1da8:1d00:d575:624d:f65a:e8ae"
# ----------------------------------------------------------------------------


def filled(value: Column) -> Column:
    """The value, with '' as NULL."""
    return F.nullif(value, F.lit(""))


def client_ip(headers: Column, remote_addr: Column) -> Column:
    """Forwarded-for header, else the peer address, else localhost.

    A header that lists several addresses is taken as it stands.
    """
    return F.coalesce(
        filled(headers["X-Forwarded-For"]),
        filled(headers["x-forwarded-for"]),
        filled(remote_addr),
        F.lit(FALLBACK_IP),
    )


def sanitize_ip(ip: Column) -> Column:
    """Replace localhost by a fixed public address."""
    local = ip.contains(FALLBACK_IP) | (ip == "::1")
    return F.when(local, F.lit(LOCALHOST_STAND_IN)).otherwise(ip)


def truncate_ip(ip: Column) -> Column:
    """Drop the host part: last octet of IPv4, all but four groups of IPv6."""
    has_gap = ip.contains("::")
    head = F.substring_index(ip, "::", 1)
    groups = F.split(F.when(has_gap, head).otherwise(ip), ":", -1)
    kept = F.when(has_gap, F.filter(groups, lambda g: g != "")).otherwise(groups)
    v6 = F.concat(F.array_join(F.slice(kept, 1, 4), ":"), F.lit("::"))
    v4 = F.concat(F.array_join(F.slice(F.split(ip, r"\.", -1), 1, 3), "."), F.lit(".0"))
    return F.when(ip == "", F.lit("")).when(ip.contains(":"), v6).otherwise(v4)


def _hex_groups(text: Column) -> Column:
    """Groups between colons as four hex digits each; an empty text has none."""
    groups = F.filter(F.split(text, ":", -1), lambda g: g != "")
    return F.transform(groups, lambda g: F.lpad(F.lower(g), 4, "0"))


def _v4_hex(text: Column) -> Column:
    """Dotted text as eight hex digits."""
    parts = F.transform(F.split(text, r"\.", -1), lambda p: F.lpad(F.lower(F.hex(p.cast("int"))), 2, "0"))
    return F.array_join(parts, "")


def with_ip_halves(rows: DataFrame, ip: Column) -> DataFrame:
    """Add the 128 bits of an address as two longs, ``high`` and ``low``.

    IPv4 counts as mapped (::ffff:a.b.c.d); both are NULL if the text is no address.
    """
    byte = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    dotted = rf"{byte}(\.{byte}){{3}}"
    one = "[0-9A-Fa-f]{1,4}"
    some = f"({one}(:{one})*)?"
    text, v4, v6 = F.col("_text"), F.col("_v4"), F.col("_v6")
    head, rest, gap = F.col("_head"), F.col("_rest"), v6.contains("::")
    # the last two groups may be written as IPv4
    as_groups = F.concat(F.substring(v4, 1, 4), F.lit(":"), F.substring(v4, 5, 4))
    cut = F.regexp_replace(text, r"[0-9.]+$", "")
    after = F.when(gap, _hex_groups(F.regexp_replace(v6, "^.*?::", "")))
    groups = F.size(head) + F.size(rest)
    zeros = F.array_repeat(F.lit("0000"), 8 - groups)
    whole = F.when(v6.rlike(f"^{some}(::{some})?$") & F.when(gap, groups <= 7).otherwise(groups == 8), F.concat(head, zeros, rest))
    mapped = F.when(v4.isNotNull(), F.concat(F.lit("0" * 20 + "ffff"), v4))
    half = lambda start: F.conv(F.substring("_digits", start, 16), 16, -10).cast("long")
    return (
        rows.withColumn("_text", ip)
        .withColumn("_v4", F.when(text.rlike(rf"^(.*:)?{dotted}$"), _v4_hex(F.substring_index(text, ":", -1))))
        .withColumn("_v6", F.when(text.contains(":"), F.when(v4.isNull(), text).otherwise(F.concat(cut, as_groups))))
        .withColumn("_head", _hex_groups(F.substring_index(v6, "::", 1)))
        .withColumn("_rest", F.coalesce(after, F.array().cast("array<string>")))
        .withColumn("_digits", F.when(v6.isNotNull(), F.array_join(whole, "")).otherwise(mapped))
        .withColumns({"high": half(1), "low": half(17)})
        .drop("_text", "_v4", "_v6", "_head", "_rest", "_digits")
    )


def masked(half: Column, bits: Column) -> Column:
    """The first ``bits`` of a long, which may be below 0 or above 64; the rest zero."""
    kept = F.least(F.greatest(bits, F.lit(0)), F.lit(64))
    mask = F.when(kept == 0, F.lit(0).cast("long")).otherwise(
        F.call_function("shiftleft", F.lit(-1).cast("long"), (64 - kept).cast("int"))
    )
    return half.bitwiseAND(mask)
