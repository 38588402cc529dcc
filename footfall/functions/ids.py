"""Digests and opaque ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest_id(*parts: Column) -> Column:
    """base64(sha256(concatenated text)); NULL if any part is NULL."""
    return F.base64(F.unhex(F.sha2(F.concat(*[p.cast("string") for p in parts]), 256)))


#: Stands for no text in a packed column; ``packed`` never gives it.
NOTHING = b""
_PLAIN, _HEX, _BASE64 = b"\x00", b"\x01", b"\x02"


def packed(text: Column) -> Column:
    """A shorter binary form of a digest: what lower-case hex or base64 stands for.

    Any other text is kept as it is, so ``unpacked`` gives back every text exactly and
    different texts stay different.  The order of texts is not kept.
    """
    from_hex = F.unhex(text)
    from_base64 = F.when(F.length(text) == 44, F.try_to_binary(text, F.lit("base64")))
    return (
        F.when(F.lower(F.hex(from_hex)) == text, F.concat(F.lit(_HEX), from_hex))
        .when(F.base64(from_base64) == text, F.concat(F.lit(_BASE64), from_base64))
        .otherwise(F.concat(F.lit(_PLAIN), text.cast("binary")))
    )


def unpacked(data: Column) -> Column:
    """The text that ``packed`` was given."""
    kind, rest = F.substring(data, 1, 1), F.substring(data, 2, 2**31 - 1)
    return (
        F.when(kind == F.lit(_HEX), F.lower(F.hex(rest)))
        .when(kind == F.lit(_BASE64), F.base64(rest))
        .otherwise(rest.cast("string"))
    )


def packed_beside(text: Column, other: Column) -> Column:
    """``text`` packed, or ``NOTHING`` where it equals ``other``."""
    return F.when(text == other, F.lit(NOTHING)).otherwise(packed(text))


def unpacked_beside(data: Column, other: Column) -> Column:
    """The text that ``packed_beside`` was given with ``other``."""
    return F.when(data == F.lit(NOTHING), other).otherwise(unpacked(data))


def plain_hash(text: Column) -> Column:
    """Hex sha256 of a string."""
    return F.sha2(text, 256)


def visitor_hash(ip: Column, user_agent: Column, salt: Column) -> Column:
    """Daily visitor hash: hex sha256 of ip, user agent and that day's salt."""
    blank = F.lit("")
    return F.sha2(F.concat(F.coalesce(ip, blank), F.coalesce(user_agent, blank), salt), 256)
