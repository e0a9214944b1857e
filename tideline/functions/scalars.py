"""Scalar column functions: exact decimals, level ids, time parts, rates, checksums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def decimal_status(text: Column, decimals: int) -> Column:
    """Ok, Malformed, PrecisionLoss or Overflow for a decimal text scaled by 10**decimals. A null text is Malformed."""
    sig = _significant(text, decimals)
    return (
        F.when(text.isNull() | ~text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"), "Malformed")
        .when(F.length(_fraction(text)) > decimals, "PrecisionLoss")
        .when(F.length(sig) > 18, "Overflow").otherwise("Ok")
    )


def _fraction(text: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(text, r"\.([0-9]*)$", 1), "0+$", "")


def _significant(text: Column, decimals: int) -> Column:
    whole = F.regexp_extract(text, r"^[+-]?([0-9]*)", 1)
    return F.regexp_replace(F.concat(whole, F.rpad(_fraction(text), decimals, "0") if decimals else F.lit("")), "^0+", "")


def scaled_decimal(text: Column, decimals: int) -> Column:
    """The scaled integer, null unless decimal_status is Ok."""
    digits = _significant(text, decimals)
    value = F.when(digits == "", F.lit(0).cast("long")).otherwise(digits.try_cast("long"))
    return F.when(decimal_status(text, decimals) == "Ok", F.when(text.startswith("-"), -value).otherwise(value))


def level_id(price: Column, side: Column) -> Column:
    """The id of a price level: twice the price, plus one on the ask side."""
    return price * 2 + side.cast("long")


def opposite(side: Column) -> Column:
    return 1 - side


def crosses(side: Column, resting: Column, price: Column) -> Column:
    """Whether an order at price trades against a resting level of ``side``: bids at or above it, asks at or below it."""
    return F.when(side == 0, price <= resting).otherwise(price >= resting)


def ppm(matched: Column, compared: Column) -> Column:
    """Matched of compared in millionths, rounded down; 0 if nothing was compared."""
    return F.when(compared > 0, F.floor(matched * F.lit(1_000_000) / F.when(compared > 0, compared))).otherwise(0).cast("long")


def percent_text(ppm_: Column) -> Column:
    """Millionths as a percentage with four decimals."""
    return F.concat(F.floor(ppm_ / 10000).cast("string"), F.lit("."), F.lpad((ppm_ % 10000).cast("string"), 4, "0"), F.lit("%"))


def band_price(mid: Column, pct_tenths: Column) -> Column:
    """The price of a band that lies pct_tenths thousandths off the mid."""
    return mid * (1 + pct_tenths / 1000)


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def sqrt_cost(qty: Column, sigma: Column, volume: Column, y: float = 1.0) -> Column:
    """Square-root reference cost y * sigma * sqrt(qty / volume)."""
    return F.lit(y) * sigma * F.sqrt(qty / volume)


# Fixed values of the published 64-bit FNV-1a.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a(data: bytes, h: int = FNV_OFFSET) -> int:
    """64-bit FNV-1a; h carries on from earlier bytes."""
    for b in data:
        h = (h ^ b) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
    return h


@F.pandas_udf(StringType())
def fnv1a_hex(s):
    """Checksum of each text as 16 hex digits; null for null."""
    return s.map(lambda t: None if t is None else f"{fnv1a(t.encode()):016x}")
