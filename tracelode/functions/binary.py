"""Numbers, times and checks read from binary columns with built-in functions.

Positions are 0-based and may be ints or columns.  Everything stays inside
generated JVM code; no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds between 1900 and 1970, and the year 2050 in Unix seconds.
NTP_OFFSET = 2208988800
UNIX_2050 = 2524608000


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def cut(data: Column, start, length) -> Column:
    """Byte slice; shorter at the end of the data."""
    return F.substring(data, _col(start) + 1, _col(length))


def flip(data: Column, length: int) -> Column:
    """Byte order reversed, byte by byte."""
    if length == 1:
        return data
    return F.concat(*[F.substring(data, i, 1) for i in range(length, 0, -1)])


def _hex(data: Column, start, length: int, endian: str) -> Column:
    piece = cut(data, start, length)
    ordered = flip(piece, length) if endian == "little" else piece
    return F.when(F.length(piece) == length, F.hex(ordered))


def uint(data: Column, start, length: int, endian: str = "big") -> Column:
    """Unsigned integer of 1..7 bytes as bigint, 8 bytes as decimal(20,0)."""
    if length < 8:
        return F.conv(_hex(data, start, length, endian), 16, 10).cast("long")
    return F.conv(_hex(data, start, 8, endian), 16, 10).cast("decimal(20,0)")


def sint(data: Column, start, length: int, endian: str = "big") -> Column:
    if length == 8:
        return F.conv(_hex(data, start, 8, endian), 16, -10).cast("long")
    value = uint(data, start, length, endian)
    half = 1 << (8 * length - 1)
    return F.when(value >= half, value - (half << 1)).otherwise(value)


def _ieee(bits: Column, exponent_bits: int, fraction_bits: int) -> Column:
    top = (1 << exponent_bits) - 1
    bias = top >> 1
    exponent = F.shiftrightunsigned(bits, fraction_bits).bitwiseAND(F.lit(top))
    fraction = bits.bitwiseAND(F.lit((1 << fraction_bits) - 1)).cast("double")
    negative = F.shiftrightunsigned(bits, exponent_bits + fraction_bits).bitwiseAND(F.lit(1)) == 1
    scale = float(1 << fraction_bits)
    normal = (1 + fraction / scale) * F.pow(F.lit(2.0), (exponent - bias).cast("double"))
    tiny = fraction / scale * F.pow(F.lit(2.0), F.lit(float(1 - bias)))
    size = F.when(exponent == 0, tiny).otherwise(normal)
    special = F.when(fraction == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    value = F.when(exponent == top, special).otherwise(size)
    return F.when(negative, -value).otherwise(value)


def float32(data: Column, start, endian: str = "big") -> Column:
    return _ieee(uint(data, start, 4, endian), 8, 23)


def float64(data: Column, start, endian: str = "big") -> Column:
    return _ieee(sint(data, start, 8, endian), 11, 52)


def is_finite(value: Column) -> Column:
    return ~F.isnan(value) & (F.abs(value) != float("inf"))


def unix_millis(data: Column, start, length: int, endian: str = "big") -> Column:
    """Timestamp as Unix milliseconds, or null outside 1970-2050.

    4 bytes: Unix seconds, then NTP seconds.  8 bytes: Unix seconds, Unix
    milliseconds, then 32.32 fixed-point NTP."""
    if length == 4:
        v = uint(data, start, 4, endian)
        return F.when(v <= UNIX_2050, v * 1000).when(v >= NTP_OFFSET, (v - NTP_OFFSET) * 1000)
    last = UNIX_2050 * 1000
    wide = uint(data, start, 8, endian)
    high = uint(data, _col(start) + (0 if endian == "big" else 4), 4, endian)
    low = uint(data, _col(start) + (4 if endian == "big" else 0), 4, endian)
    ntp = (high - NTP_OFFSET) * 1000 + F.floor(low * 1000 / F.lit(float(1 << 32))).cast("long")
    return (
        F.when(wide <= UNIX_2050, (wide * 1000).cast("long"))
        .when(wide <= last, wide.cast("long"))
        .when((ntp >= 0) & (ntp <= last), ntp)
    )


def ipv4(data: Column, start) -> Column:
    return F.concat_ws(".", *[uint(data, _col(start) + i, 1).cast("string") for i in range(4)])


def mac(data: Column, start) -> Column:
    return F.concat_ws(":", *[F.lower(F.hex(cut(data, _col(start) + i, 1))) for i in range(6)])


def byte_values(data: Column) -> Column:
    """All bytes as an int array."""
    return F.transform(
        F.sequence(F.lit(1), F.length(data)),
        lambda i: F.conv(F.hex(F.substring(data, i, 1)), 16, 10).cast("int"),
    )


def bytes_or_empty(data: Column) -> Column:
    """Byte array that is empty (not descending) for empty input."""
    return F.when(F.length(data) > 0, byte_values(data)).otherwise(F.array().cast("array<int>"))


def reasonable_share(text: Column) -> Column:
    """Share of acceptable characters; other control characters count half."""

    def held(characters: str) -> Column:
        """How many of the characters the text holds; the others, most of it, are not matched one by one."""
        return F.length(text) - F.length(F.regexp_replace(text, f"[{characters}]+", ""))

    odd, bad = held("\\x01-\\x08\\x0B\\x0C\\x0E-\\x1F"), held("\\x7F\\x80-\\x9F")
    return F.when(F.length(text) == 0, F.lit(1.0)).otherwise(1 - (odd * 0.5 + bad) / F.length(text))


def is_protocol_string(text: Column) -> Column:
    return reasonable_share(text) >= 0.9


def decode(data: Column, start, length: int, kind: str, endian: str = "big") -> Column:
    """Typed value by field type name; numbers come back as double."""
    if kind.startswith("UINT"):
        return uint(data, start, length, endian).cast("double")
    if kind.startswith("INT"):
        return sint(data, start, length, endian).cast("double")
    if kind == "FLOAT32":
        return F.round(float32(data, start, endian), 6)
    if kind == "FLOAT64":
        return F.round(float64(data, start, endian), 12)
    if kind == "TIMESTAMP":
        return unix_millis(data, start, length, endian).cast("double")
    raise ValueError(f"{kind} is not numeric")


def decode_text(data: Column, start, length: int, kind: str) -> Column:
    piece = cut(data, start, length)
    if kind == "IPV4":
        return ipv4(data, start)
    if kind == "MAC_ADDRESS":
        return mac(data, start)
    if kind in ("ASCII_STRING", "UTF8_STRING"):
        return F.try_validate_utf8(piece.cast("string"))
    return F.lower(F.hex(piece))
