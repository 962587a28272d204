"""Packed encodings as column arithmetic: date-times in 32 bits, quantised and truncated floats, zigzag and delta."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A packed date-time's fields from the highest bits down (name, bits, offset), 32 bits in all.
DATIME_FIELDS = (("year", 6, 1995), ("month", 4, 0), ("day", 5, 0), ("hour", 5, 0), ("minute", 6, 0), ("second", 6, 0))


def unpack_datime(packed: Column) -> Column:
    """A packed date-time as a timestamp without time zone."""
    raw, at, parts = packed.cast("bigint"), 32, []
    for _, bits, offset in DATIME_FIELDS:
        at -= bits
        parts.append((F.shiftright(raw, at).bitwiseAND(F.lit((1 << bits) - 1)) + offset).cast("int"))
    return F.make_timestamp_ntz(*parts)


def pack_datime(time: Column) -> Column:
    """A timestamp as a packed date-time (a bigint below 2^32)."""
    get = {"year": F.year, "month": F.month, "day": F.day, "hour": F.hour, "minute": F.minute, "second": F.second}
    out, at = F.lit(0).cast("bigint"), 32
    for name, bits, offset in DATIME_FIELDS:
        at -= bits
        out = out + F.shiftleft((get[name](time) - offset).cast("bigint"), at)
    return out


def dequantise(raw: Column, low: float, high: float, bits: int, closed: bool = False) -> Column:
    """A quantised value: low + raw (high - low) / 2^bits, or / (2^bits - 1) where the range is closed."""
    return raw.cast("double") * F.lit((high - low) / ((1 << bits) - (1 if closed else 0))) + F.lit(float(low))


def quantise(value: Column, low: float, high: float, bits: int, closed: bool = False) -> Column:
    """The nearest code of a value, clamped to the range."""
    top = (1 << bits) - 1
    code = F.rint((value.cast("double") - F.lit(float(low))) * F.lit(((1 << bits) - (1 if closed else 0)) / (high - low)))
    return F.greatest(F.lit(0.0), F.least(F.lit(float(top)), code)).cast("bigint")


def zigzag(value: Column) -> Column:
    v = value.cast("bigint")
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def unzigzag(code: Column) -> Column:
    c = code.cast("bigint")
    return F.shiftrightunsigned(c, 1).bitwiseXOR(-(c.bitwiseAND(F.lit(1))))


def undelta(deltas: Column) -> Column:
    """Running sums of a list of differences, by doubling strides: n log n steps."""
    whole = F.transform(deltas, lambda d: d.cast("bigint"))
    strides = F.filter(F.transform(F.sequence(F.lit(0), F.lit(30)), lambda k: F.call_function("shiftleft", F.lit(1), k)), lambda d: d < F.size(deltas))
    return F.aggregate(strides, whole, lambda s, d: F.transform(s, lambda x, i: x + F.coalesce(F.get(s, i - d), F.lit(0).cast("bigint"))))


def symmetric(packed: Column, n: int) -> Column:
    """An n x n symmetric matrix, as a list of rows, from the packed lower triangle."""
    place = lambda i, j: max(i, j) * (max(i, j) + 1) // 2 + min(i, j)
    return F.array(*[F.array(*[F.get(packed, F.lit(place(i, j))) for j in range(n)]) for i in range(n)])


def truncate_float(value: Column, bits: int) -> Column:
    """A float with its mantissa cut to so many of its 23 bits, as truncated storage keeps it."""
    drop = 1 << 23 - bits
    exponent = F.floor(F.log2(F.abs(value.cast("double"))))
    unit = F.pow(F.lit(2.0), exponent - 23) * drop
    cut = F.when(value >= 0, F.floor(value.cast("double") / unit)).otherwise(F.ceil(value.cast("double") / unit)) * unit
    return F.when((value == 0) | F.isnan(value) | (F.abs(value) == float("inf")), value).otherwise(cut).cast("float")
