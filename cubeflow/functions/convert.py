"""Value conversion between sample formats, quantisation and NoValue, as column expressions.

Inside the engine NoValue is null; a format's sentinel appears only where values leave it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cubeflow.descriptor import LEVELS, Channel, InvalidArgument

#: Bounds of the integer formats.
INT_RANGE = {"U8": (0, 255), "U16": (0, 65535), "U32": (0, 2**32 - 1), "U64": (0, 2**64 - 1), "I8": (-128, 127), "I16": (-(2**15), 2**15 - 1), "I32": (-(2**31), 2**31 - 1)}


def novalue_of(fmt: str, novalue: float) -> float | bool | int:
    """How a format says NoValue: bits are false, quantised formats take their highest level."""
    if fmt == "1Bit":
        return False
    return {"U8": 255, "U16": 65535}.get(fmt, int(float_to_int_value(novalue, fmt)) if fmt in INT_RANGE else novalue)


def float_to_int_value(v: float, fmt: str) -> int:
    import math

    low, high = INT_RANGE[fmt]
    return int(min(max(math.floor(v + 0.5), low), high))


def to_bool(v: Column) -> Column:
    return v != 0


def from_bool(v: Column) -> Column:
    return F.when(v, 1.0).when(~v, 0.0)


def saturate(v: Column, fmt: str) -> Column:
    """Integer to integer: what is out of range takes the bound."""
    low, high = INT_RANGE[fmt]
    return _clamp(v, low, high)


def _clamp(v: Column, low, high) -> Column:
    """Null stays null: least and greatest alone would pass over it."""
    return F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(low)), F.lit(high)))


def round_half_up(v: Column) -> Column:
    """floor(v + 0.5); ties go up, unlike SQL's round."""
    return F.floor(v + 0.5)


def float_to_int(v: Column, fmt: str) -> Column:
    """Saturating, then rounded half up; null stays null."""
    low, high = INT_RANGE[fmt]
    return round_half_up(_clamp(v, float(low), float(high))).cast("long")


def levels(fmt: str, use_novalue: bool) -> int:
    """Highest level that a value can take."""
    if fmt not in LEVELS:
        raise InvalidArgument(f"{fmt} is not quantised")
    return LEVELS[fmt] - 1 - use_novalue


def quantize(v: Column, fmt: str, range_min: float, range_max: float, use_novalue: bool = False) -> Column:
    """Real to level: scaled over the range, clamped, rounded half up; null becomes the format's NoValue."""
    top = levels(fmt, use_novalue)
    scale = (range_max - range_min) / top or 1.0
    x = _clamp((v - range_min) * (1.0 / scale), 0.0, float(top))
    q = F.floor(x + 0.5).cast("long")
    return F.coalesce(q, F.lit(LEVELS[fmt] - 1)) if use_novalue else q


def dequantize(q: Column, fmt: str, range_min: float, range_max: float, use_novalue: bool = False) -> Column:
    """Level to real over a value range; the NoValue level becomes null."""
    scale = (range_max - range_min) / levels(fmt, use_novalue)
    v = range_min + scale * q.cast("double")
    return F.when(q != LEVELS[fmt] - 1, v) if use_novalue else v


def dequantize_scaled(q: Column, fmt: str, scale: float, offset: float, use_novalue: bool = False) -> Column:
    """Level to real by a channel's integer scale and offset."""
    v = offset + scale * q.cast("double")
    return F.when(q != LEVELS[fmt] - 1, v) if use_novalue and fmt in LEVELS else v


def replace_novalue(v: Column, replacement) -> Column:
    return F.coalesce(v, F.lit(replacement))


def convert(v: Column, source: Channel, fmt: str, replacement: float | None = None) -> Column:
    """A stored value of ``source`` in another format.

    Quantised sources become reals first; reals go to quantised targets over the channel's value
    range; NoValue becomes the replacement if there is one, else the target's own sentinel.
    """
    if source.format == fmt and replacement is None:
        return v
    if source.format == "1Bit":
        real = from_bool(v)
    elif source.format in LEVELS:
        real = dequantize_scaled(v, source.format, source.int_scale, source.int_offset, source.use_novalue)
    else:
        real = v.cast("double")
        if source.use_novalue:
            real = F.when(real != source.novalue, real)
    if replacement is not None:
        real = F.coalesce(real, F.lit(float(replacement)))
    if fmt == "1Bit":
        return F.coalesce(to_bool(real), F.lit(False))
    if fmt in LEVELS:
        return quantize(real, fmt, source.range_min, source.range_max, source.use_novalue)
    if fmt in INT_RANGE:
        return F.coalesce(float_to_int(real, fmt), F.lit(novalue_of(fmt, source.novalue)))
    out = real if replacement is not None or not source.use_novalue else F.coalesce(real, F.lit(float(source.novalue)))
    return out.cast("float" if fmt == "R32" else "double")


def base64_encode(data: Column) -> Column:
    return F.base64(data)


def base64_decode(text: Column) -> Column:
    return F.unbase64(text)
