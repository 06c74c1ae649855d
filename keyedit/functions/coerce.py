"""Text -> target-type conversion used for keys and values.

Every change arrives as text. Conversion is done with ``try_cast`` so a bad
value marks its row instead of failing the job:

* integral target: the text is read as ``decimal(38,18)`` and rounded half
  away from zero (``'1.5'`` -> 2, ``'1e3'`` -> 1000, ``' 7 '`` -> 7,
  ``'12abc'`` -> NULL), then range-checked for the target width;
* key against an integral key column: as above but only whole numbers match, judged
  on the digits as written (``'1e-19'`` is not 0, ``'70e-1'`` is 7);
* decimal / floating / boolean / date / timestamp: ``try_cast``;
* string: unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTEGRAL_RANGE = {
    T.ByteType: (-(2 ** 7), 2 ** 7 - 1),
    T.ShortType: (-(2 ** 15), 2 ** 15 - 1),
    T.IntegerType: (-(2 ** 31), 2 ** 31 - 1),
    T.LongType: (-(2 ** 63), 2 ** 63 - 1),
}

_WIDE = "decimal(38,18)"   # 20 integer digits hold any 64-bit key; 18 decimals


def is_integral(dt: T.DataType) -> bool:
    return isinstance(dt, tuple(_INTEGRAL_RANGE))


def blank_to_null(text: Column) -> Column:
    """An empty cell is NULL (a blank value overwrites the target with NULL)."""
    return F.when(text != F.lit(""), text)


def coerce_value(text: Column, dt: T.DataType) -> Column:
    """Convert change text to ``dt``; NULL when it does not convert."""
    if isinstance(dt, T.StringType):
        return text
    if is_integral(dt):
        lo, hi = _INTEGRAL_RANGE[type(dt)]
        whole = F.round(text.try_cast(_WIDE), 0)
        return _plain_or(text, dt, F.when(whole.between(F.lit(lo), F.lit(hi)), whole.try_cast(dt)))
    return text.try_cast(dt)


def _plain_or(text: Column, dt: T.DataType, other: Column) -> Column:
    """Plain digits as they are; the decimal rules only for text that is no plain number."""
    lo, hi = _INTEGRAL_RANGE[type(dt)]
    plain = text.try_cast("bigint")
    return F.when(plain.isNotNull(), F.when(plain.between(F.lit(lo), F.lit(hi)), plain.cast(dt))).otherwise(other)


def _whole(text: Column) -> Column:
    """Is the numeral in ``text`` a whole number? By its digits, so nothing is rounded first.

    The fraction's digits must be used up by the exponent and by the zeros that end the digits.
    """
    mantissa = F.regexp_extract(text, "([0-9.]+)", 1)
    digits = F.replace(mantissa, F.lit("."), F.lit(""))
    fraction = F.length(F.regexp_extract(text, r"\.([0-9]*)", 1))
    exponent = F.coalesce(F.regexp_extract(text, "[eE]([+-]?[0-9]+)", 1).try_cast("int"), F.lit(0))
    significant = F.rtrim(digits, F.lit("0"))
    return (significant == "") | (F.length(digits) - F.length(significant) + exponent >= fraction)


def canonical_key(text: Column, dt: T.DataType) -> Column:
    """Change-side key in the target key's type; only the change side is cast."""
    if isinstance(dt, T.StringType):
        return text
    if is_integral(dt):
        lo, hi = _INTEGRAL_RANGE[type(dt)]
        d = text.try_cast(_WIDE)
        return _plain_or(text, dt, F.when(_whole(text) & d.between(F.lit(lo), F.lit(hi)), d.try_cast(dt)))
    return text.try_cast(dt)
