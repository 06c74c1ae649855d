"""DuckDB spellings of the coercion rules, for the oracle SQL of the registered queries.

They mirror ``keyedit.functions.coerce`` exactly; a property test checks
that both give the same value on arbitrary text.
"""

from __future__ import annotations

from pyspark.sql import types as T

from keyedit.functions.coerce import _INTEGRAL_RANGE, is_integral

_DUCK_INTEGRAL = {
    T.ByteType: "tinyint", T.ShortType: "smallint",
    T.IntegerType: "integer", T.LongType: "bigint",
}


def _duck_type(dt: T.DataType) -> str:
    if isinstance(dt, T.TimestampNTZType):
        return "timestamp"
    if isinstance(dt, T.TimestampType):
        return "timestamptz"
    return dt.simpleString()


def duck_coerce(expr: str, dt: T.DataType) -> str:
    if isinstance(dt, T.StringType):
        return expr
    if is_integral(dt):
        lo, hi = _INTEGRAL_RANGE[type(dt)]
        w = f"round(try_cast({expr} as decimal(38,18)), 0)"
        return (f"case when {w} between {lo} and {hi} "
                f"then try_cast({w} as {_DUCK_INTEGRAL[type(dt)]}) end")
    return f"try_cast({expr} as {_duck_type(dt)})"


def duck_canonical_key(expr: str, dt: T.DataType) -> str:
    if isinstance(dt, T.StringType):
        return expr
    if is_integral(dt):
        lo, hi = _INTEGRAL_RANGE[type(dt)]
        d = f"try_cast({expr} as decimal(38,18))"
        # whole numbers by their digits: the cast to a decimal rounds what lies beyond its scale
        digits = f"replace(regexp_extract({expr}, '([0-9.]+)', 1), '.', '')"
        fraction = f"length(regexp_extract({expr}, '[.]([0-9]*)', 1))"
        exponent = f"coalesce(try_cast(regexp_extract({expr}, '[eE]([+-]?[0-9]+)', 1) as integer), 0)"
        whole = (f"(rtrim({digits}, '0') = '' or "
                 f"length({digits}) - length(rtrim({digits}, '0')) + {exponent} >= {fraction})")
        return (f"case when {whole} and {d} between {lo} and {hi} "
                f"then try_cast({d} as {_DUCK_INTEGRAL[type(dt)]}) end")
    return f"try_cast({expr} as {_duck_type(dt)})"
