"""Scalar text helpers, all built from JVM-side Spark functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keyedit.functions import fixed

_WS = " \t\n\r\x0b\x0c"


def strip(text: Column) -> Column:
    """Remove surrounding whitespace (space, tab, newlines, vt, ff)."""
    return F.trim(text, F.lit(_WS))


def is_blank(text: Column) -> Column:
    """True for NULL or whitespace-only text (the blank-header test)."""
    return F.coalesce(strip(text), F.lit("")) == F.lit("")


def megabytes(n_bytes: Column) -> Column:
    """Bytes as megabytes with two decimals, e.g. ``'10.50'``."""
    return F.format_string("%.2f", n_bytes / F.lit(1048576.0))


def idiv(a: Column, b) -> Column:
    """Integer division of non-negative whole numbers (exact below 2**53)."""
    b = b if isinstance(b, Column) else F.lit(b)
    return F.floor(a / b).cast("long")


def percent(current: Column, total: Column) -> Column:
    """Whole percentage, 0 when the total is 0 (exact integer division)."""
    return F.when(total > 0, idiv(current * 100, total)).otherwise(F.lit(0)).cast("long")


def parse_log_line(line: Column) -> Column:
    """Split ``[time] LEVEL - message`` into a struct of (time, level, message).

    The split is on the first ``' - '``; without one the level is empty; a line
    that does not start with ``[`` or has no ``'] '`` is all message. Blank
    lines give NULL (drop them).
    """
    e = strip(line)
    close = F.instr(e, "]")
    bracketed = e.startswith("[") & (F.instr(e, "] ") > 0)
    # positions are 1-based
    time_part = F.substring(e, F.lit(2), close - F.lit(2))
    rest = F.substring(e, close + F.lit(2), F.length(e))
    dash = F.instr(rest, " - ")
    level = F.when(dash > 0, F.substring(rest, F.lit(1), dash - F.lit(1))).otherwise(F.lit(""))
    message = F.when(dash > 0, F.substring(rest, dash + F.lit(3), F.length(rest))).otherwise(rest)
    parsed = F.struct(
        F.when(bracketed, time_part).otherwise(F.lit("")).alias("time"),
        F.when(bracketed, level).otherwise(F.lit("")).alias("level"),
        F.when(bracketed, message).otherwise(e).alias("message"),
    )
    return F.when(e != F.lit(""), parsed)


def classify_error(message: Column, stage: str) -> Column:
    """Map an error text to the user-facing reason for ``stage``; first code wins."""
    fallback, append = fixed.ERROR_FALLBACK[stage]
    out = message if fallback is None else F.concat(F.lit(fallback), message) if append else F.lit(fallback)
    for st, code, label, add_msg in reversed(fixed.ERROR_LABELS):
        if st != stage:
            continue
        value = F.concat(F.lit(label), message) if add_msg else F.lit(label)
        out = F.when(message.contains(code), value).otherwise(out)
    return out


def stamp(ts: Column, fmt: str) -> Column:
    """A time as text in one of the fixed formats (``fixed.*_TS_FORMAT``)."""
    return F.date_format(ts, fmt)


def backup_name(table: Column, ts: Column) -> Column:
    """``<table>_BAK_<yyyyMMdd_HHmmss>``: the snapshot's name for a run time."""
    return F.concat(table, F.lit(fixed.BACKUP_INFIX), stamp(ts, fixed.NAME_TS_FORMAT))


def staging_name(ts: Column) -> Column:
    """``TEMP_UPDATE_<yyyyMMdd_HHmmss>``: the staging table's name for a run time."""
    return F.concat(F.lit(fixed.STAGING_PREFIX), stamp(ts, fixed.NAME_TS_FORMAT))
