"""Previews and export column widths."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyedit.functions import fixed
from keyedit.operators.staging import ROW_NUM


def preview(bound_with_nulls: DataFrame, max_rows: int = fixed.PREVIEW_ROWS) -> DataFrame:
    """First ``max_rows`` data rows by sheet row, NULL-key rows included (a top-k)."""
    return bound_with_nulls.orderBy(ROW_NUM).limit(max_rows)


def preview_headers(raw: DataFrame, update_columns: Sequence[str] | None = None) -> list[str]:
    """Header row of a preview (schema only, no job).

    With update columns: the file's key header, then the requested names cut
    to the data columns the file has. Without: the file's first two headers.
    """
    data = [c for c in raw.columns if c != ROW_NUM]
    if update_columns is None:
        return data[:2]
    return data[:1] + list(update_columns)[:max(len(data) - 1, 0)]


def preview_summary(bound_with_nulls: DataFrame, max_rows: int = fixed.PREVIEW_ROWS) -> DataFrame:
    """One row: ``total_rows, shown_rows, has_more, more_rows`` against the actual limit."""
    n = F.count(F.lit(1)).cast("long")
    return bound_with_nulls.agg(n.alias("total_rows")).select(
        "total_rows",
        F.least(F.col("total_rows"), F.lit(max_rows).cast("long")).alias("shown_rows"),
        (F.col("total_rows") > max_rows).alias("has_more"),
        F.greatest(F.col("total_rows") - max_rows, F.lit(0).cast("long")).alias("more_rows"),
    )


def column_widths(df: DataFrame, pad: int = fixed.WIDTH_PAD, cap: int = fixed.WIDTH_CAP) -> DataFrame:
    """Display width per column: ``min(max(len(header), len(text of values)) + pad, cap)``.

    One aggregate over the whole table (max text length per column, NULL as
    empty), laid out as rows with ``stack``.
    """
    cols = df.columns
    aggs = [F.coalesce(F.max(F.length(F.col(f"`{c}`").cast("string"))), F.lit(0)).alias(f"w{i}")
            for i, c in enumerate(cols)]
    one = df.agg(*aggs)
    parts = []
    for i, c in enumerate(cols):
        name = c.replace("'", "''")
        parts.append(f"{i + 1}L, '{name}', cast(least(greatest({len(c)}, w{i}) + {pad}, {cap}) as bigint)")
    return one.select(F.expr(f"stack({len(cols)}, {', '.join(parts)}) as (ordinal, column_name, width)"))


def export_fill(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Records for export: a missing (NULL) field is written as ``''``."""
    cols = columns or df.columns
    return df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in cols])
