"""Change-set binding, staging as text, and per-row value coercion.

A *raw* change set has a ``row_num`` column (the sheet row of the record;
the first data row is 2) and then its data columns in sheet order. Binding
is positional: data column 1 is the key, data column ``1 + i`` is the value
for the ``i``-th requested update column (the header text is not used).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyedit.functions.coerce import blank_to_null, canonical_key, coerce_value

ROW_NUM = "row_num"
KEY = "key_value"
KEY_CAST = "key_cast"
TWO_COL_VALUE = "update_value"


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def data_columns(raw: DataFrame, row_num: str = ROW_NUM) -> list[str]:
    return [c for c in raw.columns if c != row_num]


def bind_changeset(raw: DataFrame, update_columns: Sequence[str], row_num: str = ROW_NUM,
                   keep_null_keys: bool = False) -> DataFrame:
    """Positional binding: ``(row_num, key_value, <update columns>...)``.

    A requested column beyond the data width is NULL (short rows are padded).
    Rows with a NULL key are dropped unless ``keep_null_keys``.
    """
    data = data_columns(raw, row_num)
    if not data:
        raise ValueError("change set has no key column")
    cols = [_q(row_num).cast("long").alias(ROW_NUM), _q(data[0]).alias(KEY)]
    for i, name in enumerate(update_columns):
        src = data[1 + i] if 1 + i < len(data) else None
        cols.append((_q(src) if src else F.lit(None)).alias(name))
    out = raw.select(*cols)
    return out if keep_null_keys else out.where(F.col(KEY).isNotNull())


def bind_two_column(raw: DataFrame, row_num: str = ROW_NUM, keep_null_keys: bool = False) -> DataFrame:
    """The older two-column form: ``(row_num, key_value, update_value)``."""
    return bind_changeset(raw, [TWO_COL_VALUE], row_num, keep_null_keys)


def changeset_keys(changes: DataFrame) -> DataFrame:
    """Non-null keys, duplicates kept (order is carried by ``row_num``)."""
    return changes.where(F.col(KEY).isNotNull()).select(ROW_NUM, KEY)


def stage_as_text(changes: DataFrame, update_columns: Sequence[str]) -> DataFrame:
    """Everything as text; an empty value is NULL; keys are text too."""
    cols = [F.col(ROW_NUM), F.col(KEY).cast("string").alias(KEY)]
    cols += [blank_to_null(_q(c).cast("string")).alias(c) for c in update_columns]
    return changes.select(*cols)


def _field(schema: T.StructType, name: str) -> T.StructField:
    for f in schema.fields:
        if f.name.lower() == name.lower():
            return f
    raise KeyError(name)


def coerce_changes(staged: DataFrame, target_schema: T.StructType, key_column: str,
                   update_columns: Sequence[str], not_null: frozenset[str] = frozenset()) -> DataFrame:
    """Add the typed key, typed values and the per-row verdict.

    Output: ``row_num, key_value, key_cast, <c> (typed), type_ok, null_ok``,
    plus ``<c>__raw`` text for reporting. A row fails as a whole when any
    column fails (it was one UPDATE statement).
    """
    key_type = _field(target_schema, key_column).dataType
    typed, raw, type_checks, null_checks = [], [], [], []
    for c in update_columns:
        f = _field(target_schema, c)
        text = _q(c)
        value = coerce_value(text, f.dataType)
        typed.append(value.alias(f.name))
        raw.append(text.alias(f"{f.name}__raw"))
        type_checks.append(text.isNull() | value.isNotNull())
        if f.name.upper() in not_null:
            null_checks.append(value.isNotNull())
    type_ok = F.lit(True)
    for chk in type_checks:
        type_ok = type_ok & chk
    null_ok = F.lit(True)
    for chk in null_checks:
        null_ok = null_ok & chk
    return staged.select(
        F.col(ROW_NUM), F.col(KEY),
        canonical_key(F.col(KEY), key_type).alias(KEY_CAST),
        *typed, *raw,
        type_ok.alias("type_ok"), null_ok.alias("null_ok"),
    )
