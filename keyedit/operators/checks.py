"""Change-set checks: duplicates, missing keys, unknown columns, gates.

None of these collects a group: duplicates are found with map-side-combined
aggregates and a keyed join back to the rows (hot keys salted); the list of
row numbers per duplicated key is emitted in bounded chunks of row-number
ranges.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyedit.operators.joins import keyed_join
from keyedit.operators.staging import KEY, KEY_CAST, ROW_NUM
from keyedit.session import ensure_checkpoint_dir

# A key with more occurrences than this has its row numbers listed in blocks of about as many.
ROWS_PER_CHUNK = 100_000


# --- duplicates ------------------------------------------------------------
# ``key`` is one column name or a list of them (e.g. ``["path", "key_value"]``
# for a folder of workbooks, where sheet row numbers repeat across files).

def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _keyed(changes: DataFrame, key) -> DataFrame:
    cond = None
    for k in _keys(key):
        c = F.col(k).isNotNull()
        cond = c if cond is None else cond & c
    return changes.where(cond)


def canonical_keys(coerced: DataFrame) -> DataFrame:
    """``row_num, key_value`` with the key in its canonical spelling.

    A key that converts to the target's key type is written as that value, so
    ``7`` and ``007`` are one key; one that does not stays as it is. All duplicate
    checks take these rows, and so agree with the ``unique_keys`` gate.
    """
    return coerced.select(ROW_NUM, F.coalesce(F.col(KEY_CAST).cast("string"), F.col(KEY)).alias(KEY))


def first_rows(changes: DataFrame, key=KEY) -> DataFrame:
    """``(key…, first_row, occurrences)`` per key, from a partial aggregate."""
    return (_keyed(changes, key).groupBy(*_keys(key))
            .agg(F.min(ROW_NUM).alias("first_row"), F.count(F.lit(1)).cast("long").alias("occurrences")))


def second_rows(changes: DataFrame, key=KEY) -> DataFrame:
    """``(key…, second_row)`` of each duplicated key: the second smallest of its row numbers.

    Ranks up to two are cut to two rows for each key before the shuffle (a group limit
    of the window), so a hot key leaves a task as two rows; nothing is collected.
    """
    ks = _keys(key)
    order = Window.partitionBy(*ks).orderBy(ROW_NUM)
    ranked = _keyed(changes, key).select(*ks, ROW_NUM, F.row_number().over(order).alias("__rank"))
    return ranked.where(F.col("__rank") <= 2).where(F.col("__rank") == 2).select(*ks, F.col(ROW_NUM).alias("second_row"))


def duplicate_keys(changes: DataFrame, key=KEY) -> DataFrame:
    """Distinct duplicated keys with their count and first row."""
    return first_rows(changes, key).where(F.col("occurrences") > 1)


def _keys_once(changes: DataFrame, key) -> DataFrame:
    """Keys and row numbers written once: finding, measuring and joining duplicates read what was written.

    The canonical spelling of a key is not worked out again in each pass.
    """
    ensure_checkpoint_dir(changes.sparkSession)
    return _keyed(changes, key).select(*_keys(key), ROW_NUM).checkpoint()


def duplicate_pairs(changes: DataFrame, key=KEY) -> DataFrame:
    """Every repeat as ``(key…, first_row, row_num)``: k occurrences give k-1 rows."""
    ks = _keys(key)
    rows = _keys_once(changes, key)
    dups = duplicate_keys(rows, key).select(*ks, "first_row")
    j = keyed_join(rows, dups, ks, "inner")
    return j.where(F.col(ROW_NUM) > F.col("first_row")).select(*ks, "first_row", ROW_NUM)


def duplicate_keys_ordered(changes: DataFrame, key=KEY) -> DataFrame:
    """Duplicated keys ordered by their second occurrence (``second_row``): one scan, no join."""
    return second_rows(changes, key).orderBy("second_row")


def duplicate_keys_top(changes: DataFrame, n: int = 5, key=KEY) -> DataFrame:
    """The first ``n`` duplicated keys in order of their second occurrence."""
    return duplicate_keys_ordered(changes, key).limit(n)


def duplicate_key_rows(changes: DataFrame, key=KEY, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Every duplicated key with all its row numbers as ``"2, 5, 9"`` text.

    A key is one row (``chunk = 0``), unless it occurs more than
    ``rows_per_chunk`` times: its list is then split by blocks of as many sheet
    rows (``chunk = row_num div rows_per_chunk``), so no group grows with a hot
    key; concatenating a key's chunks in ``chunk`` order gives its full list.
    """
    ks = _keys(key)
    written = _keys_once(changes, key)
    dups = duplicate_keys(written, key).select(*ks, "occurrences")
    rows = keyed_join(written, dups, ks, "inner")
    chunk = F.when(F.col("occurrences") > rows_per_chunk, (F.col(ROW_NUM) / F.lit(rows_per_chunk)).cast("long")).otherwise(F.lit(0).cast("long"))
    return (rows.groupBy(*[F.col(k) for k in ks], chunk.alias("chunk"))
            .agg(F.count(F.lit(1)).cast("long").alias("n_rows"),
                 F.array_join(F.array_sort(F.collect_list(F.col(ROW_NUM))), ", ").alias("rows")))


# --- keys against the target -----------------------------------------------

def _present(target: DataFrame, key_column: str, coerced: DataFrame, fits: bool) -> DataFrame:
    """Distinct target keys among the change keys (size <= change keys).

    ``distinct`` is a map-side-combined aggregate: a hot target key becomes
    one row per task before the shuffle.
    """
    tkey = next(c for c in target.columns if c.lower() == key_column.lower())
    tk = target.select(F.col(f"`{tkey}`").alias(KEY_CAST))
    keys = coerced.select(KEY_CAST).where(F.col(KEY_CAST).isNotNull())
    if fits:
        return keyed_join(tk, keys, [KEY_CAST], "left_semi", small_fits=True).distinct()
    # distinct first (map-side combined), then a join whose target side is unique
    return keyed_join(tk.distinct(), keys.distinct(), [KEY_CAST], "left_semi", small_fits=False, big_unique=True)


def _keys_fit(coerced: DataFrame) -> bool:
    from keyedit.operators.joins import can_broadcast
    return can_broadcast(coerced.select(KEY_CAST))


def missing_keys(coerced: DataFrame, target: DataFrame, key_column: str, fits: bool | None = None) -> DataFrame:
    """Change rows whose key is not in the target; repeats kept (a bag difference)."""
    fits = _keys_fit(coerced) if fits is None else fits
    present = _present(target, key_column, coerced, fits)
    return keyed_join(coerced.select(ROW_NUM, KEY, KEY_CAST), present, [KEY_CAST], "left_anti",
                      small_fits=fits).select(ROW_NUM, KEY)


def present_keys(coerced: DataFrame, target: DataFrame, key_column: str, fits: bool | None = None) -> DataFrame:
    """Change rows whose key is in the target."""
    fits = _keys_fit(coerced) if fits is None else fits
    present = _present(target, key_column, coerced, fits)
    return keyed_join(coerced.select(ROW_NUM, KEY, KEY_CAST), present, [KEY_CAST], "left_semi",
                      small_fits=fits).select(ROW_NUM, KEY)


def consistency_summary(coerced: DataFrame, target: DataFrame, key_column: str) -> DataFrame:
    """One row: change keys, target key values, missing keys, passed.

    The three counts come from one aggregate over a union of tagged rows.
    """
    tkey = next(c for c in target.columns if c.lower() == key_column.lower())
    z, o = F.lit(0).cast("long"), F.lit(1).cast("long")
    parts = (coerced.select(o.alias("c"), z.alias("t"), z.alias("m"))
             .unionByName(target.select(z.alias("c"), o.alias("t"), z.alias("m")))
             .unionByName(missing_keys(coerced, target, key_column).select(z.alias("c"), z.alias("t"), o.alias("m"))))
    out = parts.agg(F.coalesce(F.sum("c"), z).alias("change_keys"),
                    F.coalesce(F.sum("t"), z).alias("target_keys"),
                    F.coalesce(F.sum("m"), z).alias("missing_count"))
    return out.withColumn("passed", F.col("missing_count") == 0)


# --- columns ---------------------------------------------------------------

def missing_columns(requested: DataFrame, target_schema: T.StructType, name_col: str = "column_name") -> DataFrame:
    """Requested update columns absent from the target (case-insensitive), with position."""
    spark = requested.sparkSession
    names = spark.createDataFrame([(f.name.upper(),) for f in target_schema.fields], "__u string")
    req = requested.withColumn("__u", F.upper(F.col(name_col)))
    return req.join(F.broadcast(names), "__u", "left_anti").drop("__u")


def target_columns(spark, schema: T.StructType) -> DataFrame:
    """``(ordinal, column_name, data_type, nullable)`` in ordinal order; names upper-cased."""
    rows = [(i + 1, f.name.upper(), f.dataType.simpleString(), f.nullable) for i, f in enumerate(schema.fields)]
    return spark.createDataFrame(rows, "ordinal long, column_name string, data_type string, nullable boolean")


def column_profile(df: DataFrame) -> DataFrame:
    """The column dictionary of a table with observed statistics.

    ``ordinal, column_name (upper), data_type, nullable, max_length, null_count``:
    one aggregate over the whole table (max text length and NULL count per
    column), laid out one row per column with ``stack``.
    """
    aggs = []
    for i, c in enumerate(df.columns):
        ref = F.col(f"`{c}`")
        aggs.append(F.coalesce(F.max(F.length(ref.cast("string"))), F.lit(0)).cast("long").alias(f"l{i}"))
        aggs.append(F.count_if(ref.isNull()).cast("long").alias(f"n{i}"))
    one = df.agg(*aggs)
    parts = []
    for i, f in enumerate(df.schema.fields):
        name = f.name.upper().replace("'", "''")
        parts.append(f"{i + 1}L, '{name}', '{f.dataType.simpleString()}', {str(f.nullable).lower()}, l{i}, n{i}")
    return one.select(F.expr(
        f"stack({len(parts)}, {', '.join(parts)}) as (ordinal, column_name, data_type, nullable, max_length, null_count)"))


# --- profile and gates -----------------------------------------------------

def changeset_profile(raw_bound: DataFrame) -> DataFrame:
    """One row of counts over a bound change set that still has NULL-key rows."""
    return raw_bound.agg(
        F.count(F.lit(1)).cast("long").alias("total_rows"),
        F.count(F.col(KEY)).cast("long").alias("valid_rows"),
        F.count_if(F.col(KEY).isNull()).cast("long").alias("null_key_rows"),
        F.count_distinct(F.col(KEY)).cast("long").alias("distinct_keys"),
    )


def gate_report(raw_bound: DataFrame, coerced: DataFrame, update_columns: Sequence[str],
                n_data_columns: int, *, max_rows: int | None = None,
                max_text: int | None = None) -> DataFrame:
    """The quality gates as rows ``(seq, check_name, passed, observed, limit_value, message)``.

    One aggregate over the rows and one over the canonical keys; the gates are
    laid out with ``stack`` from those one-row results, nothing is collected.
    There is no row or text limit unless one is given.
    """
    texts = [F.octet_length(F.col(KEY).cast("string"))]
    texts += [F.octet_length(F.col(f"`{c}`").cast("string")) for c in update_columns]
    longest = F.greatest(*[F.coalesce(t, F.lit(0)) for t in texts]) if len(texts) > 1 else F.coalesce(texts[0], F.lit(0))
    z = F.lit(0).cast("long")
    per_row = raw_bound.select(F.lit(1).cast("long").alias("r"), F.col(KEY).isNotNull().cast("long").alias("k"),
                               longest.cast("long").alias("t"), z.alias("d"))
    dup_key = F.coalesce(F.col(KEY_CAST).cast("string"), F.col(KEY))
    per_key = (coerced.groupBy(dup_key.alias("__k")).agg(F.count(F.lit(1)).alias("__n"))
               .select(z.alias("r"), z.alias("k"), z.alias("t"), (F.col("__n") > 1).cast("long").alias("d")))
    one = per_row.unionByName(per_key).agg(
        F.coalesce(F.sum("r"), z).alias("n_rows"), F.coalesce(F.sum("k"), z).alias("n_keyed"),
        F.coalesce(F.max("t"), z).alias("max_text"), F.coalesce(F.sum("d"), z).alias("n_dup_keys"))
    need_cols = 1 + len(update_columns)
    lim_rows = -1 if max_rows is None else int(max_rows)
    lim_text = -1 if max_text is None else int(max_text)
    gates = F.expr(
        "stack(6, "
        "1L, 'has_data_rows', n_rows >= 1, n_rows, 1L, 'at least one data row', "
        f"2L, 'row_limit', ({lim_rows} < 0 or n_rows <= {lim_rows}), n_rows, {lim_rows}L, 'data rows within the limit', "
        f"3L, 'column_count', {n_data_columns} >= {need_cols}, {n_data_columns}L, {need_cols}L, 'key column plus one column per update column', "
        "4L, 'has_keyed_rows', n_keyed >= 1, n_keyed, 1L, 'at least one row with a key', "
        "5L, 'unique_keys', n_dup_keys = 0, n_dup_keys, 0L, 'no key appears twice', "
        f"6L, 'text_length', ({lim_text} < 0 or max_text <= {lim_text}), max_text, {lim_text}L, 'staged text within the limit'"
        ") as (seq, check_name, passed, observed, limit_value, message)")
    return one.select(gates)
