"""Applying a checked change set to a target table.

Plan shape (``apply_updates``): one scan of the target, one left join with
the passing changes on the target's raw key column (only the change side is
cast, so the target key keeps its parquet pushdown and needs no re-hash),
one projection. The change side is broadcast when its measured size allows,
otherwise the join shuffles with hot target keys salted (see ``joins``).

Outcome per change row, first hit wins: ``missing_key``, ``type_mismatch``,
``null_not_allowed``, the rules of ``constraints``, ``applied``.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyedit.functions import fixed
from keyedit.operators.joins import can_broadcast, change_stats, hot_limit, hot_of_counts, keyed_join, stats_fit
from keyedit.operators.staging import KEY, KEY_CAST, ROW_NUM
from keyedit.session import ensure_checkpoint_dir

APPLIED = "applied"
MISSING_KEY = "missing_key"
TYPE_MISMATCH = "type_mismatch"
NULL_NOT_ALLOWED = "null_not_allowed"

_HIT = "__hit"
_NEW = "__new_"


def _target_name(target: DataFrame, name: str) -> str:
    for c in target.columns:
        if c.lower() == name.lower():
            return c
    raise KeyError(f"column {name!r} not in target")


def _dup_key():
    return F.coalesce(F.col(KEY_CAST).cast("string"), F.col(KEY))


def assert_unique_keys(coerced: DataFrame) -> None:
    """Refuse a change set whose canonical keys repeat (the join would multiply rows)."""
    dups = (coerced.groupBy(_dup_key().alias("__k")).agg(F.count(F.lit(1)).alias("__n"))
            .where(F.col("__n") > 1))
    if dups.limit(1).count():
        raise ValueError("change set has duplicate keys; run the duplicate check first")


def change_keys_fit(coerced: DataFrame) -> bool:
    """Whether the change keys may be broadcast (one distributed count of them).

    Every key list derived from them (present keys, per-key counts) has at
    most as many rows, so one answer serves all joins of a check.
    """
    return can_broadcast(coerced.select(KEY_CAST))


def matched_key_counts(target: DataFrame, key_column: str, change_keys: DataFrame,
                       fits: bool | None = None) -> DataFrame:
    """``(key_cast, rows_matched)`` for change keys present in the target.

    When the change keys fit a broadcast, the target is filtered map-side by
    a broadcast semi join, then counted. Otherwise the target key column is
    counted first (a map-side-combined aggregate: a hot key leaves each task
    as one row), and those unique per-key counts are semi-joined with the
    change keys. Either way no task holds a hot key's rows and the output
    is bounded by the number of change keys.
    """
    tkey = _target_name(target, key_column)
    fits = change_keys_fit(change_keys) if fits is None else fits
    keys = change_keys.select(F.col(KEY_CAST)).where(F.col(KEY_CAST).isNotNull())
    tk = target.select(F.col(f"`{tkey}`").alias(KEY_CAST))
    if fits:
        # broadcast semi join filters the target map-side, then a small count
        present = keyed_join(tk, keys, [KEY_CAST], "left_semi", small_fits=True)
        return present.groupBy(KEY_CAST).agg(F.count(F.lit(1)).alias("rows_matched"))
    # count first: one row per target key leaves the map side, so a hot key is
    # one row per task and the join below has a unique side
    counts = tk.groupBy(KEY_CAST).agg(F.count(F.lit(1)).alias("rows_matched"))
    return keyed_join(counts, keys.distinct(), [KEY_CAST], "left_semi", small_fits=False, big_unique=True)


def key_table(target: DataFrame, key_column: str, change_keys: DataFrame) -> DataFrame:
    """``key_cast, rows_matched, wanted``: target rows of each change key that is there, and of each hot key.

    For runs beyond the broadcast bound: the target's keys are counted and shuffled once, and
    the outcomes (``wanted`` rows) and the salting of the join that applies the changes (hot keys,
    changed or not) both read this table. It has no more rows than change keys and hot keys.
    """
    tkey = _target_name(target, key_column)
    keys = change_keys.select(KEY_CAST).where(F.col(KEY_CAST).isNotNull()).distinct()
    tk = target.select(F.col(f"`{tkey}`").alias(KEY_CAST)).where(F.col(KEY_CAST).isNotNull())
    counts = tk.groupBy(KEY_CAST).agg(F.count(F.lit(1)).alias("rows_matched"))
    marked = keyed_join(counts, keys.withColumn("__wanted", F.lit(True)), [KEY_CAST], "left", small_fits=False, big_unique=True)
    ensure_checkpoint_dir(target.sparkSession)
    return marked.select(KEY_CAST, "rows_matched", F.coalesce("__wanted", F.lit(False)).alias("wanted")).where(
        F.col("wanted") | (F.col("rows_matched") >= hot_limit(target))).checkpoint()


def row_outcomes(coerced: DataFrame, target: DataFrame, key_column: str, unmatched: str = "ignore",
                 fits: bool | None = None, refused: DataFrame | None = None, keys: DataFrame | None = None) -> DataFrame:
    """``row_num, key_value, status, reason, rows_updated, failed`` for every change row.

    ``refused`` (``key_cast, status, reason``) are changes that break a rule of the target
    (see ``constraints``). ``keys`` is the run's ``key_table``, where it has one.
    """
    fits = change_keys_fit(coerced) if fits is None else fits
    counts = (matched_key_counts(target, key_column, coerced, fits) if keys is None
              else keys.where("wanted").select(KEY_CAST, "rows_matched"))
    return judged(coerced, counts, unmatched, fits, refused)


def judged(coerced: DataFrame, counts: DataFrame, unmatched: str, fits: bool, refused: DataFrame | None = None,
           keep: Sequence[str] = ()) -> DataFrame:
    """Outcomes from the matched rows of each key; ``keep`` names further columns to carry along."""
    joined = keyed_join(coerced, counts, [KEY_CAST], "left", small_fits=fits, big_unique=not keep)
    n = F.coalesce(F.col("rows_matched"), F.lit(0)).cast("long")
    status = (F.when(n == 0, F.lit(MISSING_KEY))
              .when(~F.col("type_ok"), F.lit(TYPE_MISMATCH))
              .when(~F.col("null_ok"), F.lit(NULL_NOT_ALLOWED))
              .otherwise(F.lit(APPLIED)))
    if refused is not None:
        joined = keyed_join(joined, refused.select(KEY_CAST, F.col("status").alias("__rule"), F.col("reason").alias("__why")),
                            [KEY_CAST], "left", small_fits=fits, big_unique=True)
        status = F.when(status == APPLIED, F.coalesce("__rule", status)).otherwise(status)
    reason = (F.when(status == MISSING_KEY, F.lit(fixed.REASON_ZERO_ROWS))
              .when(status == TYPE_MISMATCH, F.lit(fixed.REASON_TYPE_MISMATCH))
              .when(status == NULL_NOT_ALLOWED, F.lit(fixed.REASON_NULL_NOT_ALLOWED)))
    if refused is not None:
        reason = F.when(status == F.col("__rule"), F.col("__why")).otherwise(reason)
    counts_as_failure = status != APPLIED
    if unmatched == "ignore":
        counts_as_failure = counts_as_failure & (status != MISSING_KEY)
    return joined.select(
        *keep, F.col(ROW_NUM), F.col(KEY), status.alias("status"), reason.alias("reason"),
        F.when(status == APPLIED, n).otherwise(F.lit(0).cast("long")).alias("rows_updated"),
        counts_as_failure.alias("failed"),
    )


def passing_changes(coerced: DataFrame) -> DataFrame:
    return coerced.where(F.col("type_ok") & F.col("null_ok") & F.col(KEY_CAST).isNotNull())


def apply_updates(target: DataFrame, coerced: DataFrame, key_column: str,
                  update_columns: Sequence[str], *, check_unique: bool = True,
                  changes_fit: bool | None = None, keys: DataFrame | None = None) -> DataFrame:
    """New target: every target row once; matched rows get all listed columns.

    Unmatched changes are ignored (no inserts), no row is deleted, column
    order and types are those of the target. One aggregate pass over the
    passing changes both proves their keys unique and measures them for the
    broadcast decision. ``keys`` (``key_table``) spares counting the target's hot keys.
    """
    tkey = _target_name(target, key_column)
    names = [_target_name(target, c) for c in update_columns]
    good = passing_changes(coerced).select(
        F.col(KEY_CAST).alias(tkey),
        *[F.col(f"`{n}`").alias(_NEW + n) for n in names],
        F.lit(True).alias(_HIT),
    )
    if check_unique or changes_fit is None:
        stats = change_stats(good, tkey)
        if check_unique and stats["dup_keys"]:
            raise ValueError("change set has duplicate keys; run the duplicate check first")
        if changes_fit is None:
            changes_fit = stats_fit(good, stats)
    hot = "find" if keys is None else hot_of_counts(keys.withColumnRenamed(KEY_CAST, tkey), [tkey], "rows_matched")
    joined = keyed_join(target, good, [tkey], "left", small_fits=changes_fit, hot=hot)
    hit = F.coalesce(F.col(_HIT), F.lit(False))
    out = []
    for c in target.columns:
        if c in names:
            out.append(F.when(hit, F.col(f"`{_NEW}{c}`")).otherwise(F.col(f"`{c}`")).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return joined.select(*out)


def match_changes(target: DataFrame, staged_keys: DataFrame, key_column: str) -> DataFrame:
    """Inner join target x changes: one row per matching target row."""
    tkey = _target_name(target, key_column)
    ch = staged_keys.select(F.col(KEY_CAST).alias(tkey), F.col(ROW_NUM), F.col(KEY))
    ch = ch.where(F.col(tkey).isNotNull())
    return keyed_join(target.select(tkey), ch, [tkey], "inner", equal_rows=True).select(ROW_NUM, KEY, tkey)


def old_new_values(target: DataFrame, coerced: DataFrame, key_column: str,
                   update_columns: Sequence[str]) -> DataFrame:
    """For each matched target row: key, ``old_<c>`` (target) and ``new_<c>`` (change text)."""
    tkey = _target_name(target, key_column)
    names = [_target_name(target, c) for c in update_columns]
    ch = coerced.select(F.col(KEY_CAST).alias(tkey), F.col(ROW_NUM),
                        *[F.col(f"`{n}__raw`").alias(f"new_{n}") for n in names]
                        ).where(F.col(tkey).isNotNull())
    t = target.select(tkey, *[F.col(f"`{n}`").alias(f"old_{n}") for n in names])
    j = keyed_join(t, ch, [tkey], "inner", equal_rows=True)
    return j.select(ROW_NUM, tkey, *[f"old_{n}" for n in names], *[f"new_{n}" for n in names])


def failed_records(outcomes: DataFrame, run_ts) -> DataFrame:
    """One row per failed change: key text, update value (empty), reason, time."""
    return outcomes.where(F.col("failed")).select(
        F.col(KEY).cast("string").alias("key_value"),
        F.lit("").alias("update_value"),
        F.col("reason"),
        F.date_format(F.lit(run_ts).cast("timestamp"), fixed.TEXT_TS_FORMAT).alias("timestamp"),
    )


def run_summary(outcomes: DataFrame) -> DataFrame:
    """One row: totals of a run, as the run's audit entry reports them.

    ``total_count = success_count + fail_count``; a missing key is neither
    unless it counts as a failure (``unmatched='fail'``). ``change_rows`` is
    every change row with a key; ``rows_updated`` counts target rows.
    ``success`` means no failed change.
    """
    s = F.col("status")
    agg = outcomes.agg(
        F.count(F.lit(1)).alias("change_rows"),
        F.count_if(s == APPLIED).alias("success_count"),
        F.count_if(F.col("failed")).alias("fail_count"),
        F.count_if(s == MISSING_KEY).alias("missing_count"),
        F.coalesce(F.sum("rows_updated"), F.lit(0)).cast("long").alias("rows_updated"),
    )
    return agg.select(
        F.col("change_rows").cast("long").alias("change_rows"),
        (F.col("success_count") + F.col("fail_count")).cast("long").alias("total_count"),
        *[F.col(c).cast("long").alias(c) for c in ("success_count", "fail_count", "missing_count", "rows_updated")],
        (F.col("fail_count") == 0).alias("success"),
    )


def failures_by_reason(outcomes: DataFrame) -> DataFrame:
    return (outcomes.where(F.col("status") != APPLIED)
            .groupBy("status", "reason").agg(F.count(F.lit(1)).cast("long").alias("n_changes")))


def apply_all_or_nothing(target: DataFrame, new_target: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Publish ``new_target`` only when no change failed; else the target as it was."""
    failed = outcomes.where(F.col("failed")).limit(1).count()
    return target if failed else new_target


def upsert_by_key(target: DataFrame, new_target: DataFrame, coerced: DataFrame, key_column: str,
                  update_columns: Sequence[str], fits: bool | None = None) -> DataFrame:
    """Applied target plus one inserted row per passing change whose key is absent.

    The keys present are a subset of the change keys, so the change-key bound
    (``fits``) also bounds them; they are not measured again.
    """
    tkey = _target_name(target, key_column)
    names = [_target_name(target, c) for c in update_columns]
    fits = change_keys_fit(coerced) if fits is None else fits
    # by key, not by row number: row numbers repeat where a change set comes from several files
    present = matched_key_counts(target, key_column, coerced, fits).select(KEY_CAST)
    new_rows = keyed_join(passing_changes(coerced), present, [KEY_CAST], "left_anti", small_fits=fits, big_unique=True)
    fields = {f.name: f.dataType for f in target.schema.fields}
    cols = []
    for c in target.columns:
        if c == tkey:
            cols.append(F.col(KEY_CAST).cast(fields[c]).alias(c))
        elif c in names:
            cols.append(F.col(f"`{c}`").cast(fields[c]).alias(c))
        else:
            cols.append(F.lit(None).cast(fields[c]).alias(c))
    return new_target.unionByName(new_rows.select(*cols))


def restore_rows(current: DataFrame, backup: DataFrame, keys: DataFrame, key_column: str,
                 columns: Sequence[str] | None = None) -> DataFrame:
    """Put selected keys back as they are in ``backup``.

    ``columns=None`` restores whole rows (exact even with several rows per
    key: current rows of those keys are replaced by the backup's rows).
    With ``columns`` only those columns are restored; the backup must then
    hold one row per key.
    """
    tkey = _target_name(current, key_column)
    ensure_checkpoint_dir(current.sparkSession)
    # written once: the measurement and every join below read the selection, not its plan
    sel = keys.select(F.col(tkey)).where(F.col(tkey).isNotNull()).distinct().checkpoint()
    sel_fits = can_broadcast(sel)
    if columns is None:
        kept = keyed_join(current, sel, [tkey], "left_anti", small_fits=sel_fits)
        back = keyed_join(backup, sel, [tkey], "left_semi", small_fits=sel_fits)
        return kept.unionByName(back.select(*current.columns))
    names = [_target_name(current, c) for c in columns]
    old = keyed_join(backup.select(tkey, *names), sel, [tkey], "left_semi", small_fits=sel_fits).select(
        tkey, *[F.col(f"`{n}`").alias(_NEW + n) for n in names], F.lit(True).alias(_HIT)).checkpoint()
    stats = change_stats(old, tkey)
    if stats["dup_keys"]:
        raise ValueError("the backup holds several rows for a selected key; restore whole rows instead")
    joined = keyed_join(current, old, [tkey], "left", small_fits=stats_fit(old, stats))
    hit = F.coalesce(F.col(_HIT), F.lit(False))
    return joined.select(*[
        (F.when(hit, F.col(f"`{_NEW}{c}`")).otherwise(F.col(f"`{c}`")).alias(c) if c in names else F.col(f"`{c}`"))
        for c in current.columns])
