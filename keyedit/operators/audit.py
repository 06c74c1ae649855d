"""Audit entries, run history and run logs as tables.

Audit entries are JSON lines ``{timestamp, action_type, user, success,
error_msg, details}``; history records carry the run counts. Views are
newest first by ``(timestamp desc, id desc)`` and limited; purges and
deletions write a new table and report counts.
"""

from __future__ import annotations

import json
from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyedit.functions import fixed
from keyedit.functions.text import parse_log_line

AUDIT_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("action_type", T.StringType()),
    T.StructField("user", T.StringType()),
    T.StructField("success", T.BooleanType()),
    T.StructField("error_msg", T.StringType()),
    T.StructField("details", T.StringType()),
    T.StructField("id", T.LongType()),
])

UPDATE_DETAILS = T.StructType([
    T.StructField("schema", T.StringType()),
    T.StructField("table", T.StringType()),
    T.StructField("key_column", T.StringType()),
    T.StructField("update_columns", T.ArrayType(T.StringType())),
    T.StructField("total_count", T.LongType()),
    T.StructField("success_count", T.LongType()),
    T.StructField("fail_count", T.LongType()),
    T.StructField("backup_table", T.StringType()),
])


# --- reading -----------------------------------------------------------------

_CORRUPT = "_corrupt"
_READABLE = "a is not null and a._corrupt is null"


def _parsed(lines: DataFrame, value_col: str) -> DataFrame:
    schema = T.StructType([*AUDIT_SCHEMA.fields, T.StructField(_CORRUPT, T.StringType())])
    return lines.select(F.from_json(F.col(value_col), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})
                        .alias("a"), F.col(value_col))


def parse_audit_lines(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """Decode JSON lines; a line that is not a JSON object is dropped (see ``audit_corrupt``).

    An entry without an ``action_type`` is an entry like any other.

    ``details`` stays JSON text so every action type fits one schema; decode it
    per action with ``from_json`` (``UPDATE_DETAILS`` for updates).
    """
    parsed = _parsed(lines, value_col)
    return parsed.where(_READABLE).select("a.*").drop(_CORRUPT)


def audit_corrupt(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """The lines that ``parse_audit_lines`` drops, kept as a side output."""
    return _parsed(lines, value_col).where(~F.expr(_READABLE)).select(value_col)


def read_audit(spark, path: str) -> DataFrame:
    """Audit table from JSON-lines files anywhere under ``path``; a missing path gives an empty table."""
    try:
        lines = spark.read.option("recursiveFileLookup", "true").text(path)
    except Exception as exc:  # AnalysisException for a missing path
        if "PATH_NOT_FOUND" in str(exc) or "does not exist" in str(exc):
            return spark.createDataFrame([], AUDIT_SCHEMA)
        raise
    return parse_audit_lines(lines)


HISTORY_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("schema", T.StringType()),
    T.StructField("table", T.StringType()),
    T.StructField("key_column", T.StringType()),
    T.StructField("update_columns", T.ArrayType(T.StringType())),
    T.StructField("total_count", T.LongType()),
    T.StructField("success_count", T.LongType()),
    T.StructField("fail_count", T.LongType()),
    T.StructField("success", T.BooleanType()),
    T.StructField("backup_table", T.StringType()),
])


def read_history_json(spark, path: str) -> DataFrame:
    """Import a history kept as one JSON array per file (the desktop tool's format).

    Each array element becomes a row; the file is read whole by one task (it
    is one JSON document), which is why runs here keep history as parquet.
    """
    return spark.read.schema(HISTORY_SCHEMA).option("multiLine", "true").json(path)


def read_history(spark, path: str) -> DataFrame:
    """History records from parquet files anywhere under ``path`` (one folder per run)."""
    return spark.read.option("recursiveFileLookup", "true").parquet(path)


# --- views -------------------------------------------------------------------

def by_action(audit: DataFrame, action_type: str | None = None) -> DataFrame:
    return audit if action_type is None else audit.where(F.col("action_type") == action_type)


def newest_first(df: DataFrame, limit: int = fixed.HISTORY_LIMIT) -> DataFrame:
    """Newest ``limit`` rows by ``(timestamp desc, id desc)`` (a distributed top-k)."""
    return df.orderBy(F.col("timestamp").desc_nulls_last(), F.col("id").desc()).limit(limit)


def history_view(history: DataFrame, limit: int = fixed.HISTORY_LIMIT, placeholder: bool = False) -> DataFrame:
    """The history table as shown: 1-based sequence, defaults, status text.

    The window runs over the already limited top-k rows only. With
    ``placeholder`` an empty history shows one "no records" row, as the
    tool's table did.
    """
    top = newest_first(history, limit)
    if placeholder and top.limit(1).count() == 0:
        row = [(1, fixed.MISSING_TEXT, fixed.MISSING_TEXT, fixed.MISSING_TEXT, fixed.MISSING_COUNT,
                fixed.MISSING_COUNT, fixed.MISSING_COUNT, fixed.NO_RECORDS)]
        return history.sparkSession.createDataFrame(
            row, "seq long, timestamp string, table string, schema string, total_count string, "
                 "success_count string, fail_count string, status string")
    w = Window.orderBy(F.col("timestamp").desc_nulls_last(), F.col("id").desc())
    txt = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(fixed.MISSING_TEXT))
    num = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(fixed.MISSING_COUNT))
    return top.select(
        F.row_number().over(w).cast("long").alias("seq"),
        txt("timestamp").alias("timestamp"),
        txt("table").alias("table"),
        txt("schema").alias("schema"),
        num("total_count").alias("total_count"),
        num("success_count").alias("success_count"),
        num("fail_count").alias("fail_count"),
        F.when(F.coalesce(F.col("success"), F.lit(False)), F.lit(fixed.STATUS_SUCCESS))
        .otherwise(F.lit(fixed.STATUS_PARTIAL)).alias("status"),
    )


# --- purges and deletions ----------------------------------------------------

def purge_before(audit: DataFrame, before: str) -> tuple[DataFrame, DataFrame]:
    """Split at ``before`` (text compare on ``yyyy-MM-dd HH:mm:ss``).

    A missing timestamp compares as ``''`` and is therefore purged.
    Returns ``(kept, purged)``.
    """
    old = F.coalesce(F.col("timestamp"), F.lit("")) < F.lit(before)
    return audit.where(~old), audit.where(old)


def purge_counts(audit: DataFrame, before: str, corrupt: DataFrame | None = None) -> DataFrame:
    """One row: ``deleted_count, kept_count, corrupt_count``."""
    old = (F.coalesce(F.col("timestamp"), F.lit("")) < F.lit(before))
    agg = audit.agg(F.count_if(old).cast("long").alias("deleted_count"),
                    F.count_if(~old).cast("long").alias("kept_count"))
    if corrupt is None:
        return agg.withColumn("corrupt_count", F.lit(0).cast("long"))
    z, o = F.lit(0).cast("long"), F.lit(1).cast("long")
    parts = (audit.select(old.cast("long").alias("d"), (~old).cast("long").alias("k"), z.alias("c"))
             .unionByName(corrupt.select(z.alias("d"), z.alias("k"), o.alias("c"))))
    return parts.agg(F.coalesce(F.sum("d"), z).alias("deleted_count"),
                     F.coalesce(F.sum("k"), z).alias("kept_count"),
                     F.coalesce(F.sum("c"), z).alias("corrupt_count"))


def purge_audit(spark, path: str, before: str, out_path: str) -> dict:
    """Write the entries kept by a purge (and the unreadable lines, apart) to new paths.

    Returns ``{deleted_count, kept_count, corrupt_count}``; all three are counted
    in the job that writes the kept entries (``Observation``). The old files stay
    as they are until the caller switches to ``out_path``.
    """
    from pyspark.sql import Observation

    from keyedit.sinks.writers import refuse_same_path, write_counted
    lines = spark.read.text(path)
    refuse_same_path(lines, out_path)
    counts = Observation("keyedit_purge")
    old = F.coalesce(F.col("a.timestamp"), F.lit("")) < F.lit(before)
    good = F.expr(_READABLE)
    seen = _parsed(lines, "value").observe(
        counts, F.count_if(good & old).alias("deleted_count"), F.count_if(good & ~old).alias("kept_count"),
        F.count_if(~good).alias("corrupt_count"))
    seen.where(good & ~old).select("a.*").drop(_CORRUPT).write.mode("overwrite").json(out_path)
    write_counted(audit_corrupt(lines), f"{out_path.rstrip('/')}_corrupt", "text", mode="overwrite")
    return {k: int(v) for k, v in counts.get.items()}


def audit_view(audit: DataFrame, limit: int = fixed.HISTORY_LIMIT, action_type: str | None = None) -> DataFrame:
    """Newest ``limit`` entries, optionally of one action type."""
    return newest_first(by_action(audit, action_type), limit)


def clear_history(history: DataFrame) -> DataFrame:
    """An empty history with the same columns (what is written back on 'clear all')."""
    return history.where(F.lit(False))


def delete_ids(history: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """History without the given record ids (anti join on a broadcast id list when small)."""
    from keyedit.operators.joins import keyed_join
    return keyed_join(history, ids.select(id_col).distinct(), [id_col], "left_anti")


def delete_count(history: DataFrame, remaining: DataFrame) -> DataFrame:
    z, o = F.lit(0).cast("long"), F.lit(1).cast("long")
    parts = history.select(o.alias("b"), z.alias("a")).unionByName(remaining.select(z.alias("b"), o.alias("a")))
    return parts.agg((F.sum("b") - F.coalesce(F.sum("a"), z)).cast("long").alias("deleted_count"),
                     F.coalesce(F.sum("a"), z).cast("long").alias("remaining_count"))


# --- building entries ----------------------------------------------------------

def update_entry(summary: DataFrame, *, schema: str, table: str, key_column: str,
                 update_columns: Sequence[str], backup_table: str, run_ts: str,
                 user: str = "system", entry_id: int = 0) -> DataFrame:
    """The UPDATE audit entry of one run, from its one-row summary."""
    details = F.to_json(F.struct(
        F.lit(schema).alias("schema"), F.lit(table).alias("table"), F.lit(key_column).alias("key_column"),
        F.array(*[F.lit(c) for c in update_columns]).alias("update_columns"),
        F.col("total_count"), F.col("success_count"), F.col("fail_count"),
        F.lit(backup_table).alias("backup_table")))
    return summary.select(
        F.date_format(F.lit(run_ts).cast("timestamp"), fixed.TEXT_TS_FORMAT).alias("timestamp"),
        F.lit(fixed.ACTION_UPDATE).alias("action_type"),
        F.lit(user).alias("user"),
        F.col("success"),
        F.lit("").alias("error_msg"),
        details.alias("details"),
        F.lit(entry_id).cast("long").alias("id"),
    )


def _entry(spark, action: str, details: dict, *, success: bool, run_ts: str, error_msg: str = "",
           user: str = "system", entry_id: int = 0) -> DataFrame:
    """One audit entry of a given kind; ``details`` is kept as JSON text."""
    one = spark.range(1)
    return one.select(
        F.date_format(F.lit(run_ts).cast("timestamp"), fixed.TEXT_TS_FORMAT).alias("timestamp"),
        F.lit(action).alias("action_type"), F.lit(user).alias("user"), F.lit(success).alias("success"),
        F.lit(error_msg).alias("error_msg"), F.lit(json.dumps(details, ensure_ascii=False)).alias("details"),
        F.lit(entry_id).cast("long").alias("id"))


def connection_entry(spark, *, source: str, success: bool, run_ts: str, error_msg: str = "", **more) -> DataFrame:
    """A source or target was opened (or could not be)."""
    return _entry(spark, fixed.ACTION_CONNECTION, {"source": source}, success=success, run_ts=run_ts,
                  error_msg=error_msg, **more)


def export_entry(spark, *, kind: str, path: str, record_count: int, success: bool, run_ts: str,
                 error_msg: str = "", **more) -> DataFrame:
    """Records were exported (or the export failed)."""
    return _entry(spark, fixed.ACTION_EXPORT, {"export_type": kind, "file_path": path, "record_count": record_count},
                  success=success, run_ts=run_ts, error_msg=error_msg, **more)


def rollback_entry(spark, *, schema: str, table: str, backup_table: str, success: bool, run_ts: str,
                   error_msg: str = "", **more) -> DataFrame:
    """A target went back to, or stayed at, the version before a run."""
    return _entry(spark, fixed.ACTION_ROLLBACK, {"schema": schema, "table": table, "backup_table": backup_table},
                  success=success, run_ts=run_ts, error_msg=error_msg, **more)


def write_history(history: DataFrame, remaining: DataFrame, path: str) -> dict:
    """Write a shortened or cleared history to a new path: ``{deleted_count, remaining_count}``."""
    from keyedit.sinks.writers import write_counted
    n = write_counted(remaining, path, mode="overwrite")
    return {"deleted_count": history.count() - n, "remaining_count": n}


def history_record(summary: DataFrame, *, schema: str, table: str, key_column: str,
                   update_columns: Sequence[str], backup_table: str, run_ts: str) -> DataFrame:
    ts = F.lit(run_ts).cast("timestamp")
    return summary.select(
        F.date_format(ts, fixed.ID_TS_FORMAT).alias("id"),
        F.date_format(ts, fixed.TEXT_TS_FORMAT).alias("timestamp"),
        F.lit(schema).alias("schema"), F.lit(table).alias("table"), F.lit(key_column).alias("key_column"),
        F.array(*[F.lit(c) for c in update_columns]).alias("update_columns"),
        "total_count", "success_count", "fail_count", "success",
        F.lit(backup_table).alias("backup_table"),
    )


def append_json(df: DataFrame, path: str) -> None:
    """Append entries as JSON lines (a bag union with what is there)."""
    df.write.mode("append").json(path)


# --- run log -------------------------------------------------------------------

def export_log_csv(parsed: DataFrame, path: str) -> int:
    """Write parsed log lines with the tool's three column headers; returns the line count."""
    from keyedit.sinks.writers import export_csv
    h = fixed.LOG_EXPORT_HEADERS
    out = parsed.select(F.col("time").alias(h[0]), F.col("level").alias(h[1]), F.col("message").alias(h[2]))
    return export_csv(out, path, empty_ok=True)


def parse_log(lines: DataFrame, value_col: str = "value", normalize_level: bool = False) -> DataFrame:
    """``(time, level, message)`` per non-blank line.

    With ``normalize_level`` a ``SUCCESS - ``/``ERROR - ``/``WARNING - `` prefix
    that the logger put in the message replaces the level.
    """
    other = [c for c in lines.columns if c != value_col]
    p = lines.select(*other, parse_log_line(F.col(value_col)).alias("p")).where(F.col("p").isNotNull())
    out = p.select(*other, "p.time", "p.level", "p.message")
    if normalize_level:
        pref = F.regexp_extract("message", r"^(SUCCESS|ERROR|WARNING) - ", 1)
        out = out.select(*other, "time",
                         F.when(pref != "", pref).otherwise(F.col("level")).alias("level"),
                         F.when(pref != "", F.expr("substring(message, length(regexp_extract(message, '^(SUCCESS|ERROR|WARNING) - ', 0)) + 1)"))
                         .otherwise(F.col("message")).alias("message"))
    return out
