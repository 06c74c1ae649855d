"""Apply a change set to a partitioned catalog table, rewriting only touched partitions.

At scale a run should not rewrite the whole table. For a table stored
partitioned (``partitionBy``), the partitions holding a changed key are found
with a semi join of the target's ``(partition columns, key)`` against the
change keys. That set is bounded by the number of partitions; it is broadcast
and then drives dynamic partition pruning. Only those partitions are:

1. copied to the backup path (the snapshot of what will change; when a
   partition column itself is updated, the partitions that rows move into are
   copied and rebuilt too),
2. rebuilt with ``apply_updates`` and written to a staging path under the
   shared checkpoint folder (a written table cuts the lineage, so the
   overwrite never reads what it replaces),
3. swapped in with ``insertInto(..., overwrite=True)`` under dynamic partition
   overwrite, which replaces exactly the partitions present in the staged data;
   partitions that lost all their rows are then dropped (of an external table the
   catalog forgets them; their files stay where they are).

A NULL partition value is a partition like any other (joins are null-safe).
Untouched partitions are neither read in full nor written.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyedit.operators import apply as ap
from keyedit.operators.joins import keyed_join
from keyedit.operators.staging import KEY_CAST
from keyedit.scratch import RunScratch
from keyedit.session import ensure_checkpoint_dir, scratch_path
from keyedit.sinks.writers import write_counted


@dataclass
class PartitionRun:
    touched_partitions: int
    rows_rewritten: int
    backup_path: str


def touched_partitions(target: DataFrame, partition_cols: Sequence[str], key_column: str,
                       coerced: DataFrame, update_columns: Sequence[str] = ()) -> DataFrame:
    """Distinct partition values holding at least one passing change key.

    With a partition column among ``update_columns`` also the partitions that
    the changed rows move into.
    """
    # equal rows are collapsed before the join: a hot key is one row per partition value
    tk = target.select(*partition_cols, key_column).distinct()
    updated = {c.lower() for c in update_columns}
    moved = [c for c in partition_cols if c.lower() in updated]
    fields = {f.name.lower(): f.dataType for f in target.schema.fields}
    changes = ap.passing_changes(coerced)
    names = {c.lower(): c for c in changes.columns}
    keys = changes.select(F.col(KEY_CAST).alias(key_column),
                          *[F.col(f"`{names[c.lower()]}`").cast(fields[c.lower()]).alias(f"__to_{c}") for c in moved])
    hit = keyed_join(tk, keys, [key_column], "inner")
    out = hit.select(*partition_cols)
    if moved:
        out = out.union(hit.select(*[F.col(f"__to_{c}").alias(c) if c in moved else F.col(c) for c in partition_cols]))
    return out.distinct()


def _same_partition(a: DataFrame, b: DataFrame, partition_cols: Sequence[str]):
    cond = F.lit(True)
    for c in partition_cols:
        cond = cond & a[c].eqNullSafe(b[f"__p_{c}"])
    return cond


def _named(parts: DataFrame, partition_cols: Sequence[str]) -> DataFrame:
    return parts.select(*[F.col(c).alias(f"__p_{c}") for c in partition_cols])


def _drop_partitions(spark: SparkSession, table: str, gone: DataFrame, partition_cols: Sequence[str]) -> None:
    """Drop emptied partitions, a few hundred to a statement (bounded by the touched partitions)."""
    def literal(v):
        return "null" if v is None else "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"
    q = lambda n: "`" + n.replace("`", "``") + "`"
    specs = []

    def flush():
        if specs:
            spark.sql(f"ALTER TABLE {table} DROP IF EXISTS " + ", ".join(specs))
            specs.clear()
    for r in gone.toLocalIterator():
        specs.append("PARTITION (" + ", ".join(f"{q(c)} = {literal(r[c])}" for c in partition_cols) + ")")
        if len(specs) >= 500:
            flush()
    flush()


def apply_to_partitions(spark: SparkSession, table: str, partition_cols: Sequence[str], key_column: str,
                        update_columns: Sequence[str], coerced: DataFrame, backup_path: str,
                        run_id: str) -> PartitionRun:
    """Rewrite only the partitions of catalog table ``table`` that the changes touch.

    The staged partitions are removed when the run ends, also by an error; the backup stays.
    """
    with RunScratch(spark, f"{table}-{run_id}"):
        return _apply(spark, table, partition_cols, key_column, update_columns, coerced, backup_path, run_id)


def _apply(spark: SparkSession, table: str, partition_cols: Sequence[str], key_column: str,
           update_columns: Sequence[str], coerced: DataFrame, backup_path: str, run_id: str) -> PartitionRun:
    target = spark.table(table)
    ap.assert_unique_keys(coerced)
    ensure_checkpoint_dir(spark)
    parts = touched_partitions(target, partition_cols, key_column, coerced, update_columns).checkpoint()
    n_parts = parts.count()
    if n_parts == 0:
        return PartitionRun(0, 0, backup_path)
    # the partition list is counted above; broadcast it (which also enables
    # dynamic partition pruning of the scan) only while it is small
    max_parts = int(spark.conf.get("keyedit.partitions.maxBroadcast", "1000000"))
    side = _named(parts, partition_cols)
    side = F.broadcast(side) if n_parts <= max_parts else side
    affected = target.join(side, _same_partition(target, side, partition_cols), "left_semi")
    write_counted(affected.select(*target.columns), backup_path, mode="overwrite")
    old = spark.read.parquet(backup_path)
    new = ap.apply_updates(old, coerced, key_column, update_columns, check_unique=False)
    staged = scratch_path(spark, f"staged_{table}_{run_id}")
    n_rows = write_counted(new.select(*target.columns), staged, mode="overwrite")
    previous = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        spark.read.parquet(staged).select(*target.columns).write.insertInto(table, overwrite=True)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", previous)
    left = _named(spark.read.parquet(staged).select(*partition_cols).distinct(), partition_cols)
    was = old.select(*partition_cols).distinct()
    _drop_partitions(spark, table, was.join(left, _same_partition(was, left, partition_cols), "left_anti"), partition_cols)
    return PartitionRun(n_parts, n_rows, backup_path)


def merge_sql(table: str, source_view: str, key_column: str, update_columns: Sequence[str]) -> str:
    """``MERGE INTO`` text for table formats that support it (Delta, Iceberg).

    Identifiers are back-quoted; the caller has already resolved them against
    the table's schema, so nothing user-typed reaches the SQL unchecked.
    """
    q = lambda n: "`" + n.replace("`", "``") + "`"
    sets = ", ".join(f"t.{q(c)} = s.{q(c)}" for c in update_columns)
    return (f"MERGE INTO {table} AS t USING {q(source_view)} AS s "
            f"ON t.{q(key_column)} = s.{q(key_column)} WHEN MATCHED THEN UPDATE SET {sets}")


def apply_with_merge(spark: SparkSession, table: str, key_column: str, update_columns: Sequence[str],
                     coerced: DataFrame, *, partition_cols: Sequence[str] | None = None,
                     backup_path: str | None = None, run_id: str = "run") -> str:
    """Apply passing changes with ``MERGE INTO`` where the table format supports it.

    Returns ``"merge"`` or, when the table refuses MERGE (plain parquet),
    ``"partitions"`` after rewriting only the touched partitions instead.
    Keys must be unique (checked first), so MERGE never matches a target row twice.
    """
    target = spark.table(table)
    cols = {c.lower(): c for c in target.columns}
    key = cols[key_column.lower()]
    names = [cols[c.lower()] for c in update_columns]
    ap.assert_unique_keys(coerced)
    good = ap.passing_changes(coerced).select(F.col(KEY_CAST).alias(key), *[F.col(f"`{n}`") for n in names])
    view = f"keyedit_changes_{run_id}"
    good.createOrReplaceTempView(view)
    try:
        spark.sql(merge_sql(table, view, key, names))
        return "merge"
    except Exception as exc:  # AnalysisException / UnsupportedOperation on formats without MERGE
        # only a table that cannot MERGE at all leads to the rewrite; other errors quote the statement too
        error_class = exc.getCondition() if hasattr(exc, "getCondition") else None
        refused = (error_class or "").startswith("UNSUPPORTED") or "MERGE INTO TABLE is not supported" in str(exc)
        if not refused:
            raise
        if not partition_cols or backup_path is None:
            raise ValueError(f"table {table} does not support MERGE; give partition_cols and backup_path") from exc
        apply_to_partitions(spark, table, partition_cols, key, names, coerced, backup_path, run_id)
        return "partitions"
    finally:
        spark.catalog.dropTempView(view)
