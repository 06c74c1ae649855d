"""The update run end to end.

``run_update`` composes the operators as the tool's run does: gates, target
and column checks, snapshot, staging, match and apply, outcomes, audit and
history. Differences from the tool, on purpose: a failed match is an error,
not a silent success; ``on_failure='restore'`` publishes nothing when any
change fails (the old version and the snapshot stay); the new target is a new
path, the input is never overwritten.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyedit.functions import fixed
from keyedit.operators import apply as ap
from keyedit.operators import audit as au
from keyedit.operators import checks as ck
from keyedit.operators.constraints import Constraints, constraint_failures, without_failed
from keyedit.operators.joins import change_stats, stats_fit
from keyedit.operators.staging import KEY_CAST, bind_changeset, coerce_changes, stage_as_text
from keyedit.plans.versions import VersionStore
from keyedit.scratch import RunScratch
from keyedit.session import checkpoint_by_key
from keyedit.sinks.writers import snapshot, write_counted
from keyedit.spec import UpdateSpec


@dataclass
class RunResult:
    ok: bool
    message: str
    target_path: str | None          # the version to use from now on
    backup_path: str | None          # where the pre-run version lives
    backup_name: str | None          # ``<table>_BAK_<yyyyMMdd_HHmmss>``
    summary: dict
    gates: list[dict]
    outcomes_path: str | None
    version: int | None = None       # the store's version to use from now on, where the target is a store
    files_rewritten: int | None = None


def restore_full(current: DataFrame, backup: DataFrame) -> DataFrame:
    """The whole target as it was in the snapshot (``current`` only fixes the column order)."""
    return backup.select(*current.columns)


def _stamp(run_ts: str, fmt: str) -> str:
    dt = datetime.strptime(run_ts, "%Y-%m-%d %H:%M:%S")
    java_to_py = {"yyyyMMdd_HHmmss": "%Y%m%d_%H%M%S", "yyyy-MM-dd HH:mm:ss": "%Y-%m-%d %H:%M:%S"}
    return dt.strftime(java_to_py[fmt])


def _join_partitions(spark: SparkSession, target: DataFrame) -> int:
    """Partitions for a join with the whole target: its planned size in pieces of the advisory size.

    The checkpointed changes fix the join's partition count (adaptive execution
    can't change it), so it follows the larger side.
    """
    size = int(str(target._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    piece = int(spark.conf.get("keyedit.join.partitionBytes", str(128 << 20)))
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // piece))


def _rolled_back(spark: SparkSession, spec: UpdateSpec, bak_name: str, run_ts: str, summary: dict) -> DataFrame:
    return au.rollback_entry(spark, schema=spec.schema, table=spec.table, backup_table=bak_name, success=True,
                             run_ts=run_ts, error_msg=f"{summary['fail_count']} changes failed")


def run_update(spark: SparkSession, spec: UpdateSpec, raw_changes: DataFrame, target_path: str,
               out_dir: str, run_ts: str, *, audit_path: str | None = None,
               history_path: str | None = None, snapshot_mode: str = "pointer",
               run_id: str | None = None, rules: Constraints | None = None) -> RunResult:
    """Apply ``raw_changes`` (``row_num`` + positional data columns) to the parquet target.

    ``target_path`` may also be the root of a ``VersionStore``: the run then publishes the
    store's next version and rewrites only the files that hold a matching row; untouched
    files are listed again, and the old values are kept for ``VersionStore.undone``.

    Writes under ``out_dir``: ``target_<ts>`` (new version, unless nothing may
    be published) and ``outcomes_<ts>``. The input version is never modified,
    so by default it *is* the snapshot (``snapshot_mode="pointer"``: the
    backup is the old path, restore is a pointer change, nothing is copied).
    ``snapshot_mode="copy"`` also writes ``<table>_BAK_<ts>`` as a full copy.

    Audit entry and history record go to a folder of their own, named by
    ``run_id`` (default: table, stamp and microseconds of the clock); a retry
    that is given the id of its first try replaces what that wrote. A run that
    publishes nothing adds a ROLLBACK entry. Changes that break one of ``rules`` fail with a
    reason of their own and are not applied.

    What the run stages and checkpoints is removed when it ends, also by an error (``scratch``).
    """
    stamp = _stamp(run_ts, fixed.NAME_TS_FORMAT)
    run_id = run_id or f"{spec.table}-{stamp}-{datetime.now():%f}"
    with RunScratch(spark, run_id):
        return _run(spark, spec, raw_changes, target_path, out_dir, run_ts, stamp, audit_path, history_path,
                    snapshot_mode, run_id, rules)


def _run(spark: SparkSession, spec: UpdateSpec, raw_changes: DataFrame, target_path: str, out_dir: str, run_ts: str,
         stamp: str, audit_path: str | None, history_path: str | None, snapshot_mode: str, run_id: str,
         rules: Constraints | None) -> RunResult:
    files = None
    store = VersionStore(spark, target_path)
    store = store if store.exists() else None
    try:
        target = store.frame() if store else spark.read.parquet(target_path)
    except AnalysisException as exc:
        if exc.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return RunResult(False, f"target {target_path!r} does not exist", None, None, None, {}, [], None)

    # 1. gates: one pass over the change set, one over its canonical keys
    n_data = len([c for c in raw_changes.columns if c != "row_num"])
    columns_missing = [c for c in spec.update_columns
                       if c.upper() not in {t.upper() for t in target.columns}]
    if spec.key_column.upper() not in {t.upper() for t in target.columns}:
        return RunResult(False, f"key column {spec.key_column!r} not in target", None, None, None, {}, [], None)
    if columns_missing:
        return RunResult(False, f"update columns not in target: {', '.join(columns_missing)}",
                         None, None, None, {}, [], None)
    bound_all = bind_changeset(raw_changes, spec.update_columns, keep_null_keys=True)
    bound = bound_all.where(F.col("key_value").isNotNull())
    staged = stage_as_text(bound, spec.update_columns)
    coerced = coerce_changes(staged, target.schema, spec.key_column, spec.update_columns, spec.not_null)
    coerced = coerced.persist(StorageLevel.MEMORY_AND_DISK)
    staged_cache = coerced
    try:
        gates = [r.asDict() for r in ck.gate_report(bound_all, coerced, spec.update_columns, n_data,
                                                    max_rows=spec.max_rows, max_text=spec.max_text)
                 .orderBy("seq").collect()]          # six rows
        failed_gate = next((g for g in gates if not g["passed"]), None)
        if failed_gate:
            return RunResult(False, f"gate failed: {failed_gate['check_name']} "
                                    f"(observed {failed_gate['observed']}, limit {failed_gate['limit_value']})",
                             None, None, None, {}, gates, None)

        # 2. snapshot before anything changes
        bak_name = f"{spec.table}{fixed.BACKUP_INFIX}{stamp}"
        if snapshot_mode == "copy":
            backup_path = f"{out_dir.rstrip('/')}/{bak_name}"
            snapshot(target, backup_path)
            backup = spark.read.parquet(backup_path)
        else:
            backup_path, backup = target_path, target

        # one measurement of the staged changes bounds every join of the run: the
        # key list and the passing changes are both subsets of it
        fits = stats_fit(coerced, change_stats(coerced, KEY_CAST))
        if not fits:
            # too large to broadcast: hash-partition the changes by key once and
            # checkpoint them to the shared folder. The checkpoint keeps that
            # partitioning, so the outcome and apply joins shuffle only the target
            # side, and it cuts the lineage (a lost executor re-reads the files).
            coerced = checkpoint_by_key(coerced, KEY_CAST, _join_partitions(spark, target))
            staged_cache.unpersist()          # the checkpoint replaces the cached copy

        # 3. outcomes (written: they feed the summary, the report and the decision)
        outcomes_path = f"{out_dir.rstrip('/')}/outcomes_{stamp}"
        # run outputs are unique per run and never inputs (checked), so a retried run overwrites its own partial output
        keys = None if fits else ap.key_table(backup, spec.key_column, coerced)
        refused = None
        if rules:
            refused = constraint_failures(coerced, backup, spec.key_column, spec.update_columns, rules, fits=fits)
            refused = refused.checkpoint()
        write_counted(ap.row_outcomes(coerced, backup, spec.key_column, spec.unmatched, fits=fits, refused=refused, keys=keys),
                      outcomes_path, mode="overwrite")
        if refused is not None:
            coerced = without_failed(coerced, refused, fits)
        outcomes = spark.read.parquet(outcomes_path)
        summary = ap.run_summary(outcomes).first().asDict()

        # 4. publish a new version unless all-or-nothing forbids it
        publish = not (spec.on_failure == "restore" and summary["fail_count"] > 0)
        new_path = None
        if publish:
            if store:
                new_path = target_path
                files = store.apply(spec.key_column, spec.update_columns, coerced, row_key=spec.row_key or None,
                                    fits=fits, check_unique=False)
            else:
                new_path = f"{out_dir.rstrip('/')}/target_{stamp}"
                new_t = ap.apply_updates(backup, coerced, spec.key_column, spec.update_columns, check_unique=False,
                                         changes_fit=fits, keys=keys)
                write_counted(new_t, new_path, mode="overwrite")

        # 5. audit entry and history record
        one = spark.createDataFrame([summary])
        # one folder per run, overwritten: a retried run replaces its own entry, never adds a second
        if audit_path:
            au.update_entry(one, schema=spec.schema, table=spec.table, key_column=spec.key_column,
                            update_columns=spec.update_columns, backup_table=bak_name, run_ts=run_ts) \
                .unionByName(_rolled_back(spark, spec, bak_name, run_ts, summary).limit(0 if publish else 1)) \
                .coalesce(1).write.mode("overwrite").json(f"{audit_path.rstrip('/')}/run={run_id}")
        if history_path:
            au.history_record(one, schema=spec.schema, table=spec.table, key_column=spec.key_column,
                              update_columns=spec.update_columns, backup_table=bak_name,
                              run_ts=run_ts).write.mode("overwrite").parquet(f"{history_path.rstrip('/')}/run={run_id}")

    finally:
        staged_cache.unpersist()          # staging is dropped on every path, failures included

    if summary["change_rows"] and summary["success_count"] == 0 and summary["fail_count"] == 0:
        msg = "no change matched the target"
    elif publish:
        msg = f"applied {summary['success_count']}, failed {summary['fail_count']}"
    else:
        msg = f"{summary['fail_count']} changes failed; nothing published, target unchanged"
    return RunResult(publish, msg, new_path if publish else target_path, backup_path, bak_name, summary, gates,
                     outcomes_path, files.version if files else store.latest() if store else None,
                     files.files_rewritten if files else None)
