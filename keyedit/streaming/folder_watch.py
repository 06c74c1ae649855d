"""Apply change sets as they arrive in a folder.

The tool applies one change set per run. Here a folder is watched with the
file stream source, one file to a micro-batch; every file is one run
(``run_update``): gates, snapshot, outcomes, new target version, audit. A file
that a gate refuses stops the stream with an error and stays unapplied: its
batch is not committed, so a restart meets it again.
The stream's checkpoint (in the shared checkpoint folder) records which files
were applied, so a restarted job neither skips nor repeats a file. The
current target version is kept in a small pointer table next to the outputs.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from keyedit.plans.job import run_update
from keyedit.session import scratch_path
from keyedit.spec import UpdateSpec

_POINTER = "current_target"


def current_target(spark: SparkSession, out_dir: str, initial: str) -> str:
    try:
        row = spark.read.json(f"{out_dir.rstrip('/')}/{_POINTER}").orderBy("seq", ascending=False).first()
        return row["path"] if row else initial
    except AnalysisException as exc:
        if exc.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):     # no pointer yet
            return initial
        raise


def _advance(spark: SparkSession, out_dir: str, path: str, seq: int) -> None:
    spark.createDataFrame([(seq, path)], "seq long, path string").write.mode("append").json(
        f"{out_dir.rstrip('/')}/{_POINTER}")


def watch_folder(spark: SparkSession, spec: UpdateSpec, source_dir: str, schema: T.StructType,
                 target_path: str, out_dir: str, *, fmt: str = "csv", audit_path: str | None = None,
                 history_path: str | None = None, checkpoint: str | None = None,
                 once: bool = False):
    """Start the watch; returns the ``StreamingQuery``.

    ``schema`` must start with ``row_num`` and then the change set's data
    columns in order. ``once=True`` processes what is there and stops.
    """
    reader = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", 1)
    if fmt == "csv":
        reader = reader.option("header", "true")
    stream = reader.load(source_dir)

    def apply_batch(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        current = current_target(spark, out_dir, target_path)
        ts = datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
        run_dir = f"{out_dir.rstrip('/')}/batch_{batch_id}"
        result = run_update(spark, spec, batch, current, run_dir, ts,
                            audit_path=audit_path, history_path=history_path)
        if not result.ok and result.outcomes_path is None:      # refused before any change was judged
            raise RuntimeError(f"change set of batch {batch_id} was not applied: {result.message}")
        if result.ok and result.target_path and result.target_path != current:
            _advance(spark, out_dir, result.target_path, batch_id)

    writer = (stream.writeStream.foreachBatch(apply_batch)
              .option("checkpointLocation", checkpoint or scratch_path(spark, f"watch_{spec.table}")))
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")
    return writer.start()
