"""What a run keeps in the shared checkpoint folder, and its removal.

Inside ``with RunScratch(spark, run_id):`` every scratch table and every ``checkpoint()`` of
the run goes below ``<spark.checkpoint.dir>/runs/<run_id>``. The folder is the register: it
is made before anything is staged and removed when the run ends, by success or by an
error. A run that was killed leaves it, with a note of who made it and when; ``left_runs``
lists such folders and ``remove_run`` removes one.

Checkpoints have one folder for the whole application, so of runs that overlap in one driver
only the first sends its checkpoints to its own folder; those of the others stay where
they always were.
"""

from __future__ import annotations

import json
import re
import threading
import time

from pyspark.sql import DataFrame, SparkSession

from keyedit.session import ensure_checkpoint_dir, use_scratch_root

_NOTE = "_run.json"
_CHECKPOINTS = threading.Lock()


def _path(spark: SparkSession, *parts: str):
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path("/".join((ensure_checkpoint_dir(spark).rstrip("/"), "runs", *parts)))
    return path, path.getFileSystem(sc._jsc.hadoopConfiguration())


class RunScratch:
    """The scratch folder of one run; a retry with the same id starts with an empty one."""

    def __init__(self, spark: SparkSession, run_id: str):
        self.spark, self.run_id = spark, re.sub(r"[^\w.\-]", "_", run_id)
        self.folder, self.fs = _path(spark, self.run_id)

    def __enter__(self) -> "RunScratch":
        self.fs.delete(self.folder, True)
        note, _ = _path(self.spark, self.run_id, _NOTE)
        out = self.fs.create(note, True)
        text = json.dumps({"application": self.spark.sparkContext.applicationId, "started": int(time.time())})
        out.write(bytearray(text.encode()))
        out.close()
        self._previous = use_scratch_root(str(self.folder))
        self._checkpoints = _CHECKPOINTS.acquire(blocking=False)
        if self._checkpoints:
            self.spark.sparkContext.setCheckpointDir(f"{self.folder}/checkpoints")
        return self

    def __exit__(self, *_) -> None:
        use_scratch_root(self._previous)
        if self._checkpoints:
            self.spark.sparkContext.setCheckpointDir(ensure_checkpoint_dir(self.spark))
            _CHECKPOINTS.release()
        self.fs.delete(self.folder, True)


def left_runs(spark: SparkSession) -> DataFrame:
    """``run_id, application, started, bytes`` of the run folders that exist: runs that go on, or were killed."""
    root, fs = _path(spark)
    rows = []
    for status in fs.listStatus(root) if fs.exists(root) else []:
        name = status.getPath().getName()
        note, _ = _path(spark, name, _NOTE)
        said = {}
        if fs.exists(note):
            stream = fs.open(note)
            try:
                said = json.loads(bytes(stream.readAllBytes()).decode())
            finally:
                stream.close()
        rows.append((name, said.get("application"), said.get("started"), fs.getContentSummary(status.getPath()).getLength()))
    return spark.createDataFrame(rows, "run_id string, application string, started long, bytes long")


def remove_run(spark: SparkSession, run_id: str) -> bool:
    """Remove what a killed run left; False when there is nothing of that name."""
    if not re.fullmatch(r"[\w.\-]+", run_id) or run_id in (".", ".."):
        raise ValueError(f"not a run id: {run_id!r}")
    folder, fs = _path(spark, run_id)
    return bool(fs.delete(folder, True))
