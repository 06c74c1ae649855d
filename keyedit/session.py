"""Spark session set-up and the shared folder for lineage cuts."""

from __future__ import annotations

import tempfile
from contextvars import ContextVar

from pyspark.sql import SparkSession

# Settings every job relies on: adaptive execution re-plans joins from
# measured shuffle sizes, splits skewed partitions and coalesces small ones.
_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def get_session(app: str = "keyedit", master: str | None = None,
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the package defaults.

    On a cluster ``master`` stays ``None`` and the cluster's own settings win;
    tests pass ``local[*]`` and a small shuffle-partition count.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


_CHECKPOINT_SET: set[tuple[str, str]] = set()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster must name a shared folder; only a local session (tests, a
    laptop) gets a private one when the setting is missing.
    """
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master or ""
        if not master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        path = tempfile.mkdtemp(prefix="keyedit-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    app = (spark.sparkContext.applicationId, path)
    if app not in _CHECKPOINT_SET:      # each call would make another subfolder
        spark.sparkContext.setCheckpointDir(path)
        _CHECKPOINT_SET.add(app)
    return path


_SCRATCH_ROOT: ContextVar[str | None] = ContextVar("scratch_root", default=None)


def use_scratch_root(root: str | None) -> str | None:
    """From now on scratch tables of this thread go below ``root``; returns the previous one (None: the checkpoint folder)."""
    previous = _SCRATCH_ROOT.get()
    _SCRATCH_ROOT.set(root)
    return previous


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder (or the run's part of it) for written intermediate tables."""
    base = (_SCRATCH_ROOT.get() or ensure_checkpoint_dir(spark)).rstrip("/")
    return f"{base}/{name}"


def checkpoint_by_key(df, keys, num_partitions: int | None = None):
    """Hash-partition ``df`` by ``keys`` and checkpoint it to the shared folder.

    The checkpointed frame remembers its hash partitioning, so later
    aggregates and joins on ``keys`` do not shuffle it again. The checkpoint
    is planned with adaptive execution off: an adaptive plan does not report
    a definite partitioning for the checkpoint to record. The setting is
    restored afterwards; later queries plan adaptively as usual.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [keys] if isinstance(keys, str) else list(keys)
    previous = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df.repartition(n, *keys).checkpoint()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", previous)
