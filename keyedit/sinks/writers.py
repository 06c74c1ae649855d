"""Writes: snapshots, new target versions, reports.

A table that is being read is never overwritten in place: every write goes to
a new path, and the caller gets that path back (restoring is then a pointer
change). Writes carry a row count taken by an ``Observation`` in the same
job, so counting costs no second pass.
"""

from __future__ import annotations

import os
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def _norm(path: str) -> str:
    """Plain absolute form of a path or URI: percent codes decoded, the local scheme left out."""
    if "://" in path or path.startswith("file:"):
        u = urlsplit(path)
        path = unquote(u.path)
        if u.scheme != "file":
            return f"{u.scheme}://{u.netloc}{os.path.normpath(path)}"
    return os.path.abspath(path)


def input_paths(df: DataFrame) -> list[str]:
    """Root folders and files of the file relations that ``df`` reads (no listing of their files)."""
    found: set[str] = set()
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() != "LogicalRelation":
            continue
        relation = leaf.relation()
        if relation.getClass().getSimpleName() == "HadoopFsRelation":
            roots = relation.location().rootPaths()
            found.update(_norm(roots.apply(k).toString()) for k in range(roots.size()))
    return sorted(found)


def refuse_same_path(df: DataFrame, path: str) -> None:
    """Refuse to write over, into or around anything the frame reads."""
    out = _norm(path)
    for p in input_paths(df):
        if p == out or p.startswith(out + "/") or out.startswith(p + "/"):
            raise ValueError(f"output path {path!r} is also an input of this job")


def write_counted(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists",
                  **options) -> int:
    """Write ``df`` to a new ``path`` and return its row count from the same job."""
    refuse_same_path(df, path)
    obs = Observation("keyedit_write")
    observed = df.observe(obs, F.count(F.lit(1)).alias("rows"))
    w = observed.write.mode(mode).format(fmt)
    for k, v in options.items():
        w = w.option(k, v)
    w.save(path)
    return int(obs.get["rows"])


def snapshot(df: DataFrame, path: str) -> int:
    """Copy the target as it is to ``path`` (the backup); returns its row count."""
    return write_counted(df, path, "parquet", mode="overwrite")


def export_csv(df: DataFrame, path: str, empty_ok: bool = False) -> int:
    """Export records with a header line; an empty export is an error unless allowed."""
    n = write_counted(df, path, "csv", header="true")
    if n == 0 and not empty_ok:
        raise ValueError("no records to export")
    return n


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", batchsize: int = 10000,
               **options) -> None:
    """Stage rows in a database table (batched inserts per partition)."""
    w = df.write.format("jdbc").option("url", url).option("dbtable", table).option("batchsize", batchsize)
    for k, v in options.items():
        w = w.option(k, v)
    w.mode(mode).save()
