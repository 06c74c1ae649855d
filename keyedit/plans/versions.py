"""A target kept as versions of a list of files; a run rewrites only files that hold a changed row.

A store is a folder with ``versions/v=<n>`` (one row per data file: the list that *is* the
version), and for each run a folder under ``data`` (files that it added) and one under
``undo`` (what it overwrote). Data files are never changed once listed:

* ``apply`` finds the files with a matching key (a semi join of the target's key and file
  name against the change keys, reduced to distinct files), rewrites those with
  ``apply_updates`` into new files and lists these beside the untouched ones;
* ``restore`` lists the files of an earlier version again, without moving a row;
* ``undone`` takes chosen keys or columns back to any version, over several runs: of the
  undo entries made after it, the earliest one for each key and column holds the old value.

A version counts once its list, written whole elsewhere, is renamed to its place, so of two
runs that start from one version only one can publish; the other fails, as does a run that
is lost on the way, and leaves files that no version lists (``unlisted`` names them). File
names come to the driver, as they do for every scan that Spark plans; rows do not.

Partitioned tables of a catalog are rewritten by partition instead (``partitioned``).
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass
from typing import Sequence
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyedit.operators import apply as ap
from keyedit.operators.joins import change_stats, keyed_join, stats_fit
from keyedit.operators.staging import KEY_CAST
from keyedit.sinks.writers import write_counted

VERSION = "version"
#: same_as: the version whose files are listed again; undo: the run's folder of old values
_LIST = "file string, schema string, same_as int, undo string"
_CHANGED, _OLD = "changed", "old_"


def file_name() -> Column:
    """The file of a scanned row, spelled as the lists have it."""
    return F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/")


def _names(scan: DataFrame) -> list[str]:
    """The files that a plain scan reads, in the same spelling (escaped, as Spark gives them)."""
    return [re.sub("^file:/+", "file:/", f) for f in scan.inputFiles()]


@dataclass
class FileRun:
    version: int             # the version that holds the result (the old one where nothing matched)
    files_rewritten: int
    files_kept: int
    rows_rewritten: int


class VersionStore:
    """The versions of one unpartitioned parquet target under ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # --- lists of files ---------------------------------------------------------

    def _list(self, version: int) -> str:
        return f"{self.root}/versions/v={version}"

    def _folder(self, *parts: str):
        """A folder as Hadoop names it, and its file system."""
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))
        return path, path.getFileSystem(sc._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        return bool(self.versions())

    def versions(self) -> list[int]:
        """The published versions, ascending: those whose list was written to its end."""
        folder, fs = self._folder("versions")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n[2:]) for n in names if re.fullmatch("v=[0-9]+", n))

    def latest(self) -> int:
        return self.versions()[-1]

    def files(self, version: int | None = None) -> DataFrame:
        """``file, schema, same_as, undo`` of a version: one row per data file."""
        return self.spark.read.schema(_LIST).parquet(self._list(self.latest() if version is None else version) + "/*.parquet")

    def _publish(self, version: int, files: DataFrame) -> None:
        """Write the list aside and rename it to its place; a place that is taken is never written to."""
        name = uuid.uuid4().hex
        files.select("file", "schema", "same_as", "undo").write.parquet(f"{self.root}/lists/{name}")
        written, fs = self._folder("lists", name)
        place, _ = self._folder("versions", f"v={version}")
        fs.mkdirs(place.getParent())
        moved = not fs.exists(place) and fs.rename(written, place)
        late, _ = self._folder("versions", f"v={version}", name)
        if moved and fs.exists(late):       # another list was renamed in between: this one went below it
            fs.delete(late, True)
            moved = False
        if not moved:
            raise RuntimeError(f"version {version} was published by another run; start again from it")

    def _read(self, paths: Sequence[str], schema: T.StructType) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[unquote(p) for p in paths])

    def schema(self, version: int | None = None) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.files(version).first()["schema"]))

    def frame(self, version: int | None = None) -> DataFrame:
        """The rows of a version (the newest by default)."""
        rows = self.files(version).collect()        # one row per file
        return self._read(sorted(r["file"] for r in rows), self.schema(version))

    def unlisted(self) -> DataFrame:
        """Data files that no version lists: what a run left that failed before it was published."""
        lists = [self.files(v).select("file") for v in self.versions()]
        listed = lists[0]
        for more in lists[1:]:
            listed = listed.union(more)
        try:
            found = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
                "pathGlobFilter", "*.parquet").load(f"{self.root}/data").select(F.col("path").alias("file"))
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
            found = self.spark.createDataFrame([], "file string")
        place = F.regexp_extract("file", "(/data/v=[0-9]+-[0-9a-f]+/[^/]+)$", 1).alias("place")     # the one spelling of all
        return found.select("file", place).join(listed.select(place).distinct(), "place", "left_anti").select("file")

    # --- writing versions -------------------------------------------------------

    def create(self, target: DataFrame) -> int:
        """Version 0: a list of the files that ``target`` (a plain parquet scan) reads. Nothing is copied."""
        if self.exists():
            raise ValueError(f"{self.root} already holds versions")
        names = _names(target)
        if not names:
            raise ValueError("the target has no data files")
        if any(f"/{c}=" in f for f in names for c in target.columns):
            raise ValueError("the target is partitioned by a column: its files do not hold it")
        schema = target.schema.json()
        self._publish(0, self.spark.createDataFrame([(f, schema, None, None) for f in names], _LIST))
        return 0

    def touched_files(self, key_column: str, coerced: DataFrame, version: int | None = None,
                      fits: bool | None = None) -> DataFrame:
        """``file``: the files with at least one row that a passing change matches.

        Beyond the broadcast bound the target side is first reduced to one row for each key
        and file, map-side, so the rows of a hot key do not travel.
        """
        target = self.frame(version)
        tkey = ap._target_name(target, key_column)
        keys = ap.passing_changes(coerced).select(F.col(KEY_CAST).alias(tkey))
        if fits is None:
            fits = stats_fit(keys, change_stats(keys, tkey))
        rows = target.select(f"`{tkey}`", file_name().alias("file"))
        if fits:
            hit = keyed_join(rows, keys, [tkey], "left_semi", small_fits=True)
        else:
            hit = keyed_join(rows.distinct(), keys.distinct(), [tkey], "left_semi", small_fits=False)
        return hit.select("file").distinct()

    def apply(self, key_column: str, update_columns: Sequence[str], coerced: DataFrame, *,
              row_key: Sequence[str] | None = None, fits: bool | None = None, check_unique: bool = True) -> FileRun:
        """Publish the next version with the passing changes applied.

        ``row_key`` names columns that tell the target rows of one key apart (needed to undo
        a run on a target with several rows per key); without it the key stands for its row.
        """
        before = self.latest()
        listed = self.files(before)
        schema = self.schema(before)
        if check_unique:
            ap.assert_unique_keys(coerced)
        if fits is None:
            good = ap.passing_changes(coerced)
            fits = stats_fit(good, change_stats(good, KEY_CAST))     # one measurement for every join below
        touched = sorted(r["file"] for r in self.touched_files(key_column, coerced, before, fits).collect())
        if not touched:
            return FileRun(before, 0, listed.count(), 0)
        version = before + 1
        old = self._read(touched, schema)
        run = f"v={version}-{uuid.uuid4().hex}"       # a run's own folders: a run beside it can't touch them
        self._journal(run, old, coerced, key_column, update_columns, row_key, fits)
        new = ap.apply_updates(old, coerced, key_column, update_columns, check_unique=False, changes_fit=fits)
        data = f"{self.root}/data/{run}"
        n = write_counted(new, data)
        added = _names(self.spark.read.schema(schema).parquet(data))
        gone = self.spark.createDataFrame([(f,) for f in touched], "file string")
        kept = listed.join(gone, "file", "left_anti").drop("same_as", "undo")
        more = self.spark.createDataFrame([(f, schema.json()) for f in added], "file string, schema string")
        self._publish(version, kept.unionByName(more).withColumns({"same_as": F.lit(None).cast("int"), "undo": F.lit(run)}))
        return FileRun(version, len(touched), self.files(version).count() - len(added), n)

    def restore(self, version: int) -> int:
        """Publish a version that lists the files of an earlier one: the whole target goes back, no row is written."""
        now = self.latest()
        if version not in self.versions():
            raise ValueError(f"no version {version}")
        self._publish(now + 1, self.files(version).withColumns({"same_as": F.lit(version), "undo": F.lit(None).cast("string")}))
        return now + 1

    # --- undo -------------------------------------------------------------------

    def _journal(self, run: str, old: DataFrame, coerced: DataFrame, key_column: str,
                 update_columns: Sequence[str], row_key: Sequence[str] | None, fits: bool | None) -> None:
        """The old values of every row that the run overwrites, with the names of the columns it sets."""
        tkey = ap._target_name(old, key_column)
        place = [ap._target_name(old, c) for c in (row_key or [key_column])]
        names = [ap._target_name(old, c) for c in update_columns]
        if set(place) & set(names):
            raise ValueError("columns that identify a row can't be updated in a store with undo")
        keys = ap.passing_changes(coerced).select(F.col(KEY_CAST).alias(tkey))
        wanted = dict.fromkeys([tkey, *place, *names])
        rows = keyed_join(old.select(*[F.col(f"`{c}`") for c in wanted]), keys, [tkey], "left_semi", small_fits=fits)
        entries = rows.select(*[F.col(f"`{c}`") for c in place], *[F.col(f"`{c}`").alias(_OLD + c) for c in names],
                              F.array(*[F.lit(c) for c in names]).alias(_CHANGED))
        write_counted(entries, f"{self.root}/undo/{run}")

    def runs_since(self, version: int) -> list[int]:
        """The runs that lead from ``version`` to the newest version, newest first.

        A restored version goes on from the one it lists again; the runs it left behind do not count.
        """
        out, now = [], self.latest()
        while now > version:
            back = self.files(now).first()["same_as"]
            if back is None:
                out.append(now)
            now = now - 1 if back is None else int(back)
        if now != version:
            raise ValueError(f"version {version} was left behind by a restore: take it back with restore()")
        return out

    def undo_entries(self, after: int, place: Sequence[str], columns: Sequence[str]) -> DataFrame:
        """Undo entries of the runs that lead from version ``after`` to now, with the run's ``version``."""
        of = {f.name: f.dataType for f in self.schema(after).fields}
        shape = T.StructType([T.StructField(c, of[c]) for c in place]
                             + [T.StructField(_OLD + c, of[c]) for c in columns]
                             + [T.StructField(_CHANGED, T.ArrayType(T.StringType()))])
        out = self.spark.createDataFrame([], shape).withColumn(VERSION, F.lit(0))
        for v in self.runs_since(after):
            # columns that a run did not set are missing from its entries and read as NULL
            out = out.unionByName(self.spark.read.schema(shape).parquet(
                f"{self.root}/undo/{self.files(v).first()['undo']}").withColumn(VERSION, F.lit(v)))
        return out

    def undone(self, version: int, key_column: str, columns: Sequence[str], *, keys: DataFrame | None = None,
               row_key: Sequence[str] | None = None) -> DataFrame:
        """The newest rows with ``columns`` (of the chosen ``keys``, or of all) as they were in ``version``.

        An entry says what a column held before its run. A value of ``version`` that no later
        run set is still there; else it is in the earliest later entry for that row and
        column: one aggregate over the entries, one join with the target.
        """
        now = self.frame()
        place = [ap._target_name(now, c) for c in (row_key or [key_column])]
        names = [ap._target_name(now, c) for c in columns]
        tkey = ap._target_name(now, key_column)
        entries = self.undo_entries(version, place, names)
        if keys is not None:
            wanted = keys.select(F.col(tkey)).where(F.col(tkey).isNotNull()).distinct()
            entries = keyed_join(entries, wanted, [tkey], "left_semi")
        # a struct tells an old NULL from no entry at all
        first = [F.min_by(F.struct(F.col(f"`{_OLD}{c}`").alias("v")),
                          F.when(F.array_contains(_CHANGED, c), F.col(VERSION))).alias(_OLD + c) for c in names]
        old = entries.groupBy(*[F.col(f"`{c}`") for c in place]).agg(*first)
        joined = keyed_join(now, old, place, "left")
        return joined.select(*[
            F.when(F.col(f"`{_OLD}{c}`").isNotNull(), F.col(f"`{_OLD}{c}`.v")).otherwise(F.col(f"`{c}`")).alias(c)
            if c in names else F.col(f"`{c}`") for c in now.columns])
