"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import os
import uuid
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyedit.session import scratch_path

#: White space that parts words: space and the five control characters 09 to 0D.
WS = " \t\n\x0b\x0c\r"
WS_CLASS = r"[ \t-\r]"


try:
    _LIBC = ctypes.CDLL(None)
    _LIBC.malloc_trim
except (AttributeError, OSError):       # another C library: it keeps what it likes
    _LIBC = None

#: What a worker's arrays leave goes back to the system, not to a store of its own: workers go on to other stages.
_FRUGAL = {"MALLOC_TRIM_THRESHOLD_": str(8 << 20), "MALLOC_MMAP_THRESHOLD_": str(1 << 20), "MALLOC_ARENA_MAX": "2",
           "ARROW_DEFAULT_MEMORY_POOL": "system"}
#: Rows and bytes of an Arrow batch between the JVM and a worker. Both hold whole batches, and the JVM some times as
#: much outside its heap: its buffers double as they grow, and what it frees it keeps. A longer row is a batch alone.
BATCH_ROWS, BATCH_BYTES = 2_000, 3 << 20
#: Rows that a Parquet reader decodes at once: 4,096 texts are arrays of many MB, for which the JVM's heap grows.
READ_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def on_workers(spark: SparkSession) -> None:
    """Python workers look for this package where the driver found it (a cluster may have it installed as well)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])
    env.update(_FRUGAL)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(min(
        BATCH_ROWS, int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")))))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(min(
        READ_ROWS, int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")))))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the identifier and the text: other columns, whatever their names, play no part."""
    on_workers(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).cast("string").alias("text"))


def crc_bucket(col: Column, n: int) -> Column:
    """crc32 of the number's decimal text, modulo ``n`` (NULL for a NULL number)."""
    return F.pmod(F.crc32(F.encode(col.cast("string"), "UTF-8")), F.lit(n))


#: For rows of some MB. Parquet's writer looks at what it holds only every 100 rows, compresses a page of them outside
#: the JVM's heap, and its reader decodes a row group at once: with these, both hold a few rows.
LARGE_ROWS = {"parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}


def stored(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    The committed files replace the lineage: an executor lost later costs a
    re-read, not a recomputation. ``options``: of the writer.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_KEPT: dict[tuple[str, str], object] = {}


def kept(kind: str, path: str, make):
    """What ``make(path)`` gives, kept in this worker for later tasks; only the last one asked for."""
    if (kind, path) not in _KEPT:
        _KEPT.clear()
        _KEPT[kind, path] = make(path)
    return _KEPT[kind, path]


def _task_starts(keeps: bool) -> None:
    if not keeps:
        _KEPT.clear()       # left by a stage of another operator


def _task_ends() -> None:
    """What Arrow and the allocator hold for later use is given back: the worker goes on to other stages."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def slices(batches, rows: int = 256, keeps: bool = False):
    """Parts of Arrow batches, so that Python objects exist for a few hundred texts at once.

    ``keeps``: the task uses what ``kept`` holds; else that is dropped first.
    """
    _task_starts(keeps)
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    _task_ends()


def slices_of_size(batches, column: str = "text", size: int = 8 << 20, keeps: bool = False):
    """Parts of Arrow batches whose texts take about ``size`` bytes, or hold one longer text."""
    _task_starts(keeps)
    for batch in batches:
        length = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(length) // size
        at = 0
        for end in [*(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]:
            if end > at:
                yield batch.slice(at, end - at)
            at = end
    _task_ends()


def gathered(batches, column: str = "text", size: int = 8 << 20):
    """Arrow batches put together until their texts take ``size`` bytes: what equal rows share is worked out once for all."""
    held, length = [], 0
    for batch in batches:
        held.append(batch)
        length += pc.sum(pc.binary_length(batch.column(column))).as_py() or 0
        if length >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, length = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def text_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; NULL gives an empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


class Memory:
    """Values by key in two generations: what is in use stays, the rest goes when the newer one is full."""

    def __init__(self, limit: int):
        self.limit, self.new, self.old = limit, {}, {}

    def find(self, keys: list) -> list:
        """The values, None where unknown. Found ones belong to the newer generation from now on."""
        if len(self.new) > self.limit:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        values = list(map(new.get, keys))
        if old:
            for i, x in enumerate(values):
                if x is None and (x := old.get(keys[i])) is not None:
                    values[i] = new[keys[i]] = x
        return values


class Split:
    """Texts of an Arrow array cut at single spaces, with each distinct piece once.

    ``distinct`` are the distinct pieces, ``pieces`` the same as a list; ``join`` puts a value
    for each piece back into the texts' order, one value per text.
    """

    def __init__(self, column: pa.Array):
        lists = pc.split_pattern(column, " ")
        self.offsets = lists.offsets
        coded = lists.flatten().dictionary_encode()
        self.indices = coded.indices
        self.distinct = coded.dictionary

    @cached_property
    def pieces(self) -> list[str]:
        return self.distinct.to_numpy(zero_copy_only=False).tolist()

    def join(self, values: list[bytes | None] | pa.Array, separator: bytes, skip_first: bool = False) -> list[bytes | None]:
        """Joined values of each text's pieces; None where a piece's value is None."""
        indices = self.indices
        if not isinstance(values, pa.Array):
            values = pa.array(values, pa.large_binary())
        if skip_first:
            values = pa.concat_arrays([values, pa.array([b""], pa.large_binary())])
            at = self.offsets.to_numpy()[:-1]
            at = at[at < self.offsets.to_numpy()[1:]]
            x = indices.to_numpy().copy()
            x[at] = len(values) - 1
            indices = pa.array(x)
        taken = values.take(indices)
        return pc.binary_join(pa.ListArray.from_arrays(self.offsets, taken), pa.scalar(separator, pa.large_binary())).to_pylist()
