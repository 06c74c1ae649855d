"""Keyed joins that stay safe at scale.

``keyed_join(big, small, keys, how)`` picks one of two plans:

1. **Broadcast** the small side, but only after measuring it with one
   distributed aggregate: at most ``max_rows`` rows and ``max_bytes`` bytes.
   The big side is then never shuffled, so a hot key on the big side costs
   nothing.
2. Otherwise a **shuffle join with hot-key salting**: keys holding at least
   ``hot_rows`` rows of the big side are found with a map-side-combined
   count (at most ``rows(big) / hot_rows`` of them). Each hot key's
   big-side rows are spread by a hash of their content
   over ``ceil(rows / rows_per_bucket)`` buckets, so every piece holds about
   ``rows_per_bucket`` rows however hot the key, and its small-side rows are
   repeated once per bucket. All other keys join in bucket 0. Rows with a
   NULL key stay out of the shuffle.

Salting keeps every pair exactly once: a big-side row sits in one bucket and
each small-side row of a hot key is present in every bucket of that key.
Nothing is dropped, capped or sampled; the replicated part is the small-side
rows of hot keys times their bucket counts.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyedit.session import ensure_checkpoint_dir

_SALT = "__salt"
_HOT = "__hot"
_BUCKETS = "__buckets"


def _conf_int(df: DataFrame, key: str, default: int) -> int:
    try:
        v = df.sparkSession.conf.get(key, None)
    except Exception:  # pragma: no cover - conf access is plain
        v = None
    return int(v) if v not in (None, "") else default


def broadcast_limits(df: DataFrame) -> tuple[int, int]:
    """(max_rows, max_bytes) for a broadcast side, from session settings."""
    threshold = _conf_int(df, "spark.sql.autoBroadcastJoinThreshold", 10 * 1024 * 1024)
    max_bytes = _conf_int(df, "keyedit.broadcast.maxBytes", max(threshold, 0))
    max_rows = _conf_int(df, "keyedit.broadcast.maxRows", 4_000_000)
    return max_rows, max_bytes


def row_bytes(df: DataFrame):
    """Bytes of a row in Spark's row format, from above: null bits, a word per column, padded variable parts."""
    width = F.lit(8 * ((len(df.columns) + 63) // 64) + 8 * len(df.columns)).cast("long")
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind in ("string", "binary", "char", "varchar"):
            width = width + F.coalesce((F.octet_length(F.col(f"`{f.name}`")) + 7), F.lit(0))
        elif kind == "decimal":
            width = width + 16
        elif kind in ("array", "map", "struct", "variant", "interval"):
            # text holds each element's value; a word and a length for each is added
            width = width + F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{f.name}`")))) * 16 + 64, F.lit(0))
    return width


def measured_size(df: DataFrame) -> tuple[int, int]:
    """(rows, bytes) of ``df`` from one distributed aggregate.

    Partial counts and byte sums are combined map-side; only one row per task
    reaches the final merge (no ``limit`` funnel into a single task).
    """
    total = row_bytes(df)
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(total).alias("b")).first()
    return int(row["n"]), int(row["b"] or 0)


def change_stats(df: DataFrame, key: str) -> dict:
    """Rows, bytes and repeated keys of a keyed frame, in one aggregate pass.

    The per-key partial aggregate is combined map-side, so a hot key costs
    one row per task; the result also bounds the frame for broadcasting.
    """
    width = row_bytes(df)
    per_key = df.groupBy(F.col(f"`{key}`").alias("__k")).agg(F.count(F.lit(1)).alias("__n"),
                                                            F.sum(width).alias("__b"))
    row = per_key.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("rows"),
                      F.coalesce(F.sum("__b"), F.lit(0)).alias("bytes"),
                      F.count_if((F.col("__n") > 1) & F.col("__k").isNotNull()).alias("dup_keys")).first()
    return {"rows": int(row["rows"]), "bytes": int(row["bytes"]), "dup_keys": int(row["dup_keys"])}


def stats_fit(df: DataFrame, stats: dict) -> bool:
    max_rows, max_bytes = broadcast_limits(df)
    return stats["rows"] <= max_rows and stats["bytes"] <= max_bytes


def can_broadcast(df: DataFrame, max_rows: int | None = None, max_bytes: int | None = None) -> bool:
    dr, db = broadcast_limits(df)
    max_rows = dr if max_rows is None else max_rows
    max_bytes = db if max_bytes is None else max_bytes
    if max_rows <= 0 or max_bytes <= 0:
        return False
    n, b = measured_size(df)
    return n <= max_rows and b <= max_bytes


def hot_keys(big: DataFrame, keys: Sequence[str], hot_rows: int,
             rows_per_bucket: int | None = None) -> DataFrame | None:
    """Keys with at least ``hot_rows`` big-side rows, with a bucket count each.

    The count is a partial (map-side) aggregate, so a hot key is combined
    before the shuffle. The keys stay a DataFrame, checkpointed to the shared
    folder; at most ``rows(big) / hot_rows`` qualify. A key gets
    ``ceil(rows / rows_per_bucket)`` buckets (at least 2), so its share of the
    join is split into pieces of about ``rows_per_bucket`` rows however large
    it is. ``None`` when no key is hot.
    """
    counts = big.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return hot_of_counts(counts, keys, "__n", hot_rows, rows_per_bucket)


def hot_of_counts(counts: DataFrame, keys: Sequence[str], n: str, hot_rows: int | None = None,
                  rows_per_bucket: int | None = None) -> DataFrame | None:
    """As ``hot_keys``, from rows per key that are counted already (column ``n``)."""
    hot_rows = hot_rows or hot_limit(counts)
    per = rows_per_bucket or _conf_int(counts, "keyedit.skew.rowsPerBucket", hot_rows)
    hot = (counts.where(F.col(n) >= hot_rows)
           .select(*keys, F.greatest(F.ceil(F.col(n) / F.lit(per)), F.lit(2)).cast("int").alias(_BUCKETS),
                   F.lit(True).alias(_HOT)))
    ensure_checkpoint_dir(counts.sparkSession)
    hot = hot.checkpoint()
    return None if hot.isEmpty() else hot


def hot_limit(df: DataFrame) -> int:
    """Rows from which a key is hot."""
    return _conf_int(df, "keyedit.skew.hotRows", 1_000_000)


def keyed_join(big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "left",
               *, small_fits: bool | None = None, hot_rows: int | None = None,
               big_unique: bool = False, equal_rows: bool = False,
               hot: DataFrame | None | str = "find") -> DataFrame:
    """Join ``big`` with ``small`` on equal ``keys`` (USING semantics).

    ``how`` is one of ``left``, ``inner``, ``left_semi``, ``left_anti``; the
    big side is always the preserved/probe side. ``big_unique`` says the big
    side has one row per non-NULL key (e.g. an aggregate), so no key can be hot.
    ``equal_rows`` says that many rows of a key may be equal in all columns (a
    projection of a file scan): they are then told apart by their place in it.
    ``hot`` gives the big side's hot keys (``hot_of_counts``; None: there are none)
    where they are known; else they are counted.

    Rows with a NULL key match nothing: in a shuffle join they never travel by
    key. ``left`` and ``left_anti`` keep them aside and add them back, ``inner``
    and ``left_semi`` leave them out.
    """
    keys = list(keys)
    if small_fits is None:
        small_fits = can_broadcast(small)
    if small_fits:
        return big.join(F.broadcast(small), keys, how)

    keyed = F.lit(True)
    for k in keys:
        keyed = keyed & F.col(f"`{k}`").isNotNull()
    full, small = big.where(keyed), small.where(keyed)
    if big_unique:
        hot = None
    elif isinstance(hot, str):
        hot_rows = hot_rows or hot_limit(big)
        per_bucket = _conf_int(big, "keyedit.skew.rowsPerBucket", hot_rows)
        hot = hot_keys(full, keys, hot_rows, per_bucket)
    out = full.join(small, keys, how) if hot is None else _salted(full, small, keys, how, hot, equal_rows)
    nullable = any(f.nullable for f in big.schema.fields if f.name.lower() in {k.lower() for k in keys})
    if how in ("left", "left_anti", "leftanti", "left_outer") and nullable:
        out = out.unionByName(big.where(~keyed), allowMissingColumns=True).select(*out.columns)
    return out


def _salted(big: DataFrame, small: DataFrame, keys: list[str], how: str, hot: DataFrame,
            equal_rows: bool) -> DataFrame:
    """The shuffle join with the rows of hot keys dealt over their buckets.

    A row's bucket is a hash of its content, so a retried task deals it the same
    way. With ``equal_rows`` its place in the scan is added: a retried scan task
    reads the same rows in the same order.
    """
    fits = can_broadcast(hot)
    side = F.broadcast(hot) if fits else hot
    # maps cannot be hashed; they are left out of the hash input
    hashable = [F.col(f"`{f.name}`") for f in big.schema.fields if "map<" not in f.dataType.simpleString()]
    place = [F.monotonically_increasing_id()] if equal_rows else []
    salted_big = (big.withColumn(_SALT, F.xxhash64(*hashable, *place)).join(side, keys, "left")
                  .withColumn(_SALT, F.when(F.col(_HOT), F.pmod(F.col(_SALT), F.col(_BUCKETS)))
                              .otherwise(F.lit(0)).cast("int"))
                  .drop(_HOT, _BUCKETS))
    reps = F.when(F.col(_HOT), F.sequence(F.lit(0), F.col(_BUCKETS) - 1)).otherwise(F.array(F.lit(0)))
    salted_small = (small.join(side, keys, "left")
                    .withColumn(_SALT, F.explode(reps))
                    .drop(_HOT, _BUCKETS))
    return salted_big.join(salted_small, keys + [_SALT], how).drop(_SALT)
