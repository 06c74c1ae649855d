"""Several change sets in order, applied as one: the last writer of each key and column.

Running set after set reads and writes the target once for each. A key's row is there or
not throughout (updates insert and delete nothing), so what the runs leave in a column is
the last passing change that lists the column. ``fold_sets`` finds it with one aggregate by
key (``max_by`` over the sets' numbers, combined map-side); ``apply_folded`` joins the target
once. A set whose canonical keys repeat is refused as a whole, as its own run would be.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyedit.operators import apply as ap
from keyedit.operators.joins import keyed_join
from keyedit.operators.staging import KEY, KEY_CAST, ROW_NUM

SET_NO = "set_no"
_LISTED = "__listed"
CoercedSet = tuple[DataFrame, Sequence[str]]


def numbered_sets(sets: Sequence[CoercedSet], target_schema: T.StructType) -> DataFrame:
    """All sets as one frame: ``set_no`` (from 0), the columns that the set lists, key, verdict and typed values."""
    names = {f.name.lower(): f for f in target_schema.fields}
    every = list(dict.fromkeys(names[c.lower()].name for _, columns in sets for c in columns))
    out = None
    for k, (coerced, columns) in enumerate(sets):
        listed = [names[c.lower()].name for c in columns]
        values = [F.col(f"`{c}`") if c in listed else F.lit(None).cast(names[c.lower()].dataType).alias(c) for c in every]
        part = coerced.select(F.lit(k).alias(SET_NO), F.array(*[F.lit(c) for c in listed]).alias(_LISTED), ROW_NUM, KEY,
                              KEY_CAST, "type_ok", "null_ok", *values)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no change set given")
    return out


def refused_sets(changes: DataFrame) -> DataFrame:
    """``set_no, repeated_keys`` of the sets whose canonical keys repeat."""
    per_key = changes.groupBy(SET_NO, ap._dup_key().alias("__k")).agg(F.count(F.lit(1)).alias("__n"))
    return (per_key.where("__n > 1").groupBy(SET_NO).agg(F.count(F.lit(1)).alias("repeated_keys")))


def without_refused(changes: DataFrame) -> DataFrame:
    """The changes of the sets that pass. There are no more refused sets than sets."""
    return changes.join(F.broadcast(refused_sets(changes).select(SET_NO)), SET_NO, "left_anti")


def fold_sets(changes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``key_cast`` and of each column a struct of the value that the last set leaves; NULL where no set lists it."""
    good = ap.passing_changes(changes)
    last = [F.max_by(F.struct(F.col(f"`{c}`").alias("v")), F.when(F.array_contains(_LISTED, c), F.col(SET_NO))).alias(c)
            for c in columns]
    return good.groupBy(KEY_CAST).agg(*last)


def apply_folded(target: DataFrame, folded: DataFrame, key_column: str) -> DataFrame:
    """The target after all sets: every row once, columns and types as they were."""
    tkey = ap._target_name(target, key_column)
    names = [c for c in folded.columns if c != KEY_CAST]
    new = folded.select(F.col(KEY_CAST).alias(tkey), *[F.col(f"`{c}`").alias(f"__new_{c}") for c in names])
    joined = keyed_join(target, new, [tkey], "left")
    return joined.select(*[
        F.when(F.col(f"`__new_{c}`").isNotNull(), F.col(f"`__new_{c}`.v")).otherwise(F.col(f"`{c}`")).alias(c)
        if c in names else F.col(f"`{c}`") for c in target.columns])


def apply_in_order(target: DataFrame, sets: Sequence[CoercedSet], key_column: str) -> DataFrame:
    """The target as the runs of ``sets``, one after another, would leave it: one pass over it in place of one per set."""
    changes = without_refused(numbered_sets(sets, target.schema))
    columns = changes.columns[changes.columns.index("null_ok") + 1:]
    return apply_folded(target, fold_sets(changes, columns), key_column)


def outcomes_in_order(target: DataFrame, sets: Sequence[CoercedSet], key_column: str,
                      unmatched: str = "ignore") -> DataFrame:
    """``set_no`` and the outcome of every change of every set that passes; the target's keys are looked up once."""
    changes = without_refused(numbered_sets(sets, target.schema))
    fits = ap.change_keys_fit(changes)
    counts = ap.matched_key_counts(target, key_column, changes.select(KEY_CAST).distinct(), fits)
    return ap.judged(changes, counts, unmatched, fits, keep=[SET_NO])
