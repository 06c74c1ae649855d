"""Constraints of the target, judged for every change before a run publishes anything.

The tool records whatever its database refuses, row by row. Here the rules are given with
the run (``Constraints``) and all changes are judged as one statement: what counts is the
table as it would be afterwards, so a chain of renames or a swap of two names is fine in
any row order. First hit wins, after the verdicts on key, type and NULL:

* ``too_long``: a text value of more bytes than its column holds;
* ``no_parent``: a value that the parent table does not have (NULL is allowed);
* ``child_found``: the old value of a changed column is still referred to by a child table;
* ``not_unique``: the new value would be there twice. Of several changes that want one value
  the first by row number may have it. A value held by a row that keeps it is taken; one held
  by a row whose own change moves away is free if that change passes. So verdicts run along
  chains of holders, which are followed by pointer doubling, in as many rounds as the
  logarithm of the longest chain. A value that several rows hold already is taken, whatever
  becomes of them. A NULL in any column of a set is no conflict.

No rule joins the target with itself: the values that changes want (no more than changes)
are looked up in one pass over the target's columns of the set.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyedit.operators import apply as ap
from keyedit.operators.joins import keyed_join
from keyedit.operators.staging import KEY_CAST, ROW_NUM
from keyedit.session import ensure_checkpoint_dir

TOO_LONG, NO_PARENT, CHILD_FOUND, NOT_UNIQUE = "too_long", "no_parent", "child_found", "not_unique"
_ORDER = (TOO_LONG, NO_PARENT, CHILD_FOUND, NOT_UNIQUE)


@dataclass(frozen=True)
class Reference:
    """``column`` of the target and ``other_column`` of another table hold the same values."""

    column: str
    other: DataFrame
    other_column: str


@dataclass(frozen=True)
class Constraints:
    """Rules for the values of a target. Names are the target's, in any case."""

    max_bytes: dict[str, int] = field(default_factory=dict)
    parents: tuple[Reference, ...] = ()
    children: tuple[Reference, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()


def declared_bytes(schema: T.StructType) -> dict[str, int]:
    """Declared lengths of a table's ``char(n)`` and ``varchar(n)`` columns, for ``Constraints.max_bytes``.

    Spark declares characters; text of one-byte characters is the case in which both are the same.
    """
    out = {}
    for f in schema.fields:
        declared = re.fullmatch(r"(?:var)?char\((\d+)\)", (f.metadata or {}).get("__CHAR_VARCHAR_TYPE_STRING", ""))
        if declared:
            out[f.name] = int(declared[1])
    return out


def _failure(keys: DataFrame, status: str, reason: Column) -> DataFrame:
    return keys.select(KEY_CAST, F.lit(_ORDER.index(status)).alias("rank"), reason.alias("reason"))


def _present(table: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Which of the values ``v`` of ``wanted`` the table's column has, each once."""
    values = table.select(F.col(f"`{column}`").alias("v"))
    return keyed_join(values, wanted.distinct(), ["v"], "left_semi", equal_rows=True).distinct()


def _too_long(good: DataFrame, limits: dict[str, int]) -> DataFrame:
    reason = F.lit(None).cast("string")
    for c, limit in reversed(list(limits.items())):
        n = F.octet_length(F.col(f"`{c}`"))
        text = F.format_string(f'ORA-12899: value too large for column "{c.upper()}" (actual: %d, maximum: {limit})', n)
        reason = F.when(n > limit, text).otherwise(reason)
    return _failure(good.where(reason.isNotNull()), TOO_LONG, reason)


def _no_parent(good: DataFrame, column: str, ref: Reference) -> DataFrame:
    wanted = good.select(KEY_CAST, F.col(f"`{column}`").alias("v")).where(F.col("v").isNotNull())
    found = _present(ref.other, ref.other_column, wanted.select("v"))
    return _failure(keyed_join(wanted, found, ["v"], "left_anti"), NO_PARENT,
                    F.lit(f"ORA-02291: integrity constraint ({column.upper()}) violated - parent key not found"))


def _child_found(matched: DataFrame, column: str, ref: Reference) -> DataFrame:
    changed = ~F.col(f"`old_{column}`").eqNullSafe(F.col(f"`{column}`"))
    old = matched.where(changed).select(KEY_CAST, F.col(f"`old_{column}`").alias("v")).where(F.col("v").isNotNull()).distinct()
    found = _present(ref.other, ref.other_column, old.select("v"))
    return _failure(keyed_join(old, found, ["v"], "left_semi").select(KEY_CAST).distinct(), CHILD_FOUND,
                    F.lit(f"ORA-02292: integrity constraint ({column.upper()}) violated - child record found"))


def _not_unique(matched: DataFrame, target: DataFrame, tkey: str, columns: Sequence[str],
                updated: Sequence[str]) -> DataFrame:
    """Keys of the changes in ``matched`` (one row per target row) that would make a set of values repeat."""
    post = [(F.col(f"`{c}`") if c in updated else F.col(f"`old_{c}`")).alias(f"u{i}") for i, c in enumerate(columns)]
    u = [f"u{i}" for i in range(len(columns))]
    same, whole = F.lit(True), F.lit(True)
    for i, c in enumerate(columns):
        same = same & F.col(f"u{i}").eqNullSafe(F.col(f"o{i}"))
        whole = whole & F.col(f"u{i}").isNotNull()
    rows = matched.select(KEY_CAST, ROW_NUM, *post, *[F.col(f"`old_{c}`").alias(f"o{i}") for i, c in enumerate(columns)],
                          "n_rows").where(~same)
    several = rows.where(whole & (F.col("n_rows") > 1)).select(KEY_CAST).distinct()
    moving = rows.where(F.col("n_rows") == 1)
    claims = moving.where(whole).select(KEY_CAST, ROW_NUM, *u)
    first = claims.groupBy(*u).agg(F.min(F.struct(ROW_NUM, KEY_CAST)).alias("f")).select(
        *u, F.col(f"f.{KEY_CAST}").alias("first")).checkpoint()
    late = keyed_join(claims, first, u, "left").where(F.col("first") != F.col(KEY_CAST)).select(KEY_CAST)
    # who holds the wanted values now: one pass over the target's columns of the set
    wanted = first.select(*u)
    held = keyed_join(target.select(F.col(f"`{tkey}`").alias("holder"),
                                    *[F.col(f"`{c}`").alias(f"u{i}") for i, c in enumerate(columns)]), wanted, u, "inner")
    held = held.groupBy(*u).agg(F.min("holder").alias("holder"), F.count(F.lit(1)).alias("n"))
    free = moving.where(~whole).select(F.col(KEY_CAST).alias("holder"), F.lit(True).alias("leaves"))
    going = first.select(F.col("first").alias("holder"), F.lit(False).alias("leaves")).unionByName(free)
    links = first.join(held, u).select(F.col("first").alias("k"), "holder", "n").join(going, "holder", "left").select(
        "k", "holder", F.when((F.col("n") > 1) | F.col("leaves").isNull(), F.lit("taken"))
        .when(F.col("leaves"), F.lit("free")).otherwise(F.lit("waits")).alias("state"))
    return several.union(late).union(_follow(links)).distinct()


def _follow(links: DataFrame) -> DataFrame:
    """Keys whose chain of holders ends at one that stays. Who waits in a circle passes.

    ``k`` waits for ``holder`` if that one's change passes; each holder is waited for by one key.
    """
    links = links.checkpoint()
    waiting = links.where(F.col("state") == "waits").count()
    for _ in range(math.ceil(math.log2(waiting)) + 1 if waiting else 0):
        ahead = links.select(F.col("k").alias("holder"), F.col("holder").alias("next"), F.col("state").alias("then"))
        open_ = links.where(F.col("state") == "waits").join(ahead, "holder", "left").select(
            "k", F.coalesce("next", "holder").alias("holder"), F.coalesce("then", F.lit("free")).alias("state"))
        links = links.where(F.col("state") != "waits").unionByName(open_).checkpoint()
    return links.where(F.col("state") == "taken").select(F.col("k").alias(KEY_CAST))


def constraint_failures(coerced: DataFrame, target: DataFrame, key_column: str, update_columns: Sequence[str],
                        rules: Constraints, fits: bool | None = None) -> DataFrame:
    """``key_cast, status, reason`` of the passing, matched changes that break a rule.

    Keys of the change set must be unique. A unique set with a column that the run does not
    update needs one target row per key.
    """
    tkey = ap._target_name(target, key_column)
    names = [ap._target_name(target, c) for c in update_columns]
    ensure_checkpoint_dir(coerced.sparkSession)
    ap.assert_unique_keys(coerced)
    fits = ap.change_keys_fit(coerced) if fits is None else fits
    counts = ap.matched_key_counts(target, key_column, coerced, fits)
    good = keyed_join(ap.passing_changes(coerced).select(KEY_CAST, ROW_NUM, *[F.col(f"`{c}`") for c in names]), counts,
                      [KEY_CAST], "inner", small_fits=fits, big_unique=True).withColumnRenamed("rows_matched", "n_rows").checkpoint()
    types = {f.name: f.dataType for f in target.schema.fields}
    limits = {ap._target_name(target, c): n for c, n in rules.max_bytes.items()}
    limits = {c: limits[c] for c in names if c in limits and isinstance(types[c], T.StringType)}
    parts = [_too_long(good, limits)] if limits else []
    for ref in rules.parents:
        if (c := ap._target_name(target, ref.column)) in names:
            parts.append(_no_parent(good, c, ref))
    children = [(c, ref) for ref in rules.children if (c := ap._target_name(target, ref.column)) in names]
    unique = [[ap._target_name(target, c) for c in cs] for cs in rules.unique]
    unique = [cs for cs in unique if set(cs) & set(names)]
    old = sorted({c for c, _ in children} | {c for cs in unique for c in cs})
    if old:
        # the old values of the rows that changes match: bounded by what the run would write
        before = target.select(F.col(f"`{tkey}`").alias(KEY_CAST), *[F.col(f"`{c}`").alias(f"old_{c}") for c in old])
        matched = keyed_join(before, good, [KEY_CAST], "inner", small_fits=fits, equal_rows=True).checkpoint()
    parts += [_child_found(matched, c, ref) for c, ref in children]
    empty = good.sparkSession.createDataFrame([], T.StructType([
        T.StructField(KEY_CAST, good.schema[KEY_CAST].dataType), T.StructField("rank", T.IntegerType()),
        T.StructField("reason", T.StringType())]))
    failed = empty
    for p in parts:
        failed = failed.unionByName(p)
    failed = _first_rule(failed).checkpoint()
    if any(set(cs) - set(names) for cs in unique) and not matched.where("n_rows > 1").isEmpty():
        raise ValueError("a unique set with columns that are not updated needs one target row per key")
    # a change that fails keeps its old values, which may be taken from another: until nothing new fails
    again = bool(unique)
    while again:
        again = False
        for cs in unique:
            left = keyed_join(matched, failed.select(KEY_CAST), [KEY_CAST], "left_anti")
            reason = F.lit(f"ORA-00001: unique constraint ({', '.join(cs).upper()}) violated")
            new = _failure(_not_unique(left, target, tkey, cs, names), NOT_UNIQUE, reason).checkpoint()
            if not new.isEmpty():
                failed, again = failed.unionByName(new).checkpoint(), len(unique) > 1
    status = F.element_at(F.array(*[F.lit(s) for s in _ORDER]), F.col("rank") + 1)
    return failed.select(KEY_CAST, status.alias("status"), "reason")


def _first_rule(failed: DataFrame) -> DataFrame:
    first = failed.groupBy(KEY_CAST).agg(F.min(F.struct("rank", "reason")).alias("f"))
    return first.select(KEY_CAST, "f.rank", "f.reason")


def without_failed(coerced: DataFrame, failures: DataFrame, fits: bool | None = None) -> DataFrame:
    """The changes that break no rule."""
    return keyed_join(coerced, failures.select(KEY_CAST), [KEY_CAST], "left_anti", small_fits=fits)
