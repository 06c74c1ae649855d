"""Registered queries of runs on a versioned target and of constraints (see ``catalog``)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyedit.functions import fixed
from keyedit.operators import apply as ap
from keyedit.operators.constraints import Constraints, Reference, constraint_failures, without_failed
from keyedit.operators.ordered_sets import apply_in_order, outcomes_in_order
from keyedit.operators.staging import bind_changeset, coerce_changes, stage_as_text
from keyedit.plans import fixtures as fx
from keyedit.plans.bucketed import BucketedTarget
from keyedit.plans.catalog import ORACLE, QUERIES, _CUSTOMER_COLS, _CUSTOMER_TYPES, _applied_sql, _coerced_sql, _outcomes_sql, query
from keyedit.plans.versions import VersionStore, file_name
from keyedit.session import scratch_path
from keyedit.sinks.workbook import export_workbook
from keyedit.sources.workbook import changes_from_workbooks, read_workbooks


def _typed(target: DataFrame, raw: DataFrame, spec) -> DataFrame:
    staged = stage_as_text(bind_changeset(raw, spec.update_columns), spec.update_columns)
    return coerce_changes(staged, target.schema, spec.key_column, spec.update_columns, spec.not_null)


def _customer_store(spark, d) -> VersionStore:
    """Customer laid out in files by its key, as version 0 of a new store."""
    customer = fx.table(spark, d, "customer")
    root = scratch_path(spark, f"versions-{uuid.uuid4().hex}")
    place = F.pmod("c_custkey", F.lit(fx.FILES))
    customer.withColumn("b", place).repartition(fx.FILES, "b").write.partitionBy("b").parquet(f"{root}/start")
    laid = spark.read.schema(customer.schema).option("recursiveFileLookup", "true").parquet(f"{root}/start")
    store = VersionStore(spark, root)
    store.create(laid)
    return store


def _run(store: VersionStore, raw: DataFrame, spec) -> None:
    store.apply(spec.key_column, spec.update_columns, _typed(store.frame(), raw, spec))


_CSF_CO = _coerced_sql(fx.CSF_SQL, fx.CUSTOMER_SPEC, _CUSTOMER_TYPES)
_GOOD = "select * from co where type_ok and null_ok and key_cast is not null"


@query("apply_updates_files", f"""with {_CSF_CO}, good as ({_GOOD})
select {_applied_sql(fx.CUSTOMER_SPEC, _CUSTOMER_COLS)} from customer t left join good g on t.c_custkey = g.key_cast""")
def q_apply_updates_files(spark, d):
    """The new version where only files with a changed row are rewritten."""
    store = _customer_store(spark, d)
    _run(store, fx.csf(spark, d), fx.CUSTOMER_SPEC)
    return store.frame()


@query("files_rewritten", f"""with {_CSF_CO}, good as ({_GOOD})
select cast(c_custkey % {fx.FILES} as bigint) as file_no, count(*) as n_rows, bool_or(g.key_cast is not null) as rewritten
from customer t left join good g on t.c_custkey = g.key_cast group by 1""")
def q_files_rewritten(spark, d):
    """K5: of each file of the old version its rows and whether the new version lists it no more."""
    store = _customer_store(spark, d)
    _run(store, fx.csf(spark, d), fx.CUSTOMER_SPEC)
    old = store.frame(0).groupBy(file_name().alias("file")).agg(F.count(F.lit(1)).alias("n_rows"))
    now = store.files().select("file", F.lit(True).alias("listed"))
    return old.join(now, "file", "left").select(
        F.regexp_extract("file", "/b(?:=|%3D)([0-9]+)/", 1).cast("long").alias("file_no"), "n_rows",
        F.col("listed").isNull().alias("rewritten"))


def _state(name: str, before: str, cs_sql: str, spec) -> str:
    """One run as SQL: the table ``name`` after the changes of ``cs_sql`` to the table ``before``."""
    inner = _coerced_sql(cs_sql, spec, _CUSTOMER_TYPES)
    return (f"{name} as (with {inner}, good as ({_GOOD}) select {_applied_sql(spec, _CUSTOMER_COLS)} "
            f"from {before} t left join good g on t.c_custkey = g.key_cast)")


_THREE_RUNS = [(fx.cs1, fx.CS1_SQL, fx.CUSTOMER_SPEC), (fx.csf, fx.CSF_SQL, fx.CUSTOMER_SPEC),
               (fx.cse, fx.CSE_SQL, fx.SEGMENT_SPEC)]
_STATES = "s0 as (select * from customer), " + ", ".join(
    _state(f"s{k + 1}", f"s{k}", sql, spec) for k, (_, sql, spec) in enumerate(_THREE_RUNS))


def _three_runs(spark, d) -> VersionStore:
    store = _customer_store(spark, d)
    for raw, _, spec in _THREE_RUNS:
        _run(store, raw(spark, d), spec)
    return store


_ALL_STATES = f"with {_STATES}\n" + "\nunion all\n".join(
    f"select {v} as version, {', '.join(_CUSTOMER_COLS)} from s{v}" for v in range(4))


def _labelled(frames) -> DataFrame:
    out = None
    for v, f in frames:
        f = f.select(F.lit(v).alias("version"), *_CUSTOMER_COLS)
        out = f if out is None else out.unionByName(f)
    return out


@query("undo_over_runs", _ALL_STATES)
def q_undo_over_runs(spark, d):
    """After three runs, all rows taken back to each version by the undo entries."""
    store = _three_runs(spark, d)
    return _labelled([(v, store.undone(v, "c_custkey", ["c_mktsegment", "c_nationkey"])) for v in range(4)])


@query("restore_versions", _ALL_STATES)
def q_restore_versions(spark, d):
    """After three runs, each version restored by listing its files again."""
    store = _three_runs(spark, d)
    return _labelled([(v, store.frame(store.restore(v))) for v in range(4)])


@query("undo_selected", f"""with {_STATES}
select n.c_custkey, n.c_name, case when s.k is not null then o.c_nationkey else n.c_nationkey end as c_nationkey,
       n.c_acctbal, n.c_mktsegment
from s3 n join s1 o on n.c_custkey = o.c_custkey
left join (select distinct s_suppkey as k from supplier) s on n.c_custkey = s.k""")
def q_undo_selected(spark, d):
    """One column of chosen keys as it was two runs ago; all else stays."""
    store = _three_runs(spark, d)
    keys = fx.table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"))
    return store.undone(1, "c_custkey", ["c_nationkey"], keys=keys)


# --- constraints ----------------------------------------------------------------------

_NAME_TYPES = {**_CUSTOMER_TYPES, "c_name": T.StringType()}
_TOO_LONG = "octet_length(encode(m.c_mktsegment))"
_RULES_SQL = f"""with recursive {_outcomes_sql(fx.CSU_SQL, fx.NAME_SPEC, _NAME_TYPES)},
m as (select g.*, c.c_name as old_name from co g join customer c on c.c_custkey = g.key_cast where type_ok and null_ok),
simple as (
  select key_cast, 'too_long' as status, 'ORA-12899: value too large for column "C_MKTSEGMENT" (actual: '
         || cast({_TOO_LONG} as varchar) || ', maximum: {fx.SEGMENT_BYTES})' as reason
  from m where {_TOO_LONG} > {fx.SEGMENT_BYTES}
  union all
  select key_cast, 'no_parent', 'ORA-02291: integrity constraint (C_NATIONKEY) violated - parent key not found'
  from m where {_TOO_LONG} <= {fx.SEGMENT_BYTES} and c_nationkey is not null
    and c_nationkey not in (select n_nationkey from nation)),
moving as (select * from m where key_cast not in (select key_cast from simple) and c_name is distinct from old_name),
firsts as (
  select * from moving where c_name is not null qualify row_number() over (partition by c_name order by row_num) = 1),
waits as (
  select f.key_cast, h.c_custkey as holder from firsts f join customer h on h.c_name = f.c_name),
stays as (
  select key_cast from waits where holder not in (select key_cast from firsts)
    and holder not in (select key_cast from moving where c_name is null)
  union
  select w.key_cast from waits w join stays s on w.holder = s.key_cast),
rules as (
  select * from simple
  union all
  select key_cast, 'not_unique', 'ORA-00001: unique constraint (C_NAME) violated' from (
    select key_cast from stays
    union
    select key_cast from moving where c_name is not null and key_cast not in (select key_cast from firsts)))"""
_JUDGED_SQL = f"""{_RULES_SQL}
select o.row_num, o.key_value, coalesce(r.status, o.status) as status, coalesce(r.reason, o.reason) as reason,
       case when r.status is null then o.rows_updated else 0 end as rows_updated,
       o.failed or r.status is not null as failed
from oc o join co on co.row_num = o.row_num left join rules r on r.key_cast = co.key_cast"""


def _rules(spark, d) -> Constraints:
    return Constraints(max_bytes={"c_mktsegment": fx.SEGMENT_BYTES},
                       parents=(Reference("c_nationkey", fx.table(spark, d, "nation"), "n_nationkey"),),
                       unique=(("c_name",),))


def _judged(spark, d):
    spec, target = fx.NAME_SPEC, fx.table(spark, d, "customer")
    coerced = _typed(target, fx.csu(spark, d), spec)
    return target, coerced, constraint_failures(coerced, target, spec.key_column, spec.update_columns, _rules(spark, d))


@query("row_outcomes_constraints", _JUDGED_SQL)
def q_row_outcomes_constraints(spark, d):
    """R2/F8: outcomes with the rules of the target: length in bytes, parent key, unique names."""
    target, coerced, refused = _judged(spark, d)
    return ap.row_outcomes(coerced, target, "c_custkey", refused=refused)


@query("apply_updates_constraints", f"""{_RULES_SQL},
good as (select * from co where type_ok and null_ok and key_cast is not null
         and key_cast not in (select key_cast from rules))
select {_applied_sql(fx.NAME_SPEC, _CUSTOMER_COLS)} from customer t left join good g on t.c_custkey = g.key_cast""")
def q_apply_updates_constraints(spark, d):
    """The new target holds no value that breaks a rule; names stay unique."""
    target, coerced, refused = _judged(spark, d)
    return ap.apply_updates(target, without_failed(coerced, refused), "c_custkey", fx.NAME_SPEC.update_columns)


# --- several change sets in one run -------------------------------------------------------

def _sets(spark, d):
    target = fx.table(spark, d, "customer")
    return target, [(_typed(target, raw(spark, d), spec), spec.update_columns) for raw, _, spec in _THREE_RUNS]


@query("apply_in_order", f"with {_STATES} select * from s3")
def q_apply_in_order(spark, d):
    """Three change sets with different columns in one pass over the target, as if run one after another."""
    target, sets = _sets(spark, d)
    return apply_in_order(target, sets, "c_custkey")


@query("outcomes_in_order", "\nunion all\n".join(
    f"(with {_outcomes_sql(sql, spec, _CUSTOMER_TYPES)} select {k} as set_no, oc.* from oc)"
    for k, (_, sql, spec) in enumerate(_THREE_RUNS)))
def q_outcomes_in_order(spark, d):
    """Outcomes of every change of the three sets."""
    target, sets = _sets(spark, d)
    return outcomes_in_order(target, sets, "c_custkey")


# --- a target in buckets ------------------------------------------------------------------

def _bucketed(spark, d, table: str, key: str) -> BucketedTarget:
    name = f"{table}_{uuid.uuid4().hex}"
    return BucketedTarget.write(fx.table(spark, d, table), name, key, scratch_path(spark, name))


@query("apply_updates_bucketed", ORACLE["apply_updates_lineitem"])
def q_apply_updates_bucketed(spark, d):
    """Lineitem updated in buckets by its key, without a shuffle of the target."""
    target = _bucketed(spark, d, "lineitem", "l_orderkey")
    return target.apply_updates(_typed(target.frame(), fx.csl(spark, d), fx.LINEITEM_SPEC), fx.LINEITEM_SPEC.update_columns)


@query("row_outcomes_bucketed", ORACLE["row_outcomes_lineitem"])
def q_row_outcomes_bucketed(spark, d):
    """Outcomes against the buckets."""
    target = _bucketed(spark, d, "lineitem", "l_orderkey")
    return target.row_outcomes(_typed(target.frame(), fx.csl(spark, d), fx.LINEITEM_SPEC))


@query("missing_keys_bucketed", ORACLE["missing_keys"])
def q_missing_keys_bucketed(spark, d):
    """Change keys that no bucket holds, repeats kept."""
    target = _bucketed(spark, d, "customer", "c_custkey")
    return target.missing_keys(_typed(target.frame(), fx.cs1(spark, d), fx.CUSTOMER_SPEC))


@query("present_keys_bucketed", ORACLE["present_keys"])
def q_present_keys_bucketed(spark, d):
    """Change keys that a bucket holds."""
    target = _bucketed(spark, d, "customer", "c_custkey")
    return target.present_keys(_typed(target.frame(), fx.cs1(spark, d), fx.CUSTOMER_SPEC))


# --- workbooks ------------------------------------------------------------------------------

def _exported(spark, df: DataFrame, **how) -> DataFrame:
    path = scratch_path(spark, f"export-{uuid.uuid4().hex}")
    export_workbook(df, path, **how)
    rows = changes_from_workbooks(read_workbooks(spark, path, len(df.columns)))
    return rows.select(*[F.coalesce(F.col(f"c{i + 1}"), F.lit("")).alias(c) for i, c in enumerate(df.columns)])


@query("export_workbook", ORACLE["failed_records"])
def q_export_workbook(spark, d):
    """K6/K7: the failed records as workbooks, a part for each task, and read back."""
    target = fx.table(spark, d, "customer")
    coerced = _typed(target, fx.cs2(spark, d), fx.CUSTOMER_SPEC)
    failed = ap.failed_records(ap.row_outcomes(coerced, target, "c_custkey"), fx.RUN_TS)
    return _exported(spark, failed.repartition(3, "key_value"))


@query("export_log_workbook", f"select time, level, message from ({ORACLE['log_parse']})")
def q_export_log_workbook(spark, d):
    """K9: the run log as workbooks with the tool's sheet and widths."""
    log = QUERIES["log_parse"](spark, d).select("time", "level", "message")
    return _exported(spark, log, sheet=fixed.LOG_SHEET, widths=[fixed.LOG_WIDTH] * 3)
