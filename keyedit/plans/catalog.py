"""Registered queries: one Spark plan per operator, with its DuckDB oracle.

Every query reads the given tables (through the derivations in
``fixtures``) and runs over them whole. ``QUERIES[name](spark, sf_dir)``
returns a DataFrame; ``ORACLE[name]`` is the same result as DuckDB SQL over
the same tables. Column names are equal on both sides.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyedit.functions import fixed
from keyedit.plans.duck_sql import duck_canonical_key, duck_coerce
from keyedit.functions.text import backup_name, classify_error, is_blank, megabytes, staging_name
from keyedit.operators import apply as ap
from keyedit.operators import audit as au
from keyedit.operators import checks as ck
from keyedit.operators import preview as pv
from keyedit.operators.staging import (KEY, KEY_CAST, ROW_NUM, bind_changeset, bind_two_column,
                                       changeset_keys, coerce_changes, stage_as_text)
from keyedit.plans import fixtures as fx
from keyedit.session import ensure_checkpoint_dir
from keyedit.spec import UpdateSpec, normalize_columns_expr

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


# --- shared Spark building blocks ------------------------------------------------

def _prepared(spark, sf_dir, raw_fn, spec: UpdateSpec):
    target = fx.table(spark, sf_dir, spec.table)
    bound = bind_changeset(raw_fn(spark, sf_dir), spec.update_columns)
    staged = stage_as_text(bound, spec.update_columns)
    coerced = coerce_changes(staged, target.schema, spec.key_column, spec.update_columns, spec.not_null)
    return target, coerced


def _outcomes(spark, sf_dir, raw_fn, spec):
    target, coerced = _prepared(spark, sf_dir, raw_fn, spec)
    return ap.row_outcomes(coerced, target, spec.key_column, spec.unmatched)


# --- shared oracle building blocks -----------------------------------------------

_CUSTOMER_TYPES = {"c_custkey": T.LongType(), "c_mktsegment": T.StringType(), "c_nationkey": T.IntegerType()}
_LINEITEM_TYPES = {"l_orderkey": T.LongType(), "l_returnflag": T.StringType(),
                   "l_linestatus": T.StringType(), "l_quantity": T.DoubleType()}


def _coerced_sql(cs_sql: str, spec: UpdateSpec, types: dict) -> str:
    """CTEs ``cs`` (raw), ``st`` (staged text) and ``co`` (typed + verdict)."""
    cols = spec.update_columns
    staged = ", ".join(f"nullif(cast({c} as varchar), '') as {c}" for c in cols)
    typed = ", ".join(f"{duck_coerce('st.' + c, types[c])} as {c}" for c in cols)
    raw = ", ".join(f"st.{c} as {c}__raw" for c in cols)
    type_ok = " and ".join(f"(st.{c} is null or {duck_coerce('st.' + c, types[c])} is not null)" for c in cols)
    nn = [c for c in cols if c.upper() in spec.not_null]
    null_ok = " and ".join(f"{duck_coerce('st.' + c, types[c])} is not null" for c in nn) or "true"
    key = duck_canonical_key("st.key_value", types[spec.key_column])
    return f"""cs as ({cs_sql}),
st as (select row_num, cast(key_value as varchar) as key_value, {staged} from cs where key_value is not null),
co as (select st.row_num, st.key_value, {key} as key_cast, {typed}, {raw},
              {type_ok} as type_ok, {null_ok} as null_ok from st)"""


def _outcomes_sql(cs_sql: str, spec: UpdateSpec, types: dict) -> str:
    k = spec.key_column
    ignore = spec.unmatched == "ignore"
    failed = "status <> 'applied'" + (" and status <> 'missing_key'" if ignore else "")
    return _coerced_sql(cs_sql, spec, types) + f""",
cnt as (select {k} as key_cast, count(*) as rows_matched from {spec.table}
        where {k} in (select key_cast from co where key_cast is not null) group by {k}),
oc0 as (select co.*, coalesce(cnt.rows_matched, 0) as n,
              case when coalesce(cnt.rows_matched, 0) = 0 then 'missing_key'
                   when not co.type_ok then 'type_mismatch'
                   when not co.null_ok then 'null_not_allowed' else 'applied' end as status
        from co left join cnt on co.key_cast = cnt.key_cast),
oc as (select row_num, key_value, status,
              case status when 'missing_key' then '{fixed.REASON_ZERO_ROWS}'
                          when 'type_mismatch' then '{fixed.REASON_TYPE_MISMATCH}'
                          when 'null_not_allowed' then '{fixed.REASON_NULL_NOT_ALLOWED}' end as reason,
              cast(case when status = 'applied' then n else 0 end as bigint) as rows_updated,
              ({failed}) as failed
       from oc0)"""


def _applied_sql(spec: UpdateSpec, target_cols: list[str]) -> str:
    """Select list of the new target from ``{table} t left join good g``."""
    names = set(spec.update_columns)
    parts = []
    for c in target_cols:
        if c in names:
            parts.append(f"case when g.key_cast is not null then g.{c} else t.{c} end as {c}")
        else:
            parts.append(f"t.{c}")
    return ", ".join(parts)


_CUSTOMER_COLS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
_LINEITEM_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                  "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]

CS1_CO = _coerced_sql(fx.CS1_SQL, fx.CUSTOMER_SPEC, _CUSTOMER_TYPES)
CS2_CO = _coerced_sql(fx.CS2_SQL, fx.CUSTOMER_SPEC, _CUSTOMER_TYPES)
CS1_OC = _outcomes_sql(fx.CS1_SQL, fx.CUSTOMER_SPEC, _CUSTOMER_TYPES)
CS2_OC = _outcomes_sql(fx.CS2_SQL, fx.CUSTOMER_SPEC, _CUSTOMER_TYPES)
CSL_OC = _outcomes_sql(fx.CSL_SQL, fx.LINEITEM_SPEC, _LINEITEM_TYPES)
_GOOD = "good as (select * from co where type_ok and null_ok and key_cast is not null)"
CS1_NEW = (f"with {CS1_CO}, {_GOOD},\nnew_t as (select {_applied_sql(fx.CUSTOMER_SPEC, _CUSTOMER_COLS)} "
           f"from customer t left join good g on t.c_custkey = g.key_cast)")

_HIST = f"h as ({fx.HIST_SQL})"

# ======================================================================================
# CS1: clean change set against customer
# ======================================================================================


@query("changeset_scan", f"""
select row_num, key_value, c_mktsegment, c_nationkey, cast(null as varchar) as c_name
from ({fx.CS1_SQL}) where key_value is not null""")
def q_changeset_scan(spark, d):
    """Positional binding, NULL padding for a column past the data width."""
    return bind_changeset(fx.cs1(spark, d), ["c_mktsegment", "c_nationkey", "c_name"]) \
        .withColumn("c_name", F.col("c_name").cast("string"))


@query("changeset_scan_two_col", f"""
select row_num, key_value, c_mktsegment as update_value from ({fx.CS1_SQL}) where key_value is not null""")
def q_changeset_scan_two_col(spark, d):
    """The two-column form."""
    return bind_two_column(fx.cs1(spark, d))


@query("changeset_keys", f"select key_value from ({fx.CS1_SQL}) where key_value is not null")
def q_changeset_keys(spark, d):
    """S3: key-only scan, NULL keys dropped, repeats kept."""
    return changeset_keys(bind_changeset(fx.cs1(spark, d), [])).select(KEY)


@query("changeset_keys_with_rows", f"select row_num, key_value from ({fx.CS1_SQL}) where key_value is not null")
def q_changeset_keys_with_rows(spark, d):
    """Keys with their sheet rows."""
    return changeset_keys(bind_changeset(fx.cs1(spark, d), []))


@query("apply_updates", f"{CS1_NEW}\nselect * from new_t")
def q_apply_updates(spark, d):
    """The new target after applying CS1."""
    target, coerced = _prepared(spark, d, fx.cs1, fx.CUSTOMER_SPEC)
    return ap.apply_updates(target, coerced, "c_custkey", fx.CUSTOMER_SPEC.update_columns)


@query("match_changes", f"""with {CS1_CO}
select co.row_num, co.key_value, t.c_custkey from customer t join co on t.c_custkey = co.key_cast""")
def q_match_changes(spark, d):
    """One row per matching target row."""
    target, coerced = _prepared(spark, d, fx.cs1, fx.CUSTOMER_SPEC)
    return ap.match_changes(target, coerced, "c_custkey")


@query("old_new_values", f"""with {CS1_CO}
select co.row_num, t.c_custkey, t.c_mktsegment as old_c_mktsegment, t.c_nationkey as old_c_nationkey,
       co.c_mktsegment__raw as new_c_mktsegment, co.c_nationkey__raw as new_c_nationkey
from customer t join co on t.c_custkey = co.key_cast""")
def q_old_new_values(spark, d):
    """Old and new values of matched rows."""
    target, coerced = _prepared(spark, d, fx.cs1, fx.CUSTOMER_SPEC)
    return ap.old_new_values(target, coerced, "c_custkey", fx.CUSTOMER_SPEC.update_columns)


@query("missing_keys", f"""with {CS1_CO}
select row_num, key_value from co
where key_cast is null or key_cast not in (select c_custkey from customer where c_custkey is not null)""")
def q_missing_keys(spark, d):
    """Change keys absent from the target, repeats kept."""
    target, coerced = _prepared(spark, d, fx.cs1, fx.CUSTOMER_SPEC)
    return ck.missing_keys(coerced, target, "c_custkey")


@query("present_keys", f"""with {CS1_CO}
select row_num, key_value from co where key_cast in (select c_custkey from customer)""")
def q_present_keys(spark, d):
    """Change keys present in the target."""
    target, coerced = _prepared(spark, d, fx.cs1, fx.CUSTOMER_SPEC)
    return ck.present_keys(coerced, target, "c_custkey")


@query("consistency_summary", f"""with {CS1_CO},
m as (select count(*) as n from co where key_cast is null
      or key_cast not in (select c_custkey from customer where c_custkey is not null))
select (select count(*) from co) as change_keys, (select count(*) from customer) as target_keys,
       (select n from m) as missing_count, (select n from m) = 0 as passed""")
def q_consistency_summary(spark, d):
    """The consistency check as one row."""
    target, coerced = _prepared(spark, d, fx.cs1, fx.CUSTOMER_SPEC)
    return ck.consistency_summary(coerced, target, "c_custkey")


@query("preview_multi", f"""
select row_num, key_value, c_mktsegment, c_nationkey from ({fx.CS1_SQL}) order by row_num limit 50""")
def q_preview_multi(spark, d):
    """L1: first 50 data rows, NULL keys included."""
    bound = bind_changeset(fx.cs1(spark, d), fx.CUSTOMER_SPEC.update_columns, keep_null_keys=True)
    return pv.preview(bound, fixed.PREVIEW_ROWS)


@query("preview_two_col", f"""
select row_num, key_value, c_mktsegment as update_value from ({fx.CS1_SQL}) order by row_num limit 50""")
def q_preview_two_col(spark, d):
    """L2: two-column preview."""
    return pv.preview(bind_two_column(fx.cs1(spark, d), keep_null_keys=True), fixed.PREVIEW_ROWS)


@query("preview_summary", f"""
select count(*) as total_rows, least(count(*), 50) as shown_rows, count(*) > 50 as has_more,
       greatest(count(*) - 50, 0) as more_rows from ({fx.CS1_SQL})""")
def q_preview_summary(spark, d):
    """L3: rows shown, has-more flag and rows left."""
    bound = bind_changeset(fx.cs1(spark, d), fx.CUSTOMER_SPEC.update_columns, keep_null_keys=True)
    return pv.preview_summary(bound, fixed.PREVIEW_ROWS)


@query("import_count", f"""with {CS1_CO}
select count(*) as imported_count from co""")
def q_import_count(spark, d):
    """K3: rows staged."""
    _, coerced = _prepared(spark, d, fx.cs1, fx.CUSTOMER_SPEC)
    return coerced.agg(F.count(F.lit(1)).cast("long").alias("imported_count"))


@query("upsert_by_key", f"""{CS1_NEW},
ins as (select good.* from good where key_cast not in (select c_custkey from customer))
select * from new_t
union all
select key_cast as c_custkey, cast(null as varchar) as c_name, c_nationkey, cast(null as double) as c_acctbal,
       c_mktsegment from ins""")
def q_upsert_by_key(spark, d):
    """U4: matched keys updated, absent keys inserted."""
    target, coerced = _prepared(spark, d, fx.cs1, fx.CUSTOMER_SPEC)
    spec = fx.CUSTOMER_SPEC
    ensure_checkpoint_dir(spark)
    coerced = coerced.checkpoint()      # staged once, as a run does
    new_t = ap.apply_updates(target, coerced, spec.key_column, spec.update_columns)
    return ap.upsert_by_key(target, new_t, coerced, spec.key_column, spec.update_columns)


@query("restore_rows", f"""{CS1_NEW},
sel as (select key_cast from good where c_mktsegment = 'SEG0')
select n.c_custkey, n.c_name,
       case when n.c_custkey in (select key_cast from sel) then b.c_nationkey else n.c_nationkey end as c_nationkey,
       n.c_acctbal,
       case when n.c_custkey in (select key_cast from sel) then b.c_mktsegment else n.c_mktsegment end as c_mktsegment
from new_t n left join customer b on n.c_custkey = b.c_custkey""")
def q_restore_rows(spark, d):
    """Selected keys get their listed columns back from the backup."""
    target, coerced = _prepared(spark, d, fx.cs1, fx.CUSTOMER_SPEC)
    spec = fx.CUSTOMER_SPEC
    new_t = ap.apply_updates(target, coerced, spec.key_column, spec.update_columns)
    sel = ap.passing_changes(coerced).where(F.col("c_mktsegment") == "SEG0").select(F.col(KEY_CAST).alias("c_custkey"))
    return ap.restore_rows(new_t, target, sel, "c_custkey", spec.update_columns)


def _snapshot(spark, d) -> tuple[str, str]:
    """A copy of customer under its backup name in the shared folder: (name, path)."""
    import uuid

    from keyedit.session import scratch_path
    from keyedit.sinks.writers import snapshot
    name = spark.range(1).select(backup_name(F.lit("customer"), F.lit(fx.RUN_TS).cast("timestamp")).alias("n")).first()["n"]
    path = scratch_path(spark, f"{uuid.uuid4().hex}/{name}")
    snapshot(fx.table(spark, d, "customer"), path)
    return name, path


@query("restore_full", "select * from customer")
def q_restore_full(spark, d):
    """Whole-table restore from a snapshot written before the run and read back."""
    from keyedit.plans.job import restore_full
    _, path = _snapshot(spark, d)
    target, coerced = _prepared(spark, d, fx.cs1, fx.CUSTOMER_SPEC)
    new_t = ap.apply_updates(target, coerced, "c_custkey", fx.CUSTOMER_SPEC.update_columns)
    return restore_full(current=new_t, backup=spark.read.parquet(path))


@query("backup_verify", """
select 'customer_BAK_20240131_120000' as backup_table, count(*) as row_count, sum(c_custkey) as key_sum from customer""")
def q_backup_verify(spark, d):
    """A snapshot written under its name; rows and keys counted in what was written."""
    name, path = _snapshot(spark, d)
    return spark.read.parquet(path).select("*", F.element_at(F.split(F.input_file_name(), "/"), -2).alias("backup_table")).groupBy(
        "backup_table").agg(F.count(F.lit(1)).cast("long").alias("row_count"), F.sum("c_custkey").alias("key_sum"))


# ======================================================================================
# CS2: dirty change set against customer
# ======================================================================================


@query("drop_null_keys", f"""
select row_num, key_value, c_mktsegment, c_nationkey from ({fx.CS2_SQL}) where key_value is not null""")
def q_drop_null_keys(spark, d):
    """NULL-key rows are dropped."""
    return bind_changeset(fx.cs2(spark, d), fx.CUSTOMER_SPEC.update_columns)


@query("stage_as_text", f"""with {CS2_CO} select row_num, key_value, c_mktsegment, c_nationkey from st""")
def q_stage_as_text(spark, d):
    """All text, blank is NULL."""
    bound = bind_changeset(fx.cs2(spark, d), fx.CUSTOMER_SPEC.update_columns)
    return stage_as_text(bound, fx.CUSTOMER_SPEC.update_columns)


@query("coerce_values", f"""with {CS2_CO}
select row_num, key_value, key_cast, c_mktsegment, c_nationkey, type_ok, null_ok from co""")
def q_coerce_values(spark, d):
    """Text to target types, per-row verdicts."""
    _, coerced = _prepared(spark, d, fx.cs2, fx.CUSTOMER_SPEC)
    return coerced.select(ROW_NUM, KEY, KEY_CAST, "c_mktsegment", "c_nationkey", "type_ok", "null_ok")


@query("null_violations", f"""with {CS2_CO}
select row_num, key_value, 'c_nationkey' as column_name from co where c_nationkey is null""")
def q_null_violations(spark, d):
    """NULL into a NOT NULL column, one row per violating column."""
    _, coerced = _prepared(spark, d, fx.cs2, fx.CUSTOMER_SPEC)
    nn = [c for c in fx.CUSTOMER_SPEC.update_columns if fx.CUSTOMER_SPEC.is_not_null(c)]
    parts = [coerced.where(F.col(c).isNull()).select(ROW_NUM, KEY, F.lit(c).alias("column_name")) for c in nn]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("row_outcomes", f"with {CS2_OC} select * from oc")
def q_row_outcomes(spark, d):
    """R2: outcome and reason of every change row."""
    return _outcomes(spark, d, fx.cs2, fx.CUSTOMER_SPEC)


@query("failed_records", f"""with {CS2_OC}
select key_value, '' as update_value, reason, '2024-01-31 12:00:00' as timestamp from oc where failed""")
def q_failed_records(spark, d):
    """The failed-records report."""
    return ap.failed_records(_outcomes(spark, d, fx.cs2, fx.CUSTOMER_SPEC), fx.RUN_TS)


@query("failures_by_reason", f"""with {CS2_OC}
select status, reason, count(*) as n_changes from oc where status <> 'applied' group by status, reason""")
def q_failures_by_reason(spark, d):
    """Failures rolled up by reason."""
    return ap.failures_by_reason(_outcomes(spark, d, fx.cs2, fx.CUSTOMER_SPEC))


_SUMMARY_SQL = """select count(*) as change_rows,
       count(*) filter (where status = 'applied') + count(*) filter (where failed) as total_count,
       count(*) filter (where status = 'applied') as success_count,
       count(*) filter (where failed) as fail_count, count(*) filter (where status = 'missing_key') as missing_count,
       cast(coalesce(sum(rows_updated), 0) as bigint) as rows_updated,
       count(*) filter (where failed) = 0 as success from oc"""


@query("run_summary", f"with {CS2_OC} {_SUMMARY_SQL}")
def q_run_summary(spark, d):
    """A4: totals of the run."""
    return ap.run_summary(_outcomes(spark, d, fx.cs2, fx.CUSTOMER_SPEC))


@query("apply_all_or_nothing", f"""with {CS2_OC}, {_GOOD},
new_t as (select {_applied_sql(fx.CUSTOMER_SPEC, _CUSTOMER_COLS)} from customer t left join good g on t.c_custkey = g.key_cast)
select * from new_t where (select count(*) from oc where failed) = 0
union all
select * from customer where (select count(*) from oc where failed) > 0""")
def q_apply_all_or_nothing(spark, d):
    """With any failed change the target stays as it was."""
    target, coerced = _prepared(spark, d, fx.cs2, fx.CUSTOMER_SPEC)
    new_t = ap.apply_updates(target, coerced, "c_custkey", fx.CUSTOMER_SPEC.update_columns)
    oc = ap.row_outcomes(coerced, target, "c_custkey")
    return ap.apply_all_or_nothing(target, new_t, oc)


@query("apply_all_or_nothing_clean", f"""{CS1_NEW}
select * from new_t""")
def q_apply_all_or_nothing_clean(spark, d):
    """Without a failed change the new version is published."""
    target, coerced = _prepared(spark, d, fx.cs1, fx.CUSTOMER_SPEC)
    new_t = ap.apply_updates(target, coerced, "c_custkey", fx.CUSTOMER_SPEC.update_columns)
    return ap.apply_all_or_nothing(target, new_t, ap.row_outcomes(coerced, target, "c_custkey"))


@query("changeset_profile", f"""
select count(*) as total_rows, count(key_value) as valid_rows, count(*) filter (where key_value is null) as null_key_rows,
       count(distinct key_value) as distinct_keys from ({fx.CS2_SQL})""")
def q_changeset_profile(spark, d):
    """A2: row counts of the change set."""
    return ck.changeset_profile(bind_changeset(fx.cs2(spark, d), fx.CUSTOMER_SPEC.update_columns, keep_null_keys=True))


@query("gate_report", f"""with {CS2_CO},
r as (select count(*) as n_rows, count(key_value) as n_keyed,
             coalesce(max(greatest(coalesce(strlen(cast(key_value as varchar)), 0),
                                   coalesce(strlen(c_mktsegment), 0), coalesce(strlen(c_nationkey), 0))), 0) as max_text
      from cs),
k as (select count(*) filter (where n > 1) as n_dup_keys
      from (select coalesce(cast(key_cast as varchar), key_value) as dk, count(*) as n from co group by dk))
select cast(1 as bigint) as seq, 'has_data_rows' as check_name, n_rows >= 1 as passed, n_rows as observed, cast(1 as bigint) as limit_value,
       'at least one data row' as message from r
union all select 2, 'row_limit', n_rows <= 100000, n_rows, 100000, 'data rows within the limit' from r
union all select 3, 'column_count', true, 3, 3, 'key column plus one column per update column'
union all select 4, 'has_keyed_rows', n_keyed >= 1, n_keyed, 1, 'at least one row with a key' from r
union all select 5, 'unique_keys', n_dup_keys = 0, n_dup_keys, 0, 'no key appears twice' from k
union all select 6, 'text_length', max_text <= 4000, max_text, 4000, 'staged text within the limit' from r""")
def q_gate_report(spark, d):
    """The gates as a checks table."""
    raw = fx.cs2(spark, d)
    spec = fx.CUSTOMER_SPEC
    bound = bind_changeset(raw, spec.update_columns, keep_null_keys=True)
    target, coerced = _prepared(spark, d, fx.cs2, spec)
    n_data = len(raw.columns) - 1
    return ck.gate_report(bound, coerced, spec.update_columns, n_data, max_rows=fixed.MAX_ROWS,
                          max_text=fixed.STAGED_TEXT_MAX)


@query("gate_report_broken", f"""with k as (select row_num, key_value from ({fx.CSD_SQL})),
c as (select coalesce(cast(try_cast(key_value as bigint) as varchar), key_value) as dk, count(*) as n from k group by dk),
r as (select count(*) as n_rows, count(key_value) as n_keyed, max(strlen(key_value)) as longest from k)
select cast(1 as bigint) as seq, 'has_data_rows' as check_name, n_rows >= 1 as passed, n_rows as observed, cast(1 as bigint) as limit_value,
       'at least one data row' as message from r
union all select 2, 'row_limit', n_rows <= 10, n_rows, 10, 'data rows within the limit' from r
union all select 3, 'column_count', false, 2, 3, 'key column plus one column per update column'
union all select 4, 'has_keyed_rows', n_keyed >= 1, n_keyed, 1, 'at least one row with a key' from r
union all select 5, 'unique_keys', count(*) = 0, count(*), 0, 'no key appears twice' from c where n > 1
union all select 6, 'text_length', m <= 9, m, 9, 'staged text within the limit'
          from (select greatest(longest, (select max(strlen(o_orderpriority)) from orders)) as m from r)""")
def q_gate_report_broken(spark, d):
    """A change set that breaks the row, column, duplicate and text gates."""
    raw = fx.csd(spark, d)
    bound = bind_changeset(raw, ["new_priority"], keep_null_keys=True)
    coerced = _csd_coerced(spark, d)
    return ck.gate_report(bound.withColumn("more", F.lit(None).cast("string")), coerced, ["new_priority", "more"], 2,
                          max_rows=10, max_text=9)


@query("export_fill", f"""with {CS2_CO}
select coalesce(cast(row_num as varchar), '') as row_num, coalesce(key_value, '') as key_value,
       coalesce(c_mktsegment, '') as c_mktsegment, coalesce(c_nationkey, '') as c_nationkey from st""")
def q_export_fill(spark, d):
    """Missing fields written as empty text."""
    bound = bind_changeset(fx.cs2(spark, d), fx.CUSTOMER_SPEC.update_columns)
    return pv.export_fill(stage_as_text(bound, fx.CUSTOMER_SPEC.update_columns))


@query("audit_update_entry", f"""with {CS2_OC}, s as ({_SUMMARY_SQL})
select '2024-01-31 12:00:00' as timestamp, 'UPDATE' as action_type, 'system' as "user", success, '' as error_msg,
       to_json({{'schema': '', 'table': 'customer', 'key_column': 'c_custkey',
                 'update_columns': ['c_mktsegment', 'c_nationkey'], 'total_count': total_count,
                 'success_count': success_count, 'fail_count': fail_count,
                 'backup_table': 'customer_BAK_20240131_120000'}})::varchar as details,
       cast(0 as bigint) as id from s""")
def q_audit_update_entry(spark, d):
    """The run's UPDATE audit entry."""
    s = ap.run_summary(_outcomes(spark, d, fx.cs2, fx.CUSTOMER_SPEC))
    spec = fx.CUSTOMER_SPEC
    return au.update_entry(s, schema=spec.schema, table=spec.table, key_column=spec.key_column,
                           update_columns=spec.update_columns, backup_table="customer_BAK_20240131_120000",
                           run_ts=fx.RUN_TS)


# ======================================================================================
# CSD: duplicate keys
# ======================================================================================

# keys in their canonical spelling: the key as a number where it is one
_CSD_K = ("k as (select row_num, coalesce(cast(try_cast(key_value as bigint) as varchar), key_value) as key_value "
          f"from ({fx.CSD_SQL}) where key_value is not null)")
_CSD_F = "f as (select key_value, min(row_num) as first_row, count(*) as occurrences from k group by key_value)"
_CSD_P = ("p as (select k.key_value, f.first_row, k.row_num from k join f using (key_value) "
          "where f.occurrences > 1 and k.row_num > f.first_row)")


def _csd_coerced(spark, d):
    staged = stage_as_text(bind_changeset(fx.csd(spark, d), ["new_priority"]), ["new_priority"])
    schema = T.StructType([*fx.table(spark, d, "customer").schema.fields, T.StructField("new_priority", T.StringType())])
    return coerce_changes(staged, schema, "c_custkey", ["new_priority"])


def _csd(spark, d):
    return ck.canonical_keys(_csd_coerced(spark, d))


@query("duplicate_keys", f"with {_CSD_K}, {_CSD_F} select * from f where occurrences > 1")
def q_duplicate_keys(spark, d):
    """Distinct duplicated keys."""
    return ck.duplicate_keys(_csd(spark, d))


@query("duplicate_key_rows", f"""with {_CSD_K}, {_CSD_F}
select key_value, cast(0 as bigint) as chunk, count(*) as n_rows,
       string_agg(cast(row_num as varchar), ', ' order by row_num) as rows
from k where key_value in (select key_value from f where occurrences > 1)
group by key_value""")
def q_duplicate_key_rows(spark, d):
    """Every duplicated key with all its rows."""
    return ck.duplicate_key_rows(_csd(spark, d))


@query("duplicate_pairs", f"with {_CSD_K}, {_CSD_F}, {_CSD_P} select * from p")
def q_duplicate_pairs(spark, d):
    """Each repeat paired with the first occurrence."""
    return ck.duplicate_pairs(_csd(spark, d))


@query("duplicate_keys_ordered", f"""with {_CSD_K}, {_CSD_F}, {_CSD_P}
select key_value, min(row_num) as second_row from p group by key_value order by second_row""")
def q_duplicate_keys_ordered(spark, d):
    """Duplicated keys in order of their second occurrence."""
    return ck.duplicate_keys_ordered(_csd(spark, d))


@query("duplicate_keys_top5", f"""with {_CSD_K}, {_CSD_F}, {_CSD_P}
select key_value, min(row_num) as second_row from p group by key_value order by second_row limit 5""")
def q_duplicate_keys_top5(spark, d):
    """The first five duplicates reported."""
    return ck.duplicate_keys_top(_csd(spark, d), 5)


# ======================================================================================
# customer as the target
# ======================================================================================


@query("target_scan", "select * from customer")
def q_target_scan(spark, d):
    """The whole target."""
    return fx.table(spark, d, "customer")


@query("target_keys", "select c_custkey from customer")
def q_target_keys(spark, d):
    """The key column only (one-column scan)."""
    return fx.table(spark, d, "customer").select("c_custkey")


def _profile_sql(table: str, cols: list[str]) -> str:
    parts = []
    for i, c in enumerate(cols):
        parts.append(f"select cast({i + 1} as bigint) as ordinal, '{c.upper()}' as column_name, "
                     f"(select case data_type when 'VARCHAR' then 'string' when 'INTEGER' then 'int' else lower(data_type) end "
                     f"from information_schema.columns where table_name = '{table}' and column_name = '{c}') as data_type, "
                     f"(select is_nullable = 'YES' from information_schema.columns "
                     f"where table_name = '{table}' and column_name = '{c}') as nullable, "
                     f"coalesce(max(length(cast({c} as varchar))), 0) as max_length, "
                     f"count(*) filter (where {c} is null) as null_count from {table}")
    return "\nunion all ".join(parts)


@query("target_columns", _profile_sql("customer", _CUSTOMER_COLS))
def q_target_columns(spark, d):
    """The target's columns in ordinal order, with observed length and NULLs."""
    prof = ck.column_profile(fx.table(spark, d, "customer"))
    return prof.select("ordinal", "column_name", "data_type", "nullable", "max_length", "null_count")


@query("missing_columns", f"""with {_HIST},
r as (select id, unnest(range(1, len(a) + 1)) as position, unnest(a) as name
      from (select id, string_split(update_columns, ',') as a from h))
select id, cast(position as bigint) as position, trim(name) as column_name from r
where upper(trim(name)) not in (select upper(column_name) from information_schema.columns where table_name = 'lineitem')""")
def q_missing_columns(spark, d):
    """Columns each recorded run asked for that the target lacks (case-insensitive)."""
    h = fx.hist(spark, d)
    req = h.select("id", F.posexplode(F.split("update_columns", ",")).alias("pos", "name")).select(
        "id", (F.col("pos") + 1).cast("long").alias("position"), F.trim("name").alias("column_name"))
    return ck.missing_columns(req, fx.table(spark, d, "lineitem").schema)


@query("column_widths", """
select cast(1 as bigint) as ordinal, 'c_custkey' as column_name, least(greatest(9, coalesce(max(length(cast(c_custkey as varchar))), 0)) + 2, 50) as width from customer
union all select 2, 'c_name', least(greatest(6, coalesce(max(length(c_name)), 0)) + 2, 50) from customer
union all select 3, 'c_nationkey', least(greatest(11, coalesce(max(length(cast(c_nationkey as varchar))), 0)) + 2, 50) from customer
union all select 4, 'c_acctbal', least(greatest(9, coalesce(max(length(cast(c_acctbal as varchar))), 0)) + 2, 50) from customer
union all select 5, 'c_mktsegment', least(greatest(12, coalesce(max(length(c_mktsegment)), 0)) + 2, 50) from customer""")
def q_column_widths(spark, d):
    """Export column widths over the whole table."""
    return pv.column_widths(fx.table(spark, d, "customer"))


# ======================================================================================
# audit entries (AUD)
# ======================================================================================

_AUD = f"a as ({fx.AUD_SQL})"
_AUD_COLS = "timestamp, action_type, user_name, success, error_msg, details, id"


@query("audit_scan", f"""with e as (select * from events)
select strftime(ts, '%Y-%m-%d %H:%M:%S') as timestamp,
       case when event_type in ('click', 'error') then 'UPDATE' when event_type = 'view' then 'CONNECTION'
            when event_type = 'purchase' then 'EXPORT' when event_type = 'signup' then 'ROLLBACK' end as action_type,
       'user_' || cast(user_id as varchar) as "user", event_type <> 'error' as success,
       case when event_type = 'error' then 'ORA-01722: event ' || cast(event_id as varchar) else '' end as error_msg,
       props as details, event_id as id
from e where not (value < 1.0)""")
def q_audit_scan(spark, d):
    """JSON-lines audit decoded; lines cut short are dropped."""
    return au.parse_audit_lines(fx.audit_lines(spark, d))


@query("audit_by_type", f"with {_AUD} select {_AUD_COLS} from a where action_type = 'UPDATE'")
def q_audit_by_type(spark, d):
    """P10: entries of one action type."""
    return au.by_action(fx.aud(spark, d), fixed.ACTION_UPDATE).select(*_AUD_COLS.split(", "))


@query("audit_latest", f"with {_AUD} select {_AUD_COLS} from a order by timestamp desc, id desc limit 100")
def q_audit_latest(spark, d):
    """L4: newest 100 entries."""
    return au.newest_first(fx.aud(spark, d)).select(*_AUD_COLS.split(", "))


@query("audit_purge_keep", f"""with {_AUD}
select {_AUD_COLS} from a where not (coalesce(timestamp, '') < '2024-01-15 00:00:00')""")
def q_audit_purge_keep(spark, d):
    """Entries kept by a purge before a date."""
    kept, _ = au.purge_before(fx.aud(spark, d), "2024-01-15 00:00:00")
    return kept.select(*_AUD_COLS.split(", "))


@query("audit_purge_count", """
select count(*) filter (where value >= 1.0 and strftime(ts, '%Y-%m-%d %H:%M:%S') < '2024-01-15 00:00:00') as deleted_count,
       count(*) filter (where value >= 1.0 and strftime(ts, '%Y-%m-%d %H:%M:%S') >= '2024-01-15 00:00:00') as kept_count,
       count(*) filter (where value < 1.0) as corrupt_count
from events""")
def q_audit_purge_count(spark, d):
    """Deleted, kept and unreadable entry counts of a purge."""
    lines = fx.audit_lines(spark, d)
    return au.purge_counts(au.parse_audit_lines(lines), "2024-01-15 00:00:00", au.audit_corrupt(lines))


@query("audit_append", f"""with {CS2_OC}, s as ({_SUMMARY_SQL}), e as (select * from events)
select strftime(ts, '%Y-%m-%d %H:%M:%S') as timestamp,
       case when event_type in ('click', 'error') then 'UPDATE' when event_type = 'view' then 'CONNECTION'
            when event_type = 'purchase' then 'EXPORT' when event_type = 'signup' then 'ROLLBACK' end as action_type,
       'user_' || cast(user_id as varchar) as "user", event_type <> 'error' as success, event_id as id
from e where not (value < 1.0)
union all
select '2024-01-31 12:00:00', 'UPDATE', 'system', success, cast(-1 as bigint) from s""")
def q_audit_append(spark, d):
    """A log of JSON lines, a run's entry appended to its files, and all read back."""
    import uuid

    from keyedit.session import scratch_path
    path = scratch_path(spark, f"audit-{uuid.uuid4().hex}")
    au.append_json(au.parse_audit_lines(fx.audit_lines(spark, d)), path)
    s = ap.run_summary(_outcomes(spark, d, fx.cs2, fx.CUSTOMER_SPEC))
    spec = fx.CUSTOMER_SPEC
    au.append_json(au.update_entry(s, schema=spec.schema, table=spec.table, key_column=spec.key_column,
                                   update_columns=spec.update_columns, backup_table="customer_BAK_20240131_120000",
                                   run_ts=fx.RUN_TS, entry_id=-1), path)
    return au.read_audit(spark, path).select("timestamp", "action_type", "user", "success", "id")


@query("audit_entries_by_kind", """
select kind as action_type, n as n_records, ok as success from (
  select 'CONNECTION' as kind, count(*) as n, true as ok from customer
  union all select 'EXPORT', count(*), true from customer where c_acctbal < 0
  union all select 'ROLLBACK', count(*), true from customer)""")
def q_audit_entries_by_kind(spark, d):
    """Entries for opening, exporting and rolling back, written as JSON lines and read back."""
    import uuid

    from keyedit.session import scratch_path
    from keyedit.sinks.writers import export_csv, snapshot
    path = scratch_path(spark, f"audit-{uuid.uuid4().hex}")
    target = fx.table(spark, d, "customer")
    n = target.count()
    au.append_json(au.connection_entry(spark, source="customer", success=True, run_ts=fx.RUN_TS, entry_id=n), path)
    out = scratch_path(spark, f"export-{uuid.uuid4().hex}")
    k = export_csv(target.where("c_acctbal < 0"), out, empty_ok=True)
    au.append_json(au.export_entry(spark, kind="csv", path=out, record_count=k, success=True, run_ts=fx.RUN_TS, entry_id=k), path)
    m = snapshot(target, scratch_path(spark, f"back-{uuid.uuid4().hex}"))
    au.append_json(au.rollback_entry(spark, schema="", table="customer", backup_table="customer_BAK_20240131_120000",
                                     success=True, run_ts=fx.RUN_TS, entry_id=m), path)
    return au.read_audit(spark, path).select("action_type", F.col("id").cast("long").alias("n_records"), "success")


@query("audit_details", f"""with {_AUD}
select id, cast(json_extract_string(details, '$.k') as bigint) as k from a where action_type = 'UPDATE'""")
def q_audit_details(spark, d):
    """fields decoded from the details JSON."""
    a = au.by_action(fx.aud(spark, d), fixed.ACTION_UPDATE)
    return a.select("id", F.get_json_object("details", "$.k").cast("long").alias("k"))


# ======================================================================================
# run history (HIST)
# ======================================================================================

_HIST_COLS = ("id, timestamp, schema, \"table\", key_column, update_columns, total_count, success_count, "
              "fail_count, success, backup_table")


def _hist_cols():
    return ["id", "timestamp", "schema", "table", "key_column", "update_columns", "total_count",
            "success_count", "fail_count", "success", "backup_table"]


@query("history_scan", f"with {_HIST} select {_HIST_COLS} from h")
def q_history_scan(spark, d):
    """The history table."""
    return fx.hist(spark, d).select(*_hist_cols())


@query("history_latest", f"with {_HIST} select {_HIST_COLS} from h order by timestamp desc, id desc limit 100")
def q_history_latest(spark, d):
    """L4: newest 100 records."""
    return au.newest_first(fx.hist(spark, d)).select(*_hist_cols())


@query("history_view", f"""with {_HIST}, top as (select * from h order by timestamp desc, id desc limit 100)
select cast(row_number() over (order by timestamp desc, id desc) as bigint) as seq,
       coalesce(timestamp, '--') as timestamp, coalesce("table", '--') as "table", coalesce(schema, '--') as schema,
       coalesce(cast(total_count as varchar), '0') as total_count,
       coalesce(cast(success_count as varchar), '0') as success_count,
       coalesce(cast(fail_count as varchar), '0') as fail_count,
       case when coalesce(success, false) then '{fixed.STATUS_SUCCESS}' else '{fixed.STATUS_PARTIAL}' end as status
from top""")
def q_history_view(spark, d):
    """The history as displayed."""
    return au.history_view(fx.hist(spark, d))


@query("history_delete", f"""with {_HIST}, sel as (select id from h order by timestamp desc, id desc limit 100)
select {_HIST_COLS} from h where id not in (select id from sel)""")
def q_history_delete(spark, d):
    """Records left after deleting the selected ids."""
    h = fx.hist(spark, d)
    sel = au.newest_first(h).select("id")
    return au.delete_ids(h, sel).select(*_hist_cols())


@query("history_delete_count", f"""with {_HIST}, sel as (select id from h order by timestamp desc, id desc limit 100)
select count(*) filter (where id in (select id from sel)) as deleted_count,
       count(*) filter (where id not in (select id from sel)) as remaining_count from h""")
def q_history_delete_count(spark, d):
    """How many records a deletion removed."""
    h = fx.hist(spark, d)
    remaining = au.delete_ids(h, au.newest_first(h).select("id"))
    return au.delete_count(h, remaining)


@query("run_names", f"""with {_HIST}
select id, 'lineitem_BAK_' || strftime(run_ts, '%Y%m%d_%H%M%S') as backup_name,
       'TEMP_UPDATE_' || strftime(run_ts, '%Y%m%d_%H%M%S') as staging_name,
       strftime(run_ts, '%Y%m%d%H%M%S%f') as record_id from h""")
def q_run_names(spark, d):
    """snapshot, staging and record names from run times."""
    h = fx.hist(spark, d)
    return h.select("id", backup_name(F.col("table"), F.col("run_ts")).alias("backup_name"),
                    staging_name(F.col("run_ts")).alias("staging_name"),
                    F.date_format("run_ts", fixed.ID_TS_FORMAT).alias("record_id"))


# ======================================================================================
# logs and errors
# ======================================================================================


@query("log_parse", f"""with l as ({fx.LOG_SQL}), t as (select line_no, trim(value, chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) as e from l where trim(value, chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) <> '')
select line_no,
       case when starts_with(e, '[') and strpos(e, '] ') > 0 then substring(e, 2, strpos(e, ']') - 2) else '' end as time,
       case when starts_with(e, '[') and strpos(e, '] ') > 0 then
            case when strpos(substring(e, strpos(e, ']') + 2), ' - ') > 0
                 then substring(substring(e, strpos(e, ']') + 2), 1, strpos(substring(e, strpos(e, ']') + 2), ' - ') - 1)
                 else '' end
            else '' end as level,
       case when starts_with(e, '[') and strpos(e, '] ') > 0 then
            case when strpos(substring(e, strpos(e, ']') + 2), ' - ') > 0
                 then substring(substring(e, strpos(e, ']') + 2), strpos(substring(e, strpos(e, ']') + 2), ' - ') + 3)
                 else substring(e, strpos(e, ']') + 2) end
            else e end as message
from t""")
def q_log_parse(spark, d):
    """Run-log lines split into time, level, message."""
    return au.parse_log(fx.log_lines(spark, d))


def _classify_sql(stage: str) -> str:
    parts = []
    for st, code, label, add in fixed.ERROR_LABELS:
        if st == stage:
            val = f"'{label}' || message" if add else f"'{label}'"
            parts.append(f"when strpos(message, '{code}') > 0 then {val}")
    fb, add = fixed.ERROR_FALLBACK[stage]
    other = "message" if fb is None else (f"'{fb}' || message" if add else f"'{fb}'")
    return f"case {' '.join(parts)} else {other} end"


@query("classify_errors", f"""with e as ({fx.ERR_SQL})
select event_id, message, {_classify_sql('update')} as update_reason, {_classify_sql('sql')} as sql_reason,
       {_classify_sql('keys')} as keys_reason, {_classify_sql('connect')} as connect_reason from e""")
def q_classify_errors(spark, d):
    """F8: error text to the reason shown, per stage."""
    e = fx.err(spark, d)
    m = F.col("message")
    return e.select("event_id", "message", classify_error(m, "update").alias("update_reason"),
                    classify_error(m, "sql").alias("sql_reason"), classify_error(m, "keys").alias("keys_reason"),
                    classify_error(m, "connect").alias("connect_reason"))


# ======================================================================================
# other inputs
# ======================================================================================


@query("file_size_gate", f"""
select doc_id, cast(strlen(text) as bigint) as n_bytes, printf('%.2f', strlen(text) / 1048576.0) as size_mb,
       strlen(text) <= {fixed.MAX_FILE_BYTES} as passed from documents""")
def q_file_size_gate(spark, d):
    """Size limit per file; the text length stands for the file size."""
    docs = fx.table(spark, d, "documents")
    n = F.octet_length("text").cast("long")
    return docs.select("doc_id", n.alias("n_bytes"), megabytes(n).alias("size_mb"),
                       (n <= fixed.MAX_FILE_BYTES).alias("passed"))


@query("normalize_columns", """
select o_orderkey, array_to_string(list_filter(list_transform(string_split(
         ' ' || o_orderpriority || ' ,, ' || o_orderstatus || ',  ,' || o_clerk_free, ','), lambda x: trim(x)), lambda x: x <> ''), '|') as columns
from (select *, case when o_orderkey % 4 = 0 then o_orderpriority else ' ' end as o_clerk_free from orders)""")
def q_normalize_columns(spark, d):
    """User column lists cleaned (trim, drop blanks, keep order and repeats)."""
    o = fx.table(spark, d, "orders")
    extra = F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderpriority")).otherwise(F.lit(" "))
    text = F.concat(F.lit(" "), F.col("o_orderpriority"), F.lit(" ,, "), F.col("o_orderstatus"), F.lit(",  ,"), extra)
    return o.select("o_orderkey", F.array_join(normalize_columns_expr(text), "|").alias("columns"))


@query("header_gate", """
with h as (select conv_id, arg_min(role, turn) as h1, arg_min(text, turn) as h2 from conversations group by conv_id)
select conv_id, coalesce(trim(h1, chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)), '') = '' as first_blank,
       coalesce(trim(h2, chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)), '') = '' as second_blank,
       not (coalesce(trim(h1, chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)), '') = '' or coalesce(trim(h2, chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)), '') = '') as passed
from h""")
def q_header_gate(spark, d):
    """The first two header cells must not be blank.

    Each conversation stands for a two-column sheet whose first turn is the
    header row: its ``role`` and ``text`` cells are the two headers. They are
    taken with ``min_by(…, turn)`` over the whole table (one bounded value per
    group), not by filtering rows.
    """
    conv = fx.table(spark, d, "conversations")
    heads = conv.groupBy("conv_id").agg(F.min_by("role", "turn").alias("h1"), F.min_by("text", "turn").alias("h2"))
    first, second = is_blank(F.col("h1")), is_blank(F.col("h2"))
    return heads.select("conv_id", first.alias("first_blank"), second.alias("second_blank"),
                        (~(first | second)).alias("passed"))


# ======================================================================================
# lineitem as a target with several rows per key
# ======================================================================================


@query("apply_updates_lineitem", f"""with {_coerced_sql(fx.CSL_SQL, fx.LINEITEM_SPEC, _LINEITEM_TYPES)}, {_GOOD}
select {_applied_sql(fx.LINEITEM_SPEC, _LINEITEM_COLS)} from lineitem t left join good g on t.l_orderkey = g.key_cast""")
def q_apply_updates_lineitem(spark, d):
    """J4 on a target with several rows per key: every row of a key is updated."""
    target, coerced = _prepared(spark, d, fx.csl, fx.LINEITEM_SPEC)
    return ap.apply_updates(target, coerced, "l_orderkey", fx.LINEITEM_SPEC.update_columns)


@query("row_outcomes_lineitem", f"with {CSL_OC} select * from oc")
def q_row_outcomes_lineitem(spark, d):
    """R2 on lineitem: rows_updated counts every target row of the key."""
    return _outcomes(spark, d, fx.csl, fx.LINEITEM_SPEC)


_CSL_CO = _coerced_sql(fx.CSL_SQL, fx.LINEITEM_SPEC, _LINEITEM_TYPES)


@query("restore_rows_lineitem", f"""with {_CSL_CO}, {_GOOD},
new_t as (select {_applied_sql(fx.LINEITEM_SPEC, _LINEITEM_COLS)} from lineitem t left join good g on t.l_orderkey = g.key_cast),
sel as (select key_cast from good where l_returnflag = 'A')
select * from new_t where l_orderkey not in (select key_cast from sel)
union all
select * from lineitem where l_orderkey in (select key_cast from sel)""")
def q_restore_rows_lineitem(spark, d):
    """J8, whole rows: selected keys get all their rows back from the backup (several rows per key)."""
    target, coerced = _prepared(spark, d, fx.csl, fx.LINEITEM_SPEC)
    new_t = ap.apply_updates(target, coerced, "l_orderkey", fx.LINEITEM_SPEC.update_columns)
    sel = ap.passing_changes(coerced).where(F.col("l_returnflag") == "A").select(F.col(KEY_CAST).alias("l_orderkey"))
    return ap.restore_rows(new_t, target, sel, "l_orderkey")


_ORDERS_TYPES = {"o_orderkey": T.LongType(), "o_totalprice": T.DoubleType(),
                 "o_orderdate": T.TimestampNTZType(), "o_orderstatus": T.StringType()}
_ORDERS_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
_CSO_CO = _coerced_sql(fx.CSO_SQL, fx.ORDERS_SPEC, _ORDERS_TYPES)


@query("coerce_values_orders", f"""with {_CSO_CO}
select row_num, key_value, key_cast, o_totalprice, o_orderdate, o_orderstatus, type_ok, null_ok from co""")
def q_coerce_values_orders(spark, d):
    """P5: text to double and to timestamp, per-row verdicts."""
    _, coerced = _prepared(spark, d, fx.cso, fx.ORDERS_SPEC)
    return coerced.select(ROW_NUM, KEY, KEY_CAST, "o_totalprice", "o_orderdate", "o_orderstatus", "type_ok", "null_ok")


@query("apply_updates_orders", f"""with {_CSO_CO}, {_GOOD}
select {_applied_sql(fx.ORDERS_SPEC, _ORDERS_COLS)} from orders t left join good g on t.o_orderkey = g.key_cast""")
def q_apply_updates_orders(spark, d):
    """J4 with double and timestamp columns: only rows whose every value converts are applied."""
    target, coerced = _prepared(spark, d, fx.cso, fx.ORDERS_SPEC)
    return ap.apply_updates(target, coerced, "o_orderkey", fx.ORDERS_SPEC.update_columns)


from keyedit.plans import catalog_runs  # noqa: E402,F401  (registers its queries)
