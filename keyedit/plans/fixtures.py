"""Inputs derived from the given tables, over whole tables.

Each derivation exists twice: as a DataFrame (what the queries run) and as
DuckDB SQL text (what the oracle queries start from). Dirty cases are chosen
by integer arithmetic on the keys, so both engines build identical rows; no
derivation filters rows away.

* ``CS1`` - clean change set for ``customer``: one row per customer; every
  tenth key (``c_custkey % 10 = 5``) points outside the table.
* ``CS2`` - dirty change set for ``customer``: NULL keys, leading-zero keys, keys a hair above a whole number,
  blank strings, ``'12x'``, ``'3.5'`` and NULL values.
* ``CSD`` - change set with duplicate keys: one row per order keyed by
  ``o_custkey``.
* ``CSL`` - change set for ``lineitem`` keyed by ``l_orderkey`` (several target
  rows per key), one row per order.
* ``AUD`` / ``HIST`` / ``LOG`` / ``ERR`` - audit entries, run history, log
  lines and error texts built from ``events`` and ``orders``/``lineitem``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyedit.functions import fixed
from keyedit.spec import UpdateSpec

RUN_TS = "2024-01-31 12:00:00"   # wall clock is an argument: results stay deterministic

CUSTOMER_SPEC = UpdateSpec(table="customer", key_column="c_custkey",
                           update_columns=("c_mktsegment", "c_nationkey"),
                           not_null=frozenset({"c_nationkey"}))
ORDERS_SPEC = UpdateSpec(table="orders", key_column="o_orderkey",
                         update_columns=("o_totalprice", "o_orderdate", "o_orderstatus"))
LINEITEM_SPEC = UpdateSpec(table="lineitem", key_column="l_orderkey",
                           update_columns=("l_returnflag", "l_linestatus", "l_quantity"),
                           not_null=frozenset({"l_returnflag"}))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _s(c):
    return c.cast("string")


# --- change sets -------------------------------------------------------------

def cs1(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        (k + 2).cast("long").alias("row_num"),
        _s(F.when(k % 10 == 5, k + 1000000).otherwise(k)).alias("key_value"),
        F.concat(F.lit("SEG"), _s(k % 3)).alias("c_mktsegment"),
        _s((k * 7) % 25).alias("c_nationkey"),
    )


CS1_SQL = """select cast(c_custkey + 2 as bigint) as row_num,
       cast(case when c_custkey % 10 = 5 then c_custkey + 1000000 else c_custkey end as varchar) as key_value,
       'SEG' || cast(c_custkey % 3 as varchar) as c_mktsegment,
       cast((c_custkey * 7) % 25 as varchar) as c_nationkey
from customer"""


def cs2(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        (k + 2).cast("long").alias("row_num"),
        (F.when(k % 20 == 15, F.lit(None).cast("string"))
         .when(k % 20 == 5, _s(k + 1000000))
         .when(k % 40 == 10, F.lpad(_s(k), 6, "0"))
         .when(k % 40 == 30, F.concat(_s(k), F.lit(".0000000000000000001")))
         .otherwise(_s(k))).alias("key_value"),
        F.when(k % 60 == 40, F.lit("")).otherwise(F.concat(F.lit("SEG"), _s(k % 3))).alias("c_mktsegment"),
        (F.when(k % 30 == 0, F.lit("12x"))
         .when(k % 50 == 20, F.lit(None).cast("string"))
         .when(k % 70 == 10, F.lit("3.5"))
         .otherwise(_s((k * 7) % 25))).alias("c_nationkey"),
    )


CS2_SQL = """select cast(c_custkey + 2 as bigint) as row_num,
       case when c_custkey % 20 = 15 then null
            when c_custkey % 20 = 5 then cast(c_custkey + 1000000 as varchar)
            when c_custkey % 40 = 10 then lpad(cast(c_custkey as varchar), 6, '0')
            when c_custkey % 40 = 30 then cast(c_custkey as varchar) || '.0000000000000000001'
            else cast(c_custkey as varchar) end as key_value,
       case when c_custkey % 60 = 40 then '' else 'SEG' || cast(c_custkey % 3 as varchar) end as c_mktsegment,
       case when c_custkey % 30 = 0 then '12x' when c_custkey % 50 = 20 then null
            when c_custkey % 70 = 10 then '3.5' else cast((c_custkey * 7) % 25 as varchar) end as c_nationkey
from customer"""


def csd(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") + 2).cast("long").alias("row_num"),
        F.when(F.col("o_orderkey") % 3 == 1, F.lpad(_s(F.col("o_custkey")), 9, "0"))
        .when(F.col("o_orderkey") % 17 == 3, F.concat(F.lit("no key "), _s(F.col("o_custkey") % 40)))
        .otherwise(_s(F.col("o_custkey"))).alias("key_value"),
        F.col("o_orderpriority").alias("new_priority"),
    )


CSD_SQL = """select cast(o_orderkey + 2 as bigint) as row_num,
       case when o_orderkey % 3 = 1 then lpad(cast(o_custkey as varchar), 9, '0')
            when o_orderkey % 17 = 3 then 'no key ' || cast(o_custkey % 40 as varchar)
            else cast(o_custkey as varchar) end as key_value,
       o_orderpriority as new_priority
from orders"""


def csl(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        (k + 2).cast("long").alias("row_num"),
        _s(F.when(k % 8 == 3, k + 100000000).otherwise(k)).alias("key_value"),
        F.when(k % 2 == 0, F.lit("A")).otherwise(F.lit("N")).alias("l_returnflag"),
        F.col("o_orderstatus").alias("l_linestatus"),
        F.when(k % 11 == 7, F.lit("many")).otherwise(_s(k % 50 + 1)).alias("l_quantity"),
    )


CSL_SQL = """select cast(o_orderkey + 2 as bigint) as row_num,
       cast(case when o_orderkey % 8 = 3 then o_orderkey + 100000000 else o_orderkey end as varchar) as key_value,
       case when o_orderkey % 2 = 0 then 'A' else 'N' end as l_returnflag,
       o_orderstatus as l_linestatus,
       case when o_orderkey % 11 = 7 then 'many' else cast(o_orderkey % 50 + 1 as varchar) end as l_quantity
from orders"""


def cso(spark, sf_dir) -> DataFrame:
    """Change set for ``orders``: prices and dates as text, some of them unusable."""
    k = F.col("o_orderkey")
    price = F.when(k % 9 == 4, F.lit("n/a")).otherwise(F.concat(_s(k % 1000), F.lit(".25")))
    day = F.date_format(F.col("o_orderdate"), "yyyy-MM-dd")
    date = F.when(k % 7 == 3, F.lit("2024-13-45")).otherwise(F.concat(day, F.lit(" 08:30:00")))
    status = F.when(k % 5 == 1, F.lit("X")).otherwise(F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").select(
        (k + 2).cast("long").alias("row_num"), _s(k).alias("key_value"),
        price.alias("o_totalprice"), date.alias("o_orderdate"), status.alias("o_orderstatus"))


CSO_SQL = """select cast(o_orderkey + 2 as bigint) as row_num, cast(o_orderkey as varchar) as key_value,
       case when o_orderkey % 9 = 4 then 'n/a' else cast(o_orderkey % 1000 as varchar) || '.25' end as o_totalprice,
       case when o_orderkey % 7 = 3 then '2024-13-45' else strftime(o_orderdate, '%Y-%m-%d') || ' 08:30:00' end as o_orderdate,
       case when o_orderkey % 5 = 1 then 'X' else o_orderstatus end as o_orderstatus
from orders"""


# --- audit, history, log, errors ------------------------------------------------

def _aud_columns():
    et = F.col("event_type")
    action = (F.when(et.isin("click", "error"), F.lit(fixed.ACTION_UPDATE))
              .when(et == "view", F.lit(fixed.ACTION_CONNECTION))
              .when(et == "purchase", F.lit(fixed.ACTION_EXPORT))
              .when(et == "signup", F.lit(fixed.ACTION_ROLLBACK)))
    return [
        F.col("event_id").alias("id"),
        F.date_format("ts", fixed.TEXT_TS_FORMAT).alias("timestamp"),
        action.alias("action_type"),
        F.concat(F.lit("user_"), _s(F.col("user_id"))).alias("user_name"),
        (et != "error").alias("success"),
        F.when(et == "error", F.concat(F.lit("ORA-01722: event "), _s(F.col("event_id")))).otherwise(F.lit("")).alias("error_msg"),
        F.col("props").alias("details"),
    ]


def aud(spark, sf_dir) -> DataFrame:
    """Audit entries, one per event."""
    return table(spark, sf_dir, "events").select(*_aud_columns())


AUD_SQL = """select event_id as id, strftime(ts, '%Y-%m-%d %H:%M:%S') as timestamp,
       case when event_type in ('click', 'error') then 'UPDATE' when event_type = 'view' then 'CONNECTION'
            when event_type = 'purchase' then 'EXPORT' when event_type = 'signup' then 'ROLLBACK' end as action_type,
       'user_' || cast(user_id as varchar) as user_name,
       event_type <> 'error' as success,
       case when event_type = 'error' then 'ORA-01722: event ' || cast(event_id as varchar) else '' end as error_msg,
       props as details
from events"""


def audit_lines(spark, sf_dir) -> DataFrame:
    """The audit entries as JSON lines; for events with ``value < 1`` the line
    lost its closing brace while being written (malformed lines a reader must skip)."""
    a = table(spark, sf_dir, "events").select(*_aud_columns(), "value")
    line = F.to_json(F.struct(
        "timestamp", "action_type", F.col("user_name").alias("user"), "success", "error_msg",
        F.col("details"), F.col("id")))
    return a.select(F.col("id"), F.when(F.col("value") < 1.0, F.regexp_replace(line, "}$", "")).otherwise(line).alias("value"))


# the update columns a run asked for, by order priority (some are not lineitem columns)
_REQUESTED = [
    ("1-URGENT", "l_returnflag,l_linestatus"),
    ("2-HIGH", "L_QUANTITY"),
    ("3-MEDIUM", "l_returnflag, l_shipmode"),
    ("4-NOT SPECIFIED", "l_tax,L_COMMENT"),
    ("5-LOW", "l_discount"),
]


def _requested_columns(priority):
    out = F.when(priority == _REQUESTED[0][0], F.lit(_REQUESTED[0][1]))
    for p, cols in _REQUESTED[1:]:
        out = out.when(priority == p, F.lit(cols))
    return out.otherwise(F.lit("l_returnflag"))


def _requested_sql() -> str:
    whens = " ".join(f"when '{p}' then '{c}'" for p, c in _REQUESTED)
    return f"case o_orderpriority {whens} else 'l_returnflag' end"


def hist(spark, sf_dir) -> DataFrame:
    """Run history, one record per order: its line items as one update run.

    Line items are aggregated per order first (map-side combined), then
    joined to orders, so the join sees one row per order on each side.
    """
    li = (table(spark, sf_dir, "lineitem").groupBy("l_orderkey")
          .agg(F.count(F.lit(1)).cast("long").alias("total_count"),
               F.count_if(F.col("l_returnflag") != "R").cast("long").alias("success_count")))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    j = o.join(li, o["o_orderkey"] == li["l_orderkey"], "inner")
    fail = (F.col("total_count") - F.col("success_count")).cast("long")
    return j.select(
        F.col("o_orderkey").alias("id"),
        F.date_format("o_orderdate", fixed.TEXT_TS_FORMAT).alias("timestamp"),
        F.lit("TPCH").alias("schema"),
        F.lit("lineitem").alias("table"),
        F.lit("l_orderkey").alias("key_column"),
        _requested_columns(F.col("o_orderpriority")).alias("update_columns"),
        F.col("total_count"), F.col("success_count"), fail.alias("fail_count"),
        (fail == 0).alias("success"),
        F.concat(F.lit("lineitem"), F.lit(fixed.BACKUP_INFIX),
                 F.date_format("o_orderdate", fixed.NAME_TS_FORMAT)).alias("backup_table"),
        F.col("o_orderdate").alias("run_ts"),
    )


HIST_SQL = """select o_orderkey as id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as timestamp,
       'TPCH' as schema, 'lineitem' as "table", 'l_orderkey' as key_column, """ + _requested_sql() + """ as update_columns,
       li.total_count, li.success_count, li.total_count - li.success_count as fail_count,
       li.total_count - li.success_count = 0 as success,
       'lineitem_BAK_' || strftime(o_orderdate, '%Y%m%d_%H%M%S') as backup_table,
       o_orderdate as run_ts
from orders join (select l_orderkey, cast(count(*) as bigint) as total_count,
                         cast(count(*) filter (where l_returnflag <> 'R') as bigint) as success_count
                  from lineitem group by l_orderkey) li on o_orderkey = li.l_orderkey"""


def log_lines(spark, sf_dir) -> DataFrame:
    """Log lines ``[time] LEVEL - message`` from events, with the odd forms mixed in."""
    e = F.col("event_id")
    ts = F.date_format("ts", fixed.TEXT_TS_FORMAT)
    level = F.when(F.col("event_type") == "error", F.lit("ERROR")).otherwise(F.lit("INFO"))
    msg = F.when(F.col("event_type") == "purchase", F.concat(F.lit("SUCCESS - event "), _s(e))) \
        .otherwise(F.concat(F.lit("event "), _s(e)))
    line = (F.when(e % 10 == 0, F.concat(F.lit("plain text "), _s(e)))
            .when(e % 10 == 1, F.concat(F.lit("["), ts, F.lit("] "), level, F.lit(" "), msg))
            .otherwise(F.concat(F.lit("["), ts, F.lit("] "), level, F.lit(" - "), msg)))
    return table(spark, sf_dir, "events").select(e.alias("line_no"), line.alias("value"))


LOG_SQL = """select event_id as line_no,
       case when event_id % 10 = 0 then 'plain text ' || cast(event_id as varchar)
            when event_id % 10 = 1 then '[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '] '
                 || case when event_type = 'error' then 'ERROR' else 'INFO' end || ' '
                 || case when event_type = 'purchase' then 'SUCCESS - event ' else 'event ' end || cast(event_id as varchar)
            else '[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '] '
                 || case when event_type = 'error' then 'ERROR' else 'INFO' end || ' - '
                 || case when event_type = 'purchase' then 'SUCCESS - event ' else 'event ' end || cast(event_id as varchar)
       end as value
from events"""


_ERR_CODES = ["ORA-01722", "ORA-01407", "ORA-00942", "ORA-00904", "ORA-00001"]


def err(spark, sf_dir) -> DataFrame:
    e = F.col("event_id")
    code = F.when(e % 6 == 0, F.lit(_ERR_CODES[0]))
    for i, c in enumerate(_ERR_CODES[1:], start=1):
        code = code.when(e % 6 == i, F.lit(c))
    code = code.otherwise(F.lit("ORA-12541"))
    msg = F.concat(code, F.lit(": failure at event "), _s(e))
    return table(spark, sf_dir, "events").select(e.alias("event_id"), msg.alias("message"))


ERR_SQL = """select event_id, (case event_id % 6 when 0 then 'ORA-01722' when 1 then 'ORA-01407'
       when 2 then 'ORA-00942' when 3 then 'ORA-00904' when 4 then 'ORA-00001' else 'ORA-12541' end)
       || ': failure at event ' || cast(event_id as varchar) as message
from events"""


# --- runs on a target of several files -------------------------------------------

FILES = 16      # files that the customer table is laid out in, by c_custkey % FILES


def csf(spark, sf_dir) -> DataFrame:
    """Change set for ``customer`` from the suppliers: its keys lie in three of the table's files."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        (k + 2).cast("long").alias("row_num"), _s(k * FILES + F.col("s_nationkey") % 3).alias("key_value"),
        F.concat(F.lit("FILE"), _s(k % 4)).alias("c_mktsegment"),
        F.when(k % 9 == 4, F.lit("n/a")).otherwise(_s((F.col("s_nationkey") + 1) % 25)).alias("c_nationkey"))


CSF_SQL = f"""select cast(s_suppkey + 2 as bigint) as row_num,
       cast(s_suppkey * {FILES} + s_nationkey % 3 as varchar) as key_value,
       'FILE' || cast(s_suppkey % 4 as varchar) as c_mktsegment,
       case when s_suppkey % 9 = 4 then 'n/a' else cast((s_nationkey + 1) % 25 as varchar) end as c_nationkey
from supplier"""


def cse(spark, sf_dir) -> DataFrame:
    """Change set for one column of ``customer``: the priority of each customer's first order, NULL for a fifth of them."""
    first = F.min_by("o_orderpriority", "o_orderkey")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(first.alias("p")).select(
        (F.col("o_custkey") + 2).cast("long").alias("row_num"), _s(F.col("o_custkey")).alias("key_value"),
        F.when(F.col("o_custkey") % 5 != 3, F.col("p")).alias("c_mktsegment"))


CSE_SQL = """select cast(o_custkey + 2 as bigint) as row_num, cast(o_custkey as varchar) as key_value,
       case when o_custkey % 5 <> 3 then arg_min(o_orderpriority, o_orderkey) end as c_mktsegment
from orders group by o_custkey"""

SEGMENT_SPEC = UpdateSpec(table="customer", key_column="c_custkey", update_columns=("c_mktsegment",))


# --- constraints ----------------------------------------------------------------------

NAME_SPEC = UpdateSpec(table="customer", key_column="c_custkey", update_columns=("c_name", "c_nationkey", "c_mktsegment"))
SEGMENT_BYTES = 10


def csu(spark, sf_dir) -> DataFrame:
    """Renames of every customer: chains that end at a free or a kept name, swaps, equal wishes, NULLs; some values break other rules."""
    k = F.col("c_custkey")

    def name(x):
        return F.concat(F.lit("Customer#"), F.lpad(_s(x), 9, "0"))
    renamed = (F.when((k % 10).between(1, 4) | (k % 20 == 15) | (k % 10 == 7), name(k + 1))
               .when(k % 20 == 5, F.concat(F.lit("New#"), _s(k)))
               .when(k % 10 == 8, name(k - 1))
               .when(k % 10 == 9, F.concat(F.lit("Same#"), _s(k % 30)))
               .when(k % 20 == 0, F.lit(None).cast("string"))
               .otherwise(name(k)))
    return table(spark, sf_dir, "customer").select(
        (k + 2).cast("long").alias("row_num"),
        _s(F.when(k % 23 == 0, k + 1000000).otherwise(k)).alias("key_value"), renamed.alias("c_name"),
        F.when(k % 37 == 0, F.lit("99")).otherwise(_s((k * 7) % 25)).alias("c_nationkey"),
        F.when(k % 41 == 0, F.lit("SEGMENT TOO LONG")).when(k % 43 == 0, F.lit("éééééé"))
        .otherwise(F.concat(F.lit("SEG"), _s(k % 3))).alias("c_mktsegment"))


CSU_SQL = """select cast(c_custkey + 2 as bigint) as row_num,
       cast(case when c_custkey % 23 = 0 then c_custkey + 1000000 else c_custkey end as varchar) as key_value,
       case when c_custkey % 10 between 1 and 4 or c_custkey % 20 = 15 or c_custkey % 10 = 7
                 then 'Customer#' || lpad(cast(c_custkey + 1 as varchar), 9, '0')
            when c_custkey % 20 = 5 then 'New#' || cast(c_custkey as varchar)
            when c_custkey % 10 = 8 then 'Customer#' || lpad(cast(c_custkey - 1 as varchar), 9, '0')
            when c_custkey % 10 = 9 then 'Same#' || cast(c_custkey % 30 as varchar)
            when c_custkey % 20 = 0 then null
            else 'Customer#' || lpad(cast(c_custkey as varchar), 9, '0') end as c_name,
       case when c_custkey % 37 = 0 then '99' else cast((c_custkey * 7) % 25 as varchar) end as c_nationkey,
       case when c_custkey % 41 = 0 then 'SEGMENT TOO LONG' when c_custkey % 43 = 0 then 'éééééé'
            else 'SEG' || cast(c_custkey % 3 as varchar) end as c_mktsegment
from customer"""
