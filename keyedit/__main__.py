"""Command line: ``python -m keyedit <command> …`` (cluster settings come from the environment).

Commands:

* ``run``     apply a change-set file to a parquet target (``run_update``)
* ``check``   duplicate keys and keys missing from the target, written as CSV
* ``preview`` the first rows of a change set and its row counts, printed

The change set is read positionally: first data column = key, then one
column per ``--columns`` entry. Output is one JSON line on stdout.
"""

from __future__ import annotations

import argparse
import json
import sys
from datetime import datetime, timezone


def _args(argv):
    p = argparse.ArgumentParser(prog="keyedit")
    sub = p.add_subparsers(dest="cmd", required=True)
    for name in ("run", "check", "preview"):
        s = sub.add_parser(name)
        s.add_argument("--changes", required=True, help="change-set file or folder")
        s.add_argument("--format", default="csv", choices=["csv", "json", "parquet", "xlsx"])
        s.add_argument("--sheet", default=None, help="xlsx: sheet name (default: the first sheet)")
        s.add_argument("--row-num-col", default=None, help="column holding the sheet row, if any")
        s.add_argument("--schema", default=None, help="DDL schema of the file (needed for json: keeps the column order)")
        s.add_argument("--columns", required=True, help="update columns, comma separated, in file order")
        if name != "preview":
            s.add_argument("--target", required=True, help="parquet path of the target")
            s.add_argument("--key", required=True, help="key column of the target")
            s.add_argument("--out", required=True, help="output folder (new paths only)")
        if name == "run":
            s.add_argument("--table", default=None, help="table name for names and audit (default: last path part)")
            s.add_argument("--not-null", default="", help="NOT NULL columns, comma separated")
            s.add_argument("--on-failure", default="keep", choices=["keep", "restore"])
            s.add_argument("--unmatched", default="ignore", choices=["ignore", "fail"])
            s.add_argument("--snapshot", default="pointer", choices=["pointer", "copy"])
            s.add_argument("--audit", default=None)
            s.add_argument("--history", default=None)
        if name == "preview":
            s.add_argument("--rows", type=int, default=50)
    return p.parse_args(argv)


def _workbook_changes(spark, path: str, n_columns: int, sheet: str | None):
    """One workbook as a change set: ``row_num`` then its first ``n_columns`` cells.

    The header row (sheet row 1) names the columns; data rows start at row 2.
    """
    from pyspark.sql import functions as F
    from keyedit.sources.workbook import read_workbooks
    rows = read_workbooks(spark, path, n_columns, sheet=sheet)
    if rows.select("path").distinct().limit(2).count() > 1:
        raise SystemExit("give one workbook per run (sheet row numbers repeat across files)")
    header = rows.where(F.col("row_num") == 1).first()
    names = [(header[f"c{i + 1}"] if header and header[f"c{i + 1}"] else f"c{i + 1}") for i in range(n_columns)]
    data = rows.where(F.col("row_num") >= 2)
    return data.select("row_num", *[F.col(f"c{i + 1}").alias(n) for i, n in enumerate(names)])


def main(argv=None) -> int:
    a = _args(sys.argv[1:] if argv is None else argv)
    from keyedit.operators import checks as ck
    from keyedit.operators import preview as pv
    from keyedit.operators.staging import bind_changeset, coerce_changes, stage_as_text
    from keyedit.session import get_session
    from keyedit.sinks.writers import export_csv
    from keyedit.sources.changeset import read_changeset
    from keyedit.spec import normalize_columns

    spark = get_session(app=f"keyedit-{a.cmd}")
    cols = normalize_columns(a.columns.split(","))
    if a.format == "xlsx":
        raw = _workbook_changes(spark, a.changes, len(cols) + 1, a.sheet)
    else:
        raw = read_changeset(spark, a.changes, a.format, a.row_num_col, schema=a.schema)

    if a.cmd == "preview":
        bound = bind_changeset(raw, cols, keep_null_keys=True)
        s = pv.preview_summary(bound, a.rows).first().asDict()
        rows = [r.asDict() for r in pv.preview(bound, a.rows).collect()]       # bounded by --rows
        print(json.dumps({"headers": pv.preview_headers(raw, cols), "rows": rows, **s}, default=str))
        return 0

    if a.cmd == "check":
        target = spark.read.parquet(a.target)
        bound = bind_changeset(raw, cols)
        co = coerce_changes(stage_as_text(bound, cols), target.schema, a.key, cols)
        n_dup = export_csv(ck.duplicate_pairs(ck.canonical_keys(co)), f"{a.out}/duplicate_pairs", empty_ok=True)
        n_miss = export_csv(ck.missing_keys(co, target, a.key), f"{a.out}/missing_keys", empty_ok=True)
        n_data = len([c for c in raw.columns if c != "row_num"])
        gates = [r.asDict() for r in ck.gate_report(bind_changeset(raw, cols, keep_null_keys=True), co, cols, n_data)
                 .orderBy("seq").collect()]                                   # six rows
        ok = n_dup == 0 and n_miss == 0 and all(g["passed"] for g in gates)
        print(json.dumps({"duplicate_repeats": n_dup, "missing_keys": n_miss, "gates": gates, "passed": ok}))
        return 0 if ok else 2

    from keyedit.plans.job import run_update
    from keyedit.spec import UpdateSpec
    table = a.table or a.target.rstrip("/").split("/")[-1].replace(".parquet", "")
    spec = UpdateSpec(table=table, key_column=a.key, update_columns=tuple(cols),
                      not_null=frozenset(normalize_columns(a.not_null.split(","))),
                      on_failure=a.on_failure, unmatched=a.unmatched)
    ts = datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
    r = run_update(spark, spec, raw, a.target, a.out, ts, audit_path=a.audit, history_path=a.history,
                   snapshot_mode=a.snapshot)
    print(json.dumps({"ok": r.ok, "message": r.message, "target_path": r.target_path,
                      "backup_path": r.backup_path, "backup_name": r.backup_name,
                      "outcomes_path": r.outcomes_path, "summary": r.summary}, default=str))
    return 0 if r.ok else 1


if __name__ == "__main__":
    sys.exit(main())
