"""Sources, sinks, the end-to-end run and the folder watch."""

import os
import zipfile

import pytest
from pyspark.sql import functions as F

from conftest import SF001, rows
from keyedit.operators.staging import bind_changeset
from keyedit.plans.job import run_update
from keyedit.sinks.writers import refuse_same_path, snapshot, write_counted
from keyedit.sources.changeset import read_changeset
from keyedit.sources.target import columns_of, key_values, list_tables, table_exists
from keyedit.sources.workbook import changes_from_workbooks, decode_workbook, read_workbooks
from keyedit.spec import UpdateSpec, normalize_columns


def test_normalize_columns():
    assert normalize_columns([" A ", "", "  ", "B", "A", None]) == ["A", "B", "A"]
    with pytest.raises(ValueError):
        UpdateSpec(table="t", key_column="k", update_columns=[" ", ""])
    with pytest.raises(ValueError):
        UpdateSpec(table="t", key_column="k", update_columns=["a", "A "])
    with pytest.raises(ValueError):
        UpdateSpec(table="", key_column="k", update_columns=["a"])


def test_csv_change_set_row_numbers_and_padding(spark, tmp_dir):
    p = os.path.join(tmp_dir, "cs.csv")
    with open(p, "w") as f:
        f.write("ID,VALUE,EXTRA\n1,a,x\n,b,y\n3\n4,d,z\n")
    raw = read_changeset(spark, p, "csv")
    assert raw.columns[0] == "row_num"
    got = rows(bind_changeset(raw, ["VALUE", "EXTRA"]))
    assert got == [(2, "1", "a", "x"), (4, "3", None, None), (5, "4", "d", "z")]


def _xlsx(path, rows_, sheet_name="Data", guide_first=True):
    """A minimal workbook (shared strings + one data sheet, optional guide sheet first)."""
    strings = []

    def sidx(s):
        if s not in strings:
            strings.append(s)
        return strings.index(s)

    def sheet_xml(data):
        out = ['<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>']
        for r, cells in enumerate(data, start=1):
            out.append(f'<row r="{r}">')
            for c, v in enumerate(cells):
                ref = f"{chr(65 + c)}{r}"
                if v is None:
                    continue
                if isinstance(v, (int, float)):
                    out.append(f'<c r="{ref}"><v>{v}</v></c>')
                else:
                    out.append(f'<c r="{ref}" t="s"><v>{sidx(v)}</v></c>')
            out.append("</row>")
        out.append("</sheetData></worksheet>")
        return "".join(out)

    sheets = ([("Guide", [["read me"]])] if guide_first else []) + [(sheet_name, rows_)]
    with zipfile.ZipFile(path, "w") as z:
        xmls = [sheet_xml(d) for _, d in sheets]
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" '
                   'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' +
                   "".join(f'<sheet name="{n}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, (n, _) in enumerate(sheets)) +
                   "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' +
                   "".join(f'<Relationship Id="rId{i + 1}" Target="worksheets/sheet{i + 1}.xml" Type="x"/>' for i in range(len(sheets))) +
                   "</Relationships>")
        for i, x in enumerate(xmls):
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", x)
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">' +
                   "".join(f"<si><t>{s}</t></si>" for s in strings) + "</sst>")


def test_workbook_ingest_by_sheet_name(spark, tmp_dir):
    d = os.path.join(tmp_dir, "books")
    os.makedirs(d)
    _xlsx(os.path.join(d, "a.xlsx"), [["ID", "VALUE"], [1001, "x"], [1002, "y"], [None, "z"], [1003]])
    _xlsx(os.path.join(d, "b.xlsx"), [["ID", "VALUE"], ["001", "p"]])
    with open(os.path.join(d, "a.xlsx"), "rb") as f:
        assert decode_workbook(f.read(), "Data")[1] == (2, ["1001", "x"])
    wb = changes_from_workbooks(read_workbooks(spark, d, 2, sheet="Data"))
    raw = wb.select("row_num", "c1", "c2")
    got = rows(bind_changeset(raw, ["VALUE"]))
    assert got == [(2, "001", "p"), (2, "1001", "x"), (3, "1002", "y"), (5, "1003", None)]


def test_catalog_metadata(spark):
    t = spark.read.parquet(f"{SF001}/customer.parquet")
    t.createOrReplaceTempView("cust_view")
    assert "cust_view" in [r["name"] for r in list_tables(spark).collect()]
    assert table_exists(spark, "cust_view")
    cols = columns_of(spark, t).orderBy("ordinal").collect()
    assert [r["column_name"] for r in cols] == ["C_CUSTKEY", "C_NAME", "C_NATIONKEY", "C_ACCTBAL", "C_MKTSEGMENT"]
    assert key_values(t, "C_CUSTKEY").columns == ["c_custkey"]


def test_refuse_overwrite_of_an_input(spark, tmp_dir):
    p = os.path.join(tmp_dir, "t")
    spark.range(5).write.parquet(p)
    df = spark.read.parquet(p)
    with pytest.raises(ValueError):
        refuse_same_path(df, p)
    assert write_counted(df, os.path.join(tmp_dir, "t2")) == 5
    assert snapshot(df, os.path.join(tmp_dir, "bak")) == 5


def _cs(spark, data):
    return spark.createDataFrame(data, "row_num long, key string, seg string, nat string")


def test_run_update_end_to_end(spark, tmp_dir):
    target_path = os.path.join(tmp_dir, "customer")
    spark.read.parquet(f"{SF001}/customer.parquet").write.parquet(target_path)
    spec = UpdateSpec(table="customer", key_column="c_custkey", update_columns=["c_mktsegment", "c_nationkey"],
                      not_null={"c_nationkey"})
    cs = _cs(spark, [(2, "1", "S1", "3"), (3, "2", "S2", "x"), (4, "999999", "S3", "1")])
    out = os.path.join(tmp_dir, "out")
    r = run_update(spark, spec, cs, target_path, out, "2024-01-31 12:00:00",
                   audit_path=os.path.join(tmp_dir, "audit"), history_path=os.path.join(tmp_dir, "hist"), run_id="one")
    assert r.ok and r.summary["success_count"] == 1 and r.summary["fail_count"] == 1
    assert r.backup_name == "customer_BAK_20240131_120000" and r.backup_path == target_path
    new = spark.read.parquet(r.target_path)
    assert new.where("c_custkey = 1").first()["c_mktsegment"] == "S1"
    assert new.count() == spark.read.parquet(target_path).count()
    from keyedit.operators.audit import read_audit, read_history
    assert read_audit(spark, os.path.join(tmp_dir, "audit")).count() == 1
    # a retried run replaces its own audit entry and history record
    run_update(spark, spec, cs, target_path, out, "2024-01-31 12:00:00",
               audit_path=os.path.join(tmp_dir, "audit"), history_path=os.path.join(tmp_dir, "hist"), run_id="one")
    assert read_audit(spark, os.path.join(tmp_dir, "audit")).count() == 1
    assert read_history(spark, os.path.join(tmp_dir, "hist")).count() == 1
    # all-or-nothing: the failed row keeps the published target unchanged
    spec2 = UpdateSpec(table="customer", key_column="c_custkey", update_columns=["c_mktsegment", "c_nationkey"],
                       not_null={"c_nationkey"}, on_failure="restore")
    r2 = run_update(spark, spec2, cs, target_path, os.path.join(tmp_dir, "out2"), "2024-01-31 12:00:00",
                    snapshot_mode="copy")
    assert not r2.ok and r2.target_path == target_path
    assert r2.backup_path.endswith("customer_BAK_20240131_120000")
    assert spark.read.parquet(r2.backup_path).count() == spark.read.parquet(target_path).count()
    # a duplicate key stops the run at the gates
    dup = _cs(spark, [(2, "1", "a", "1"), (3, "01", "b", "2")])
    r3 = run_update(spark, spec, dup, target_path, os.path.join(tmp_dir, "out3"), "2024-01-31 12:00:00")
    assert not r3.ok and "unique_keys" in r3.message


def test_folder_watch_applies_each_file_once(spark, tmp_dir):
    from pyspark.sql import types as T
    from keyedit.streaming.folder_watch import current_target, watch_folder
    target_path = os.path.join(tmp_dir, "customer")
    spark.read.parquet(f"{SF001}/customer.parquet").write.parquet(target_path)
    src = os.path.join(tmp_dir, "incoming")
    os.makedirs(src)
    with open(os.path.join(src, "c1.csv"), "w") as f:
        f.write("row_num,key,seg\n2,1,WATCHED\n3,2,WATCHED\n")
    schema = T.StructType([T.StructField("row_num", T.LongType()), T.StructField("key", T.StringType()),
                           T.StructField("seg", T.StringType())])
    spec = UpdateSpec(table="customer", key_column="c_custkey", update_columns=["c_mktsegment"])
    out = os.path.join(tmp_dir, "runs")
    q = watch_folder(spark, spec, src, schema, target_path, out, once=True,
                     checkpoint=os.path.join(tmp_dir, "ckpt"))
    q.awaitTermination(120)
    now = current_target(spark, out, target_path)
    assert now != target_path
    assert spark.read.parquet(now).where("c_mktsegment = 'WATCHED'").count() == 2


def test_row_numbers_across_many_input_partitions(spark, tmp_dir):
    p = os.path.join(tmp_dir, "big.csv")
    with open(p, "w") as f:
        f.write("ID,V\n")
        for i in range(3000):
            f.write(f"{i},v{i}\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = read_changeset(spark, p, "csv")
        assert df.rdd.getNumPartitions() > 4
        got = sorted((r["row_num"], r["ID"]) for r in df.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(i + 2, str(i)) for i in range(3000)]


def test_file_gate_and_exports(spark, tmp_dir):
    from keyedit.sinks.writers import export_csv
    from keyedit.sources.workbook import file_gate
    p = os.path.join(tmp_dir, "in")
    os.makedirs(p)
    with open(os.path.join(p, "small.csv"), "w") as f:
        f.write("ID,V\n1,a\n")
    with open(os.path.join(p, "big.csv"), "w") as f:
        f.write("x" * 2048)
    g = {os.path.basename(r["path"]): (r["passed"], r["size_mb"]) for r in file_gate(spark, p, max_bytes=1024).collect()}
    assert g == {"small.csv": (True, "0.00"), "big.csv": (False, "0.00")}
    failed = spark.createDataFrame([("1", "", "r", "2024-01-01 00:00:00")],
                                   "key_value string, update_value string, reason string, timestamp string")
    assert export_csv(failed, os.path.join(tmp_dir, "failed")) == 1
    back = spark.read.option("header", "true").csv(os.path.join(tmp_dir, "failed"))
    assert back.columns == ["key_value", "update_value", "reason", "timestamp"]
    with pytest.raises(ValueError):
        export_csv(failed.limit(0), os.path.join(tmp_dir, "none"))


def test_partitioned_table_rewrites_only_touched_partitions(spark, tmp_dir):
    from keyedit.operators.staging import coerce_changes, stage_as_text
    from keyedit.plans.partitioned import apply_to_partitions
    src = spark.read.parquet(f"{SF001}/customer.parquet")
    loc = os.path.join(tmp_dir, "cust_part")
    spark.sql("drop table if exists cust_part")
    src.write.partitionBy("c_nationkey").option("path", loc).saveAsTable("cust_part")
    before = {r["c_nationkey"]: r["count"] for r in spark.table("cust_part").groupBy("c_nationkey").count().collect()}
    keys = [r["c_custkey"] for r in src.where("c_nationkey = 3").limit(2).collect()]
    raw = spark.createDataFrame([(2 + i, str(k), "PART") for i, k in enumerate(keys)],
                                "row_num long, k string, seg string")
    bound = bind_changeset(raw, ["c_mktsegment"])
    t = spark.table("cust_part")
    co = coerce_changes(stage_as_text(bound, ["c_mktsegment"]), t.schema, "c_custkey", ["c_mktsegment"])
    untouched_files = sorted(f for f in os.listdir(os.path.join(loc, "c_nationkey=4")) if f.endswith(".parquet"))
    run = apply_to_partitions(spark, "cust_part", ["c_nationkey"], "c_custkey", ["c_mktsegment"], co,
                              os.path.join(tmp_dir, "bak"), "r1")
    assert run.touched_partitions == 1 and run.rows_rewritten == before[3]
    spark.catalog.refreshTable("cust_part")
    after = spark.table("cust_part")
    assert after.count() == src.count()
    assert after.where("c_mktsegment = 'PART'").count() == 2
    assert sorted(f for f in os.listdir(os.path.join(loc, "c_nationkey=4")) if f.endswith(".parquet")) == untouched_files
    assert spark.read.parquet(run.backup_path).where("c_mktsegment = 'PART'").count() == 0


def test_command_line_run_check_preview(spark, tmp_dir, capsys):
    import json as _json
    from keyedit.__main__ import main
    target_path = os.path.join(tmp_dir, "customer")
    spark.read.parquet(f"{SF001}/customer.parquet").write.parquet(target_path)
    cs = os.path.join(tmp_dir, "cs.csv")
    with open(cs, "w") as f:
        f.write("KEY,SEGMENT\n1,CLI\n2,CLI\n2,DUP\n999999,X\n")
    assert main(["preview", "--changes", cs, "--columns", "c_mktsegment", "--rows", "2"]) == 0
    p = _json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert p["headers"] == ["KEY", "c_mktsegment"] and p["total_rows"] == 4 and len(p["rows"]) == 2
    rc = main(["check", "--changes", cs, "--columns", "c_mktsegment", "--target", target_path,
               "--key", "c_custkey", "--out", os.path.join(tmp_dir, "chk")])
    c = _json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert rc == 2 and c["duplicate_repeats"] == 1 and c["missing_keys"] == 1
    assert [g["check_name"] for g in c["gates"] if not g["passed"]] == ["unique_keys"]
    with open(cs, "w") as f:
        f.write("KEY,SEGMENT\n1,CLI\n2,CLI\n")
    rc = main(["run", "--changes", cs, "--columns", "c_mktsegment", "--target", target_path,
               "--key", "c_custkey", "--out", os.path.join(tmp_dir, "run")])
    r = _json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert rc == 0 and r["summary"]["success_count"] == 2
    assert spark.read.parquet(r["target_path"]).where("c_mktsegment = 'CLI'").count() == 2


def test_json_and_parquet_change_sets(spark, tmp_dir):
    p = os.path.join(tmp_dir, "cs.json")
    with open(p, "w") as f:
        f.write('{"Z": "1", "A": "a"}\n{"Z": null, "A": "b"}\n{"Z": "3", "A": "c"}\n')
    raw = read_changeset(spark, p, "json", schema="Z string, A string")     # key column Z first
    assert rows(bind_changeset(raw, ["A"])) == [(2, "1", "a"), (4, "3", "c")]
    pq = os.path.join(tmp_dir, "cs.parquet")
    spark.createDataFrame([(7, 5, "x"), (9, 6, "y")], "sheet_row long, ID long, V string").write.parquet(pq)
    raw2 = read_changeset(spark, pq, "parquet", row_num_col="sheet_row")
    assert rows(bind_changeset(raw2, ["V"])) == [(7, 5, "x"), (9, 6, "y")]


def test_merge_text_and_fallback_on_parquet(spark, tmp_dir):
    from keyedit.operators.staging import coerce_changes, stage_as_text
    from keyedit.plans.partitioned import apply_with_merge, merge_sql
    assert merge_sql("db.t", "v", "id", ["a", "b"]) == (
        "MERGE INTO db.t AS t USING `v` AS s ON t.`id` = s.`id` "
        "WHEN MATCHED THEN UPDATE SET t.`a` = s.`a`, t.`b` = s.`b`")
    loc = os.path.join(tmp_dir, "cust_merge")
    spark.sql("drop table if exists cust_merge")
    spark.read.parquet(f"{SF001}/customer.parquet").write.partitionBy("c_nationkey").option("path", loc) \
        .saveAsTable("cust_merge")
    raw = spark.createDataFrame([(2, "1", "MERGED")], "row_num long, k string, seg string")
    bound = bind_changeset(raw, ["c_mktsegment"])
    t = spark.table("cust_merge")
    co = coerce_changes(stage_as_text(bound, ["c_mktsegment"]), t.schema, "c_custkey", ["c_mktsegment"])
    how = apply_with_merge(spark, "cust_merge", "C_CUSTKEY", ["C_MKTSEGMENT"], co, partition_cols=["c_nationkey"],
                           backup_path=os.path.join(tmp_dir, "bak"), run_id="m1")
    assert how == "partitions"
    spark.catalog.refreshTable("cust_merge")
    assert spark.table("cust_merge").where("c_custkey = 1").first()["c_mktsegment"] == "MERGED"


def test_folder_watch_restart_applies_only_new_files(spark, tmp_dir):
    from pyspark.sql import types as T
    from keyedit.streaming.folder_watch import current_target, watch_folder
    target_path = os.path.join(tmp_dir, "customer")
    spark.read.parquet(f"{SF001}/customer.parquet").write.parquet(target_path)
    src, out, ckpt = (os.path.join(tmp_dir, n) for n in ("incoming", "runs", "ckpt"))
    os.makedirs(src)
    schema = T.StructType([T.StructField("row_num", T.LongType()), T.StructField("key", T.StringType()),
                           T.StructField("seg", T.StringType())])
    spec = UpdateSpec(table="customer", key_column="c_custkey", update_columns=["c_mktsegment"])
    with open(os.path.join(src, "a.csv"), "w") as f:
        f.write("row_num,key,seg\n2,1,FIRST\n")
    watch_folder(spark, spec, src, schema, target_path, out, once=True, checkpoint=ckpt).awaitTermination(120)
    v1 = current_target(spark, out, target_path)
    with open(os.path.join(src, "b.csv"), "w") as f:
        f.write("row_num,key,seg\n2,2,SECOND\n")
    watch_folder(spark, spec, src, schema, target_path, out, once=True, checkpoint=ckpt).awaitTermination(120)
    v2 = current_target(spark, out, target_path)
    assert v2 != v1
    now = spark.read.parquet(v2)
    assert now.where("c_custkey = 1").first()["c_mktsegment"] == "FIRST"
    assert now.where("c_custkey = 2").first()["c_mktsegment"] == "SECOND"
    assert len([d for d in os.listdir(out) if d.startswith("batch_")]) == 2


def test_command_line_reads_a_workbook(spark, tmp_dir, capsys):
    import json as _json
    from keyedit.__main__ import main
    target_path = os.path.join(tmp_dir, "customer")
    spark.read.parquet(f"{SF001}/customer.parquet").write.parquet(target_path)
    book = os.path.join(tmp_dir, "changes.xlsx")
    _xlsx(book, [["ID", "SEGMENT"], [1, "BOOK"], [2, "BOOK"], [None, "skip"]])
    rc = main(["run", "--changes", book, "--format", "xlsx", "--sheet", "Data", "--columns", "c_mktsegment",
               "--target", target_path, "--key", "c_custkey", "--out", os.path.join(tmp_dir, "run")])
    r = _json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert rc == 0 and r["summary"]["success_count"] == 2
    assert spark.read.parquet(r["target_path"]).where("c_mktsegment = 'BOOK'").count() == 2


def test_run_update_above_the_broadcast_bound_gives_the_same_result(spark, tmp_dir):
    target_path = os.path.join(tmp_dir, "customer")
    spark.read.parquet(f"{SF001}/customer.parquet").write.parquet(target_path)
    spec = UpdateSpec(table="customer", key_column="c_custkey", update_columns=["c_mktsegment", "c_nationkey"],
                      not_null={"c_nationkey"})
    cs = _cs(spark, [(2, "1", "S1", "3"), (3, "2", "S2", "x"), (4, "999999", "S3", "1"), (5, "3", "", "4")])
    small = run_update(spark, spec, cs, target_path, os.path.join(tmp_dir, "a"), "2024-01-31 12:00:00")
    spark.conf.set("keyedit.broadcast.maxRows", "0")
    try:
        big = run_update(spark, spec, cs, target_path, os.path.join(tmp_dir, "b"), "2024-01-31 12:00:00")
    finally:
        spark.conf.unset("keyedit.broadcast.maxRows")
    assert small.summary == big.summary
    a, b = spark.read.parquet(small.target_path), spark.read.parquet(big.target_path)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def _styled_xlsx(path, date1904=False):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        pr = '<workbookPr date1904="1"/>' if date1904 else ""
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">'
                   f'{pr}<sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   '<Relationship Id="rId1" Target="worksheets/sheet1.xml" Type="x"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><numFmts count="1"><numFmt numFmtId="164" formatCode="yyyy-mm-dd hh:mm"/>'
                   '</numFmts><cellXfs count="4"><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="2"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData>'
                   '<row r="2"><c r="A2" s="1"><v>45292</v></c><c r="B2" s="2"><v>45292.5</v></c>'
                   '<c r="C2" s="3"><v>45292</v></c><c r="D2"><v>12.0</v></c></row></sheetData></worksheet>')


def test_workbook_date_cells_become_date_text(tmp_dir):
    p = os.path.join(tmp_dir, "dates.xlsx")
    _styled_xlsx(p)
    with open(p, "rb") as f:
        assert decode_workbook(f.read()) == [(2, ["2024-01-01 00:00:00", "2024-01-01 12:00:00", "45292", "12"])]
    _styled_xlsx(p, date1904=True)
    with open(p, "rb") as f:
        assert decode_workbook(f.read())[0][1][0] == "2028-01-02 00:00:00"
