"""Cases in which rows, files, entries or inputs must not be lost."""

import os

import pytest
from pyspark.sql import types as T

from conftest import rows
from keyedit.operators import audit as au
from keyedit.operators import checks as ck
from keyedit.operators.staging import bind_changeset, coerce_changes, stage_as_text
from keyedit.plans.partitioned import apply_to_partitions, apply_with_merge
from keyedit.sinks.writers import refuse_same_path, write_counted
from keyedit.sources.changeset import read_changeset
from keyedit.spec import UpdateSpec


def _changes(spark, target, key, columns, data):
    raw = spark.createDataFrame(data, "row_num long, key_value string, " + ", ".join(f"{c} string" for c in columns))
    return coerce_changes(stage_as_text(bind_changeset(raw, columns), columns), target.schema, key, columns)


def _table(spark, name, data, folder):
    spark.sql(f"drop table if exists {name}")
    (spark.createDataFrame(data, "id long, v string, p long").write.partitionBy("p").format("parquet")
     .option("path", os.path.join(folder, name)).saveAsTable(name))
    return spark.table(name)


def test_updated_partition_column_keeps_all_rows(spark, tmp_dir):
    """Id 1 moves into a partition that others live in; its old partition keeps id 2."""
    t = _table(spark, "moving", [(1, "a", 1), (2, "b", 1), (3, "c", 2), (4, "d", 2)], tmp_dir)
    co = _changes(spark, t, "id", ["p"], [(2, "1", "2")])
    run = apply_to_partitions(spark, "moving", ["p"], "id", ["p"], co, os.path.join(tmp_dir, "bak"), "r1")
    spark.catalog.refreshTable("moving")
    assert rows(spark.table("moving").select("id", "v", "p")) == [(1, "a", 2), (2, "b", 1), (3, "c", 2), (4, "d", 2)]
    assert run.touched_partitions == 2
    assert rows(spark.read.parquet(run.backup_path).select("id", "p")) == [(1, 1), (2, 1), (3, 2), (4, 2)]


def test_emptied_partition_is_dropped(spark, tmp_dir):
    t = _table(spark, "emptied", [(1, "a", 1), (3, "c", 2), (5, "e", 3)], tmp_dir)
    co = _changes(spark, t, "id", ["p"], [(2, "1", "2")])
    apply_to_partitions(spark, "emptied", ["p"], "id", ["p"], co, os.path.join(tmp_dir, "bak"), "r2")
    spark.catalog.refreshTable("emptied")
    assert rows(spark.table("emptied").select("id", "v", "p")) == [(1, "a", 2), (3, "c", 2), (5, "e", 3)]


def test_null_partition_is_rewritten(spark, tmp_dir):
    t = _table(spark, "nullpart", [(1, "a", None), (2, "b", None), (3, "c", 2)], tmp_dir)
    co = _changes(spark, t, "id", ["v"], [(2, "1", "new"), (3, "3", "new")])
    run = apply_to_partitions(spark, "nullpart", ["p"], "id", ["v"], co, os.path.join(tmp_dir, "bak"), "r3")
    spark.catalog.refreshTable("nullpart")
    got = sorted((tuple(r) for r in spark.table("nullpart").select("id", "v", "p").collect()), key=str)
    assert got == [(1, "new", None), (2, "b", None), (3, "new", 2)]
    assert (run.touched_partitions, run.rows_rewritten) == (2, 3)


def test_merge_errors_that_quote_the_statement_are_raised(spark, tmp_dir):
    t = _table(spark, "merged", [(1, "a", 1)], tmp_dir)
    co = _changes(spark, t, "id", ["v"], [(2, "1", "new")])
    assert apply_with_merge(spark, "merged", "id", ["v"], co, partition_cols=["p"], backup_path=os.path.join(tmp_dir, "b"),
                            run_id="m2") == "partitions"
    with pytest.raises(KeyError):
        apply_with_merge(spark, "merged", "nothing", ["v"], co)


def test_oversize_workbook_is_named(spark, tmp_dir):
    from test_sources_job import _xlsx
    from keyedit.sources.workbook import read_workbooks
    d = os.path.join(tmp_dir, "books")
    os.makedirs(d)
    _xlsx(os.path.join(d, "small.xlsx"), [["ID"], [1]])
    _xlsx(os.path.join(d, "large.xlsx"), [["ID"], *[[k] for k in range(3000)]])
    assert read_workbooks(spark, d, 1, sheet="Data").count() == 3003
    limit = os.path.getsize(os.path.join(d, "large.xlsx")) - 1
    with pytest.raises(ValueError, match="large.xlsx"):
        read_workbooks(spark, d, 1, sheet="Data", max_bytes=limit)


def test_refused_file_stops_the_watch_and_stays(spark, tmp_dir):
    from keyedit.streaming.folder_watch import current_target, watch_folder
    target = os.path.join(tmp_dir, "t")
    spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string").write.parquet(target)
    src, out, ckpt = (os.path.join(tmp_dir, n) for n in ("in", "out", "ckpt"))
    os.makedirs(src)
    schema = T.StructType([T.StructField("row_num", T.LongType()), T.StructField("key", T.StringType()), T.StructField("v", T.StringType())])
    spec = UpdateSpec(table="t", key_column="id", update_columns=["v"])
    for name, body in (("a.csv", "2,1,first\n"), ("b.csv", "2,1,second\n")):      # one run each: no key repeats
        with open(os.path.join(src, name), "w") as f:
            f.write("row_num,key,v\n" + body)
        os.utime(os.path.join(src, name), (1, 1 if name == "a.csv" else 2))
    watch_folder(spark, spec, src, schema, target, out, once=True, checkpoint=ckpt).awaitTermination(120)
    assert rows(spark.read.parquet(current_target(spark, out, target))) == [(1, "second"), (2, "b")]
    with open(os.path.join(src, "c.csv"), "w") as f:
        f.write("row_num,key,v\n2,2,x\n3,2,y\n")
    for _ in range(2):                                                             # a restart meets the file again
        with pytest.raises(Exception, match="unique_keys"):
            watch_folder(spark, spec, src, schema, target, out, once=True, checkpoint=ckpt).awaitTermination(120)


def test_overwrite_guard_decodes_paths(spark, tmp_dir):
    p = os.path.join(tmp_dir, "a b%c", "t")
    spark.range(5).write.parquet(p)
    df = spark.read.parquet(p).where("id > 1")
    for out in (p, os.path.dirname(p), os.path.join(p, "inside"), "file://" + p.replace("%", "%25").replace(" ", "%20")):
        with pytest.raises(ValueError):
            write_counted(df, out, mode="overwrite")
    refuse_same_path(df, p + "2")
    assert spark.read.parquet(p).count() == 5


def test_two_runs_in_one_second_keep_both_records(spark, tmp_dir):
    from keyedit.plans.job import run_update
    audit, hist = os.path.join(tmp_dir, "audit"), os.path.join(tmp_dir, "hist")
    for name in ("x", "y"):
        target = os.path.join(tmp_dir, name)
        spark.createDataFrame([(1, "a")], "id long, v string").write.parquet(target)
        raw = spark.createDataFrame([(2, "1", "b")], "row_num long, id string, v string")
        run_update(spark, UpdateSpec(table=name, key_column="id", update_columns=["v"]), raw, target,
                   os.path.join(tmp_dir, "out" + name), "2024-01-31 12:00:00", audit_path=audit, history_path=hist)
    assert au.read_audit(spark, audit).count() == 2 and au.read_history(spark, hist).count() == 2


def test_unpublished_run_writes_a_rollback_entry(spark, tmp_dir):
    from keyedit.plans.job import run_update
    target, audit = os.path.join(tmp_dir, "t"), os.path.join(tmp_dir, "audit")
    spark.createDataFrame([(1, 5)], "id long, n int").write.parquet(target)
    raw = spark.createDataFrame([(2, "1", "bad")], "row_num long, id string, n string")
    spec = UpdateSpec(table="t", key_column="id", update_columns=["n"], on_failure="restore")
    r = run_update(spark, spec, raw, target, os.path.join(tmp_dir, "o"), "2024-01-31 12:00:00", audit_path=audit)
    assert not r.ok and r.target_path == target
    assert sorted(x["action_type"] for x in au.read_audit(spark, audit).collect()) == ["ROLLBACK", "UPDATE"]
    gone = run_update(spark, spec, raw, os.path.join(tmp_dir, "none"), os.path.join(tmp_dir, "o2"), "2024-01-31 12:00:00")
    assert not gone.ok and "does not exist" in gone.message


def test_entries_without_an_action_type_are_kept(spark, tmp_dir):
    path = os.path.join(tmp_dir, "log")
    os.makedirs(path)
    with open(os.path.join(path, "a.json"), "w") as f:
        f.write('{"timestamp": "2024-01-02 00:00:00", "user": "u"}\n{"timestamp": "2024-02-02 00:00:00", "action_type": "UPDATE"}\n{"cut": tr\n')
    lines = spark.read.text(path)
    assert au.parse_audit_lines(lines).count() == 2 and au.audit_corrupt(lines).count() == 1
    got = au.purge_audit(spark, path, "2024-01-15 00:00:00", os.path.join(tmp_dir, "kept"))
    assert got == {"deleted_count": 1, "kept_count": 1, "corrupt_count": 1}


def test_shortened_history_is_written(spark, tmp_dir):
    h = spark.createDataFrame([("a",), ("b",)], "id string")
    left = au.delete_ids(h, spark.createDataFrame([("a",)], "id string"))
    assert au.write_history(h, left, os.path.join(tmp_dir, "h")) == {"deleted_count": 1, "remaining_count": 1}
    assert au.write_history(h, au.clear_history(h), os.path.join(tmp_dir, "h2")) == {"deleted_count": 2, "remaining_count": 0}


def test_spellings_of_a_key_are_duplicates(spark):
    t = spark.createDataFrame([(7, "a")], "id long, v string")
    co = _changes(spark, t, "id", ["v"], [(2, "7", "x"), (3, "007", "y"), (4, "abc", "z")])
    assert rows(ck.duplicate_pairs(ck.canonical_keys(co))) == [("7", 2, 3)]
    assert rows(ck.duplicate_key_rows(ck.canonical_keys(co)).select("key_value", "chunk", "n_rows", "rows")) == [("7", 0, 2, "2, 3")]
    many = ck.duplicate_key_rows(ck.canonical_keys(co), rows_per_chunk=1)
    assert rows(many.select("chunk", "rows")) == [(2, "2"), (3, "3")]


def test_rows_are_numbered_in_their_own_file(spark, tmp_dir):
    d = os.path.join(tmp_dir, "in")
    os.makedirs(d)
    with open(os.path.join(d, "a.csv"), "w") as f:
        f.write("k,v\n" + "".join(f"a{i},{'x' * 50}\n" for i in range(2000)))
    with open(os.path.join(d, "b.csv"), "w") as f:
        f.write("k,v\nb0,1\n\n\nb1,2\n,\n" + "".join(f"c{i},{'y' * 80}\n" for i in range(3000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        got = {r["k"]: (r["row_num"], os.path.basename(r["path"])) for r in read_changeset(spark, d, with_path=True).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got["a0"] == (2, "a.csv") and got["a1999"] == (2001, "a.csv")
    assert got["b0"] == (2, "b.csv") and got["b1"] == (5, "b.csv")
    assert got["c0"] == (7, "b.csv") and got["c2999"] == (3006, "b.csv") and len(got) == 2000 + 2 + 3000 + 1


def test_check_and_run_share_their_limits(spark):
    """No limit unless one is given."""
    t = spark.createDataFrame([(1, "a")], "id long, v string")
    raw = spark.range(100_001).selectExpr("id + 2 as row_num", "cast(id as string) as key_value", "repeat('x', 5000) as v")
    bound = bind_changeset(raw, ["v"], keep_null_keys=True)
    co = coerce_changes(stage_as_text(bound, ["v"]), t.schema, "id", ["v"])
    assert all(r["passed"] for r in ck.gate_report(bound, co, ["v"], 2).collect())
