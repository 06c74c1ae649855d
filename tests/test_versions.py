"""Versions of a target: only touched files are rewritten, and every version can be had back."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import rows
from keyedit.operators.staging import coerce_changes
from keyedit.plans.job import run_update
from keyedit.plans.versions import VersionStore, file_name
from keyedit.spec import UpdateSpec

SCHEMA = "id long, grp string, v double, note string"


def laid_out(spark, folder, n=40, files=8, extra=()):
    df = spark.createDataFrame([(i, f"g{i % 3}", i + 0.5, None if i % 5 == 0 else f"n{i}") for i in range(n)] + list(extra), SCHEMA)
    df.repartitionByRange(files, "id").sortWithinPartitions("id").write.parquet(f"{folder}/start")
    store = VersionStore(spark, f"{folder}/store")
    store.create(spark.read.parquet(f"{folder}/start"))
    return store


def changes(spark, store, values, columns, key="id"):
    raw = spark.createDataFrame([(i + 2, *r) for i, r in enumerate(values)],
                                "row_num long, key_value string, " + ", ".join(f"{c} string" for c in columns))
    return coerce_changes(raw, store.frame().schema, key, columns)


def apply(spark, store, values, columns, **kw):
    return store.apply("id", columns, changes(spark, store, values, columns), **kw)


def contents(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def brute(state, values, columns):
    new = {k: dict(zip(columns, v)) for k, *v in values}
    return [dict(r, **new[str(r["id"])]) if str(r["id"]) in new else r for r in state]


def as_rows(state):
    return sorted(((r["id"], r["grp"], None if r["v"] is None else float(r["v"]), r["note"]) for r in state), key=str)


def test_only_touched_files_are_rewritten(spark, tmp_dir):
    store = laid_out(spark, tmp_dir)
    before = {r["file"]: os.stat(r["file"][5:]).st_mtime_ns for r in store.files().collect()}
    assert len(before) == 8
    run = apply(spark, store, [("3", "x"), ("4", "y"), ("999", "z")], ["grp"])
    assert (run.version, run.files_rewritten, run.files_kept, run.rows_rewritten) == (1, 1, 7, 5)
    now = {r["file"] for r in store.files().collect()}
    assert len(now & set(before)) == 7
    assert {f: os.stat(f[5:]).st_mtime_ns for f in before} == before       # data files are never changed
    holder = store.frame(0).where("id in (3, 4)").select(file_name().alias("f")).distinct().collect()
    assert [r["f"] for r in holder] == list(set(before) - now)
    got = {r["id"]: r["grp"] for r in store.frame().collect()}
    assert got[3] == "x" and got[4] == "y" and got[5] == "g2" and len(got) == 40


def test_a_run_without_a_match_publishes_nothing(spark, tmp_dir):
    store = laid_out(spark, tmp_dir)
    run = apply(spark, store, [("999", "x"), ("abc", "y")], ["grp"])
    assert (run.version, run.files_rewritten, run.files_kept) == (0, 0, 8) and store.versions() == [0]


def test_three_runs_and_back_to_each(spark, tmp_dir):
    store = laid_out(spark, tmp_dir)
    state = [r.asDict() for r in store.frame().collect()]
    states = [state]
    for values, columns in [([("1", "a", "9.25"), ("2", None, None), ("30", "b", "1e3")], ["grp", "v"]),
                            ([("1", "first", None)], ["note", "grp"]),
                            ([("2", "-1"), ("5", None), ("30", "7")], ["v"])]:
        apply(spark, store, values, columns)
        states.append(brute(states[-1], values, columns))
    assert store.versions() == [0, 1, 2, 3]
    for v in range(4):
        assert contents(store.frame(v)) == as_rows(states[v])
        assert contents(store.undone(v, "id", ["grp", "v", "note"])) == as_rows(states[v])
    # one column of one key; an old NULL is a value, not "no entry"
    keys = spark.createDataFrame([(1,), (2,), (None,)], "id long")
    got = {r["id"]: (r["grp"], r["v"], r["note"]) for r in store.undone(1, "id", ["v"], keys=keys).collect()}
    now = {r["id"]: (r["grp"], r["v"], r["note"]) for r in store.frame().collect()}
    assert got[2] == (now[2][0], None, now[2][2]) and got[30] == now[30] and got[1] == now[1]


def test_undo_goes_on_from_a_restored_version(spark, tmp_dir):
    store = laid_out(spark, tmp_dir)
    start = contents(store.frame())
    apply(spark, store, [("1", "a")], ["grp"])
    one = contents(store.frame())
    apply(spark, store, [("1", "b"), ("7", "b")], ["grp"])
    assert store.restore(1) == 3 and contents(store.frame()) == one
    apply(spark, store, [("7", "c")], ["grp"])
    assert store.runs_since(0) == [4, 1]
    assert contents(store.undone(0, "id", ["grp"])) == start
    assert contents(store.undone(1, "id", ["grp"])) == one
    with pytest.raises(ValueError, match="left behind"):
        store.undone(2, "id", ["grp"])
    with pytest.raises(ValueError, match="no version"):
        store.restore(9)


def test_several_rows_of_a_key_and_beyond_the_broadcast_bound(spark, tmp_dir):
    """Rows of a hot key lie in several files; with no broadcast the same files and rows come out."""
    extra = [(7, "hot", float(k), str(k)) for k in range(300)]
    store = laid_out(spark, tmp_dir, extra=extra)
    start = contents(store.frame())
    values = [("7", "x"), ("39", "y")]
    c = changes(spark, store, values, ["grp"])
    a = sorted(r["file"] for r in store.touched_files("id", c, fits=True).collect())
    assert a == sorted(r["file"] for r in store.touched_files("id", c, fits=False).collect()) and len(a) >= 2
    run = apply(spark, store, values, ["grp"], row_key=["id", "note"], fits=False)
    assert run.files_rewritten == len(a)
    got = store.frame()
    assert got.where("id = 7 and grp = 'x'").count() == 301 and got.count() == 340
    assert contents(store.undone(0, "id", ["grp"], row_key=["id", "note"])) == start


def test_untouched_files_are_not_read_when_rewriting(spark, tmp_dir):
    """The rewrite scans the touched files alone; the others are only asked for their key."""
    store = laid_out(spark, tmp_dir)
    c = changes(spark, store, [("3", "x")], ["grp"])
    plan = store.touched_files("id", c, fits=True)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint>" in plan
    apply(spark, store, [("3", "x")], ["grp"])
    new = [r["file"] for r in store.files().where(F.col("file").contains("/data/v=1-")).collect()]
    assert spark.read.parquet(*[f for f in new]).count() == 5


def test_a_failed_publish_leaves_the_version_and_names_its_files(spark, tmp_dir):
    store = laid_out(spark, tmp_dir)
    real = store._publish
    store._publish = lambda *a: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        apply(spark, store, [("3", "x")], ["grp"])
    store._publish = real
    assert store.versions() == [0] and store.unlisted().count() >= 1
    run = apply(spark, store, [("3", "x")], ["grp"])       # the retry takes the same version
    assert run.version == 1 and store.unlisted().count() == 1     # those of the lost try


def test_two_runs_from_one_version(spark, tmp_dir):
    """The second one to finish fails, and harms nothing of the first."""
    store = laid_out(spark, tmp_dir)
    other = VersionStore(spark, store.root)
    other.latest = lambda: 0
    apply(spark, store, [("3", "x")], ["grp"])
    one = contents(store.frame())
    with pytest.raises(RuntimeError, match="another run"):
        apply(spark, other, [("3", "z"), ("4", "z")], ["grp"])
    assert store.versions() == [0, 1] and contents(store.frame()) == one and store.unlisted().count() >= 1


def test_refusals(spark, tmp_dir):
    store = laid_out(spark, tmp_dir)
    with pytest.raises(ValueError, match="already holds"):
        store.create(spark.read.parquet(f"{tmp_dir}/start"))
    with pytest.raises(ValueError, match="duplicate keys"):
        apply(spark, store, [("3", "x"), ("03", "y")], ["grp"])
    with pytest.raises(ValueError, match="identify a row"):
        apply(spark, store, [("3", "x")], ["grp"], row_key=["id", "grp"])
    spark.read.parquet(f"{tmp_dir}/start").write.partitionBy("grp").parquet(f"{tmp_dir}/parts")
    with pytest.raises(ValueError, match="partitioned"):
        VersionStore(spark, f"{tmp_dir}/other").create(spark.read.parquet(f"{tmp_dir}/parts"))


def test_run_update_on_a_store(spark, tmp_dir):
    store = laid_out(spark, tmp_dir)
    spec = UpdateSpec(table="t", key_column="id", update_columns=("grp", "v"))
    raw = spark.createDataFrame([(2, "3", "x", "1.5"), (3, "4", "y", "bad"), (4, "77", "z", "2")],
                                "row_num long, k string, a string, b string")
    res = run_update(spark, spec, raw, store.root, f"{tmp_dir}/out", "2024-01-31 12:00:00")
    assert res.ok and (res.version, res.files_rewritten, res.target_path) == (1, 1, store.root)
    assert res.summary["success_count"] == 1 and res.summary["fail_count"] == 1
    assert rows(store.frame().where("id in (3, 4)"), "id", "grp", "v") == [(3, "x", 1.5), (4, "g1", 4.5)]
    strict = UpdateSpec(table="t", key_column="id", update_columns=("grp", "v"), on_failure="restore")
    res = run_update(spark, strict, raw, store.root, f"{tmp_dir}/out2", "2024-01-31 12:00:01")
    assert not res.ok and res.version == 1 and store.versions() == [0, 1]
    assert not os.path.exists(f"{tmp_dir}/out2/target_20240131_120001")
