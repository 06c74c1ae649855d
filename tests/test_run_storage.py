"""Scratch of runs, several change sets in one run, targets in buckets."""

import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from conftest import rows
from keyedit import scratch
from keyedit.operators import apply as ap
from keyedit.operators import checks as ck
from keyedit.operators.ordered_sets import apply_in_order, numbered_sets, outcomes_in_order, refused_sets
from keyedit.operators.staging import coerce_changes
from keyedit.plans.bucketed import BucketedTarget
from keyedit.plans.job import run_update
from keyedit.session import ensure_checkpoint_dir, scratch_path
from keyedit.spec import UpdateSpec

SCHEMA = "id long, grp string, v double"


def typed(spark, target, values, columns, key="id"):
    raw = spark.createDataFrame([(i + 2, *map(lambda x: None if x is None else str(x), r)) for i, r in enumerate(values)],
                                "row_num long, key_value string, " + ", ".join(f"{c} string" for c in columns))
    return coerce_changes(raw, target.schema, key, columns)


# --- scratch ---------------------------------------------------------------------------

def folders(spark):
    base = f"{ensure_checkpoint_dir(spark)}/runs"
    return sorted(os.listdir(base)) if os.path.isdir(base) else []


def test_scratch_goes_with_the_run(spark):
    with scratch.RunScratch(spark, "t-1 a/b") as run:
        path = scratch_path(spark, "staged")
        assert "/runs/t-1_a_b/" in path
        spark.range(3).write.parquet(path)
        checkpoint = spark.range(5).checkpoint()
        assert checkpoint.count() == 5 and os.path.isdir(f"{run.folder.toUri().getPath()}/checkpoints")
        left = {r["run_id"]: r for r in scratch.left_runs(spark).collect()}
        assert left["t-1_a_b"]["application"] == spark.sparkContext.applicationId and left["t-1_a_b"]["bytes"] > 0
    assert "t-1_a_b" not in folders(spark) and "/runs/" not in scratch_path(spark, "staged")
    assert spark.range(4).checkpoint().count() == 4


def test_scratch_goes_after_an_error_and_a_killed_run_is_listed(spark):
    with pytest.raises(OSError):
        with scratch.RunScratch(spark, "bad"):
            spark.range(3).write.parquet(scratch_path(spark, "staged"))
            raise OSError("lost")
    assert "bad" not in folders(spark)
    killed = scratch.RunScratch(spark, "killed")
    killed.__enter__()
    spark.range(3).write.parquet(scratch_path(spark, "staged"))
    scratch.use_scratch_root(None)          # as if the driver had gone
    scratch._CHECKPOINTS.release()
    spark.sparkContext.setCheckpointDir(ensure_checkpoint_dir(spark))
    assert "killed" in {r["run_id"] for r in scratch.left_runs(spark).collect()}
    assert scratch.remove_run(spark, "killed") and not scratch.remove_run(spark, "killed") and "killed" not in folders(spark)
    for name in ("..", "a/b", ""):
        with pytest.raises(ValueError):
            scratch.remove_run(spark, name)


def test_overlapping_runs_keep_to_their_own_scratch(spark):
    seen = {}

    def other():
        with scratch.RunScratch(spark, "second"):
            seen["path"] = scratch_path(spark, "x")
    with scratch.RunScratch(spark, "first"):
        t = threading.Thread(target=other)
        t.start()
        t.join()
        assert spark.range(2).checkpoint().count() == 2 and "/runs/first/" in scratch_path(spark, "x")
    assert "/runs/second/" in seen["path"] and not {"first", "second"} & set(folders(spark))


@pytest.mark.parametrize("broadcast", [True, False])
def test_a_run_leaves_no_scratch(spark, tmp_dir, broadcast):
    spark.createDataFrame([(i, f"g{i % 3}", float(i)) for i in range(30)], SCHEMA).write.parquet(f"{tmp_dir}/t")
    raw = spark.createDataFrame([(2, "3", "x"), (3, "4", "y")], "row_num long, k string, a string")
    spec = UpdateSpec(table="t", key_column="id", update_columns=("grp",))
    before = sorted(os.listdir(ensure_checkpoint_dir(spark)))
    if not broadcast:
        spark.conf.set("keyedit.broadcast.maxRows", "0")
    try:
        res = run_update(spark, spec, raw, f"{tmp_dir}/t", f"{tmp_dir}/out", "2024-01-31 12:00:00")
        assert res.ok and spark.read.parquet(res.target_path).where("grp = 'x'").count() == 1
        with pytest.raises(Exception):
            run_update(spark, spec, raw.withColumn("a", F.raise_error(F.lit("lost")).cast("string")), f"{tmp_dir}/t",
                       f"{tmp_dir}/out2", "2024-01-31 12:00:00")
    finally:
        spark.conf.unset("keyedit.broadcast.maxRows")
    assert folders(spark) == [] and set(os.listdir(ensure_checkpoint_dir(spark))) - {"runs"} >= set(before) - {"runs"}


# --- sets in order -----------------------------------------------------------------------

def one_by_one(target, sets):
    for coerced, columns in sets:
        try:
            target = ap.apply_updates(target, coerced, "id", columns)
        except ValueError:      # repeated keys: its run publishes nothing
            continue
    return target


@pytest.mark.parametrize("seed", range(2))
def test_sets_in_order_equal_runs_one_by_one(spark, seed):
    rng = random.Random(seed)
    target = spark.createDataFrame([(rng.randrange(20), f"g{i}", float(i)) for i in range(40)], SCHEMA)
    sets = []
    for _ in range(4):
        columns = rng.choice([["grp"], ["v"], ["v", "grp"], ["GRP", "v"]])
        keys = rng.sample(range(25), 12)
        values = [(k, *[rng.choice([None, "x", "1.5", f"{k}"]) for _ in columns]) for k in keys]
        sets.append((typed(spark, target, values, columns), columns))
    repeated = [(3, "never"), ("03", "never"), (4, "never")]
    sets.insert(2, (typed(spark, target, repeated, ["grp"]), ["grp"]))
    out = apply_in_order(target, sets, "id")
    assert out.columns == target.columns and out.where("grp = 'never'").count() == 0
    assert sorted(map(str, out.collect())) == sorted(map(str, one_by_one(target, sets).collect()))
    assert rows(refused_sets(numbered_sets(sets, target.schema))) == [(2, 1)]
    got = sorted(map(str, (tuple(r) for r in outcomes_in_order(target, sets, "id").collect())))
    want = sorted(str((k, *r)) for k, (c, _) in enumerate(sets) if k != 2 for r in map(tuple, ap.row_outcomes(c, target, "id").collect()))
    assert got == want


def test_no_set_and_empty_sets(spark):
    target = spark.createDataFrame([(1, "a", 1.0), (None, "b", 2.0)], SCHEMA)
    with pytest.raises(ValueError):
        apply_in_order(target, [], "id")
    empty = typed(spark, target, [(1, "x")], ["grp"]).limit(0)
    assert sorted(map(str, apply_in_order(target, [(empty, ["grp"])], "id").collect())) == sorted(map(str, target.collect()))


# --- buckets -----------------------------------------------------------------------------

def bucketed(spark, tmp_dir, data, buckets=4, hot_rows=50):
    spark.conf.set("keyedit.skew.hotRows", str(hot_rows))
    try:
        name = f"b_{os.path.basename(tmp_dir).replace('-', '_')}"
        return BucketedTarget.write(spark.createDataFrame(data, SCHEMA), name, "ID", tmp_dir, buckets)
    finally:
        spark.conf.unset("keyedit.skew.hotRows")


def test_a_bucketed_target_gives_the_same(spark, tmp_dir):
    """A hot key and NULL keys are kept apart; every check and the update agree with the plain target."""
    data = [(i % 90, f"g{i}", float(i)) for i in range(300)] + [(7, "hot", float(i)) for i in range(200)] + [(None, "n", 1.0)] * 3
    plain = spark.createDataFrame(data, SCHEMA)
    target = bucketed(spark, tmp_dir, data)
    assert sorted(map(str, target.frame().collect())) == sorted(map(str, plain.collect()))
    assert spark.table(f"{target.name}_apart").groupBy("id").count().count() == 2
    c = typed(spark, plain, [(7, "x", "1"), (8, "y", "bad"), (9, None, None), (500, "z", "2"), (None, "n", "3"), ("abc", "n", "3")], ["grp", "v"])
    assert sorted(map(str, target.apply_updates(c, ["grp", "v"]).collect())) == sorted(
        map(str, ap.apply_updates(plain, c, "id", ["grp", "v"]).collect()))
    assert rows(target.row_outcomes(c).drop("reason").na.fill("")) == rows(ap.row_outcomes(c, plain, "id").drop("reason").na.fill(""))
    key = lambda df: sorted(map(str, df.collect()))
    assert key(target.missing_keys(c)) == key(ck.missing_keys(c, plain, "id"))
    assert key(target.present_keys(c)) == key(ck.present_keys(c, plain, "id"))


def test_the_bucketed_target_is_not_shuffled(spark, tmp_dir):
    """Of the joins' exchanges none is above the scan of the buckets."""
    target = bucketed(spark, tmp_dir, [(i, f"g{i}", float(i)) for i in range(100)])
    c = typed(spark, target.frame(), [(7, "x"), (8, "y")], ["grp"])
    spark.conf.set("keyedit.broadcast.maxRows", "0")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for df, columns in [(target.apply_updates(c, ["grp"]), 3), (target.matched_key_counts(c), 1)]:
            plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
            scan = next(i for i, line in enumerate(plan) if "FileScan" in line and f".{target.name}[" in line)
            assert "Bucketed: true" in plan[scan]
            join = max(i for i in range(scan) if "SortMergeJoin" in plan[i])
            assert not [line for line in plan[join:scan] if "Exchange" in line]
    finally:
        spark.conf.unset("keyedit.broadcast.maxRows")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
