"""Rules of a target, judged for all changes as one statement, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from keyedit.operators import apply as ap
from keyedit.operators.constraints import (CHILD_FOUND, NO_PARENT, NOT_UNIQUE, TOO_LONG, Constraints, Reference,
                                           constraint_failures, declared_bytes, without_failed)
from keyedit.operators.staging import coerce_changes
from keyedit.plans.job import run_update
from keyedit.spec import UpdateSpec

SCHEMA = "id long, name string, grp long, note string"
COLUMNS = ["name", "grp", "note"]


def typed(spark, target, values, columns=COLUMNS):
    raw = spark.createDataFrame([(i + 2, *map(lambda x: None if x is None else str(x), r)) for i, r in enumerate(values)],
                                "row_num long, key_value string, " + ", ".join(f"{c} string" for c in columns))
    return coerce_changes(raw, target.schema, "id", columns)


def failures(spark, target, values, rules, columns=COLUMNS, **kw):
    out = constraint_failures(typed(spark, target, values, columns), target, "id", columns, rules, **kw).collect()
    assert len({r["key_cast"] for r in out}) == len(out)
    return {r["key_cast"]: r["status"] for r in out}


def brute_unique(rows, values, sets):
    """Verdicts by trying again until nothing new fails. ``rows``: id -> dict; ``values``: (id, dict) in row order."""
    failed = set()
    values = [(k, v) for k, v in values if k in rows]
    while True:
        new = set()
        for cols in sets:
            def tup(r):
                return tuple(r[c] for c in cols)
            going = [(k, tup({**rows[k], **v})) for k, v in values if k not in failed and tup({**rows[k], **v}) != tup(rows[k])]
            stay = {}
            for k, r in rows.items():
                stay.setdefault(tup(r), set()).add(k)
            movers = {k for k, _ in going}
            seen = set()
            for k, t in going:
                if None in t:
                    continue
                holders = stay.get(t, set())
                if t in seen or len(holders) > 1 or holders - movers:
                    new.add(k)
                seen.add(t)
        if not new:
            return failed
        failed |= new


@pytest.mark.parametrize("seed", range(3))
def test_unique_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = {i: {"id": i, "name": f"n{i}" if i % 11 else None, "grp": i % 4, "note": f"t{i // 2}"} for i in range(60)}
    keys = rng.sample(range(64), 50)
    values = []
    for k in keys:
        j = rng.choice([k + 1, k - 1, rng.randrange(70), rng.randrange(10)])
        values.append((k, {"name": rng.choice([f"n{j}", f"n{j}", f"n{j}", f"new{j % 5}", None]), "grp": rng.randrange(4),
                           "note": rng.choice([f"t{j // 2}", f"t{k // 2}", f"t{k}"])}))
    target = spark.createDataFrame([(r["id"], r["name"], r["grp"], r["note"]) for r in rows.values()], SCHEMA)
    sets = [("name",)] if seed < 2 else [("name",), ("GRP", "note")]
    want = brute_unique(rows, values, [tuple(c.lower() for c in s) for s in sets])
    got = failures(spark, target, [(k, v["name"], v["grp"], v["note"]) for k, v in values], Constraints(unique=tuple(sets)))
    assert got == dict.fromkeys(want, NOT_UNIQUE) and 0 < len(want) < 50


def test_long_chains_and_circles(spark):
    """A chain fails back to its start when its end is taken, and passes when it is free; a circle passes."""
    target = spark.createDataFrame([(i, f"n{i}", 0, None) for i in range(40)], SCHEMA)
    chain = [(i, f"n{i + 1}", 0, None) for i in range(19)]                        # 18 takes n19, which stays
    free = [(i, f"n{i + 1}" if i < 29 else "free", 0, None) for i in range(20, 30)]
    circle = [(i, f"n{30 + (i + 1) % 10}", 0, None) for i in range(30, 40)]
    rules = Constraints(unique=(("name",),))
    values = chain + free + circle
    assert failures(spark, target, values, rules) == dict.fromkeys(range(19), NOT_UNIQUE)
    new = ap.apply_updates(target, without_failed(c := typed(spark, target, values), constraint_failures(c, target, "id", COLUMNS, rules)),
                           "id", COLUMNS)
    assert new.where("name is not null").groupBy("name").count().where("count > 1").count() == 0


def test_order_of_rules_and_reasons(spark):
    target = spark.createDataFrame([(1, "a", 1, "x"), (2, "b", 2, None), (3, "c", 3, "z"), (4, "d", 4, None), (5, "e", 1, "v")], SCHEMA)
    parent = spark.createDataFrame([(1,), (2,), (3,), (9,), (None,), (9,)], "g long")
    child = spark.createDataFrame([("a",), ("a",), ("c",), (None,)], "who string")
    rules = Constraints(max_bytes={"NOTE": 4, "grp": 1}, parents=(Reference("grp", parent, "g"),),
                        children=(Reference("name", child, "who"),), unique=(("name",),))
    values = [(1, "q", 7, "ééé"), (2, "q", 7, "okay"), (3, "c", 9, None), (4, "e", None, "éé"), (5, "d", 1, "w"), (6, "zz", 7, "far too long")]
    c = typed(spark, target, values)
    bad = constraint_failures(c, target, "id", COLUMNS, rules)
    assert {r["key_cast"]: r["status"] for r in bad.collect()} == {1: TOO_LONG, 2: NO_PARENT}      # 4 and 5 swap; 3 keeps its name
    out = {r["key_value"]: (r["status"], r["reason"], r["rows_updated"], r["failed"])
           for r in ap.row_outcomes(c, target, "id", refused=bad).collect()}
    assert out["1"] == ("too_long", 'ORA-12899: value too large for column "NOTE" (actual: 6, maximum: 4)', 0, True)
    assert out["2"][1].startswith("ORA-02291") and out["3"] == ("applied", None, 1, False) and out["6"][0] == "missing_key"
    assert failures(spark, target, [(1, "new", 1, None), (2, "a", 1, None)], rules) == {1: CHILD_FOUND, 2: NOT_UNIQUE}


def test_several_rows_of_a_key(spark):
    target = spark.createDataFrame([(1, "a", 1, None), (1, "b", 2, None), (2, "c", 3, None)], SCHEMA)
    rules = Constraints(unique=(("name",),))
    assert failures(spark, target, [(1, "x", 1, None), (2, "y", 1, None)], rules) == {1: NOT_UNIQUE}
    assert failures(spark, target, [(1, None, 1, None), (2, "a", 1, None)], rules) == {2: NOT_UNIQUE}   # several rows: not followed
    with pytest.raises(ValueError, match="one target row per key"):
        failures(spark, target, [(1, "x")], Constraints(unique=(("name", "grp"),)), columns=["name"])


def test_nothing_to_judge(spark):
    target = spark.createDataFrame([(1, "a", 1, None)], SCHEMA)
    rules = Constraints(max_bytes={"note": 3}, unique=(("name",),))
    assert failures(spark, target, [(5, "a", 1, None), ("x", "a", 1, None)], rules) == {}
    assert failures(spark, target, [(1, "a", 1, "abc")], rules) == {}
    assert failures(spark, target.limit(0), [(1, "a", 1, "abcd")], rules) == {}
    with pytest.raises(ValueError, match="duplicate keys"):
        failures(spark, target, [(1, "a", 1, None), ("01", "b", 1, None)], rules)


def test_same_verdicts_beyond_the_broadcast_bound(spark):
    target = spark.createDataFrame([(i, f"n{i}", i % 3, None) for i in range(30)], SCHEMA)
    values = [(i, f"n{(i * 7) % 32}", i % 5, "x" * (i % 6)) for i in range(30)]
    rules = Constraints(max_bytes={"note": 4}, parents=(Reference("grp", target, "grp"),), unique=(("name",),))
    a = failures(spark, target, values, rules)
    spark.conf.set("keyedit.broadcast.maxRows", "0")
    spark.conf.set("keyedit.skew.hotRows", "3")
    try:
        assert failures(spark, target, values, rules) == a and len(set(a.values())) == 3
    finally:
        spark.conf.unset("keyedit.broadcast.maxRows")
        spark.conf.unset("keyedit.skew.hotRows")


def test_run_with_rules(spark, tmp_dir):
    path = f"{tmp_dir}/t"
    spark.createDataFrame([(1, "a", 1, "x"), (2, "b", 2, None), (3, "c", 3, "z")], SCHEMA).write.parquet(path)
    raw = spark.createDataFrame([(2, "1", "b"), (3, "2", "n"), (4, "3", "n")], "row_num long, k string, a string")
    spec = UpdateSpec(table="t", key_column="id", update_columns=("name",))
    res = run_update(spark, spec, raw, path, f"{tmp_dir}/out", "2024-01-31 12:00:00", rules=Constraints(unique=(("name",),)))
    assert res.ok and res.summary["success_count"] == 2 and res.summary["fail_count"] == 1
    got = {r["id"]: r["name"] for r in spark.read.parquet(res.target_path).collect()}
    assert got == {1: "b", 2: "n", 3: "c"}
    statuses = spark.read.parquet(res.outcomes_path).where(F.col("failed")).collect()
    assert [(r["key_value"], r["status"]) for r in statuses] == [("3", NOT_UNIQUE)]


def test_declared_lengths_of_a_table(spark, tmp_dir):
    spark.sql(f"create table declared (id bigint, code varchar(4), fixed char(2), free string) using parquet location '{tmp_dir}/d'")
    try:
        assert declared_bytes(spark.table("declared").schema) == {"code": 4, "fixed": 2}
    finally:
        spark.sql("drop table declared")
