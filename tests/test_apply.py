"""Applying change sets: semantics, invariants and edge cases."""

import pytest
from pyspark.sql import functions as F

from conftest import SF01, rows
from keyedit.operators import apply as ap
from keyedit.operators.staging import bind_changeset, coerce_changes, stage_as_text
from keyedit.plans import fixtures as fx

TARGET_SCHEMA = "ID long, name string, qty int, price double"


def _target(spark):
    return spark.createDataFrame([(1, "a", 10, 1.5), (2, "b", 20, 2.5), (3, "c", 30, 3.5)], TARGET_SCHEMA)


def _co(spark, target, data, cols=("qty", "name"), not_null=frozenset()):
    schema = "row_num long, k string, " + ", ".join(f"v{i} string" for i in range(len(cols)))
    bound = bind_changeset(spark.createDataFrame(data, schema), list(cols))
    return coerce_changes(stage_as_text(bound, list(cols)), target.schema, "ID", list(cols), not_null)


NUM_CASES = [("1.5", 2), ("-1.5", -2), ("2.5", 3), (" 7 ", 7), ("12abc", None), ("", None), ("1e3", 1000),
             ("1001.0", 1001), ("007", 7), ("+5", 5), ("1,000", None), (".5", 1), ("5.", 5), ("NaN", None)]


def test_integral_coercion_table(spark):
    t = _target(spark)
    data = [(i + 2, "1", v, "n") for i, (v, _) in enumerate(NUM_CASES)]
    co = _co(spark, t, data).orderBy("row_num").collect()
    assert [r["qty"] for r in co] == [e for _, e in NUM_CASES]


def test_apply_sets_all_listed_columns_including_null(spark):
    t = _target(spark)
    co = _co(spark, t, [(2, "1", "11", None), (3, "2", "", "bb")])
    new = ap.apply_updates(t, co, "ID", ["qty", "name"])
    assert new.columns == t.columns
    assert rows(new) == [(1, None, 11, 1.5), (2, "bb", None, 2.5), (3, "c", 30, 3.5)]


def test_outcomes_order_and_reasons(spark):
    t = _target(spark)
    data = [(2, "1", "5", "x"), (3, "9", "5", "x"), (4, "2", "12x", "x"), (5, "3", None, "x"), (6, "abc", "1", "x")]
    co = _co(spark, t, data, not_null=frozenset({"QTY"}))
    oc = {r["row_num"]: (r["status"], r["failed"]) for r in ap.row_outcomes(co, t, "ID").collect()}
    assert oc == {2: ("applied", False), 3: ("missing_key", False), 4: ("type_mismatch", True),
                  5: ("null_not_allowed", True), 6: ("missing_key", False)}
    oc_fail = {r["row_num"]: r["failed"] for r in ap.row_outcomes(co, t, "ID", unmatched="fail").collect()}
    assert oc_fail[3] is True
    s = ap.run_summary(ap.row_outcomes(co, t, "ID")).first()
    assert (s["change_rows"], s["total_count"], s["success_count"], s["fail_count"], s["missing_count"],
            s["success"]) == (5, 3, 1, 2, 2, False)
    new = ap.apply_updates(t, co, "ID", ["qty", "name"])
    assert rows(new) == [(1, "x", 5, 1.5), (2, "b", 20, 2.5), (3, "c", 30, 3.5)]


def test_duplicate_keys_are_refused(spark):
    t = _target(spark)
    co = _co(spark, t, [(2, "1", "5", "x"), (3, "001", "6", "y")])
    with pytest.raises(ValueError):
        ap.apply_updates(t, co, "ID", ["qty", "name"])


def test_several_target_rows_per_key(spark):
    t = spark.createDataFrame([(1, "a", 1, 0.0), (1, "b", 2, 0.0), (2, "c", 3, 0.0)], TARGET_SCHEMA)
    co = _co(spark, t, [(2, "1", "9", "z")])
    new = ap.apply_updates(t, co, "ID", ["qty", "name"])
    assert rows(new) == [(1, "z", 9, 0.0), (1, "z", 9, 0.0), (2, "c", 3, 0.0)]
    oc = ap.row_outcomes(co, t, "ID").first()
    assert oc["rows_updated"] == 2


def test_salted_and_broadcast_plans_agree(spark):
    t = spark.createDataFrame([(1, f"r{i}", i, 0.0) for i in range(50)] + [(2, "x", 1, 0.0), (3, "y", 2, 0.0)],
                              TARGET_SCHEMA)
    co = _co(spark, t, [(2, "1", "9", "z"), (3, "3", "8", "w")])
    a = ap.apply_updates(t, co, "ID", ["qty", "name"], changes_fit=True)
    spark.conf.set("keyedit.skew.hotRows", "10")
    spark.conf.set("keyedit.skew.rowsPerBucket", "4")
    try:
        b = ap.apply_updates(t, co, "ID", ["qty", "name"], changes_fit=False)
        assert "__salt" in b._jdf.queryExecution().analyzed().toString()
        assert rows(a) == rows(b)
    finally:
        spark.conf.unset("keyedit.skew.hotRows")
        spark.conf.unset("keyedit.skew.rowsPerBucket")


def test_apply_twice_equals_once_and_restore(spark):
    target, co = _prepared_cs1(spark)
    once = ap.apply_updates(target, co, "c_custkey", fx.CUSTOMER_SPEC.update_columns)
    twice = ap.apply_updates(once, co, "c_custkey", fx.CUSTOMER_SPEC.update_columns)
    assert once.exceptAll(twice).count() == 0 and twice.exceptAll(once).count() == 0
    assert once.count() == target.count()
    # untouched columns and unmatched rows identical
    assert once.select("c_custkey", "c_name", "c_acctbal").exceptAll(target.select("c_custkey", "c_name", "c_acctbal")).count() == 0
    back = ap.restore_rows(once, target, target.select("c_custkey"), "c_custkey")
    assert back.exceptAll(target).count() == 0 and target.exceptAll(back).count() == 0


def _prepared_cs1(spark):
    from keyedit.plans.catalog import _prepared
    return _prepared(spark, SF01, fx.cs1, fx.CUSTOMER_SPEC)


def test_outcome_counts_add_up(spark):
    from keyedit.plans.catalog import _prepared
    target, co = _prepared(spark, SF01, fx.cs2, fx.CUSTOMER_SPEC)
    oc = ap.row_outcomes(co, target, "c_custkey")
    n_nonnull = fx.cs2(spark, SF01).where(F.col("key_value").isNotNull()).count()
    by = {r["status"]: r["count"] for r in oc.groupBy("status").count().collect()}
    assert sum(by.values()) == n_nonnull
    new = ap.apply_updates(target, co, "c_custkey", fx.CUSTOMER_SPEC.update_columns)
    changed = new.exceptAll(target).count()
    assert changed <= by["applied"]


def test_zero_matches_and_upsert(spark):
    t = _target(spark)
    co = _co(spark, t, [(2, "50", "5", "new")])
    new = ap.apply_updates(t, co, "ID", ["qty", "name"])
    assert rows(new) == rows(t)
    up = ap.upsert_by_key(t, new, co, "ID", ["qty", "name"])
    assert rows(up)[-1] == (50, "new", 5, None)


def test_upsert_with_repeated_row_numbers(spark):
    """Row numbers repeat across files: a matched change is never inserted."""
    t = _target(spark)
    co = _co(spark, t, [(2, "1", "5", "x"), (2, "99", "6", "new")])
    before = t.count()
    up = ap.upsert_by_key(t, ap.apply_updates(t, co, "ID", ["qty", "name"]), co, "ID", ["qty", "name"])
    ids = sorted(r["id"] if "id" in up.columns else r[0] for r in up.collect())
    assert up.count() == before + 1 and ids.count(1) == 1 and ids.count(99) == 1


def test_all_or_nothing(spark):
    t = _target(spark)
    co = _co(spark, t, [(2, "1", "5", "x"), (3, "2", "bad", "y")])
    new = ap.apply_updates(t, co, "ID", ["qty", "name"])
    oc = ap.row_outcomes(co, t, "ID")
    assert rows(ap.apply_all_or_nothing(t, new, oc)) == rows(t)
    co_ok = _co(spark, t, [(2, "1", "5", "x")])
    new_ok = ap.apply_updates(t, co_ok, "ID", ["qty", "name"])
    assert rows(ap.apply_all_or_nothing(t, new_ok, ap.row_outcomes(co_ok, t, "ID"))) == rows(new_ok)


def test_text_keys_with_leading_zeros_match_exactly(spark):
    t = spark.createDataFrame([("001", "a"), ("1", "b")], "code string, label string")
    raw = spark.createDataFrame([(2, "001", "A")], "row_num long, code string, label string")
    bound = bind_changeset(raw, ["label"])
    co = coerce_changes(stage_as_text(bound, ["label"]), t.schema, "code", ["label"])
    assert rows(ap.apply_updates(t, co, "code", ["label"])) == [("001", "A"), ("1", "b")]


def test_restore_columns_needs_one_backup_row_per_key(spark):
    t = spark.createDataFrame([(1, "a", 1, 0.0), (1, "b", 2, 0.0)], TARGET_SCHEMA)
    with pytest.raises(ValueError):
        ap.restore_rows(t, t, t.select("ID"), "ID", ["name"]).count()
    whole = ap.restore_rows(t, t, t.select("ID"), "ID")
    assert rows(whole) == rows(t)


def test_column_names_in_another_case(spark):
    t = _target(spark)
    co = _co(spark, t, [(2, "1", "77", "zz")], cols=("QTY", "Name"), not_null=frozenset({"qty"}))
    new = ap.apply_updates(t, co, "id", ["QTY", "Name"])
    assert new.columns == t.columns
    assert rows(new)[0] == (1, "zz", 77, 1.5)


def test_outcomes_without_broadcast_count_every_target_row(spark):
    t = spark.createDataFrame([(1, "a", i, 0.0) for i in range(25)] + [(2, "b", 1, 0.0)], TARGET_SCHEMA)
    co = _co(spark, t, [(2, "1", "5", "x"), (3, "2", "6", "y"), (4, "9", "7", "z")])
    got = {r["row_num"]: (r["status"], r["rows_updated"]) for r in ap.row_outcomes(co, t, "ID", fits=False).collect()}
    assert got == {2: ("applied", 25), 3: ("applied", 1), 4: ("missing_key", 0)}


def test_tiny_fraction_key_is_not_whole(spark):
    t = _target(spark)
    co = _co(spark, t, [(2, "1000000e-16", "5", "x"), (3, "1e0", "6", "y"), (4, "2.00000000004", "7", "z")])
    got = {r["row_num"]: r["key_cast"] for r in co.collect()}
    assert got == {2: None, 3: 1, 4: None}
