"""Plan shape: the physical plans are the ones we want at scale."""

from conftest import SF001, SF01


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_apply_plan_broadcasts_changes_and_keeps_target_unshuffled(spark):
    from keyedit.plans.catalog import QUERIES
    p = _plan(QUERIES["apply_updates"](spark, SF01))
    assert "BroadcastHashJoin" in p and "LeftOuter" in p
    assert "PythonUDF" not in p and "ArrowEvalPython" not in p and "BatchEvalPython" not in p
    assert "SortMergeJoin" not in p


def test_apply_plan_without_broadcast_shuffles_on_the_key(spark):
    from keyedit.operators import apply as ap
    from keyedit.plans import fixtures as fx
    from keyedit.plans.catalog import _prepared
    target, co = _prepared(spark, SF01, fx.cs1, fx.CUSTOMER_SPEC)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = _plan(ap.apply_updates(target, co, "c_custkey", fx.CUSTOMER_SPEC.update_columns, changes_fit=False))
        assert "SortMergeJoin" in p or "ShuffledHashJoin" in p
        assert "hashpartitioning(c_custkey" in p
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_key_scan_reads_one_column_and_filters_push_down(spark):
    from keyedit.plans.catalog import QUERIES
    p = _plan(QUERIES["target_keys"](spark, SF001))
    assert "ReadSchema: struct<c_custkey:bigint>" in p
    df = spark.read.parquet(f"{SF001}/events.parquet").where("event_type = 'error'").select("event_id")
    p2 = _plan(df)
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,error)]" in p2


def test_duplicate_checks_use_partial_aggregation(spark):
    from keyedit.plans.catalog import QUERIES
    p = _plan(QUERIES["duplicate_pairs"](spark, SF01))
    assert "partial_min" in p or "partial_count" in p
    assert "Window" not in p


def test_history_view_window_only_over_top_k(spark):
    from keyedit.plans.catalog import QUERIES
    p = _plan(QUERIES["history_view"](spark, SF01))
    assert "TakeOrderedAndProject" in p


def test_no_cross_join_anywhere(spark):
    from keyedit.plans.catalog import QUERIES
    for name in ("consistency_summary", "gate_report", "audit_purge_count", "history_delete_count"):
        p = _plan(QUERIES[name](spark, SF001))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_checkpointed_changes_are_not_shuffled_again(spark):
    from keyedit.operators import apply as ap
    from keyedit.operators.staging import KEY_CAST
    from keyedit.plans import fixtures as fx
    from keyedit.plans.catalog import _prepared
    from keyedit.session import checkpoint_by_key
    target, co = _prepared(spark, SF01, fx.csl, fx.LINEITEM_SPEC)
    cp = checkpoint_by_key(co, KEY_CAST)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("keyedit.skew.hotRows", "100000000")
    try:
        new = ap.apply_updates(target, cp, "l_orderkey", fx.LINEITEM_SPEC.update_columns, check_unique=False,
                               changes_fit=False)
        p = _plan(new)
        assert p.count("Exchange hashpartitioning") == 1      # the target side only
        assert new.count() == target.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("keyedit.skew.hotRows")


def test_apply_reads_the_target_once(spark):
    from keyedit.plans.catalog import QUERIES
    p = _plan(QUERIES["apply_updates_lineitem"](spark, SF01))
    assert p.count("lineitem.parquet") == 1          # the target: one scan
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p
