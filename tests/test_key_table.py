"""Beyond the broadcast bound the target's keys are counted once for outcomes and salting."""

import random


from conftest import rows
from keyedit.operators import apply as ap
from keyedit.operators.staging import coerce_changes
from keyedit.plans.job import run_update
from keyedit.spec import UpdateSpec

SCHEMA = "id long, grp string, v double"


def test_key_table_serves_outcomes_and_salting(spark):
    rng = random.Random(1)
    data = [(rng.randrange(40), f"g{i}", float(i)) for i in range(200)] + [(7, "hot", 1.0)] * 60 + [(99, "hot", 2.0)] * 60 + [(None, "n", 0.0)] * 9
    target = spark.createDataFrame(data, SCHEMA)
    raw = spark.createDataFrame([(i + 2, str(k), f"x{k}") for i, k in enumerate([7, 3, 5, 500])], "row_num long, key_value string, grp string")
    c = coerce_changes(raw, target.schema, "id", ["grp"])
    spark.conf.set("keyedit.skew.hotRows", "50")
    spark.conf.set("keyedit.skew.rowsPerBucket", "20")
    try:
        keys = ap.key_table(target, "ID", c)
        n = {}
        for k, *_ in data:
            n[k] = n.get(k, 0) + 1
        assert rows(keys) == sorted([(k, n[k], True) for k in (3, 5, 7)] + [(99, 60, False)])
        assert sorted(map(str, ap.apply_updates(target, c, "id", ["grp"], changes_fit=False, keys=keys).collect())) == sorted(
            map(str, ap.apply_updates(target, c, "id", ["grp"], changes_fit=True).collect()))
        assert sorted(map(str, ap.row_outcomes(c, target, "id", fits=False, keys=keys).collect())) == sorted(
            map(str, ap.row_outcomes(c, target, "id", fits=True).collect()))
    finally:
        spark.conf.unset("keyedit.skew.hotRows")
        spark.conf.unset("keyedit.skew.rowsPerBucket")


def test_a_run_counts_the_keys_once(spark, tmp_dir, monkeypatch):
    """The salted run gives what the broadcast run gives, and asks for the target's keys one time."""
    spark.createDataFrame([(i % 30, f"g{i}", float(i)) for i in range(120)] + [(7, "hot", 1.0)] * 60, SCHEMA).write.parquet(f"{tmp_dir}/t")
    raw = spark.createDataFrame([(i + 2, str(k), f"x{k}") for i, k in enumerate([7, 3, 5, 500])], "row_num long, k string, a string")
    spec = UpdateSpec(table="t", key_column="id", update_columns=("grp",))
    plain = run_update(spark, spec, raw, f"{tmp_dir}/t", f"{tmp_dir}/a", "2024-01-31 12:00:00")
    calls = []
    monkeypatch.setattr(ap, "matched_key_counts", lambda *a, **k: calls.append("counts"))
    from keyedit.operators import joins
    monkeypatch.setattr(joins, "hot_keys", lambda big, *a, **k: calls.append("hot"))
    spark.conf.set("keyedit.broadcast.maxRows", "0")
    spark.conf.set("keyedit.skew.hotRows", "50")
    try:
        big = run_update(spark, spec, raw, f"{tmp_dir}/t", f"{tmp_dir}/b", "2024-01-31 12:00:00")
    finally:
        spark.conf.unset("keyedit.broadcast.maxRows")
        spark.conf.unset("keyedit.skew.hotRows")
    assert calls == [] and big.summary == plain.summary and big.summary["rows_updated"] == 64 + 4 + 4
    assert sorted(map(str, spark.read.parquet(big.target_path).collect())) == sorted(map(str, spark.read.parquet(plain.target_path).collect()))
