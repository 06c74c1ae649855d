"""Duplicate and consistency checks on the tool's own example inputs."""

from pyspark.sql import functions as F

from conftest import rows
from keyedit.operators import checks as ck
from keyedit.operators.staging import bind_changeset, coerce_changes, stage_as_text

# The duplicate example: 8 sheet rows (2..9), key 1001 on rows 2 and 5, 1002 on rows 3 and 8.
DUP_ROWS = [
    (2, 1001, "Zhang", 30, "Sales"), (3, 1002, "Li", 28, "IT"), (4, 1003, "Wang", 35, "HR"),
    (5, 1001, "Zhao", 40, "Sales"), (6, 1004, "Sun", 25, "IT"), (7, 1005, "Zhou", 33, "Ops"),
    (8, 1002, "Wu", 29, "IT"), (9, 1006, "Zheng", 31, "HR"),
]
# The consistency example: keys 9999 (row 5) and 8888 (row 8) are not in the table.
CONS_ROWS = [
    (2, 1001, "a", 1, "x"), (3, 1002, "b", 2, "x"), (4, 1003, "c", 3, "x"), (5, 9999, "d", 4, "x"),
    (6, 1004, "e", 5, "x"), (7, 1005, "f", 6, "x"), (8, 8888, "g", 7, "x"), (9, 1006, "h", 8, "x"),
]
SCHEMA = "row_num long, ID long, name string, age long, department string"


def _changes(spark, data):
    return bind_changeset(spark.createDataFrame(data, SCHEMA), ["name", "age", "department"])


def test_duplicate_pairs_example(spark):
    cs = _changes(spark, DUP_ROWS)
    assert rows(ck.duplicate_pairs(cs)) == [(1001, 2, 5), (1002, 3, 8)]


def test_duplicate_key_rows_example(spark):
    cs = _changes(spark, DUP_ROWS)
    assert rows(ck.duplicate_key_rows(cs), "key_value", "rows") == [(1001, "2, 5"), (1002, "3, 8")]


def test_duplicate_keys_ordered_by_second_occurrence(spark):
    cs = _changes(spark, DUP_ROWS)
    assert [r["key_value"] for r in ck.duplicate_keys_ordered(cs).collect()] == [1001, 1002]
    assert [r["key_value"] for r in ck.duplicate_keys_top(cs, 1).collect()] == [1001]


def test_three_occurrences_give_two_pairs(spark):
    data = [(2, 7, "a", 1, "x"), (5, 7, "b", 1, "x"), (9, 7, "c", 1, "x"), (3, 8, "d", 1, "x")]
    cs = _changes(spark, data)
    assert rows(ck.duplicate_pairs(cs)) == [(7, 2, 5), (7, 2, 9)]
    assert rows(ck.duplicate_keys(cs)) == [(7, 2, 3)]


def test_duplicate_rows_chunked_for_a_hot_key(spark):
    data = [(r, 1, "n", 1, "d") for r in range(2, 2503)]
    cs = _changes(spark, data)
    out = ck.duplicate_key_rows(cs, rows_per_chunk=1000).orderBy("chunk").collect()
    assert [r["chunk"] for r in out] == [0, 1, 2]
    joined = ", ".join(r["rows"] for r in out)
    assert joined == ", ".join(str(i) for i in range(2, 2503))
    assert max(r["n_rows"] for r in out) <= 1000


def test_drop_null_keys(spark):
    data = DUP_ROWS + [(10, None, "n", 1, "d")]
    raw = spark.createDataFrame(data, SCHEMA)
    assert bind_changeset(raw, ["name"]).count() == 8
    assert bind_changeset(raw, ["name"], keep_null_keys=True).count() == 9


def _coerced(spark, data, target):
    bound = bind_changeset(spark.createDataFrame(data, SCHEMA), ["name"])
    staged = stage_as_text(bound, ["name"])
    return coerce_changes(staged, target.schema, "ID", ["name"])


def test_missing_keys_example(spark):
    target = spark.createDataFrame([(k, "n") for k in range(1001, 1007)], "ID long, name string")
    co = _coerced(spark, CONS_ROWS, target)
    got = ck.missing_keys(co, target, "ID").orderBy("row_num").collect()
    assert [(r["row_num"], r["key_value"]) for r in got] == [(5, "9999"), (8, "8888")]
    assert ck.present_keys(co, target, "ID").count() == 6
    s = ck.consistency_summary(co, target, "ID").first()
    assert (s["change_keys"], s["target_keys"], s["missing_count"], s["passed"]) == (8, 6, 2, False)


def test_missing_keys_keep_repeats_and_shuffle_path(spark):
    target = spark.createDataFrame([(k, "n") for k in range(1001, 1007)], "ID long, name string")
    data = CONS_ROWS + [(10, 9999, "z", 1, "x")]
    co = _coerced(spark, data, target)
    got = rows(ck.missing_keys(co, target, "ID", fits=False))
    assert got == [(5, "9999"), (8, "8888"), (10, "9999")]


def test_key_spellings_collide_and_text_key_is_missing(spark):
    target = spark.createDataFrame([(7, "n")], "ID long, name string")
    raw = spark.createDataFrame([(2, "7", "a"), (3, "007", "b"), (4, "abc", "c")],
                                "row_num long, ID string, name string")
    bound = bind_changeset(raw, ["name"])
    co = coerce_changes(stage_as_text(bound, ["name"]), target.schema, "ID", ["name"])
    gates = {r["check_name"]: r for r in ck.gate_report(bound, co, ["name"], 2).collect()}
    assert gates["unique_keys"]["passed"] is False and gates["unique_keys"]["observed"] == 1
    assert rows(ck.missing_keys(co, target, "ID")) == [(4, "abc")]


def test_missing_columns_case_insensitive(spark):
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("ID", T.LongType()), T.StructField("EMAIL", T.StringType())])
    req = spark.createDataFrame([(1, "email"), (2, "Phone"), (3, "id")], "position long, column_name string")
    assert rows(ck.missing_columns(req, schema)) == [(2, "Phone")]


def test_gate_report_limits(spark):
    target = spark.createDataFrame([(1, "n")], "ID long, name string")
    long_text = "x" * 4001
    raw = spark.createDataFrame([(2, "1", long_text)], "row_num long, ID string, name string")
    bound = bind_changeset(raw, ["name"], keep_null_keys=True)
    co = coerce_changes(stage_as_text(bound, ["name"]), target.schema, "ID", ["name"])
    g = {r["check_name"]: r["passed"] for r in ck.gate_report(bound, co, ["name"], 2, max_rows=1, max_text=4000).collect()}
    assert g == {"has_data_rows": True, "row_limit": True, "column_count": True, "has_keyed_rows": True,
                 "unique_keys": True, "text_length": False}
    bound2 = bind_changeset(raw, ["name", "x"], keep_null_keys=True)   # "x" is past the data width: padded
    g2 = {r["check_name"]: r["passed"] for r in ck.gate_report(bound2, co, ["name", "x"], 2).collect()}
    assert g2["column_count"] is False


def test_empty_and_header_only_change_set(spark):
    raw = spark.createDataFrame([], SCHEMA)
    bound = bind_changeset(raw, ["name"], keep_null_keys=True)
    target = spark.createDataFrame([(1, "n")], "ID long, name string")
    co = coerce_changes(stage_as_text(bound.where(F.col("key_value").isNotNull()), ["name"]), target.schema, "ID", ["name"])
    g = {r["check_name"]: r["passed"] for r in ck.gate_report(bound, co, ["name"], 4).collect()}
    assert g["has_data_rows"] is False and g["has_keyed_rows"] is False


def test_preview_headers_and_top_rows(spark):
    from keyedit.operators import preview as pv
    raw = spark.createDataFrame(DUP_ROWS + [(10, None, "n", 1, "d")], SCHEMA)
    assert pv.preview_headers(raw, ["name", "age", "department", "extra"]) == ["ID", "name", "age", "department"]
    assert pv.preview_headers(raw) == ["ID", "name"]
    bound = bind_changeset(raw, ["name"], keep_null_keys=True)
    assert [r["row_num"] for r in pv.preview(bound, 3).collect()] == [2, 3, 4]
    s = pv.preview_summary(bound, 5).first()
    assert (s["total_rows"], s["shown_rows"], s["has_more"], s["more_rows"]) == (9, 5, True, 4)


def test_duplicates_per_file_with_a_composite_key(spark):
    raw = spark.createDataFrame([("a.xlsx", 2, "1"), ("a.xlsx", 3, "1"), ("b.xlsx", 2, "1"), ("b.xlsx", 3, "2")],
                                "path string, row_num long, key_value string")
    assert rows(ck.duplicate_pairs(raw, ["path", "key_value"])) == [("a.xlsx", "1", 2, 3)]
    assert rows(ck.duplicate_key_rows(raw, ["path", "key_value"]), "path", "rows") == [("a.xlsx", "2, 3")]
    assert rows(ck.duplicate_keys(raw), "key_value", "occurrences") == [("1", 3)]


def test_column_profile_types_and_nulls(spark):
    df = spark.createDataFrame([(1, None, 2.5), (22, "abc", None)], "id long, name string, v double")
    got = [(r["ordinal"], r["column_name"], r["data_type"], r["max_length"], r["null_count"])
           for r in ck.column_profile(df).orderBy("ordinal").collect()]
    assert got == [(1, "ID", "bigint", 2, 0), (2, "NAME", "string", 3, 1), (3, "V", "double", 3, 1)]
