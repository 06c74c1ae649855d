"""Audit, history and run-log tables."""

import json
import os

from pyspark.sql import functions as F

from conftest import rows
from keyedit.functions import fixed
from keyedit.functions.text import classify_error, percent
from keyedit.operators import audit as au


def _audit_rows():
    return [
        {"timestamp": "2024-01-01 10:00:00", "action_type": "CONNECTION", "user": "system", "success": True,
         "error_msg": "", "details": json.dumps({"host": "h", "service": "s", "username": "u"}), "id": 1},
        {"timestamp": "2024-02-01 10:00:00", "action_type": "UPDATE", "user": "system", "success": False,
         "error_msg": "x", "details": json.dumps({"table": "T", "total_count": 3}), "id": 2},
        {"timestamp": "2024-03-01 10:00:00", "action_type": "EXPORT", "user": "system", "success": True,
         "error_msg": "", "details": "{}", "id": 3},
    ]


def test_audit_json_round_trip_skips_bad_lines(spark, tmp_dir):
    path = os.path.join(tmp_dir, "audit")
    os.makedirs(path)
    with open(os.path.join(path, "part-0.json"), "w", encoding="utf-8") as f:
        for r in _audit_rows():
            f.write(json.dumps(r, ensure_ascii=False) + "\n")
        f.write('{"timestamp": "2024-0\n')      # cut short
        f.write("\n")
    a = au.read_audit(spark, path)
    assert a.count() == 3
    assert [r["id"] for r in au.by_action(a, "UPDATE").collect()] == [2]
    assert [r["id"] for r in au.newest_first(a, 2).collect()] == [3, 2]
    lines = spark.read.text(path)
    c = au.purge_counts(au.parse_audit_lines(lines), "2024-02-01 00:00:00", au.audit_corrupt(lines)).first()
    assert (c["deleted_count"], c["kept_count"], c["corrupt_count"]) == (1, 2, 2)
    kept, purged = au.purge_before(a, "2024-02-01 00:00:00")
    assert rows(kept, "id") == [(2,), (3,)] and rows(purged, "id") == [(1,)]


def test_missing_audit_path_is_empty(spark, tmp_dir):
    assert au.read_audit(spark, os.path.join(tmp_dir, "nothing-here")).count() == 0


def test_missing_timestamp_is_purged(spark):
    df = spark.createDataFrame([(None, 1), ("2030-01-01 00:00:00", 2)], "timestamp string, id long")
    kept, purged = au.purge_before(df, "2024-01-01 00:00:00")
    assert rows(purged, "id") == [(1,)]


def test_update_entry_and_history_record(spark, tmp_dir):
    summary = spark.createDataFrame([(5, 4, 1, False)], "total_count long, success_count long, fail_count long, success boolean")
    e = au.update_entry(summary, schema="S", table="T", key_column="K", update_columns=["A", "B"],
                        backup_table="T_BAK_20240101_000000", run_ts="2024-01-01 00:00:00").first()
    d = json.loads(e["details"])
    assert d == {"schema": "S", "table": "T", "key_column": "K", "update_columns": ["A", "B"], "total_count": 5,
                 "success_count": 4, "fail_count": 1, "backup_table": "T_BAK_20240101_000000"}
    h = au.history_record(summary, schema="S", table="T", key_column="K", update_columns=["A"],
                          backup_table="b", run_ts="2024-01-02 03:04:05").first()
    assert h["id"] == "20240102030405000000" and h["timestamp"] == "2024-01-02 03:04:05"
    path = os.path.join(tmp_dir, "audit")
    au.append_json(au.update_entry(summary, schema="S", table="T", key_column="K", update_columns=["A"],
                                   backup_table="b", run_ts="2024-01-01 00:00:00"), path)
    au.append_json(au.update_entry(summary, schema="S", table="T", key_column="K", update_columns=["A"],
                                   backup_table="b", run_ts="2024-01-02 00:00:00"), path)
    assert au.read_audit(spark, path).count() == 2


def test_history_view_defaults_and_delete(spark):
    h = spark.createDataFrame(
        [("1", "2024-01-01 00:00:00", None, "T", 3, 3, 0, True), ("2", "2024-01-02 00:00:00", "S", None, None, 1, 1, False)],
        "id string, timestamp string, schema string, table string, total_count long, success_count long, fail_count long, success boolean")
    v = au.history_view(h).orderBy("seq").collect()
    assert [(r["seq"], r["table"], r["schema"], r["total_count"], r["status"]) for r in v] == [
        (1, "--", "S", "0", fixed.STATUS_PARTIAL), (2, "T", "--", "3", fixed.STATUS_SUCCESS)]
    rest = au.delete_ids(h, spark.createDataFrame([("2",)], "id string"))
    assert rows(rest, "id") == [("1",)]
    c = au.delete_count(h, rest).first()
    assert (c["deleted_count"], c["remaining_count"]) == (1, 1)


def test_log_line_forms(spark):
    lines = spark.createDataFrame([
        (1, "[2024-01-01 10:00:00,123] INFO - SUCCESS - done"),
        (2, "[2024-01-01 10:00:01,000] WARNING no dash here"),
        (3, "plain line"),
        (4, "   "),
        (5, "[x]y] rest"),
    ], "n long, value string")
    got = {r["n"]: (r["time"], r["level"], r["message"]) for r in au.parse_log(lines).collect()}
    assert got == {1: ("2024-01-01 10:00:00,123", "INFO", "SUCCESS - done"),
                   2: ("2024-01-01 10:00:01,000", "", "WARNING no dash here"),
                   3: ("", "", "plain line"),
                   5: ("x", "", "] rest")}
    norm = {r["n"]: (r["level"], r["message"]) for r in au.parse_log(lines, normalize_level=True).collect()}
    assert norm[1] == ("SUCCESS", "done")


def test_classify_errors_first_code_wins(spark):
    df = spark.createDataFrame([("ORA-01722: invalid number",), ("ORA-01407 and ORA-01722",), ("boom",)], "m string")
    got = [tuple(r) for r in df.select(classify_error(F.col("m"), "update"), classify_error(F.col("m"), "sql")).collect()]
    assert got[0] == (fixed.REASON_TYPE_MISMATCH, "数据类型不匹配: ORA-01722: invalid number")
    assert got[1][0] == fixed.REASON_TYPE_MISMATCH          # 01722 is checked first
    assert got[2] == ("boom", "数据库错误: boom")


def test_percent_is_exact(spark):
    df = spark.createDataFrame([(29, 100), (57, 100), (58, 100), (0, 0), (1, 3)], "c long, t long")
    assert [r[0] for r in df.select(percent(F.col("c"), F.col("t"))).collect()] == [29, 57, 58, 0, 33]


def test_purge_writes_kept_entries_and_counts(spark, tmp_dir):
    path = os.path.join(tmp_dir, "audit")
    os.makedirs(path)
    with open(os.path.join(path, "part-0.json"), "w", encoding="utf-8") as f:
        for r in _audit_rows():
            f.write(json.dumps(r, ensure_ascii=False) + "\n")
        f.write("not json\n")
    out = os.path.join(tmp_dir, "audit_v2")
    c = au.purge_audit(spark, path, "2024-02-01 00:00:00", out)
    assert c == {"deleted_count": 1, "kept_count": 2, "corrupt_count": 1}
    assert rows(au.read_audit(spark, out), "id") == [(2,), (3,)]
    assert [r["id"] for r in au.audit_view(au.read_audit(spark, path), 10, "EXPORT").collect()] == [3]
    assert au.clear_history(au.read_audit(spark, path)).count() == 0


def test_empty_history_placeholder_and_log_export(spark, tmp_dir):
    empty = spark.createDataFrame([], "id string, timestamp string, schema string, table string, "
                                      "total_count long, success_count long, fail_count long, success boolean")
    v = au.history_view(empty, placeholder=True).collect()
    assert len(v) == 1 and v[0]["status"] == fixed.NO_RECORDS and v[0]["seq"] == 1
    assert au.history_view(empty).count() == 0
    lines = spark.createDataFrame([(1, "[t] INFO - m")], "n long, value string")
    out = os.path.join(tmp_dir, "log")
    assert au.export_log_csv(au.parse_log(lines), out) == 1
    back = spark.read.option("header", "true").csv(out)
    assert back.columns == list(fixed.LOG_EXPORT_HEADERS)


def test_import_history_json_array(spark, tmp_dir):
    p = os.path.join(tmp_dir, "history.json")
    recs = [{"schema": "APPS", "table": "T", "key_column": "K", "update_columns": ["A", "B"], "total_count": 3,
             "success_count": 3, "fail_count": 0, "success": True, "backup_table": "T_BAK_20240101_000000",
             "id": "20240101000000000001", "timestamp": "2024-01-01 00:00:00"},
            {"schema": "APPS", "table": "T", "key_column": "K", "update_columns": ["A"], "total_count": 2,
             "success_count": 1, "fail_count": 1, "success": False, "backup_table": "T_BAK_20240102_000000",
             "id": "20240102000000000001", "timestamp": "2024-01-02 00:00:00"}]
    with open(p, "w", encoding="utf-8") as f:
        json.dump(recs, f, ensure_ascii=False, indent=2)
    h = au.read_history_json(spark, p)
    assert h.count() == 2
    v = au.history_view(h).orderBy("seq").collect()
    assert [(r["seq"], r["status"]) for r in v] == [(1, fixed.STATUS_PARTIAL), (2, fixed.STATUS_SUCCESS)]


def test_classify_errors_key_query_and_connect_stages(spark):
    df = spark.createDataFrame([("ORA-00904: bad column",), ("ORA-01017: denied",), ("timeout",)], "m string")
    got = [tuple(r) for r in df.select(classify_error(F.col("m"), "keys"), classify_error(F.col("m"), "connect")).collect()]
    assert got[0][0] == "列名无效: ORA-00904: bad column"
    assert got[1][1] == "连接失败: 用户名或密码无效"
    assert got[2] == ("查询失败: timeout", "连接失败: timeout")
