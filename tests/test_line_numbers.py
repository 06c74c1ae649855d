"""Line numbers of CSV change sets, keys judged as written, duplicates in one pass."""

import csv
import io
import random

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import rows
from keyedit.functions.coerce import canonical_key, coerce_value
from keyedit.operators import checks as ck
from keyedit.plans.duck_sql import duck_canonical_key
from keyedit.sources import changeset as cs


def write(path, text):
    with open(path, "w", newline="", encoding="utf-8") as f:
        f.write(text)


@pytest.mark.parametrize("first", ["\n", "\n\n", "  \n", ""])
def test_header_after_blank_lines(spark, tmp_dir, first):
    write(f"{tmp_dir}/a.csv", first + "id,v\n\n1,x\n2,y\n")
    n = first.count("\n")
    got = cs.read_changeset(spark, f"{tmp_dir}/a.csv")
    assert got.columns == ["row_num", "id", "v"] and rows(got) == [(3 + n, "1", "x"), (4 + n, "2", "y")]


def test_header_of_each_file(spark, tmp_dir):
    write(f"{tmp_dir}/a.csv", "id,v\n1,x\n")
    write(f"{tmp_dir}/b.csv", "\n\nid,v\n1,x\n")
    got = cs.read_changeset(spark, tmp_dir, with_path=True)
    assert sorted((r["path"][-5:], r["row_num"], r["id"]) for r in got.collect()) == [("a.csv", 2, "1"), ("b.csv", 4, "1")]


def by_csv(text):
    """Records with the line at which they start, by Python's reader; blank lines and the header left out."""
    out, start = [], 1
    reader = csv.reader(io.StringIO(text, newline=""))
    for r in reader:
        if any(c.strip() for c in r) or len(r) > 1:
            out.append((start, *[c.replace("\r\n", "\n") for c in r]))
        start = reader.line_num + 1
    return out[1:]


@pytest.mark.parametrize("seed", range(3))
def test_line_breaks_in_cells(spark, tmp_dir, monkeypatch, seed):
    """Records cross blocks of a few lines and pieces of files; numbers and cells equal those of a CSV reader."""
    monkeypatch.setattr(cs, "LINES_PER_BLOCK", 5)
    rng, want = random.Random(seed), []
    for k in range(3):
        out = io.StringIO(newline="")
        out.write("\n" * (k % 2) + "id,text,note\n")
        w = csv.writer(out, lineterminator="\n")
        for i in range(40):
            cell = rng.choice(["plain", "two\nlines", 'say ""hi""'.replace('""', '"'), "a,b", "\n\n\nfar\n\nbelow\n", '"', '\n"\n', "é"])
            w.writerow([i, cell, rng.choice(["x", "last\none", 'q"'])])
            if rng.random() < .2:
                out.write("\n")
        write(f"{tmp_dir}/f{k}.csv", out.getvalue())
        want += [(f"f{k}.csv", *r) for r in by_csv(out.getvalue())]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        got = cs.read_changeset(spark, tmp_dir, with_path=True, multiLine=True)
        assert got.columns == ["row_num", "path", "id", "text", "note"]
        found = sorted((r["path"].rsplit("/", 1)[1], r["row_num"], r["id"], r["text"], r["note"]) for r in got.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == sorted(want) and len(want) == 120


def test_an_open_quote_is_refused(spark, tmp_dir):
    write(f"{tmp_dir}/a.csv", "id,v\n1,\"open\n" + "2,x\n" * 50)
    with pytest.raises(ValueError, match="starts at line 2 .*not closed"):
        cs.read_changeset(spark, f"{tmp_dir}/a.csv", multiLine=True, max_record_lines=20)


KEYS = {"1e-19": None, "7.0000000000000000001": None, "7.0": 7, "70e-1": 7, "0.7e1": 7, "0.0": 0, "0e5": 0, "-0": 0, "1e3": 1000,
        "007": 7, " 7 ": 7, "+7": 7, "1200e-2": 12, "1205e-2": None, "9223372036854775807": 2 ** 63 - 1, "9223372036854775808": None,
        "123456789012345678901234567890": None, "12x": None, "": None, ".5e1": 5, "5.": 5, "1e-400": None, "0.000000000000000000000": 0}


def test_keys_are_whole_numbers_as_written(spark):
    df = spark.createDataFrame([(k,) for k in KEYS] + [(None,)], "k string")
    got = {r["k"]: r["v"] for r in df.select("k", canonical_key(F.col("k"), T.LongType()).alias("v")).collect()}
    assert got == {**KEYS, None: None}
    small = {r["k"]: r["v"] for r in df.select("k", canonical_key(F.col("k"), T.ByteType()).alias("v")).collect()}
    assert small["1e3"] is None and small["1200e-2"] == 12 and small["9223372036854775807"] is None
    con = duckdb.connect()
    con.execute("create table t(k varchar)")
    con.executemany("insert into t values (?)", [(k,) for k in KEYS])
    assert dict(con.execute(f"select k, {duck_canonical_key('k', T.LongType())} from t").fetchall()) == KEYS
    # values are rounded, keys never
    assert [r[0] for r in spark.createDataFrame([("2.5",), ("-2.5",), ("7",), ("300",)], "k string").select(
        coerce_value(F.col("k"), T.ByteType())).collect()] == [3, -3, 7, None]


def test_second_rows_need_one_scan_and_no_join(spark):
    rng = random.Random(2)
    data = [(i + 2, f"k{rng.randrange(30)}" if i % 4 else "hot") for i in range(400)] + [(900, None), (901, None), (902, "once")]
    df = spark.createDataFrame(data, "row_num long, key_value string").repartition(6)
    want = {}
    for n, k in sorted((n, k) for n, k in data if k is not None):
        want.setdefault(k, []).append(n)
    want = sorted((v[1], k) for k, v in want.items() if len(v) > 1)
    out = ck.duplicate_keys_ordered(df)
    assert [(r["second_row"], r["key_value"]) for r in out.collect()] == want
    plan = ck.second_rows(df)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("WindowGroupLimit") == 2      # before and after the shuffle
