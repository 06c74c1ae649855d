"""Workbooks written by tasks, committed by the driver, read back cell by cell."""

import os
import random
import zipfile
from types import SimpleNamespace
from xml.etree import ElementTree as ET

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keyedit.sinks import workbook
from keyedit.sinks.workbook import Part, WorkbookWriter, export_workbook
from keyedit.sources.workbook import changes_from_workbooks, decode_workbook, read_workbooks

ODD = ["plain", "", "a & b <c> \"d\"", " spaces  kept ", "line\nbreak", "tab\there", "\x01\x1f", "_x0041_", "carriage\r\nreturn", "日本 é 😀", "\uffff"]


def test_round_trip_of_odd_text(spark, tmp_dir):
    rng = random.Random(1)
    data = [(i, rng.choice(ODD), None if i % 7 == 0 else rng.choice(ODD), i / 4, i % 3 == 0) for i in range(300)]
    df = spark.createDataFrame(data, "id long, a string, b string, v double, flag boolean").repartition(4, "id")
    export_workbook(df, f"{tmp_dir}/out", sheet="Rows & more")
    assert sorted(os.listdir(f"{tmp_dir}/out"))[0] == "_SUCCESS" or "_SUCCESS" in os.listdir(f"{tmp_dir}/out")
    assert not os.path.exists(f"{tmp_dir}/out/_temporary") and len(os.listdir(f"{tmp_dir}/out")) == 5
    back = changes_from_workbooks(read_workbooks(spark, f"{tmp_dir}/out", 5, sheet="Rows & more"))
    number = lambda x: str(int(x)) if x == int(x) else repr(x)
    want = sorted((str(i), a, b or "", number(v), str(f).lower()) for i, a, b, v, f in data)
    assert sorted((r["c1"], r["c2"] or "", r["c3"] or "", r["c4"], r["c5"]) for r in back.collect()) == want


def test_sheets_are_split_at_the_limit(spark, tmp_dir):
    df = spark.range(25).select(F.col("id"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("text")).coalesce(1)
    export_workbook(df, f"{tmp_dir}/out", rows_per_sheet=10, widths=[5, 50])
    path = f"{tmp_dir}/out/part-00000.xlsx"
    found = []
    for k, sheet in enumerate(["Sheet1", "Sheet1 (2)", "Sheet1 (3)"]):
        with open(path, "rb") as f:
            lines = decode_workbook(f.read(), sheet)
        assert lines[0] == (1, ["id", "text"]) and [n for n, _ in lines] == list(range(1, len(lines) + 1)) and len(lines) <= 10
        found += [c for _, c in lines[1:]]
    assert found == [[str(i), f"v{i}"] for i in range(25)]
    with zipfile.ZipFile(path) as z:
        for name in z.namelist():
            ET.fromstring(z.read(name))
        ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
        assert [c.get("width") for c in ET.fromstring(z.read("xl/worksheets/sheet2.xml")).iter(f"{ns}col")] == ["5", "50"]


def test_widths_come_from_the_whole_table(spark, tmp_dir):
    export_workbook(spark.createDataFrame([("x" * 9, "y" * 90)], "a string, longer string"), f"{tmp_dir}/out")
    names = [n for n in os.listdir(f"{tmp_dir}/out") if n.endswith(".xlsx")]
    with zipfile.ZipFile(f"{tmp_dir}/out/{names[0]}") as z:
        assert b'width="11"' in z.read("xl/worksheets/sheet1.xml") and b'width="50"' in z.read("xl/worksheets/sheet1.xml")


def test_refusals(spark, tmp_dir):
    df = spark.range(3).select(F.col("id").cast("string").alias("a"))
    with pytest.raises(ValueError, match="no records"):
        export_workbook(df.limit(0), f"{tmp_dir}/none")
    assert not os.path.exists(f"{tmp_dir}/none")
    os.makedirs(f"{tmp_dir}/there")
    with pytest.raises(ValueError, match="exists"):
        export_workbook(df, f"{tmp_dir}/there")
    with pytest.raises(ValueError, match="rows"):
        export_workbook(df, f"{tmp_dir}/x", rows_per_sheet=1)


def test_a_failed_job_leaves_nothing(spark, tmp_dir):
    bad = spark.range(40).repartition(4).select(F.when(F.col("id") == 17, F.raise_error(F.lit("lost"))).otherwise(
        F.col("id").cast("string")).alias("a"))
    with pytest.raises(Exception, match="lost"):
        export_workbook(bad, f"{tmp_dir}/out", widths=[9])
    assert not [n for _, _, files in os.walk(f"{tmp_dir}/out") for n in files]


def test_only_named_files_are_committed(spark, tmp_dir):
    """The file of an attempt that was repeated goes with the temporary folder."""
    options = {"path": f"{tmp_dir}/out", "job": "j", "sheet": "S", "rows_per_sheet": "10", "widths": "9"}
    writer = WorkbookWriter(options, spark.range(1).selectExpr("cast(id as string) a").schema)
    for attempt in ("1", "2"):
        os.makedirs(f"{tmp_dir}/out/_temporary/j/{attempt}")
        with open(f"{tmp_dir}/out/_temporary/j/{attempt}/part-00000.xlsx", "w") as f:
            f.write(attempt)
    writer.commit([Part(f"{tmp_dir}/out/_temporary/j/2/part-00000.xlsx", 1), Part(None, 0), None])
    assert sorted(os.listdir(f"{tmp_dir}/out")) == ["_SUCCESS", "part-00000.xlsx"]
    with open(f"{tmp_dir}/out/part-00000.xlsx") as f:
        assert f.read() == "2"


def test_a_task_that_outlives_its_job_writes_nothing(spark, tmp_dir, monkeypatch):
    """Its first rows come after the abort, which has taken the job's folder away."""
    monkeypatch.setattr(workbook, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(
        partitionId=lambda: 0, taskAttemptId=lambda: 7)))
    os.makedirs(f"{tmp_dir}/out/_temporary/j")
    options = {"path": f"{tmp_dir}/out", "job": "j", "sheet": "S", "rows_per_sheet": "10", "widths": "9"}
    writer = WorkbookWriter(options, spark.range(1).selectExpr("cast(id as string) a").schema)
    batch = pa.RecordBatch.from_pydict({"a": ["x"]})
    assert writer.write(iter([batch])).rows == 1
    writer.abort([])
    with pytest.raises(OSError):
        writer.write(iter([batch]))
    assert os.listdir(f"{tmp_dir}/out") == []
