"""Workbook (.xlsx) export as a Spark data source: every task writes one workbook of its rows.

``export_workbook`` writes a folder of ``part-<n>.xlsx``. A task streams its rows straight into
the zipped sheet XML of its file, so it holds one batch of rows whatever their number; at the
format's row limit it goes on in another sheet of the same file. Files are written under
``_temporary`` of the output folder. A task's commit message names its file; only when all
tasks have ended does the driver move the files named to their place, so a failed or
repeated task leaves nothing behind. Cells are text, as the tool's text records are, or
numbers; a NULL is an empty text. Files are opened with ``pyarrow.fs`` from the workers.
"""

from __future__ import annotations

import re
import uuid
import zipfile
from dataclasses import dataclass
from typing import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from keyedit.functions import fixed
from keyedit.operators.preview import column_widths

FORMAT = "keyedit_xlsx"
_TEMPORARY = "_temporary"
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_NOT_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")
_ESCAPED = re.compile("_x([0-9A-Fa-f]{4})_")
_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.FloatType, T.DoubleType)


def _cell_text(value: str) -> str:
    """Text as XML: characters that XML can't hold in the format's own spelling ``_xHHHH_``."""
    value = _ESCAPED.sub(r"_x005F_x\1_", value)
    value = _NOT_XML.sub(lambda m: f"_x{ord(m[0]):04X}_", value)
    return escape(value).replace("\r", "_x000D_")


class WorkbookFile:
    """One workbook written front to back."""

    def __init__(self, stream, names: list[str], numbers: list[bool], widths: list[int], sheet: str, rows_per_sheet: int):
        self.zip = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED, compresslevel=4)
        self.names, self.numbers, self.widths = names, numbers, widths
        self.sheet, self.limit = sheet, rows_per_sheet
        self.sheets, self.out, self.row = 0, None, 0

    def _open_sheet(self) -> None:
        self._close_sheet()
        self.sheets += 1
        self.out = self.zip.open(f"xl/worksheets/sheet{self.sheets}.xml", "w", force_zip64=True)
        columns = "".join(f'<col min="{i}" max="{i}" width="{w}" customWidth="1"/>' for i, w in enumerate(self.widths, 1))
        header = "".join(f'<c t="inlineStr" s="1"><is><t xml:space="preserve">{_cell_text(n)}</t></is></c>' for n in self.names)
        self.out.write(f'{_HEAD}<worksheet xmlns="{_MAIN}"><cols>{columns}</cols><sheetData><row r="1">{header}</row>'.encode())
        self.row = 1

    def _close_sheet(self) -> None:
        if self.out is not None:
            self.out.write(b"</sheetData></worksheet>")
            self.out.close()
            self.out = None

    def write(self, batch: pa.RecordBatch) -> None:
        for values in zip(*(c.to_pylist() for c in batch.columns)):
            if self.out is None or self.row >= self.limit:
                self._open_sheet()
            self.row += 1
            cells = []
            for value, number in zip(values, self.numbers):
                if number and value is not None and value == value and abs(value) != float("inf"):
                    cells.append(f"<c><v>{value!r}</v></c>")
                else:
                    text = "" if value is None else _cell_text(str(value))
                    cells.append(f'<c t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>')
            self.out.write(f'<row r="{self.row}">{"".join(cells)}</row>'.encode())

    def close(self) -> None:
        self._close_sheet()
        many = range(1, self.sheets + 1)
        name = escape(self.sheet, {'"': "&quot;"})
        put = self.zip.writestr
        put("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>' + "".join(
            f'<sheet name="{name}{"" if i == 1 else f" ({i})"}" sheetId="{i}" r:id="rId{i}"/>' for i in many) + "</sheets></workbook>")
        put("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships">' + "".join(
            f'<Relationship Id="rId{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in many)
            + f'<Relationship Id="rId{self.sheets + 1}" Type="{_REL}/styles" Target="styles.xml"/></Relationships>')
        put("xl/styles.xml", f'{_HEAD}<styleSheet xmlns="{_MAIN}"><fonts count="2"><font/><font><b/>'
            f'<color rgb="FF{fixed.EXPORT_HEADER_TEXT}"/></font></fonts><fills count="3"><fill><patternFill patternType="none"/></fill>'
            f'<fill><patternFill patternType="gray125"/></fill><fill><patternFill patternType="solid"><fgColor '
            f'rgb="FF{fixed.EXPORT_HEADER_FILL}"/></patternFill></fill></fills><borders count="1"><border/></borders>'
            '<cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" fillId="2" applyFont="1" '
            'applyFill="1" applyAlignment="1"><alignment horizontal="center" vertical="center"/></xf></cellXfs></styleSheet>')
        put("_rels/.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" '
            f'Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        put("[Content_Types].xml", f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" '
            'ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
            f'<Override PartName="/xl/workbook.xml" ContentType="{_TYPE}.sheet.main+xml"/>'
            f'<Override PartName="/xl/styles.xml" ContentType="{_TYPE}.styles+xml"/>' + "".join(
                f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{_TYPE}.worksheet+xml"/>' for i in many) + "</Types>")
        self.zip.close()


def _files(path: str) -> tuple[pafs.FileSystem, str]:
    path = re.sub("^file:/+", "/", path)
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _clear(fs: pafs.FileSystem, root: str, job: str) -> None:
    folder = f"{root}/{_TEMPORARY}/{job}"
    if fs.get_file_info(folder).type != pafs.FileType.NotFound:
        fs.delete_dir(folder)
    above = f"{root}/{_TEMPORARY}"
    if (fs.get_file_info(above).type != pafs.FileType.NotFound and not fs.get_file_info(pafs.FileSelector(above))):
        fs.delete_dir(above)


@dataclass
class Part(WriterCommitMessage):
    file: str | None
    rows: int


class WorkbookWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.job = options["path"].rstrip("/"), options["job"]
        self.sheet, self.limit = options["sheet"], int(options["rows_per_sheet"])
        self.widths = [int(w) for w in options["widths"].split(",")]
        self.names = schema.names
        self.numbers = [isinstance(f.dataType, _NUMBERS) for f in schema.fields]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        context, rows, book, stream = TaskContext.get(), 0, None, None
        name = f"part-{context.partitionId():05d}.xlsx"
        fs, root = _files(self.path)
        # a folder for each attempt: one that is repeated never shares a file with the first
        folder = f"{root}/{_TEMPORARY}/{self.job}/{context.taskAttemptId()}"
        for batch in iterator:
            if batch.num_rows and book is None:
                # the job's folder is gone once the job is aborted: a task that is killed late makes no new one
                fs.create_dir(folder, recursive=False)
                stream = fs.open_output_stream(f"{folder}/{name}")
                book = WorkbookFile(stream, self.names, self.numbers, self.widths, self.sheet, self.limit)
            if batch.num_rows:
                book.write(batch)
                rows += batch.num_rows
        if book is not None:
            book.close()
            stream.close()
        return Part(f"{folder}/{name}" if rows else None, rows)

    def commit(self, messages) -> None:
        fs, root = _files(self.path)
        for m in messages:
            if m is not None and m.file:
                fs.move(m.file, f"{root}/{m.file.rsplit('/', 1)[1]}")
        _clear(fs, root, self.job)
        if any(m is not None and m.file for m in messages):
            fs.open_output_stream(f"{root}/_SUCCESS").close()

    def abort(self, messages) -> None:
        _clear(*_files(self.path), self.job)


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: T.StructType, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(self.options, schema)


def export_workbook(df: DataFrame, path: str, sheet: str = fixed.EXPORT_SHEET, widths: list[int] | None = None,
                    rows_per_sheet: int = fixed.SHEET_ROWS) -> None:
    """Write ``df`` as a folder of workbooks, one for each task with rows; nothing to export is an error.

    Column widths are those of ``preview.column_widths`` over the whole table unless given.
    """
    if not 2 <= rows_per_sheet <= fixed.SHEET_ROWS:
        raise ValueError(f"a sheet has 2 to {fixed.SHEET_ROWS} rows")
    spark = df.sparkSession
    fs, root = _files(path)
    if fs.get_file_info(root).type != pafs.FileType.NotFound:
        raise ValueError(f"{path} exists")
    if df.isEmpty():
        raise ValueError("no records to export")
    if widths is None:
        widths = [r["width"] for r in column_widths(df).orderBy("ordinal").collect()]
    spark.dataSource.register(WorkbookSource)
    cells = [F.col(f"`{f.name}`") if isinstance(f.dataType, _NUMBERS) else F.col(f"`{f.name}`").cast("string").alias(f.name)
             for f in df.schema.fields]
    job = uuid.uuid4().hex
    fs.create_dir(f"{root}/{_TEMPORARY}/{job}", recursive=True)
    try:
        (df.select(*cells).write.format(FORMAT).mode("append").option("job", job).option("sheet", sheet)
         .option("rows_per_sheet", rows_per_sheet).option("widths", ",".join(map(str, widths))).save(path))
    except Exception:
        _clear(fs, root, job)       # what a task wrote while the job was being aborted
        raise
