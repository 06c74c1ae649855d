"""Change-set sources: delimited text, JSON lines, parquet.

A change set is bound by position, so every source keeps the file's column
order. Cells stay text unless the format is typed (parquet). The sheet row
number (``row_num``, first data row = 2) is either a column of the source or
derived from the record's position in its file (counts and offsets per piece of
a file; no window over the rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyedit.functions import fixed
from keyedit.operators.joins import keyed_join
from keyedit.operators.staging import ROW_NUM
from keyedit.session import ensure_checkpoint_dir


_MAX_BROADCAST_BLOCKS = 1_000_000
LINES_PER_BLOCK = 100_000       # lines of a file that one task puts in order
MAX_RECORD_LINES = 10_000       # lines of one record, beyond which a quote must have been left open


def with_row_numbers(df: DataFrame, first: int = fixed.FIRST_DATA_ROW, with_path: bool = False,
                     mark: Column | None = None) -> DataFrame:
    """Add ``row_num`` = position in its own file + ``first``, all on the JVM.

    ``df`` must be a file scan. A scan task reads its pieces of files one after
    another, so the rows of a piece (file and block start) are consecutive in
    ``monotonically_increasing_id``; how Spark packs pieces into tasks does not
    matter. Counts per piece (a small table, one row per piece of a file) give
    each piece's offset with a running sum within its file. ``with_path`` adds
    the file as ``path``: row numbers repeat across the files of a folder. ``mark``
    adds ``first_marked``, the number of the first row of the file for which it holds.
    """
    cols = df.columns
    base = df.select(F.col("_metadata.file_path").alias("__f"), F.col("_metadata.file_block_start").alias("__b"),
                     F.monotonically_increasing_id().alias("__m"), *cols)
    counts = base.groupBy("__f", "__b").agg(
        F.count(F.lit(1)).alias("__n"), F.min("__m").alias("__min"),
        F.min(F.when(F.lit(False) if mark is None else mark, F.col("__m"))).alias("__marked"))
    before = Window.partitionBy("__f").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__f", "__b", "__min", F.coalesce(F.sum("__n").over(before), F.lit(0)).cast("long").alias("__off"))
    if mark is not None:
        marked = F.col("__off") + F.col("__marked") - F.col("__min") + F.lit(first)
        offsets = (counts.withColumn("__off", F.coalesce(F.sum("__n").over(before), F.lit(0)).cast("long"))
                   .select("__f", "__b", "__min", "__off",
                           F.min(marked).over(Window.partitionBy("__f")).cast("long").alias("first_marked")))
    # one offset row per piece; a piece has a task of its own or shares one, so planning knows the bound (no job)
    n_parts = df.rdd.getNumPartitions()
    side = F.broadcast(offsets) if n_parts <= _MAX_BROADCAST_BLOCKS else offsets
    row_num = (F.col("__off") + F.col("__m") - F.col("__min") + F.lit(first)).cast("long")
    path = [F.col("__f").alias("path")] if with_path else []
    path += [F.col("first_marked")] if mark is not None else []
    return base.join(side, ["__f", "__b"]).select(row_num.alias(ROW_NUM), *path, *[F.col(f"`{c}`") for c in cols])


def _numbered_csv(spark: SparkSession, path: str, schema, with_path: bool, options: dict) -> DataFrame:
    """CSV rows with the numbers of their lines: blank lines count, a file's header is its first line that is not blank."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    named = reader.option("header", "true").option("inferSchema", "false").options(**options).csv(path)
    filled = F.col("value").rlike(r"[^\x00-\x20]")
    lines = with_row_numbers(spark.read.text(path), first=1, with_path=True, mark=filled)
    cells = lines.where((F.col(ROW_NUM) > F.col("first_marked")) & filled).select(
        ROW_NUM, "path", F.from_csv("value", ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(named.schema.fields)),
                                    {"mode": "PERMISSIVE", **{k: str(v) for k, v in options.items()}}).alias("r"))
    return cells.select(ROW_NUM, *(["path"] if with_path else []),
                        *[F.col(f"r.c{i}").alias(c) for i, c in enumerate(named.columns)])


def _records(spark: SparkSession, path: str, quote: str, max_lines: int) -> DataFrame:
    """``row_num, path, value``: the records of CSV files whose cells may hold line breaks.

    A line stands inside a quoted cell when an odd number of quotes goes before it in its file
    (a doubled quote adds two). Lines are numbered in parallel, taken in blocks of
    ``LINES_PER_BLOCK``; the blocks' parities are added up over one row per block, and so is the last
    record begun in the blocks before. Only then is a record put together, from its own lines.
    """
    lines = with_row_numbers(spark.read.text(path), first=1, with_path=True)
    block = F.floor(F.col(ROW_NUM) / LINES_PER_BLOCK).alias("__b")
    lines = lines.select("path", block, ROW_NUM, "value", (F.length("value") - F.length(
        F.replace("value", F.lit(quote), F.lit("")))).alias("__q"))
    before = Window.partitionBy("path").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)

    def with_blocks(rows: DataFrame, per_block: DataFrame) -> DataFrame:
        return keyed_join(rows, per_block, ["path", "__b"], "left")
    odd = lines.groupBy("path", "__b").agg(F.sum("__q").alias("__n")).select(
        "path", "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("path", "__b").orderBy(ROW_NUM)
    so_far = F.coalesce(F.sum("__q").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("__before")
    begun = with_blocks(lines, odd).withColumn("__begins", F.when(so_far % 2 == 0, F.col(ROW_NUM)))
    begun = begun.withColumn("__start", F.max("__begins").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    ensure_checkpoint_dir(spark)
    begun = begun.select("path", "__b", ROW_NUM, "value", "__begins", "__start").checkpoint()
    last = begun.groupBy("path", "__b").agg(F.max("__begins").alias("__n")).select(
        "path", "__b", F.max("__n").over(before).alias("__earlier"))
    placed = with_blocks(begun, last).select("path", F.coalesce("__start", "__earlier").alias("__start"), ROW_NUM, "value")
    longest = placed.groupBy("path", "__start").count().orderBy(F.desc("count")).first()
    if longest and longest["count"] > max_lines:
        raise ValueError(f"a record of {longest['count']} lines starts at line {longest['__start']} of {longest['path']}: "
                         "a quote is not closed")
    return placed.groupBy("path", "__start").agg(F.array_sort(F.collect_list(F.struct(ROW_NUM, "value"))).alias("__l")).select(
        F.col("__start").alias(ROW_NUM), "path", F.array_join(F.col("__l.value"), "\n").alias("value"))


def _multi_line_csv(spark: SparkSession, path: str, schema, with_path: bool, options: dict, max_lines: int) -> DataFrame:
    """CSV rows with the number of each record's first line; line breaks inside quotes belong to their cell."""
    lower = {k.lower(): v for k, v in options.items()}
    quote = str(lower.get("quote", '"'))
    options = {**{k: v for k, v in options.items() if k.lower() not in ("multiline", "escape")}, "escape": quote}
    reader = spark.read if schema is None else spark.read.schema(schema)
    named = reader.option("header", "true").option("inferSchema", "false").option("multiLine", "true").options(**options).csv(path)
    records = _records(spark, path, quote, max_lines)
    filled = records.where(F.col("value").rlike(r"[^\x00-\x20]"))
    header = filled.groupBy("path").agg(F.min(ROW_NUM).alias("__header"))
    rows = keyed_join(filled, header, ["path"], "inner").where(F.col(ROW_NUM) > F.col("__header"))
    cells = rows.select(ROW_NUM, "path", F.from_csv(
        "value", ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(named.schema.fields)),
        {"mode": "PERMISSIVE", **{k: str(v) for k, v in options.items()}}).alias("r"))
    return cells.select(ROW_NUM, *(["path"] if with_path else []),
                        *[F.col(f"r.c{i}").alias(c) for i, c in enumerate(named.columns)])


def read_changeset(spark: SparkSession, path: str, fmt: str = "csv", row_num_col: str | None = None,
                   schema=None, with_path: bool = False, **options) -> DataFrame:
    """Read a change set; returns ``row_num`` followed by the data columns in file order.

    ``fmt``: ``csv`` (header line, every cell as text, ragged rows padded with
    NULL), ``json`` (one object per line), ``parquet``. With ``row_num_col``
    the source already carries the sheet row. Binding is positional, so for
    ``json`` pass ``schema``: without it Spark infers the fields sorted by
    name, not in the order they were written.

    Without ``row_num_col`` rows are numbered by their place in their own file;
    ``with_path`` adds the file. For ``csv`` the number is the line's: blank lines
    count. With ``multiLine`` (quotes doubled inside cells, as spreadsheets write them) a record
    has the number of its first line; one of more than ``max_record_lines`` lines is an error,
    as its quote is hardly meant to stay open. (With another ``encoding`` or ``escape`` only records
    are counted.)
    """
    max_lines = int(options.pop("max_record_lines", MAX_RECORD_LINES))
    lower = {k.lower(): str(v).lower() for k, v in options.items()}
    if (fmt == "csv" and not row_num_col and lower.get("multiline") == "true" and not set(lower) & {"encoding", "charset", "header", "linesep"}
            and lower.get("escape", lower.get("quote", '"')) == lower.get("quote", '"')):
        return _multi_line_csv(spark, path, schema, with_path, options, max_lines)
    if fmt == "csv" and not row_num_col and not {k.lower() for k in options} & {"multiline", "encoding", "charset", "header", "linesep"}:
        return _numbered_csv(spark, path, schema, with_path, options)
    reader = spark.read if schema is None else spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", "true").option("inferSchema", "false").option("mode", "PERMISSIVE")
    for k, v in options.items():
        reader = reader.option(k, v)
    df = reader.format(fmt).load(path)
    if row_num_col:
        rest = [c for c in df.columns if c != row_num_col]
        return df.select(F.col(row_num_col).cast("long").alias(ROW_NUM), *rest)
    return with_row_numbers(df, with_path=with_path)


def header_names(df: DataFrame) -> list[str]:
    """The header cells of a change set (its data column names)."""
    return [c for c in df.columns if c != ROW_NUM]
