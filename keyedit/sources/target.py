"""Target tables: parquet paths, catalog tables, JDBC tables, and their metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyedit.operators.checks import target_columns


def read_target(spark: SparkSession, source: str, fmt: str = "parquet") -> DataFrame:
    """A target by path (``fmt`` file source) or, with ``fmt='table'``, by catalog name."""
    if fmt == "table":
        return spark.table(source)
    return spark.read.format(fmt).load(source)


def key_values(target: DataFrame, key_column: str) -> DataFrame:
    """The key column alone (column pruning reads only it); NULLs and repeats kept."""
    name = next(c for c in target.columns if c.lower() == key_column.lower())
    return target.select(F.col(f"`{name}`"))


def list_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Tables of a database sorted by name (catalog metadata only)."""
    rows = [(t.name, t.database or "", t.tableType, t.isTemporary)
            for t in spark.catalog.listTables(database)]
    df = spark.createDataFrame(rows, "name string, database string, table_type string, is_temporary boolean")
    return df.orderBy("name")


def table_exists(spark: SparkSession, name: str, database: str | None = None) -> bool:
    return spark.catalog.tableExists(name, database) if database else spark.catalog.tableExists(name)


def columns_of(spark: SparkSession, target: DataFrame) -> DataFrame:
    """``ordinal, column_name (upper case), data_type, nullable`` in column order."""
    return target_columns(spark, target.schema)


def read_jdbc(spark: SparkSession, url: str, table: str, *, partition_column: str | None = None,
              lower_bound: int | None = None, upper_bound: int | None = None,
              num_partitions: int | None = None, fetchsize: int = 10000, **options) -> DataFrame:
    """A database table read in parallel ranges of ``partition_column``.

    Credentials come in ``options`` (``user``, ``password``) at run time and
    are never stored. Filters and column selections on the result are pushed
    into the generated SQL by Spark.
    """
    r = (spark.read.format("jdbc").option("url", url).option("dbtable", table)
         .option("fetchsize", fetchsize))
    if partition_column:
        r = (r.option("partitionColumn", partition_column).option("lowerBound", lower_bound)
             .option("upperBound", upper_bound).option("numPartitions", num_partitions or 8))
    for k, v in options.items():
        r = r.option(k, v)
    return r.load()
