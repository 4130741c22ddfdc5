"""Writers: CSV/Parquet sinks and whole-catalog export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Parquet, overwritten atomically per job."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_csv(df: DataFrame, path: str, compression: str | None = None) -> None:
    """Header CSV (lists must be rendered to text first, CSV has no arrays)."""
    w = df.write.mode("overwrite").option("header", True).option("escape", '"')
    if compression:
        w = w.option("compression", compression)
    w.csv(path)


def export_tables(tables: dict[str, DataFrame], out_dir: str, single_file: bool = False,
                  max_records_per_file: int | None = None) -> list[str]:
    """Tables to gzip header CSV, one folder per table.

    ``single_file`` reproduces one file per table (one writer task); by default
    each table is written in parallel, bounded by ``max_records_per_file``.
    """
    written = []
    for name, df in tables.items():
        if single_file:
            df = df.coalesce(1)
        w = df.write.mode("overwrite").option("header", True).option("escape", '"').option("compression", "gzip")
        if max_records_per_file:
            w = w.option("maxRecordsPerFile", max_records_per_file)
        path = f"{out_dir}/{name}"
        w.csv(path)
        written.append(path)
    return written


def export_catalog(spark: SparkSession, database: str, out_dir: str, single_file: bool = False,
                   max_records_per_file: int | None = None) -> list[str]:
    """Every table of a database, see :func:`export_tables`."""
    tables = {t.name: spark.table(f"{database}.{t.name}") for t in spark.catalog.listTables(database)}
    return export_tables(tables, out_dir, single_file, max_records_per_file)


def write_keyed(df: DataFrame, table: str, key: str, buckets: int, path: str | None = None) -> DataFrame:
    """A table of the session's catalog, bucketed and sorted by ``key``, and the frame that reads it.

    Tables written with equal key types and numbers of buckets join and group by
    their keys without moving rows: each bucket meets its like in one task.  The
    rows move once, in the write, one file a bucket; choose ``buckets`` for files
    of some 100 MB to 1 GB.  A key that holds a large share of the rows makes its
    bucket as large.  ``path`` is a shared folder for the files, else the warehouse.
    """
    w = (df.repartition(buckets, F.col(f"`{key}`")).write.mode("overwrite").format("parquet")
         .bucketBy(buckets, key).sortBy(key))
    (w.option("path", path) if path else w).saveAsTable(table)
    return df.sparkSession.table(table)
