"""Readers: typed CSV scans, keyed-table loading, header probes, file manifests."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refinery.functions.text import parse_list_literal
from refinery.operators.dedup import latest_per_key, row_dedup
from refinery.operators.tables import cast_key, clean_null_markers, require_not_null


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str,
             repartition: int | None = None) -> DataFrame:
    """Header CSV with an explicit schema (no inference), quoted multi-line fields.

    Gzip files cannot be split: one task reads each file, so pass
    ``repartition`` to spread the rows before heavy work.
    """
    df = (spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"')
          .option("mode", "FAILFAST").csv(path))
    return df.repartition(repartition) if repartition else df


def read_csv_with_lists(spark: SparkSession, path: str, schema: T.StructType | str, list_cols: Iterable[str]
                        ) -> DataFrame:
    """CSV whose list columns hold list literals; they are parsed to arrays."""
    df = read_csv(spark, path, schema)
    return df.withColumns({c: parse_list_literal(F.col(c)) for c in list_cols})


def load_keyed_table(df: DataFrame, key: str, key_type: str | None = None, version_col: str | None = None,
                     mode: str = "latest_per_key", null_markers: bool = True) -> DataFrame:
    """Null markers -> null, drop null keys, cast the key, de-duplicate.

    ``mode='latest_per_key'`` keeps the newest row per key (documented intent);
    ``'row_dedup'`` drops rows equal on all non-key columns (the reference's code).
    """
    if null_markers:
        df = clean_null_markers(df, exclude=[key])
    df = require_not_null(df, key)
    if key_type:
        df = cast_key(df, key, key_type)
    if version_col:
        if mode == "latest_per_key":
            tie = [c for c in df.columns if c not in (key, version_col) and _orderable(df.schema[c].dataType)]
            df = latest_per_key(df, key, version_col, tie_break=tie)
        elif mode == "row_dedup":
            df = row_dedup(df, key, version_col)
        else:
            raise ValueError(f"unknown mode {mode!r}")
    return df


def _orderable(t: T.DataType) -> bool:
    return not isinstance(t, (T.MapType,))


PROBE_SCHEMA = T.StructType([
    T.StructField("table", T.StringType()), T.StructField("ordinal", T.IntegerType()),
    T.StructField("column", T.StringType()), T.StructField("type", T.StringType()),
    T.StructField("error", T.StringType()),
])


def probe_schemas(spark: SparkSession, files: Sequence[tuple[str, str]], fmt: str = "parquet") -> DataFrame:
    """S3: columns of each file from its header/footer; a failing file is recorded, not fatal.

    Only metadata is read (the CSV header line or the Parquet footer).
    """
    rows = []
    for table, path in files:
        try:
            reader = spark.read.option("header", True) if fmt == "csv" else spark.read
            schema = reader.format(fmt).load(path).schema
            rows += [(table, i, f.name, f.dataType.simpleString(), None) for i, f in enumerate(schema.fields)]
        except Exception as e:  # noqa: BLE001 -- recorded per file, the probe goes on
            rows.append((table, None, None, None, str(e).splitlines()[0][:500]))
    return spark.createDataFrame(rows, PROBE_SCHEMA)


def file_manifest(spark: SparkSession, root: str, extensions: Sequence[str] = (), name_contains: str = ""
                  ) -> DataFrame:
    """Files under ``root`` (recursive) with size and modification time, sorted by path.

    Extension match is case-insensitive; file contents are never read (the
    binary source prunes the ``content`` column).
    """
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
          .select("path", "length", "modificationTime"))
    name = F.element_at(F.split("path", "/"), -1)
    if extensions:
        low = F.lower(name)
        cond = None
        for ext in extensions:
            c = low.endswith(ext.lower() if ext.startswith(".") else "." + ext.lower())
            cond = c if cond is None else cond | c
        df = df.filter(cond)
    if name_contains:
        df = df.filter(name.contains(name_contains))
    return df.withColumn("name", name).orderBy("path")


def read_columns(spark: SparkSession, path: str, cols: Sequence[str], fmt: str = "parquet",
                 schema: T.StructType | str | None = None) -> DataFrame:
    """Column-pruned scan (pruning reaches the reader)."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path).select(*cols)
