"""Helpers the training-data operators share: scratch tables, let-bindings, tokens.

Text conventions used throughout this subpackage
  - a null text counts as the empty text;
  - white space is the six ASCII blanks ``[\\x20\\x09-\\x0D]``; a word is a
    maximal run of anything else;
  - lower-casing touches A-Z only.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from refinery.session import checkpoint_dir

BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = "[ \\x09-\\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``.

    The optimiser may inline a column into every place that reads it; a lambda
    variable is always bound once.
    """
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text as an array; empty for null, empty or blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return let(trimmed, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, BLANK_RUN)))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that the frame does not use yet (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a shared folder, for reads and writes inside tasks."""
    return pafs.FileSystem.from_uri(uri)


class Scratch:
    """Tables in the shared checkpoint folder that cut a plan's lineage.

    ``table`` writes a frame as Parquet and returns it reread, so a lost
    executor costs at most the tasks it was running.  ``drop`` removes tables
    that a later one has replaced; what a returned frame still reads must stay.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def folder(self, name: str) -> str:
        """A new shared folder for files that tasks write themselves, as a full URI."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        return re.sub("^file:/+", "file:///", fs.makeQualified(path).toString())

    def table(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        path = self.path(name)
        df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame | None) -> None:
        for df in frames:
            path = getattr(df, "_scratch_path", None)
            if path:
                jvm = self.spark._jvm
                target = jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
                df._scratch_path = None


def dense_rank(stored: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Number the rows of a written table that carries ``pos`` (``monotonically_increasing_id`` at its writing).

    Adds ``rank`` (from 0, in the order of ``pos``, within ``group``), ``n`` (rows of the group)
    and ``first`` (its smallest ``pos``).  A group must not come back in ``pos`` after another one has
    begun in the same partition: sort by it, or give none.  Only one row per group and partition is
    aggregated and joined back; no window runs over the rows themselves.
    """
    group = group or []
    part = F.shiftright("pos", 33).alias("_part")
    whole = Window.partitionBy(*(f"_g{i}" for i in range(len(group))))
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = (stored.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), part, "pos")
            .groupBy(*(f"_g{i}" for i in range(len(group))), "_part")
            .agg(F.min("pos").alias("_lo"), F.count("*").alias("_size"))
            .select("*", (F.coalesce(F.sum("_size").over(before), F.lit(0)) - F.col("_lo")).alias("_shift"),
                    F.sum("_size").over(whole).alias("n"), F.min("_lo").over(whole).alias("first"))
            .withColumnRenamed("_part", "_p"))
    on = F.shiftright(stored["pos"], 33) == runs["_p"]
    for i, g in enumerate(group):
        on &= stored[g].eqNullSafe(runs[f"_g{i}"])
    return stored.join(runs, on).select(*(stored[c] for c in stored.columns), (stored["pos"] + runs["_shift"]).alias("rank"),
                                        runs["n"], runs["first"])
