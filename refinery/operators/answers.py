"""J12/J13 + X4: a user's resolver whose answers are kept, so that no answered key is asked again.

The distinct open keys are numbered and dealt into batches.  A batch is asked up
to ``tries`` times with a pause in between; its answers are written as one file
of the answer table in a shared folder before the task goes on.  A task that runs
again, after a lost executor, finds its batch's file and does not ask.  A later
call reads the answer table first and asks only what it lacks; batches that failed
every time leave no file and are asked anew.

Defined results
  - keys are compared null-safe; a key with nulls is asked like any other;
  - an answer that is null, blank or quotes only is an answer: null, not asked again;
  - a batch that failed gives null answers and the last error's text, never a name;
  - two attempts of one task may both ask, if the first is still running when the second
    starts (speculation); one file wins, whole.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from refinery.functions.text import blank_to_null, display_name
from refinery.operators.blocked import number_rows
from refinery.session import cut_lineage

BATCH_ROWS = 1000
TRIES = 3
PAUSE_S = 1.0


def _folder(spark: SparkSession, path: str) -> str:
    """The folder, made if it is not there, as a full URI that tasks can open."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(place)
    uri = fs.makeQualified(place).toString()
    return "file://" + uri[len("file:"):] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def read_answers(spark: SparkSession, path: str, key_fields: Sequence[T.StructField]) -> DataFrame:
    """The answer table ``(keys, answer)`` as far as it goes; one row per key."""
    schema = T.StructType([*(T.StructField(f"k{i}", f.dataType) for i, f in enumerate(key_fields)),
                           T.StructField("answer", T.StringType())])
    rows = (spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
            .parquet(_folder(spark, path)))
    keys = [f"k{i}" for i in range(len(key_fields))]
    return rows.groupBy(*keys).agg(F.max("answer").alias("answer"))


def _same(left: DataFrame, keys: Sequence[str], right: DataFrame):
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond &= left[k].eqNullSafe(right[f"k{i}"])
    return cond


def resolve_resumable(residue: DataFrame, keys: Sequence[str], resolver: Callable[[pd.DataFrame], pd.Series], path: str,
                      out_col: str = "match", batch_rows: int = BATCH_ROWS, tries: int = TRIES,
                      pause_s: float = PAUSE_S) -> DataFrame:
    """``residue`` with ``out_col`` and ``resolve_error``, by the answer table at ``path`` and, where it lacks, the resolver.

    ``resolver`` gets a pandas frame of the key columns and returns one answer per row (None: unknown).
    """
    spark = residue.sparkSession
    fields = [residue.schema[k] for k in keys]
    numbered = [T.StructField(f"k{i}", f.dataType) for i, f in enumerate(fields)]
    kept = read_answers(spark, path, fields)
    distinct = residue.select(*keys).distinct()
    lacking = distinct.join(kept, _same(distinct, keys, kept), "left_anti")
    lacking = lacking.select(*(F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)))
    names = [f.name for f in numbered]
    dealt = number_rows(lacking, [F.col(c) for c in names], "_n").withColumn(
        "_batch", F.floor(F.col("_n") / F.lit(batch_rows)).cast("long"))
    root = f"{_folder(spark, path)}/run-{uuid.uuid4().hex}"
    stored = T.StructType([*numbered, T.StructField("answer", T.StringType())])
    out, arrow = T.StructType([*stored.fields, T.StructField("resolve_error", T.StringType())]), to_arrow_schema(stored)

    def ask(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_n").reset_index(drop=True)
        place = f"{root}/batch-{int(pdf['_batch'].iloc[0]):09d}.parquet"
        fs, file = pafs.FileSystem.from_uri(place)
        found = pdf[names].copy()
        if fs.get_file_info(file).type == pafs.FileType.File:
            found["answer"] = pq.read_table(file, filesystem=fs).column("answer").to_pylist()
            return found.assign(resolve_error=None)
        error = None
        for turn in range(tries):
            if turn:
                time.sleep(pause_s)
            try:
                asked = pdf[names].set_axis(list(keys), axis=1)
                answers = pd.Series(list(resolver(asked)), dtype=object)
                if len(answers) != len(found):
                    raise ValueError(f"{len(answers)} answers to {len(found)} keys")
                found["answer"] = [None if pd.isna(a) else str(a) for a in answers]
                break
            except Exception as e:  # noqa: BLE001 -- recorded per row
                error = str(e) or type(e).__name__
        else:
            return found.assign(answer=None, resolve_error=error)
        fs.create_dir(file.rpartition("/")[0], recursive=True)
        draft = f"{file}.{uuid.uuid4().hex}.tmp"
        pq.write_table(pa.Table.from_pandas(found, schema=arrow, preserve_index=False), draft, filesystem=fs)
        fs.move(draft, file)
        return found.assign(resolve_error=None)

    asked = cut_lineage(dealt.groupBy("_batch").applyInPandas(ask, out))
    every = kept.withColumn("resolve_error", F.lit(None).cast("string")).unionByName(asked)
    every = every.select(*names, display_name(blank_to_null(F.col("answer"))).alias("_answer"),
                         F.col("resolve_error").alias("_error"))
    joined = residue.join(every, _same(residue, keys, every), "left")
    return joined.select(*(residue[f"`{c}`"] for c in residue.columns), F.col("_answer").alias(out_col),
                         F.col("_error").alias("resolve_error"))
