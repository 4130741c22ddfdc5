"""Applying fitted encoder models to streaming DataFrames.

The reference has no streaming.  Encoder models are pure projections (the
frequency model is a stream-static join), so a model fitted in batch can score
a stream unchanged: ``readStream`` -> ``model.transform`` -> ``writeStream``.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def read_parquet_stream(spark: SparkSession, directory: str, schema: T.StructType, glob: str | None = None,
                        max_files_per_trigger: int | None = None) -> DataFrame:
    """Files arriving in ``directory`` as a stream (schema is required for file streams)."""
    r = spark.readStream.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(directory)


def score_stream(model: PipelineModel, stream: DataFrame) -> DataFrame:
    """Apply a fitted chain to a streaming frame."""
    return model.transform(stream)


def write_stream(df: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append to Parquet with a checkpoint (exactly-once file sink; restart-safe)."""
    w = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint) \
        .outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()
