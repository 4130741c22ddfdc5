"""Index encoders for columns with many values (E4, E5 without a column per value).

A column per value needs every value on the driver to name it.  Here a value is
a place in one sparse vector instead: the fitted model is a table of
``(value, index)``, in frequency order with ties by value, and rows get the
sorted array of their places.  No value reaches the driver, at any number of
values; only the width of the vector does.

  - scalars and lists alike: null, or a null item, holds no value;
  - ``threshold``: the coverage cut of the encoder with columns (exclusive for
    scalars, inclusive for lists); ``width - 1`` is then the place of everything
    else, null scalars included, as ``{col}_others`` is there;
  - values unseen at the fit have no place without a threshold.
"""

from __future__ import annotations

from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refinery.features.base import ArtifactPersistence, Encoder, EncoderModel, q
from refinery.operators.blocked import number_rows
from refinery.operators.counts import coverage_select, item_counts, value_counts
from refinery.operators.joins import checked_broadcast
from refinery.session import cut_lineage


class IndexEncoder(Encoder):
    """``{col}_indices``, the sorted places of a row's values in a vector of ``width``."""

    threshold = Param(Params._dummy(), "threshold", "coverage threshold", typeConverter=TypeConverters.toFloat)

    def __init__(self, column: str | None = None, threshold: float | None = None):
        super().__init__()
        if threshold is not None and not 0 <= threshold <= 1:
            raise ValueError(f"a coverage threshold lies in [0, 1], not {threshold}")
        if column:
            self._set(column=column)
        if threshold is not None:
            self._set(threshold=threshold)

    def _fit_column(self, df, col):
        lists = isinstance(df.schema[col].dataType, T.ArrayType)
        counts = item_counts(df, col) if lists else value_counts(df, col)
        freq = cut_lineage(counts.filter(F.col("value").isNotNull()))
        cut = self.getOrDefault(self.threshold) if self.isSet(self.threshold) else None
        # a zero cut over lists keeps one item and has no place for the others, as with columns
        others = cut is not None and not (lists and cut == 0)
        kept = coverage_select(freq, cut, inclusive=lists)
        table = number_rows(kept, [F.desc("count"), F.asc("value")]).select("value", "index")
        model = IndexModel(column=col, width=table.count() + others, others=others)
        model.table = table
        return model


class IndexModel(ArtifactPersistence, EncoderModel):
    """The ``(value, index)`` table is saved as Parquet next to the params."""

    ARTIFACTS = {"table": "frame"}
    width = Param(Params._dummy(), "width", "length of the vector", typeConverter=TypeConverters.toInt)
    others = Param(Params._dummy(), "others", "the last place is that of all other values",
                   typeConverter=TypeConverters.toBoolean)
    table: DataFrame | None = None

    def __init__(self, column=None, width=None, others=None):
        super().__init__()
        self._set(**{k: v for k, v in dict(column=column, width=width, others=others).items() if v is not None})

    def _place(self, found: Column) -> Column:
        return F.coalesce(found, F.lit(self.getOrDefault(self.width) - 1).cast("long")) \
            if self.getOrDefault(self.others) else found

    def _transform_column(self, df, col):
        lookup = checked_broadcast(self.table.select(F.col("value").alias("__iv"), F.col("index").alias("__ix")))
        out = f"{col}_indices"
        if not isinstance(df.schema[col].dataType, T.ArrayType):
            joined = df.join(lookup, F.col(q(col)) == F.col("__iv"), "left")
            return joined.withColumn(out, F.array_compact(F.array(self._place(F.col("__ix"))))).drop(col, "__iv", "__ix")
        # Each distinct list is looked up once, whatever the number of rows that hold it.
        # Null lists have no places, and neither has a list of nulls.
        items = F.array_distinct(F.array_compact(F.col(q(col))))
        held = df.withColumn("__items", F.array_sort(F.coalesce(items, F.array().cast(df.schema[col].dataType))))
        lists = held.select("__items").distinct()
        found = (lists.select("__items", F.explode("__items").alias("__v"))
                 .join(lookup, F.col("__v") == F.col("__iv"), "left")
                 .groupBy("__items").agg(F.array_sort(F.collect_set(self._place(F.col("__ix")))).alias(out)))
        joined = held.join(found, "__items", "left").drop("__items", col)
        return joined.withColumn(out, F.coalesce(F.col(out), F.array().cast("array<bigint>")))

    def fitted_params(self):
        return {"width": self.getOrDefault(self.width), "others": self.getOrDefault(self.others),
                "unique_values": "table"}

    def report_tables(self):
        return {"unique_values": self.table}
