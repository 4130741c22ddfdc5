"""Column profile of a table, composed of the counting operators.

Each part is its own small result frame; the scalar parts (nulls, distinct
counts, describe) are single aggregate passes, the categorical parts one
``groupBy`` per column with partial aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refinery.operators import counts


def profile(df: DataFrame, categorical: Sequence[str] = (), numeric: Sequence[str] = (),
            lists: Sequence[str] = (), top_k: int = 40, approx_distinct: bool = False) -> dict[str, DataFrame]:
    """Null/non-null/distinct counts of every column, describe() of numeric columns,
    value counts and shares (with and without nulls) and top-k coverage of
    categorical columns, item counts and distinct items of list columns, and
    the mode of each categorical column."""
    out: dict[str, DataFrame] = {"nulls": counts.null_profile(df, approx=approx_distinct)}
    if numeric:
        out["describe"] = counts.describe(df, list(numeric))
    for c in categorical:
        out[f"{c}:counts"] = counts.value_counts(df, c)
        out[f"{c}:shares"] = counts.value_shares(df, c)
        out[f"{c}:shares_with_null"] = counts.value_shares(df, c, dropna=False)
        out[f"{c}:top_{top_k}"] = counts.top_k_share(df, c, top_k)
    if categorical:
        # Mode per column from its distributed frequency table (top-1, ties -> smallest).
        modes = []
        for c in categorical:
            top = (df.filter(F.col(f"`{c}`").isNotNull()).groupBy(F.col(f"`{c}`").alias("v"))
                   .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc("v")).limit(1).collect())
            modes.append((c, None if not top else str(top[0]["v"])))
        out["modes"] = df.sparkSession.createDataFrame(modes, "column string, mode string")
    for c in lists:
        items = counts.item_counts(df, c)
        out[f"{c}:item_counts"] = items
        out[f"{c}:distinct_items"] = counts.distinct_items(df, c).agg(F.count(F.lit(1)).alias("distinct_items"))
    return out


PROFILE_SCHEMA = T.StructType([T.StructField("column", T.StringType()), T.StructField("metric", T.StringType()),
                               T.StructField("value", T.DoubleType())])


def profile_long(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Scalar profile metrics as ``(column, metric, value)`` rows in one aggregate pass."""
    parts = []
    for c in list(numeric) + list(categorical):
        col = F.col(f"`{c}`")
        parts += [F.struct(F.lit(c).alias("column"), F.lit("nulls").alias("metric"),
                           F.count_if(col.isNull()).cast("double").alias("value")),
                  F.struct(F.lit(c).alias("column"), F.lit("non_nulls").alias("metric"),
                           F.count(col).cast("double").alias("value")),
                  F.struct(F.lit(c).alias("column"), F.lit("distinct").alias("metric"),
                           F.count_distinct(col).cast("double").alias("value"))]
    for c in numeric:
        x = F.col(f"`{c}`").cast("double")
        for name, agg in [("mean", F.avg(x)), ("std", F.stddev_samp(x)), ("min", F.min(x)), ("max", F.max(x))]:
            parts.append(F.struct(F.lit(c).alias("column"), F.lit(name).alias("metric"), agg.alias("value")))
    return df.agg(F.array(*parts).alias("_p")).select(F.inline("_p"))
