"""Counting, shares, coverage cuts and column statistics.

Frequency tables are built with ``groupBy().count()`` (partial aggregation
map-side, so a hot value costs one row per task).  Running sums in frequency
order are distributed: the table is range-sorted, every partition sums its own
rows and starts from the total of the partitions before it.  One plan serves
every size.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refinery.operators.blocked import number_rows
from refinery.session import cut_lineage


def value_counts(df: DataFrame, col: str, dropna: bool = True) -> DataFrame:
    """``(value, count)`` in count-desc, value-asc order; nulls excluded unless ``dropna=False``."""
    c = F.col(f"`{col}`")
    src = df.filter(c.isNotNull()) if dropna else df
    return (src.groupBy(c.alias("value")).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), F.asc_nulls_last("value")))


def value_shares(df: DataFrame, col: str, dropna: bool = True) -> DataFrame:
    """``(value, count, share)``; share over non-null rows, or all rows with ``dropna=False``."""
    counts = cut_lineage(value_counts(df, col, dropna))  # read twice: for the total and for the result
    return counts.withColumn("share", F.col("count") / F.lit(float(max(total_count(counts), 1))))


def item_counts(df: DataFrame, col: str) -> DataFrame:
    """Multiplicity count of items across a list column (null lists skipped)."""
    items = df.select(F.explode(F.col(f"`{col}`")).alias("value"))
    return items.groupBy("value").agg(F.count(F.lit(1)).alias("count"))


def stacked_value_counts(df: DataFrame, cols: Sequence[str], dropna: bool = True) -> DataFrame:
    """Frequency tables of several columns in one pass: ``(column, value, count)``.

    Every column is cast to string and stacked, so all categorical fits share
    one scan and one shuffle.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value"))
                      for c in cols])
    stacked = df.select(F.inline(pairs))
    if dropna:
        stacked = stacked.filter(F.col("value").isNotNull())
    return stacked.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))


def stacked_item_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Item counts of several list columns in one pass: ``(column, value, count)``.

    Every list is tagged with its column name and the tagged lists are
    concatenated, so one ``inline`` and one shuffle serve all list encoders.
    """
    def tagger(name: str):
        # ``transform`` reads a 2-argument lambda as (element, index): bind the name by closure.
        return lambda x: F.struct(F.lit(name).alias("column"), x.cast("string").alias("value"))

    tagged = F.concat(*[F.transform(F.coalesce(F.col(f"`{c}`"), F.array()), tagger(c)) for c in cols])
    return df.select(F.inline(tagged)).groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))


def running_sum(df: DataFrame, order: Sequence[Column], amount: Column, out: str) -> DataFrame:
    """``df`` with the sum of ``amount`` over all rows up to and including each, in ``order``.

    No task sees more than one range of rows: a range sort, the total of every
    partition (as many rows as partitions), and a window inside each partition.
    The order must be total for a reproducible result.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(df.repartitionByRange(n, *order).sortWithinPartitions(*order)
                         .withColumn("_part", F.spark_partition_id()).withColumn("_amount", amount))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (placed.groupBy("_part").agg(F.sum("_amount").alias("_total"))
              .select("_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start")))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (placed.withColumn("_run", F.sum("_amount").over(inside))
            .join(F.broadcast(starts), "_part")  # one row per shuffle partition
            .withColumn(out, F.col("_start") + F.col("_run")).select(*df.columns, out))


def _frequency_order(value: str, count: str) -> list[Column]:
    return [F.desc(count), F.asc_nulls_last(value)]


def coverage_select(freq: DataFrame, threshold: float | None, inclusive: bool, value: str = "value",
                    count: str = "count", total: int | None = None) -> DataFrame:
    """Values kept by a cumulative-coverage cut over frequency-desc, value-asc order.

    ``inclusive`` (W2, lists): keep values up to and including the one whose
    running share first reaches ``threshold`` (threshold 0 keeps one value).
    Exclusive (W3, categories): keep values whose running share, including
    their own, stays strictly below ``threshold``.  ``threshold=None`` keeps all.
    Integer running counts are used, so a threshold of 1.0 never loses the
    tail to float drift.
    """
    return freq if threshold is None else _kept(freq, threshold, inclusive, value, count, total)[0]


def _kept(freq: DataFrame, threshold: float, inclusive: bool, value: str, count: str,
          total: int | None) -> tuple[DataFrame, int]:
    """The kept rows and the total.

    The cut is found on the histogram of counts: n counted items give at most
    sqrt(2 n) different counts.  All values above the cut's count stay, and only
    the values tied at it are put in order, if some of them stay and others go.
    """
    c = F.col(f"`{count}`")
    sizes = freq.groupBy(c.alias("c")).agg(F.count(F.lit(1)).alias("m"))
    higher = Window.orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, -1)
    classes = sizes.select("c", "m", F.coalesce(F.sum(F.col("c") * F.col("m")).over(higher), F.lit(0)).alias("before"))
    whole = F.lit(int(total)) if total is not None else F.sum(F.col("c") * F.col("m")).over(Window.partitionBy())
    classes = classes.withColumn("total", whole).withColumn("cut", F.lit(float(threshold)) * F.col("total").cast("double"))
    # values of a class whose running count stays below the cut; the estimate may be off by one
    guess = F.ceil((F.col("cut") - F.col("before")) / F.col("c")).cast("long")
    below = F.greatest(F.lit(0).cast("long"), F.array_max(F.filter(
        F.transform(F.sequence(F.lit(-2), F.lit(1)), lambda i: guess + i),
        lambda j: F.col("before") + j * F.col("c") < F.col("cut"))))
    if inclusive:  # one more: the value that reaches the cut; at least the very first one
        reached = (F.col("before") < F.col("cut")) | (F.col("before") == 0)
        below = F.when(reached, below + 1).otherwise(0)
    stay = classes.withColumn("stay", F.least(F.coalesce(below, F.lit(0)), F.col("m")))
    found = stay.agg(F.max("total").alias("total"), F.min(F.when(F.col("stay") == F.col("m"), F.col("c"))).alias("least"),
                     F.max(F.when((F.col("stay") > 0) & (F.col("stay") < F.col("m")), F.struct("c", "stay"))).alias("tied")).first()
    out = freq.filter(c >= F.lit(found["least"])) if found["least"] is not None else freq.limit(0)
    if found["tied"] is not None:
        ties = number_rows(freq.filter(c == F.lit(found["tied"]["c"])), [F.asc_nulls_last(f"`{value}`")], "_place")
        out = out.unionByName(ties.filter(F.col("_place") < found["tied"]["stay"]).drop("_place"))
    return out, int(found["total"] or 0)


def coverage_table(freq: DataFrame, threshold: float | None, inclusive: bool, value: str = "value",
                   count: str = "count", total: int | None = None) -> DataFrame:
    """The kept values with ``ratio`` and ``cumulative_ratio``."""
    if threshold is None:
        kept, whole = freq, total_count(freq, count) if total is None else total
    else:
        kept, whole = _kept(freq, threshold, inclusive, value, count, total)
    run = running_sum(kept, _frequency_order(value, count), F.col(f"`{count}`"), "_cum")  # the head of the order
    return run.select(*freq.columns, (F.col(f"`{count}`") / F.lit(whole)).alias("ratio"),
                      (F.col("_cum") / F.lit(whole)).alias("cumulative_ratio"))


def coverage_rows(freq: DataFrame, threshold: float | None, inclusive: bool, total: int | None = None,
                  value: str = "value", count: str = "count") -> tuple[list, int]:
    """The kept ``(value, count, ratio, cumulative_ratio)`` rows in frequency order, and the total.

    For encoders with one output column per kept value: the values are needed
    on the driver to name the columns, so their number is that of the columns.
    """
    if threshold is None:  # every value is kept, so every value is read
        everything = sorted(freq.select(value, count).collect(), key=lambda r: (-r[1], r[0] is None, r[0]))
        total = total or sum(r[1] for r in everything)
        cums = itertools.accumulate(r[1] for r in everything)
        return [(r[0], r[1], r[1] / total, c / total) for r, c in zip(everything, cums)], total
    kept, whole = _kept(freq.select(value, count), threshold, inclusive, value, count, total)
    rows = sorted(kept.collect(), key=lambda r: (-r[1], r[0] is None, r[0]))
    cums = itertools.accumulate(r[1] for r in rows)
    return [(r[0], r[1], r[1] / whole, c / whole) for r, c in zip(rows, cums)], whole if rows else 0


def top_k_share(df: DataFrame, col: str, k: int) -> DataFrame:
    """The ``k`` most frequent values with their share and running share (``k`` rows in one window)."""
    counts = cut_lineage(value_counts(df, col))
    total = F.lit(float(max(total_count(counts), 1)))
    order = _frequency_order("value", "count")
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (counts.orderBy(*order).limit(k).withColumn("ratio", F.col("count") / total)
            .withColumn("cumulative_ratio", F.sum("count").over(w) / total))


def _is_float(df: DataFrame, col: str) -> bool:
    return df.schema[col].dataType.simpleString() in ("float", "double")


def _missing_to_null(df: DataFrame, col: str) -> Column:
    """NaN counts as missing in the statistics, as null does."""
    c = F.col(f"`{col}`")
    return F.when(~F.isnan(c), c) if _is_float(df, col) else c


def null_profile(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """Per column ``(column, nulls, non_nulls, distinct)``; NaN is missing.

    Exact distinct counts come from one stacked ``(column, value)`` count, not
    from an aggregate that expands every row once per column.
    """
    cols = list(cols or df.columns)
    clean = df.select(*[_missing_to_null(df, c).alias(c) for c in cols])
    if approx:
        stats = clean.agg(F.array(*[F.struct(
            F.lit(c).alias("column"), F.count_if(F.col(f"`{c}`").isNull()).alias("nulls"),
            F.count(F.col(f"`{c}`")).alias("non_nulls"), F.approx_count_distinct(F.col(f"`{c}`")).alias("distinct"))
            for c in cols]).alias("s"))
        return stats.select(F.inline("s"))
    known = F.col("value").isNotNull()
    return (stacked_value_counts(clean, cols, dropna=False).groupBy("column").agg(
        F.sum(F.when(known, 0).otherwise(F.col("count"))).alias("nulls"),
        F.sum(F.when(known, F.col("count")).otherwise(0)).alias("non_nulls"),
        F.count("value").alias("distinct")))


def describe(df: DataFrame, cols: Sequence[str], quantiles: str = "distributed") -> DataFrame:
    """Count, mean, sample std, min, interpolated quartiles, max per numeric column; NaN is missing.

    Moments and extremes of every column come from one aggregate.  Quartiles
    are exact: ``quantiles='distributed'`` (default) finds those of all columns
    together (:func:`exact_quantiles`); ``'approx'`` uses ``percentile_approx``.
    """
    clean = df.select(*[_missing_to_null(df, c).cast("double").alias(c) for c in cols])
    moments = []
    for c in cols:
        x = F.col(f"`{c}`")
        parts = [F.lit(c).alias("column"), F.count(x).alias("count"), F.avg(x).alias("mean"),
                 F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max")]
        if quantiles == "approx":
            parts.append(F.percentile_approx(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
        moments.append(F.struct(*parts))
    stats = clean.agg(F.array(*moments).alias("_s")).select(F.inline("_s"))
    if quantiles == "approx":
        return stats.select("column", "count", "mean", "std", "min", F.col("q")[0].alias("p25"),
                            F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "max")
    found = exact_quantiles(clean, cols, [0.25, 0.5, 0.75])
    rows = [(r["column"], r["count"], r["mean"], r["std"], r["min"], *found[r["column"]], r["max"])
            for r in stats.collect()]  # one row per described column
    schema = ("column string, count bigint, mean double, std double, min double, p25 double, p50 double, "
              "p75 double, max double")
    return df.sparkSession.createDataFrame(rows, schema)


def distinct_items(df: DataFrame, col: str) -> DataFrame:
    """Distinct items across a list column."""
    return df.select(F.explode(F.col(f"`{col}`")).alias("value")).distinct()



def bin2d(df: DataFrame, x: str, y: str, x_width: float, y_width: float) -> DataFrame:
    """Two-column extract binned on a grid -- ``(x_bin, y_bin, count)``; the data of a scatter plot."""
    return (df.groupBy(F.floor(F.col(f"`{x}`") / x_width).cast("bigint").alias("x_bin"),
                       F.floor(F.col(f"`{y}`") / y_width).cast("bigint").alias("y_bin"))
            .agg(F.count(F.lit(1)).alias("count")))


def total_count(freq: DataFrame, count: str = "count") -> int:
    """Sum of a frequency column."""
    return int(freq.agg(F.sum(count)).first()[0] or 0)


BINS = 1024  # per bracket and pass


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, list[float | None]]:
    """Exact linear-interpolated quantiles of several numeric columns (nulls and NaN skipped).

    A quantile lies between two order statistics.  Each is known to lie in a
    bracket of values, at first the whole range of its column.  A pass counts
    the rows of every bracket in ``BINS`` equal bins, with the least and largest
    value of each bin, and keeps the bin that holds the wanted rank; a bracket
    is done when it is one value, whatever the number of rows that share it.
    A pass returns at most ``BINS`` rows per open bracket, nothing grows with
    the data, and all columns and probabilities share the passes.
    """
    values = df.select(*[_missing_to_null(df, c).cast("double").alias(c) for c in cols])
    ends = values.agg(*[f(F.col(f"`{c}`")).alias(f"{k}{i}") for i, c in enumerate(cols)
                        for k, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    places = {}  # column -> (position, lower rank, upper rank) per probability
    open_: dict[tuple[str, int], tuple[float, float, int]] = {}  # (column, rank) -> bracket, rows below it
    for i, c in enumerate(cols):
        n = ends[f"n{i}"]
        places[c] = [(p * (n - 1), math.floor(p * (n - 1)), math.ceil(p * (n - 1))) for p in map(float, probs)] \
            if n else []
        for _, low, high in places[c]:
            for rank in (low, high):
                open_[c, rank] = (ends[f"lo{i}"], ends[f"hi{i}"], 0)
    found: dict[tuple[str, int], float] = {}
    while True:
        for key, (lo, hi, _) in list(open_.items()):
            if lo == hi:
                found[key] = lo
                del open_[key]
        if not open_:
            break
        brackets = sorted({(c, lo, hi) for (c, _), (lo, hi, _) in open_.items()})
        hits = []
        for k, (c, lo, hi) in enumerate(brackets):
            x = F.col(f"`{c}`")
            # infinite ends: split at zero first, else in the finite middle; monotone in x either way
            if math.isinf(lo) or math.isinf(hi) or math.isinf(hi - lo):
                b = (F.when(x == F.lit(float("-inf")), 0).when(x < 0, 1).when(x == F.lit(float("inf")), 3).otherwise(2))
            else:
                b = F.least(F.floor((x - F.lit(lo)) / F.lit(hi - lo) * BINS), F.lit(BINS))
            hits.append(F.when(x.between(lo, hi), F.struct(F.lit(k).alias("k"), b.cast("int").alias("b"), x.alias("x"))))
        bins = (values.select(F.explode(F.array_compact(F.array(*hits))).alias("h")).groupBy("h.k", "h.b")
                .agg(F.count("*").alias("n"), F.min("h.x").alias("lo"), F.max("h.x").alias("hi")).collect())
        by: dict[int, list] = {}
        for r in sorted(bins, key=lambda r: (r["k"], r["b"])):
            by.setdefault(r["k"], []).append(r)
        number = {b: k for k, b in enumerate(brackets)}
        for (c, rank), (lo, hi, below) in list(open_.items()):
            for r in by[number[c, lo, hi]]:
                if rank < below + r["n"]:
                    open_[c, rank] = (r["lo"], r["hi"], below)
                    break
                below += r["n"]
    return {c: [found[c, low] + (at - low) * (found[c, high] - found[c, low]) if low != high else found[c, low]
                for at, low, high in places[c]] or [None] * len(probs) for c in cols}
