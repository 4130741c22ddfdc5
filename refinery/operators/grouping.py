"""Grouping operators: ordered list aggregation and distinct projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ordered_list(df: DataFrame, key: str, value: str, order_by: Sequence[str], alias: str | None = None,
                 null_items: str = "keep") -> DataFrame:
    """One row per key holding the list of ``value`` in ``order_by`` order.

    Null keys are dropped; null values and duplicates are kept (plain
    ``collect_list`` would drop nulls, so each value travels inside a struct).
    ``null_items='drop'`` leaves null values out; a key with no other value gets
    an empty list.

    A list in the order of its own values is built from ``(key, value)``
    counts: the counting combines map-side, so a hot key travels as its
    distinct values, and the list is unfolded from the counts at the end.  The
    list itself is the result, so its row is as large as its group.
    """
    if null_items not in ("keep", "drop"):
        raise ValueError(f"null_items is 'keep' or 'drop', not {null_items!r}")
    alias = alias or f"{value}_list"
    k, v = F.col(f"`{key}`"), F.col(f"`{value}`")
    base = df.filter(k.isNotNull())
    if list(order_by) == [value]:
        counted = base.groupBy(k, v.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
        runs = F.array_sort(F.collect_list(F.struct("_v", "_n")))  # a null value sorts first
        unfolded = F.flatten(F.transform("_r", lambda x: F.array_repeat(x["_v"], x["_n"].cast("int"))))
        return _items(counted.groupBy(k).agg(runs.alias("_r")).select(k, unfolded.alias(alias)), alias, null_items)
    fields = [F.col(f"`{o}`").alias(f"_o{i}") for i, o in enumerate(order_by)]
    items = F.array_sort(F.collect_list(F.struct(*fields, v.alias("_v"))))
    out = base.groupBy(k).agg(items.alias("_r")).select(k, F.transform("_r", lambda x: x["_v"]).alias(alias))
    return _items(out, alias, null_items)


def _items(lists: DataFrame, alias: str, null_items: str) -> DataFrame:
    return lists.withColumn(alias, F.array_compact(alias)) if null_items == "drop" else lists


def distinct_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """D3: distinct combinations of ``cols`` (partial aggregation map-side)."""
    return df.select(*[F.col(f"`{c}`") for c in cols]).distinct()


def distinct_values(df: DataFrame, col: str, sort: bool = False) -> DataFrame:
    """Distinct values of one column, optionally sorted."""
    out = df.select(F.col(f"`{col}`")).distinct()
    return out.orderBy(F.col(f"`{col}`").asc_nulls_last()) if sort else out
