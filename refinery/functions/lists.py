"""Array (list) column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def contains_flag(c: ColumnOrName, value) -> Column:
    """1 when the list holds ``value``; null/empty list -> 0."""
    return F.coalesce(F.array_contains(_c(c), F.lit(value)), F.lit(False)).cast("int")


def any_outside_flag(c: ColumnOrName, allowed) -> Column:
    """F16: 1 when any item of the list is not in ``allowed``; null/empty -> 0.

    ``array_except`` is used instead of ``exists`` because ``NOT IN`` yields
    null for null items; a null item counts as "outside".
    """
    allowed = list(allowed)
    lit_arr = F.array(*[F.lit(v) for v in allowed]).cast("array<string>") if allowed else F.array().cast(
        "array<string>")
    return F.coalesce(F.size(F.array_except(_c(c), lit_arr)) > 0, F.lit(False)).cast("int")


def non_empty(c: ColumnOrName) -> Column:
    """P17 predicate: list has at least one item (null excluded)."""
    return F.coalesce(F.size(_c(c)) > 0, F.lit(False))


def join_items(c: ColumnOrName, sep: str = ",") -> Column:
    """list -> delimited text."""
    return F.array_join(_c(c), sep)


def lower_items(c: ColumnOrName) -> Column:
    """lower-case every item."""
    return F.transform(_c(c), lambda x: F.lower(x))


def list_template(template: str, *lists: ColumnOrName, sep: str = ",") -> Column:
    """embed comma-joined lists into a ``format_string`` template."""
    return F.format_string(template, *[F.coalesce(F.array_join(_c(x), sep), F.lit("")) for x in lists])


def append_item(c: ColumnOrName, item: ColumnOrName) -> Column:
    """Append one item; a null list is treated as empty."""
    return F.array_append(F.coalesce(_c(c), F.array().cast("array<string>")), _c(item))


def remove_item(c: ColumnOrName, value) -> Column:
    """U4: drop every occurrence of ``value``."""
    return F.array_remove(_c(c), F.lit(value))


def argmax(c: ColumnOrName) -> Column:
    """T4: 0-based index of the largest element of a numeric array (first on ties)."""
    arr = _c(c)
    return F.array_position(arr, F.array_max(arr)).cast("int") - 1
