"""Numeric and boolean column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite_or_null(c: ColumnOrName) -> Column:
    """NaN and +/-inf become null (Spark keeps NaN distinct from NULL)."""
    col = _c(c).cast("double")
    bad = F.isnan(col) | (col == F.lit(float("inf"))) | (col == F.lit(float("-inf")))
    return F.when(bad, F.lit(None).cast("double")).otherwise(col)


def clip(c: ColumnOrName, lower: float | None = None, upper: float | None = None) -> Column:
    """Clip to ``[lower, upper]`` (null stays null)."""
    col = _c(c)
    if lower is not None:
        col = F.when(col.isNull(), col).otherwise(F.greatest(col, F.lit(lower)))
    if upper is not None:
        col = F.when(col.isNull(), col).otherwise(F.least(col, F.lit(upper)))
    return col


def safe_ratio(numerator: ColumnOrName, denominator: ColumnOrName, lower: float = 0.0,
               upper: float = 1.0) -> Column:
    """ratio where x/0, 0/0, inf and null all become 0, then clipped."""
    r = F.try_divide(_c(numerator).cast("double"), _c(denominator).cast("double"))
    return clip(F.coalesce(finite_or_null(r), F.lit(0.0)), lower, upper)


def to_flag(c: ColumnOrName) -> Column:
    """boolean coerce, null -> False (a real cast: the string 'false' is False)."""
    return F.coalesce(_c(c).cast("boolean"), F.lit(False))


def equals_flag(c: ColumnOrName, value) -> Column:
    """1 when equal to ``value``, else 0 (null -> 0)."""
    return F.coalesce(_c(c) == F.lit(value), F.lit(False)).cast("int")


def not_in_flag(c: ColumnOrName, values) -> Column:
    """1 when the value is not one of ``values``; null counts as "not in"."""
    vals = list(values)
    if not vals:
        return F.lit(1)
    return F.coalesce(~_c(c).isin(*vals), F.lit(True)).cast("int")


def affine_scale(c: ColumnOrName, center: float, scale: float) -> Column:
    """``(x - center) / scale`` with non-finite input -> 0 after scaling."""
    s = scale if scale not in (0, 0.0) and scale == scale else 1.0
    return F.coalesce((finite_or_null(c) - F.lit(float(center))) / F.lit(float(s)), F.lit(0.0))


def when_equals(cond_col: ColumnOrName, value, then: Column, otherwise: Column) -> Column:
    """``then`` where ``cond_col == value``; a null condition takes ``otherwise``."""
    return F.when(F.coalesce(_c(cond_col) == F.lit(value), F.lit(False)), then).otherwise(otherwise)


def literal_map_lookup(c: ColumnOrName, mapping: dict, value_type: str | None = None) -> Column:
    """Look a value up in a small literal map; a missing key gives null."""
    if not mapping:
        return F.lit(None).cast(value_type or "string")
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    out = F.try_element_at(m, _c(c))
    return out.cast(value_type) if value_type else out
