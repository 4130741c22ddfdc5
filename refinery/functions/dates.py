"""Date and timestamp column functions (timestamps are TIMESTAMP_NTZ throughout)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_timestamp_strict(c: ColumnOrName) -> Column:
    """a bad value raises (ANSI cast)."""
    return _c(c).cast("timestamp_ntz")


def parse_timestamp_coerce(c: ColumnOrName) -> Column:
    """a bad value becomes null."""
    return F.try_to_timestamp(_c(c).cast("string")).cast("timestamp_ntz")


def calendar_months_since(c: ColumnOrName, reference: dt.date | str) -> Column:
    """months from ``c`` to ``reference`` counting calendar fields only (day ignored)."""
    ref = reference if isinstance(reference, dt.date) else dt.date.fromisoformat(str(reference))
    d = _c(c)
    return (F.lit(ref.year) - F.year(d)) * 12 + (F.lit(ref.month) - F.month(d))


def hours_between(start: ColumnOrName, end: ColumnOrName) -> Column:
    """F8: fractional hours from ``start`` to ``end``; null end -> null."""
    micros = F.timestamp_diff("MICROSECOND", _c(start), _c(end))
    return micros.cast("double") / F.lit(3.6e9)
