"""Table hygiene operators: projections, renames, drops, null handling, key casts.

All are narrow transformations (no shuffle); Catalyst prunes the columns they
drop straight out of the Parquet scan.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refinery.functions.numeric import clip as _clip
from refinery.functions.numeric import finite_or_null
from refinery.functions.text import null_marker_to_null


class MissingColumnsError(ValueError):
    """Raised by the strict operators when named columns are absent."""


def _require(df: DataFrame, cols: Iterable[str], what: str) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise MissingColumnsError(f"{what}: columns not found: {missing}")


def strict_select(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Project exactly ``cols``; a missing column is an error."""
    cols = list(cols)
    _require(df, cols, "select")
    return df.select(*[F.col(f"`{c}`") for c in cols])


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename columns (unknown names are ignored, as ``withColumnsRenamed``)."""
    return df.withColumnsRenamed(dict(mapping))


def prefix_columns(df: DataFrame, prefix: str, keep: Iterable[str] = ()) -> DataFrame:
    """Prefix every column except those in ``keep``."""
    keep = set(keep)
    return df.select(*[F.col(f"`{c}`") if c in keep else F.col(f"`{c}`").alias(prefix + c) for c in df.columns])


def rename_and_keep(df: DataFrame, mapping: Mapping[str, str], strict: bool = True) -> DataFrame:
    """Rename by ``mapping`` and keep only mapped columns, in mapping order."""
    if strict:
        _require(df, mapping.keys(), "rename_and_keep")
    return df.select(*[F.col(f"`{k}`").alias(v) for k, v in mapping.items() if k in df.columns])


def strict_drop(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Drop ``cols``; a missing column is an error (Spark's ``drop`` ignores it)."""
    cols = list(cols)
    _require(df, cols, "drop")
    return df.drop(*cols)


def lenient_drop(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Drop whichever of ``cols`` exist."""
    return df.drop(*list(dict.fromkeys(cols)))


def require_not_null(df: DataFrame, col: str) -> DataFrame:
    """Keep rows where ``col`` is not null."""
    return df.filter(F.col(f"`{col}`").isNotNull())


def drop_incomplete(df: DataFrame, subset: Iterable[str]) -> DataFrame:
    """Drop rows with any null in ``subset``."""
    return df.na.drop("any", subset=list(subset))


def fill_constant(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Null -> constant per column."""
    return df.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit(v)) for c, v in values.items()})


def clean_null_markers(df: DataFrame, cols: Iterable[str] | None = None, exclude: Iterable[str] = (),
                       match: str = "contains") -> DataFrame:
    """Rewrite null markers to null in the string columns (all, or ``cols``)."""
    exclude = set(exclude)
    strings = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    targets = [c for c in (cols if cols is not None else df.columns) if c in strings and c not in exclude]
    return df.withColumns({c: null_marker_to_null(F.col(f"`{c}`"), match) for c in targets})


def cast_key(df: DataFrame, key: str, to_type: str) -> DataFrame:
    """P10: cast the key column (long -> string gives '123', never '123.0')."""
    return df.withColumn(key, F.col(f"`{key}`").cast(to_type))


def replace_values(df: DataFrame, col: str, mapping: Mapping[str, str]) -> DataFrame:
    """Exact-match value replacement by a small literal map."""
    if not mapping:
        return df
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    c = F.col(f"`{col}`")
    return df.withColumn(col, F.coalesce(F.try_element_at(m, c), c))


def copy_column(df: DataFrame, src: str, dst: str) -> DataFrame:
    """Copy a column under a new name."""
    return df.withColumn(dst, F.col(f"`{src}`"))


def nonfinite_to_null(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """NaN/+-inf -> null."""
    return df.withColumns({c: finite_or_null(F.col(f"`{c}`")) for c in cols})


def clip_columns(df: DataFrame, cols: Iterable[str], lower: float | None, upper: float | None) -> DataFrame:
    """Clip columns to a range."""
    return df.withColumns({c: _clip(F.col(f"`{c}`"), lower, upper) for c in cols})


def replace_with_derived(df: DataFrame, source: str, derived: list[Column]) -> DataFrame:
    """Drop ``source`` and append ``derived`` columns in one projection."""
    kept = [F.col(f"`{c}`") for c in df.columns if c != source]
    return df.select(*kept, *derived)
