"""Integration and lookup joins.

Physical strategy is left to Catalyst/AQE except for dimensions: a dimension
is broadcast only after its rows and bytes have been checked against
``refinery.broadcast.maxRows`` and ``maxBytes``; above that it is joined by shuffle (and AQE's
skew-join splitting handles a hot fact key on the streamed side).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refinery.session import broadcast_byte_limit, broadcast_row_limit


class FanOutError(ValueError):
    """A lookup join would multiply rows: the lookup key is not unique."""


def measured_bytes(df: DataFrame) -> tuple[int, int]:
    """Rows and bytes of the values of ``df``, from one distributed aggregate."""
    size = F.lit(0)
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        kind = f.dataType.typeName()
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(c), F.lit(0))
        elif kind in ("array", "map", "struct"):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
        else:
            size = size + F.lit(8)
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(size.cast("long")).alias("b")).first()
    return row["n"], row["b"] or 0


def checked_broadcast(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Broadcast-hint ``df`` only when its rows and bytes are proven small.

    The measure is one job over the dimension; above a limit the plain
    DataFrame is returned so the join shuffles instead (and AQE may still turn
    it into a broadcast from the measured size at run time).  Derived dimensions
    should be checkpointed by the caller so the measure does not recompute them.
    """
    rows = broadcast_row_limit(df.sparkSession) if max_rows is None else max_rows
    n, size = measured_bytes(df)
    return F.broadcast(df) if n <= rows and size <= broadcast_byte_limit(df.sparkSession) else df


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def join_prefixed(left: DataFrame, right: DataFrame, left_key: str, right_key: str, prefix: str,
                  how: str = "inner") -> DataFrame:
    """Join ``right`` with every column prefixed; the right key is dropped.

    The fact-to-fact join shuffles both sides on the key (sort-merge); AQE
    splits a skewed key on either side of an inner join.
    """
    r = right.select(*[F.col(f"`{c}`").alias(prefix + c) for c in right.columns])
    rk = prefix + right_key
    out = left.join(r, F.col(f"`{left_key}`") == r[f"`{rk}`"], how)
    return out.drop(r[f"`{rk}`"])


def join_on_string_key(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
                       how: str = "left") -> DataFrame:
    """Equi-join after casting both keys to string (null never matches)."""
    lk = F.col(f"`{left_key}`").cast("string")
    r = right.withColumn("__rk", F.col(f"`{right_key}`").cast("string"))
    return left.join(r, lk == r["__rk"], how).drop("__rk")


def guarded_lookup(left: DataFrame, right: DataFrame, left_key: str | Sequence[str],
                   right_key: str | Sequence[str] | None = None, how: str = "left",
                   check: bool = True, broadcast: bool = True) -> DataFrame:
    """Lookup join that must not fan out.

    ``check`` verifies the lookup key is unique first (one aggregate over the
    lookup side).  The lookup side is broadcast if its size is proven small.
    """
    lkeys = _keys(left_key)
    rkeys = _keys(right_key) if right_key is not None else lkeys
    if check:
        most = right.groupBy(*[F.col(f"`{k}`") for k in rkeys]).count().agg(F.max("count")).first()[0]
        if most is not None and most > 1:
            raise FanOutError(f"lookup: key {rkeys} is not unique ({most} rows share one key)")
    r = checked_broadcast(right) if broadcast else right
    if lkeys == rkeys:
        return left.join(r, lkeys, how)
    cond = [left[f"`{a}`"] == r[f"`{b}`"] for a, b in zip(lkeys, rkeys)]
    out = left.join(r, cond, how)
    for b in rkeys:
        out = out.drop(r[f"`{b}`"])
    return out


def null_safe_lookup(left: DataFrame, right: DataFrame, key: str, right_key: str | None = None,
                     how: str = "left") -> DataFrame:
    """Lookup where a null key matches the null row of the lookup table."""
    rk = right_key or key
    r = checked_broadcast(right.withColumnRenamed(rk, "__lk"))
    return left.join(r, left[f"`{key}`"].eqNullSafe(r["__lk"]), how).drop("__lk")


def link_join(link: DataFrame, labels: DataFrame, link_key: str, label_key: str,
              suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Inner join of a link table to a label table; overlapping names get suffixes."""
    overlap = (set(link.columns) & set(labels.columns)) - ({link_key} & {label_key})
    left = link.select(*[F.col(f"`{c}`").alias(c + suffixes[0] if c in overlap else c) for c in link.columns])
    right = labels.select(*[F.col(f"`{c}`").alias(c + suffixes[1] if c in overlap else c) for c in labels.columns])
    lk = link_key + suffixes[0] if link_key in overlap else link_key
    rk = label_key + suffixes[1] if label_key in overlap else label_key
    if lk == rk:
        return left.join(right, lk, "inner")
    return left.join(checked_broadcast(right), left[f"`{lk}`"] == right[f"`{rk}`"], "inner")


def join_grouped(left: DataFrame, grouped: DataFrame, left_key: str, right_key: str,
                 list_cols: Iterable[str], empty_when_missing: bool = True) -> DataFrame:
    """Left join one-row-per-key aggregates; a miss gives ``[]`` not null."""
    g = grouped.withColumnRenamed(right_key, "__gk")
    out = left.join(g, left[f"`{left_key}`"] == g["__gk"], "left").drop("__gk")
    if empty_when_missing:
        out = out.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.array().cast(g.schema[c].dataType))
                               for c in list_cols})
    return out


def count_rows(df: DataFrame, name: str) -> tuple[DataFrame, object]:
    """Attach a row-count metric to ``df`` without an extra job.

    Returns the observed frame and an ``Observation``; read ``obs.get`` after
    an action has run on the frame.
    """
    from pyspark.sql import Observation

    obs = Observation(name)
    return df.observe(obs, F.count(F.lit(1)).alias("rows")), obs

