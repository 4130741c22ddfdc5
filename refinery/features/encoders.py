"""Fitted column encoders.

Semantics follow the reference's processors; deliberate, documented choices:
ties in frequency order are broken by value, colliding output names are OR-ed,
an all-null mode column stays null.
"""

from __future__ import annotations

import json

from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refinery.features.base import ArtifactPersistence, Encoder, EncoderModel, FitError, q
from refinery.functions.lists import any_outside_flag, contains_flag
from refinery.functions.numeric import affine_scale, equals_flag, finite_or_null, not_in_flag
from refinery.functions.text import snake_name_py
from refinery.operators.blocked import number_rows
from refinery.operators.counts import coverage_rows, exact_quantiles, item_counts
from refinery.operators.joins import checked_broadcast
from refinery.operators.tables import replace_with_derived
from refinery.session import cut_lineage


def top_value(freq: DataFrame):
    """Most frequent non-null value of a ``(value, count)`` table, ties -> smallest.

    A per-partition top-1 merged once (``orderBy().limit(1)``), never a
    single-task map of every distinct value.
    """
    row = (freq.filter(F.col("value").isNotNull()).orderBy(F.desc("count"), F.asc("value")).limit(1)
           .collect())
    return row[0]["value"] if row else None


def _json_param(name: str, doc: str) -> Param:
    return Param(Params._dummy(), name, doc, typeConverter=TypeConverters.toString)


# ---------------------------------------------------------------------------- E1
class BooleanEncoder(Encoder):
    """Fill nulls with the majority value (mean >= 0.5; all-null -> False), emit 0/1."""

    def __init__(self, column: str | None = None):
        super().__init__()
        if column:
            self._set(column=column)

    def _scalar_aggs(self, col):
        return [F.coalesce(F.avg(F.col(q(col)).cast("int")) >= F.lit(0.5), F.lit(False)).alias(f"{col}__maj")]

    def _from_scalars(self, row, col):
        return BooleanModel(column=col, majority=bool(row[f"{col}__maj"]))

    def _fit_column(self, df, col):
        return self._from_scalars(df.agg(*self._scalar_aggs(col)).first().asDict(), col)


class BooleanModel(EncoderModel):
    majority = Param(Params._dummy(), "majority", "fill value", typeConverter=TypeConverters.toBoolean)

    def __init__(self, column: str | None = None, majority: bool | None = None):
        super().__init__()
        self._set(**{k: v for k, v in dict(column=column, majority=majority).items() if v is not None})

    def _transform_column(self, df, col):
        fill = F.lit(self.getOrDefault(self.majority))
        return df.withColumn(col, F.coalesce(F.col(q(col)).cast("boolean"), fill).cast("int"))

    def fitted_params(self):
        return {"most_common": self.getOrDefault(self.majority)}


# ---------------------------------------------------------------------------- E2
class OrdinalEncoder(Encoder):
    """Map values to integers (given map, or sorted distinct values from 0).

    Nulls are first filled with the mode (ties -> smallest value).  A value
    outside the map raises at transform (``handle_invalid='error'``, as the
    reference) or becomes null (``'null'``).
    """

    mapping_json = _json_param("mapping_json", "explicit mapping as JSON [[value, code], ...]")
    handle_invalid = Param(Params._dummy(), "handle_invalid", "error | null", typeConverter=TypeConverters.toString)

    def __init__(self, column: str | None = None, mapping: dict | None = None, handle_invalid: str = "error"):
        super().__init__()
        self._setDefault(mapping_json="", handle_invalid="error")
        if column:
            self._set(column=column)
        if mapping:
            self._set(mapping_json=json.dumps([[k, v] for k, v in mapping.items()]))
        self._set(handle_invalid=handle_invalid)

    count_kind = "values"  # FeatureChain may fit it from a stacked (column, value, count) pass

    def _fit_column(self, df, col):
        c = F.col(q(col))
        freq = df.groupBy(c.alias("value")).agg(F.count(F.lit(1)).alias("count"))
        return self._from_counts(freq, col, df.schema[col].dataType.simpleString())

    def _from_counts(self, freq, col, dtype: str | None = None):
        """Mode and (auto) mapping from ``(value, count)`` of this column.

        An automatic mapping is a table: the codes are the places of the sorted
        values, numbered range by range, and transform joins it.
        """
        typed = freq.select((F.col("value").cast(dtype) if dtype else F.col("value")).alias("value"), "count")
        given = self.getOrDefault(self.mapping_json)
        model = OrdinalModel(column=col, mapping_json=given or "", mode_json=json.dumps(top_value(typed), default=str),
                             handle_invalid=self.getOrDefault(self.handle_invalid))
        if not given:
            values = typed.filter(F.col("value").isNotNull()).select("value")
            model.table = number_rows(values, [F.col("value")], "code").withColumn("code", F.col("code").cast("int"))
        return model


class OrdinalModel(ArtifactPersistence, EncoderModel):
    """A given mapping is a literal map; an automatic one is the ``table`` of (value, code)."""

    ARTIFACTS = {"table": "frame"}
    table: DataFrame | None = None

    mapping_json = _json_param("mapping_json", "given mapping as JSON pairs")
    mode_json = _json_param("mode_json", "fill value as JSON")
    handle_invalid = Param(Params._dummy(), "handle_invalid", "error | null", typeConverter=TypeConverters.toString)

    def __init__(self, column=None, mapping_json=None, mode_json=None, handle_invalid=None):
        super().__init__()
        self._set(**{k: v for k, v in dict(column=column, mapping_json=mapping_json, mode_json=mode_json,
                                            handle_invalid=handle_invalid).items() if v is not None})

    def _transform_column(self, df, col):
        mode = json.loads(self.getOrDefault(self.mode_json))
        src_type = df.schema[col].dataType.simpleString()
        c = F.col(q(col))
        filled = F.coalesce(c, F.lit(mode).cast(src_type)) if mode is not None else c
        pairs = json.loads(self.getOrDefault(self.mapping_json) or "[]")
        if self.table is not None:
            table = checked_broadcast(self.table.select(F.col("value").alias("__ov"), F.col("code").alias("__oc")))
            df = df.join(table, filled == F.col("__ov"), "left")
            mapped = F.col("__oc")
        elif pairs:
            m = F.create_map(*[x for k, v in pairs for x in (F.lit(k).cast(src_type), F.lit(int(v)))])
            mapped = F.try_element_at(m, filled)
        else:
            mapped = F.lit(None).cast("int")
        if self.getOrDefault(self.handle_invalid) == "error":
            mapped = F.when(mapped.isNull(), F.raise_error(
                F.concat(F.lit(f"OrdinalModel: value outside the mapping in column '{col}': "),
                         F.coalesce(filled.cast("string"), F.lit("null"))))).otherwise(mapped)
        return df.withColumn(col, mapped.cast("int")).drop("__ov", "__oc")

    def fitted_params(self):
        given = self.getOrDefault(self.mapping_json)
        return {"mapping": json.loads(given) if given else "table", "mode": json.loads(self.getOrDefault(self.mode_json))}

    def report_tables(self):
        return {"mapping": self.table} if self.table is not None else {}


# ---------------------------------------------------------------------------- E3
class NumericScaler(Encoder):
    """Standard (population std), min-max or robust (IQR, no centring) scaling.

    Non-finite values are ignored when fitting and become 0 after scaling; a
    zero scale is replaced by 1 (so a constant column maps to 0).
    ``relative_error`` > 0 uses approximate quantiles for the robust scaler.
    """

    kind = Param(Params._dummy(), "kind", "standard | minmax | robust", typeConverter=TypeConverters.toString)
    relative_error = Param(Params._dummy(), "relative_error", "0 = exact quantiles",
                           typeConverter=TypeConverters.toFloat)

    quantiles = Param(Params._dummy(), "quantiles",
                      "robust quartiles: distributed (exact) | approx (relative_error)",
                      typeConverter=TypeConverters.toString)

    def __init__(self, column: str | None = None, kind: str = "standard", relative_error: float = 0.0,
                 quantiles: str = "distributed"):
        super().__init__()
        if kind not in ("standard", "minmax", "robust"):
            raise ValueError(f"unknown scaler kind {kind!r}")
        if quantiles not in ("distributed", "approx"):
            raise ValueError(f"unknown quantile method {quantiles!r}")
        if column:
            self._set(column=column)
        self._set(kind=kind, relative_error=relative_error, quantiles=quantiles)

    def _scalar_aggs(self, col):
        x = finite_or_null(F.col(q(col)))
        kind = self.getOrDefault(self.kind)
        if kind == "standard":
            return [F.avg(x).alias(f"{col}__a"), F.stddev_pop(x).alias(f"{col}__b")]
        if kind == "minmax":
            return [F.min(x).alias(f"{col}__a"), F.max(x).alias(f"{col}__b")]
        if self.getOrDefault(self.quantiles) == "distributed":
            return None  # several passes: see fit_quantiles
        qs = F.array(F.lit(0.25), F.lit(0.75))
        err = self.getOrDefault(self.relative_error)
        return [F.percentile_approx(x, qs, int(round(1 / max(err, 1e-9)))).alias(f"{col}__q")]

    @staticmethod
    def fit_quantiles(df: DataFrame, cols: list[str]) -> dict[str, dict]:
        """The quartile row of every column, all columns in the same passes."""
        finite = df.select(*[finite_or_null(F.col(q(c))).alias(c) for c in cols])
        found = exact_quantiles(finite, cols, [0.25, 0.75])
        return {c: {f"{c}__q": None if found[c][0] is None else found[c]} for c in cols}

    def _from_scalars(self, row, col):
        kind = self.getOrDefault(self.kind)
        if kind == "robust":
            qs = row[f"{col}__q"]
            if qs is None:
                raise FitError(f"NumericScaler: no finite values in '{col}'")
            center, scale = 0.0, float(qs[1]) - float(qs[0])
        else:
            a, b = row[f"{col}__a"], row[f"{col}__b"]
            if a is None:
                raise FitError(f"NumericScaler: no finite values in '{col}'")
            center, scale = (float(a), float(b)) if kind == "standard" else (float(a), float(b) - float(a))
        if scale == 0.0 or scale != scale:
            scale = 1.0
        return NumericModel(column=col, kind=kind, center=center, scale=scale)

    def _fit_column(self, df, col):
        aggs = self._scalar_aggs(col)
        if aggs is None:
            return self._from_scalars(self.fit_quantiles(df, [col])[col], col)
        return self._from_scalars(df.agg(*aggs).first().asDict(), col)


class NumericModel(EncoderModel):
    kind = Param(Params._dummy(), "kind", "scaler kind", typeConverter=TypeConverters.toString)
    center = Param(Params._dummy(), "center", "subtracted", typeConverter=TypeConverters.toFloat)
    scale = Param(Params._dummy(), "scale", "divisor", typeConverter=TypeConverters.toFloat)

    def __init__(self, column=None, kind=None, center=None, scale=None):
        super().__init__()
        self._set(**{k: v for k, v in dict(column=column, kind=kind, center=center, scale=scale).items()
                     if v is not None})

    def _transform_column(self, df, col):
        return df.withColumn(col, affine_scale(F.col(q(col)), self.getOrDefault(self.center),
                                               self.getOrDefault(self.scale)))

    def fitted_params(self):
        return {"scaler_type": self.getOrDefault(self.kind), "center": self.getOrDefault(self.center),
                "scale": self.getOrDefault(self.scale)}


# ------------------------------------------------------------------------- E4/E5
def _indicator_names(col: str, values: list) -> list[tuple[str, list]]:
    """Output names in value order; values sharing a snake name share one column."""
    out: dict[str, list] = {}
    for v in values:
        name = f"{col}_{snake_name_py(v)}"
        if name == f"{col}_others":
            name = f"{col}_others_value"
        out.setdefault(name, []).append(v)
    return list(out.items())


class OneHotEncoder(Encoder):
    """One 0/1 column per selected category, ``{col}_{snake(value)}``.

    ``threshold=None``: every non-null value, no ``_others``.  Otherwise the
    most frequent values whose running share stays below the threshold
    (exclusive cut) and ``{col}_others`` = 1 for anything else, null included.
    """

    threshold = Param(Params._dummy(), "threshold", "coverage threshold", typeConverter=TypeConverters.toFloat)

    def __init__(self, column: str | None = None, threshold: float | None = None):
        super().__init__()
        if column:
            self._set(column=column)
        if threshold is not None:
            self._set(threshold=threshold)

    count_kind = "values"  # FeatureChain may fit it from a stacked (column, value, count) pass

    def _fit_column(self, df, col):
        c = F.col(q(col))
        freq = df.groupBy(c.alias("value")).agg(F.count(F.lit(1)).alias("count"))
        return self._from_counts(freq, col)

    def _from_counts(self, freq, col, dtype: str | None = None):
        """Fit from ``(value, count)`` of this column (null row allowed, ignored here)."""
        thr = self.getOrDefault(self.threshold) if self.isSet(self.threshold) else None
        rows, _ = coverage_rows(freq.filter(F.col("value").isNotNull()), thr, inclusive=False)
        return OneHotModel(column=col, values_json=json.dumps([r[0] for r in rows], default=str),
                           shares=[float(r[2]) for r in rows], others=thr is not None)


class OneHotModel(EncoderModel):
    values_json = _json_param("values_json", "selected categories, frequency order")
    shares = Param(Params._dummy(), "shares", "share of each category", typeConverter=TypeConverters.toListFloat)
    others = Param(Params._dummy(), "others", "emit _others", typeConverter=TypeConverters.toBoolean)

    def __init__(self, column=None, values_json=None, shares=None, others=None):
        super().__init__()
        self._set(**{k: v for k, v in dict(column=column, values_json=values_json, shares=shares,
                                            others=others).items() if v is not None})

    def values(self) -> list:
        return json.loads(self.getOrDefault(self.values_json))

    def _transform_column(self, df, col):
        values = self.values()
        c = F.col(q(col))
        typ = df.schema[col].dataType.simpleString()
        derived: list[Column] = []
        for name, vs in _indicator_names(col, values):
            flag = F.greatest(*[equals_flag(c, F.lit(v).cast(typ)) for v in vs]) if len(vs) > 1 else \
                equals_flag(c, F.lit(vs[0]).cast(typ))
            derived.append(flag.alias(name))
        if self.getOrDefault(self.others):
            derived.append(not_in_flag(c, [F.lit(v).cast(typ) for v in values]).alias(f"{col}_others"))
        return replace_with_derived(df, col, derived)

    def fitted_params(self):
        return {"selected_categories": self.values(), "cumulative_proportions": self.getOrDefault(self.shares),
                "others": self.getOrDefault(self.others)}


class MultiLabelEncoder(Encoder):
    """E5: one 0/1 column per selected list item.

    ``threshold=None`` keeps every item; otherwise items up to and including
    the one whose running share reaches the threshold (inclusive cut).  A
    non-zero threshold adds ``{col}_others`` = 1 when any item is unselected.
    """

    threshold = Param(Params._dummy(), "threshold", "coverage threshold", typeConverter=TypeConverters.toFloat)

    def __init__(self, column: str | None = None, threshold: float | None = None):
        super().__init__()
        if threshold is not None and not 0 <= threshold <= 1:
            raise ValueError(f"a coverage threshold lies in [0, 1], not {threshold}")
        if column:
            self._set(column=column)
        if threshold is not None:
            self._set(threshold=threshold)

    count_kind = "items"  # FeatureChain may fit it from a stacked (column, item, count) pass

    def fit_counts(self, freq: DataFrame):
        """Fit from ``(value, count)`` item counts, e.g. of the child rows the lists are built from."""
        return self._copyValues(self._from_counts(freq, self.getColumn()))

    def _fit_column(self, df, col):
        return self._from_counts(item_counts(df, col), col)

    def _from_counts(self, freq, col):
        """Fit from ``(value, count)`` item counts of this list column."""
        thr = self.getOrDefault(self.threshold) if self.isSet(self.threshold) else None
        rows, _ = coverage_rows(freq, thr, inclusive=True)
        return MultiLabelModel(column=col, values=[r[0] for r in rows], shares=[float(r[2]) for r in rows],
                               cumulative=[float(r[3]) for r in rows], others=bool(thr))


class MultiLabelModel(EncoderModel):
    values = Param(Params._dummy(), "values", "selected items", typeConverter=TypeConverters.toListString)
    shares = Param(Params._dummy(), "shares", "item shares", typeConverter=TypeConverters.toListFloat)
    cumulative = Param(Params._dummy(), "cumulative", "running shares", typeConverter=TypeConverters.toListFloat)
    others = Param(Params._dummy(), "others", "emit _others", typeConverter=TypeConverters.toBoolean)

    def __init__(self, column=None, values=None, shares=None, cumulative=None, others=None):
        super().__init__()
        self._set(**{k: v for k, v in dict(column=column, values=values, shares=shares, cumulative=cumulative,
                                            others=others).items() if v is not None})

    def _transform_column(self, df, col):
        values = self.getOrDefault(self.values)
        c = F.col(q(col))
        derived = []
        for name, vs in _indicator_names(col, values):
            flag = F.greatest(*[contains_flag(c, v) for v in vs]) if len(vs) > 1 else contains_flag(c, vs[0])
            derived.append(flag.alias(name))
        if self.getOrDefault(self.others):
            derived.append(any_outside_flag(c, values).alias(f"{col}_others"))
        return replace_with_derived(df, col, derived)

    def fitted_params(self):
        return {"unique_values": self.getOrDefault(self.values), "ratio": self.getOrDefault(self.shares),
                "cumulative_ratio": self.getOrDefault(self.cumulative)}


# ---------------------------------------------------------------------------- E6
class FrequencyEncoder(Encoder):
    """Replace a value by its share of rows (null gets the null share; unseen -> 0).

    The share table stays a DataFrame (it grows with the number of distinct
    values); transform joins it null-safely, broadcasting only when its size
    is proven small.
    """

    def __init__(self, column: str | None = None):
        super().__init__()
        if column:
            self._set(column=column)

    count_kind = "values"  # FeatureChain may fit it from a stacked (column, value, count) pass

    def _fit_column(self, df, col):
        c = F.col(q(col))
        return self._from_counts(df.groupBy(c.alias("value")).agg(F.count(F.lit(1)).alias("count")), col,
                                 df.schema[col].dataType.simpleString())

    def _from_counts(self, freq, col, dtype: str | None = None):
        """Fit from ``(value, count)`` of this column including the null row.

        The share of a value is its count over the column total, computed as
        a window-free ratio against one scalar; the resulting table is the
        model artifact and is checkpointed once.
        """
        value = F.col("value").cast(dtype) if dtype else F.col("value")
        counted = cut_lineage(freq.select(value.alias("value"), "count"))
        total = counted.agg(F.sum("count")).first()[0] or 0
        model = FrequencyModel(column=col)
        model.table = counted.select("value", (F.col("count") / F.lit(float(max(total, 1)))).alias("share"))
        return model


class FrequencyModel(ArtifactPersistence, EncoderModel):
    """The share table is saved as Parquet next to the params."""

    ARTIFACTS = {"table": "frame"}
    table: DataFrame | None = None

    def __init__(self, column=None):
        super().__init__()
        if column:
            self._set(column=column)

    def _transform_column(self, df, col):
        t = checked_broadcast(self.table.select(F.col("value").alias("__fv"), F.col("share").alias("__fs")))
        j = df.join(t, F.col(q(col)).eqNullSafe(F.col("__fv")), "left")
        return j.withColumn(col, F.coalesce(F.col("__fs"), F.lit(0.0))).drop("__fv", "__fs")

    def fitted_params(self):
        # The whole value -> share mapping grows with the data: it is reported as
        # the ``frequency_mapping`` table (see ``report_tables``), not inlined.
        return {"frequency_mapping": "table"}

    def report_tables(self):
        return {"frequency_mapping": self.table}


# ---------------------------------------------------------------------------- E7
class ModeImputer(Encoder):
    """Fill nulls with the most frequent value (ties -> smallest); all-null stays null.

    The mode is a distributed ``groupBy`` count followed by a top-1, so no
    single task holds the column's distinct values (as Spark's ``mode``
    aggregate would in its final merge).
    """

    count_kind = "values"  # FeatureChain may fit it from a stacked (column, value, count) pass

    def __init__(self, column: str | None = None):
        super().__init__()
        if column:
            self._set(column=column)

    def _fit_column(self, df, col):
        c = F.col(q(col))
        freq = df.groupBy(c.alias("value")).agg(F.count(F.lit(1)).alias("count"))
        return self._from_counts(freq, col, df.schema[col].dataType.simpleString())

    def _from_counts(self, freq, col, dtype: str | None = None):
        typed = freq.select((F.col("value").cast(dtype) if dtype else F.col("value")).alias("value"), "count")
        return ModeModel(column=col, mode_json=json.dumps(top_value(typed), default=str))


class ModeModel(EncoderModel):
    mode_json = _json_param("mode_json", "fill value as JSON")

    def __init__(self, column=None, mode_json=None):
        super().__init__()
        self._set(**{k: v for k, v in dict(column=column, mode_json=mode_json).items() if v is not None})

    def _transform_column(self, df, col):
        mode = json.loads(self.getOrDefault(self.mode_json))
        if mode is None:
            return df
        typ = df.schema[col].dataType.simpleString()
        return df.withColumn(col, F.coalesce(F.col(q(col)), F.lit(mode).cast(typ)))

    def fitted_params(self):
        return {"mode": json.loads(self.getOrDefault(self.mode_json))}


# ---------------------------------------------------------------------------- E8
class PassThrough(Encoder):
    """Keeps the column unchanged."""

    def __init__(self, column: str | None = None):
        super().__init__()
        if column:
            self._set(column=column)

    def _fit_column(self, df, col):
        return PassThroughModel(column=col)


class PassThroughModel(EncoderModel):
    def __init__(self, column=None):
        super().__init__()
        if column:
            self._set(column=column)

    def _transform_column(self, df, col):
        return df


class DropColumn(Encoder):
    """Removes the column."""

    def __init__(self, column: str | None = None):
        super().__init__()
        if column:
            self._set(column=column)

    def _fit_column(self, df, col):
        return DropModel(column=col)


class DropModel(EncoderModel):
    def __init__(self, column=None):
        super().__init__()
        if column:
            self._set(column=column)

    def _transform_column(self, df, col):
        return df.drop(col)
