"""Estimator/Model base classes for the encoders.

An encoder's ``fit`` runs aggregates on the cluster and keeps only small
parameters (statistics, vocabularies that become output columns); its
``Model`` is a pure column projection, so it also works on streaming frames.

Encoders that can share a scan expose ``_scalar_aggs`` (aggregate expressions
over their column) and ``_from_scalars`` (build the model from the aggregate
row); ``FeatureChain`` runs every such encoder in one ``agg`` pass.
"""

from __future__ import annotations

import json

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter,
                             MLReader, MLWriter)
from pyspark.sql import Column, DataFrame

from refinery.operators.tables import MissingColumnsError


class FitError(RuntimeError):
    """A fit failed; the message names the encoder (base contract of the reference)."""


class NotFittedError(RuntimeError):
    pass


class HasColumn(Params):
    column = Param(Params._dummy(), "column", "column to encode", typeConverter=TypeConverters.toString)

    def getColumn(self) -> str:
        return self.getOrDefault(self.column)


class Encoder(Estimator, HasColumn, DefaultParamsReadable, DefaultParamsWritable):
    """Base estimator: ``fit`` wraps failures in :class:`FitError`."""

    def _fit(self, df: DataFrame):
        col = self.getColumn()
        if col not in df.columns:
            raise FitError(f"{type(self).__name__} needs column '{col}', which the frame does not have")
        try:
            model = self._fit_column(df, col)
        except FitError:
            raise
        except Exception as e:  # noqa: BLE001 -- base contract: wrap any failure
            raise FitError(f"{type(self).__name__} could not be fitted on '{col}': {e}") from e
        return self._copyValues(model)

    def _fit_column(self, df: DataFrame, col: str):  # pragma: no cover - abstract
        raise NotImplementedError

    # Optional shared-scan protocol.
    def _scalar_aggs(self, col: str) -> list[Column] | None:
        return None

    def _from_scalars(self, row: dict, col: str):  # pragma: no cover - abstract
        raise NotImplementedError


class EncoderModel(Model, HasColumn, DefaultParamsReadable, DefaultParamsWritable):
    """Base model: ``transform`` checks the column exists."""

    def _transform(self, df: DataFrame) -> DataFrame:
        col = self.getColumn()
        if col not in df.columns:
            raise MissingColumnsError(f"Column '{col}' not found in the DataFrame.")
        return self._transform_column(df, col)

    def _transform_column(self, df: DataFrame, col: str) -> DataFrame:  # pragma: no cover
        raise NotImplementedError

    def fitted_params(self) -> dict:
        """Parameters for the report."""
        return {}

    def report_tables(self) -> dict[str, DataFrame]:
        """Fitted parameters too large for the report row, as tables (written next to it)."""
        return {}

    def report_json(self) -> str:
        return json.dumps(self.fitted_params(), default=_json_default)


class ArtifactPersistence:
    """Mixin for models holding more than params: DataFrames (saved as Parquet)
    and nested ML models (saved with their own writer) next to the metadata.

    Subclasses list ``ARTIFACTS = {attribute: "frame" | "model"}``.
    """

    ARTIFACTS: dict[str, str] = {}

    def write(self):
        return _ArtifactWriter(self)

    @classmethod
    def read(cls):
        return _ArtifactReader(cls)


class _ArtifactWriter(MLWriter):
    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path):
        held = [name for name in self.instance.ARTIFACTS if getattr(self.instance, name) is not None]
        # the metadata names the artifacts, so a load needs no look at the file system
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, extraMetadata={"artifacts": held})
        for name in held:
            obj = getattr(self.instance, name)
            if self.instance.ARTIFACTS[name] == "frame":
                obj.write.mode("overwrite").parquet(f"{path}/{name}")
            else:
                obj.write().overwrite().save(f"{path}/{name}")


class _ArtifactReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path):
        from pyspark.ml import PipelineModel

        meta = DefaultParamsReader.loadMetadata(path, self.sc)
        inst = self.cls()
        DefaultParamsReader.getAndSetParams(inst, meta)
        inst._resetUid(meta["uid"])
        for name in meta["artifacts"]:
            sub = f"{path}/{name}"
            if self.cls.ARTIFACTS[name] == "frame":
                setattr(inst, name, self.sparkSession.read.parquet(sub))
            else:
                setattr(inst, name, PipelineModel.load(sub))
        return inst


def _json_default(o):
    if isinstance(o, (set, frozenset, tuple)):
        return list(o)
    if hasattr(o, "item"):
        return o.item()
    if hasattr(o, "tolist"):
        return o.tolist()
    return str(o)


def q(col: str) -> str:
    return f"`{col}`"
