"""Encoders as Spark ML stages: one saved ``Pipeline`` from raw loans to scores.

A fitted stage's state is its encoder *table*.  ``write().save`` puts the
parameters where Spark ML puts them and the table beside them as Parquet, both
through Spark's file systems; ``load`` reads them back in any session, so a
``PipelineModel`` with encoders, assembler and learner is one folder.  Fit and
transform are those of ``encoders``.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession

from .. import config as C
from ..session import materialize
from . import encoders
from .cleaning import existing

TABLE = "table"


class EncoderParams(Params):
    """Parameters shared by the estimators and their models."""

    inputCols = Param(Params._dummy(), "inputCols", "categorical columns", TypeConverters.toListString)
    labelCol = Param(Params._dummy(), "labelCol", "0/1 outcome", TypeConverters.toString)

    def getInputCols(self) -> list[str]:
        return self.getOrDefault(self.inputCols)

    def getLabelCol(self) -> str:
        return self.getOrDefault(self.labelCol)


class _TableWriter(MLWriter):
    """Parameters as Spark ML writes them, the state table as Parquet in the same folder."""

    def __init__(self, model: "EncoderModel"):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        # the super class has cleared the folder if overwrite() was asked for
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.table.write.parquet(f"{path}/{TABLE}")


class _TableReader(MLReader):
    def __init__(self, cls: type):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> "EncoderModel":
        spark = self.sparkSession
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        model = self.cls(spark.read.parquet(f"{path}/{TABLE}"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class EncoderModel(Model, EncoderParams, MLReadable, MLWritable):
    """A fitted encoder: its table, and how the table is joined to rows."""

    def __init__(self, table: DataFrame | None = None):
        super().__init__()
        self._table = table
        self._fitted = None

    @property
    def table(self) -> DataFrame:
        return self._table

    def copy(self, extra=None) -> "EncoderModel":
        # the table is immutable: copies share it
        that = super().copy(extra)
        that._table, that._fitted = self._table, self._fitted
        return that

    def fitted(self) -> encoders.Fitted:
        """The table with its per-feature sizes, counted once a model."""
        if self._fitted is None:
            self._fitted = encoders.Fitted(self._table)
        return self._fitted

    def write(self) -> MLWriter:
        return _TableWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TableReader(cls)


class EncoderEstimator(Estimator, EncoderParams, MLReadable, MLWritable):
    """Fits an encoder table on the rows whose label is known."""

    model_class: type[EncoderModel]

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, labelCol: str = C.LABEL):
        super().__init__()
        self._setDefault(inputCols=list(C.CATEGORICAL_FEATURES), labelCol=C.LABEL)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _table(self, rows: DataFrame) -> DataFrame:
        raise NotImplementedError

    def _fit(self, dataset: DataFrame) -> EncoderModel:
        model = self.model_class(materialize(self._table(dataset.where(dataset[self.getLabelCol()].isNotNull()))))
        model._resetUid(self.uid)
        return self._copyValues(model)

    def write(self) -> MLWriter:
        return DefaultParamsWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return DefaultParamsReader(cls)


# ------------------------------------------------------------- WoE (A1, A2)
class WoeEncoderModel(EncoderModel):
    """``<feature>_woe`` for every input column; unseen values, and columns that could not be fitted, get 0."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out, enc = dataset, self.fitted()
        for f in existing(dataset, self.getInputCols()):
            out = enc.lookup(out, f, "woe", f"{f}_woe", 0.0)
        return out


class WoeEncoder(EncoderEstimator):
    model_class = WoeEncoderModel

    def _table(self, rows: DataFrame) -> DataFrame:
        return encoders.woe_fit(rows, self.getInputCols(), self.getLabelCol())


# ---------------------------------------------------- target encoding (A5)
class TargetEncoderModel(EncoderModel):
    """``<feature>_target_enc``; unseen values get the global mean."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return encoders.target_apply(dataset, self.fitted(), self.getInputCols())


class TargetEncoder(EncoderEstimator):
    """Smoothed mean label by value; ``smoothing`` rows of the global mean are added to each value."""

    model_class = TargetEncoderModel
    smoothing = Param(Params._dummy(), "smoothing", "rows of the global mean added to each value", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, labelCol: str = C.LABEL, smoothing: float = C.TARGET_SMOOTHING):
        kwargs = self._input_kwargs
        super().__init__(**{k: v for k, v in kwargs.items() if k != "smoothing"})
        self._setDefault(smoothing=float(C.TARGET_SMOOTHING))
        if "smoothing" in kwargs:
            self._set(smoothing=kwargs["smoothing"])

    def _table(self, rows: DataFrame) -> DataFrame:
        return encoders.target_fit(rows, self.getInputCols(), self.getLabelCol(), self.getOrDefault(self.smoothing))


# ---------------------------------------------------- frequency
class FrequencyEncoderModel(EncoderModel):
    """``<feature>_freq``; unseen values get 0."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return encoders.frequency_apply(dataset, self.fitted(), self.getInputCols())


class FrequencyEncoder(EncoderEstimator):
    model_class = FrequencyEncoderModel

    def _table(self, rows: DataFrame) -> DataFrame:
        return encoders.frequency_fit(rows, self.getInputCols(), label=self.getLabelCol())


# ------------------------------------------------- geographic risk
class GeoRiskEncoderModel(EncoderModel):
    """Risk of residential and permanent postcode and city, risk level, address stability risk."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        res, perm = self.getInputCols()
        return encoders.geo_apply(dataset, self.fitted(), res, perm)


class GeoRiskEncoder(EncoderEstimator):
    """``inputCols``: residential and permanent postcode, in this order."""

    model_class = GeoRiskEncoderModel

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, labelCol: str = C.LABEL):
        kwargs = dict(self._input_kwargs)
        super().__init__(**kwargs)
        self._setDefault(inputCols=["post_res", "post_perm"])

    def _table(self, rows: DataFrame) -> DataFrame:
        res, perm = self.getInputCols()
        return encoders.geo_fit(rows, self.getLabelCol(), res, perm)


def saved_round_trip(model, path: str, spark: SparkSession):
    """Save a fitted pipeline under ``path`` (replacing what is there) and load it back."""
    from pyspark.ml import PipelineModel
    model.write().overwrite().save(path)
    return PipelineModel.load(path)
