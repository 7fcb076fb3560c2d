"""TF-IDF as an estimator of `pyspark.ml`: fitted in one run, saved, and loaded by another that only transforms."""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame

from . import tfidf


class _Columns(Params):
    textCol = Param(Params._dummy(), "textCol", "column of texts", TypeConverters.toString)
    itemCol = Param(Params._dummy(), "itemCol", "column that tells items apart", TypeConverters.toString)

    def __init__(self, textCol: str = "text", itemCol: str = "item"):
        super().__init__()
        self._set(textCol=textCol, itemCol=itemCol)


class TfidfEstimator(_Columns, Estimator, DefaultParamsWritable):
    """Learns the vocabulary of a corpus and its inverse document frequencies."""

    def _fit(self, dataset: DataFrame) -> TfidfModel:
        model = TfidfModel(self.getOrDefault("textCol"), self.getOrDefault("itemCol"))
        model.vocabulary = tfidf.vocabulary(dataset, self.getOrDefault("textCol"))
        return model


class TfidfModel(_Columns, Model, MLWritable, MLReadable):
    """item, term, weight of texts under a fitted vocabulary (term, df, idf); rows have length 1."""

    vocabulary: DataFrame

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return tfidf.weights(dataset, self.getOrDefault("itemCol"), self.getOrDefault("textCol"), self.vocabulary)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: TfidfModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.vocabulary.write.parquet(f"{path}/vocabulary")


class _Reader(MLReader):
    def load(self, path: str) -> TfidfModel:
        held = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = TfidfModel(held["paramMap"]["textCol"], held["paramMap"]["itemCol"])
        model.vocabulary = self.sparkSession.read.parquet(f"{path}/vocabulary")
        return model
