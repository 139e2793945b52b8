"""The file risk classifier as a Spark ML estimator, for pipelines and cross validators."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.plans.train import RiskModel, Settings, train

_DEFAULT = Settings()


class _RiskParams(Params):
    inputCol = Param(Params._dummy(), "inputCol", "column with the code", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "column with the label's name", TypeConverters.toString)
    wordFeatures = Param(Params._dummy(), "wordFeatures", "word n-grams in the vocabulary", TypeConverters.toInt)
    wordRange = Param(Params._dummy(), "wordRange", "shortest and longest word n-gram", TypeConverters.toListInt)
    charFeatures = Param(Params._dummy(), "charFeatures", "character n-grams in the vocabulary", TypeConverters.toInt)
    charRange = Param(Params._dummy(), "charRange", "shortest and longest character n-gram", TypeConverters.toListInt)
    c = Param(Params._dummy(), "c", "inverse of the penalty, for the whole data set", TypeConverters.toFloat)
    maxIter = Param(Params._dummy(), "maxIter", "steps of the optimizer at most", TypeConverters.toInt)

    def __init__(self, *args):
        super().__init__(*args)
        self._setDefault(inputCol="code", labelCol="label", wordFeatures=_DEFAULT.word_features, wordRange=list(_DEFAULT.word_range),
                         charFeatures=_DEFAULT.char_features, charRange=list(_DEFAULT.char_range), c=_DEFAULT.c, maxIter=_DEFAULT.max_iter)

    def settings(self) -> Settings:
        get = self.getOrDefault
        return Settings(get(self.wordFeatures), tuple(get(self.wordRange)), get(self.charFeatures), tuple(get(self.charRange)), get(self.c), get(self.maxIter))


class RiskClassifier(Estimator, _RiskParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fits vectorizer and classifier; the model adds ``ml_prediction``, ``confidence`` and ``all_scores``.

        CrossValidator(estimator=RiskClassifier(), estimatorParamMaps=grid, evaluator=Accuracy(), foldCol="fold", parallelism=4)
    """

    @keyword_only
    def __init__(self, **params):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> RiskClassifierModel:
        own = dataset.select(F.col(self.getOrDefault(self.inputCol)).alias("code"), F.col(self.getOrDefault(self.labelCol)).alias("label"))
        return self._copyValues(RiskClassifierModel(train(own, self.settings())))


class RiskClassifierModel(Model, _RiskParams, MLWritable, MLReadable):
    def __init__(self, risk: RiskModel | None = None):
        super().__init__()
        self.risk = risk

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.risk.predict(dataset, self.getOrDefault(self.inputCol))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: RiskClassifierModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.risk.save(path, version="saved")


class _Reader(MLReader):
    def load(self, path: str) -> RiskClassifierModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = RiskClassifierModel(RiskModel.load(f"{path}/version=saved"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class Accuracy(Evaluator):
    """Share of rows whose label was predicted."""

    def __init__(self, labelCol: str = "label", predictionCol: str = "ml_prediction"):
        super().__init__()
        self.label, self.prediction = labelCol, predictionCol

    def _evaluate(self, dataset: DataFrame) -> float:
        return dataset.agg(F.avg((F.col(self.label) == F.col(self.prediction)).cast("int"))).first()[0] or 0.0

    def isLargerBetter(self) -> bool:
        return True
