"""The classifier as an estimator, alone, in pipelines and in cross validation."""

import threading
import time

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from riskloom.plans import train
from riskloom.plans.estimator import Accuracy, RiskClassifier, RiskClassifierModel
from test_train import NAMES, TEMPLATES

SMALL = dict(wordFeatures=120, charFeatures=120, maxIter=12)


@pytest.fixture(scope="module")
def data(spark):
    rows = [(t.format(n=n), label) for label, ts in TEMPLATES.items() for t in ts[:3] for n in NAMES[:8]]
    return spark.createDataFrame([(i, *r, i % 2) for i, r in enumerate(rows)], "row_id int, code string, label string, fold int").repartition(2).persist()


def test_fit_save_and_load(spark, data, tmp_path):
    model = RiskClassifier(**SMALL).fit(data)
    assert Accuracy().evaluate(model.transform(data)) > 0.9
    model.write().overwrite().save(str(tmp_path / "model"))
    again = RiskClassifierModel.load(str(tmp_path / "model"))
    assert again.uid == model.uid and again.settings() == model.settings() == train.Settings(120, (1, 3), 120, (2, 5), 20.0, 12)
    one = {r.row_id: (r.ml_prediction, r.confidence) for r in model.transform(data).collect()}
    assert one == {r.row_id: (r.ml_prediction, r.confidence) for r in again.transform(data).collect()}
    estimator = RiskClassifier(c=3.0, inputCol="text")
    estimator.write().overwrite().save(str(tmp_path / "estimator"))
    assert RiskClassifier.load(str(tmp_path / "estimator")).settings().c == 3.0


def test_pipeline(data, tmp_path):
    renamed = data.select(F.col("code").alias("raw"), "label")
    stages = [SQLTransformer(statement="SELECT trim(raw) AS text, label FROM __THIS__"), RiskClassifier(inputCol="text", **SMALL)]
    model = Pipeline(stages=stages).fit(renamed)
    assert Accuracy().evaluate(model.transform(renamed)) > 0.9
    model.write().overwrite().save(str(tmp_path / "pipeline"))
    assert Accuracy().evaluate(PipelineModel.load(str(tmp_path / "pipeline")).transform(renamed)) > 0.9


def test_cross_validator(data):
    estimator = RiskClassifier(**SMALL)
    grid = ParamGridBuilder().addGrid(estimator.c, [0.001, 10.0]).build()
    found = CrossValidator(estimator=estimator, estimatorParamMaps=grid, evaluator=Accuracy(), numFolds=2, foldCol="fold", parallelism=2).fit(data)
    assert len(found.avgMetrics) == 2 and max(found.avgMetrics) > 0.7
    assert found.bestModel.getOrDefault("c") in (0.001, 10.0)


def test_settings_are_fitted_at_once(data, monkeypatch):
    spans, fit, lock = [], train._fit_classifier, threading.Lock()

    def timed(*args):
        start = time.monotonic()
        out = fit(*args)
        with lock:
            spans.append((start, time.monotonic()))
        return out

    monkeypatch.setattr(train, "_fit_classifier", timed)
    grid = {"word_features": (50,), "word_range": ((1, 2),), "char_features": (50,), "char_range": ((2, 3),), "c": (0.5, 1.0, 5.0)}
    rows = train.tune(data, F.col("row_id"), grid, folds=2, max_iter=5, parallelism=3).collect()
    assert len(rows) == 3 and {r.rows for r in rows} == {data.count()}
    assert any(a < d and c < b for i, (a, b) in enumerate(spans) for c, d in spans[i + 1:])
