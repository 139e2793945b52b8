"""Training, scoring, evaluation and tuning of the file risk classifier."""

from __future__ import annotations

import datetime
import itertools
import json
import math
from dataclasses import dataclass, replace
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.durable import durable, remove, storage
from riskloom.operators import features, samples


MAX_CLASSES = 100           # distinct labels that a classifier is trained for


@dataclass(frozen=True)
class Settings:
    """Sizes, ranges, ``c`` and ``max_iter`` default to FIXED VALUES that give the expected model."""

    word_features: int = features.WORD_FEATURES
    word_range: tuple[int, int] = features.WORD_RANGE
    char_features: int = features.CHAR_FEATURES
    char_range: tuple[int, int] = features.CHAR_RANGE
    c: float = 20.0
    max_iter: int = 5000


@dataclass(frozen=True)
class Vectorizer:
    """Vocabularies and idf weights; their size is fixed by the settings, not by the data."""

    settings: Settings
    words: list[str]
    chars: list[str]
    word_idf: list[float]
    char_idf: list[float]

    def narrowed(self, settings: Settings) -> "Vectorizer":
        """The vectorizer of smaller vocabularies with the same n-gram ranges."""
        w, c = settings.word_features, settings.char_features
        return Vectorizer(settings, self.words[:w], self.chars[:c], self.word_idf[:w], self.char_idf[:c])

    def counts(self, df: DataFrame, code: Column, sublinear: bool = False) -> DataFrame:
        s = self.settings
        return features.term_vectors(df.withColumn("_code", code), self.words, self.chars, s.word_range, s.char_range, sublinear).drop("_code")

    def transform(self, df: DataFrame, code: Column) -> DataFrame:
        """Add ``features``; every step runs inside the row, without a shuffle.

        Rows that have their ``counts``, over vocabularies of which these are the heads, are not read again.
        """
        s = self.settings
        if "_word_counts" in df.columns:
            return features.tfidf_of_counts(df, self.word_idf, self.char_idf)
        prepared = df.withColumn("_code", code)
        return features.tfidf_vectors(prepared, self.words, self.chars, s.word_range, s.char_range, self.word_idf, self.char_idf).drop("_code")


def fit_vectorizer(data: DataFrame, settings: Settings = Settings(), code: str = "code") -> Vectorizer:
    """Vocabulary by corpus count, idf by document count.

    Word n-grams are added up by hash bucket, and only those of full buckets by themselves, character n-grams are those of
    different words; term and document counts are combined before the shuffle.
    """
    prepared = data.select(F.col(code).alias("_code"))

    def top(kept: DataFrame) -> list[str]:
        return [row.term for row in kept.select("term").collect()]      # at most as many rows as features

    with storage(data.sparkSession):
        words = top(features.heavy_word_terms(prepared, settings.word_features, settings.word_range))
    chars = top(features.vocabulary(features.char_term_counts(features.used_words(prepared), settings.char_range), settings.char_features))
    total, by_word, by_char = features.document_counts(prepared, words, chars, settings.word_range, settings.char_range)

    def idf(counts: list[int]) -> list[float]:
        return [math.log((1 + total) / (1 + n)) + 1 for n in counts]

    return Vectorizer(settings, words, chars, idf(by_word), idf(by_char))


@dataclass(frozen=True)
class RiskModel:
    vectorizer: Vectorizer
    labels: list[str]
    classifier: object

    def predict(self, df: DataFrame, code: str = "content", width: int | None = None) -> DataFrame:
        """Add ``ml_prediction``, ``confidence`` and ``all_scores`` (percent, one decimal).

        Texts are classified whole; ``width`` looks at their first characters only.
        """
        return self.judge(self.vectorizer.transform(df, F.col(code) if width is None else F.substring(code, 1, width)))

    def judge(self, vectors: DataFrame) -> DataFrame:
        """``predict`` of rows that have their ``features``."""
        classifier = self.classifier.setFeaturesCol("features").setProbabilityCol("_probability") \
            .setPredictionCol("_prediction").setRawPredictionCol("_raw")
        scored = classifier.transform(vectors)
        names = F.array(*map(F.lit, self.labels))
        percent = F.transform(vector_to_array("_probability"), lambda p: F.round(p * 100, 1))
        index = F.col("_prediction").cast("int")
        return (
            scored.withColumn("_percent", percent)
            .withColumns({
                "ml_prediction": F.get(names, index),
                "confidence": F.get("_percent", index),
                "all_scores": F.map_from_arrays(names, F.col("_percent")),
            })
            .drop("features", "_probability", "_prediction", "_raw", "_percent")
        )

    def save(self, path: str, version: str | None = None) -> str:
        """Write under ``path/version=...``; earlier versions stay as backups."""
        version = version or datetime.datetime.now(datetime.timezone.utc).strftime("%Y%m%d%H%M%S%f")
        folder = f"{path}/version={version}"
        spark = SparkSession.getActiveSession()
        self.classifier.write().overwrite().save(f"{folder}/classifier")
        v = self.vectorizer
        s = v.settings
        meta = json.dumps([s.word_features, s.word_range, s.char_features, s.char_range, s.c, s.max_iter])
        spark.createDataFrame([(meta, v.words, v.chars, v.word_idf, v.char_idf, self.labels)], _MODEL_SCHEMA) \
            .write.mode("overwrite").parquet(f"{folder}/vectorizer")
        return folder

    @staticmethod
    def load(folder: str) -> "RiskModel":
        from pyspark.ml.classification import LogisticRegressionModel

        row = SparkSession.getActiveSession().read.parquet(f"{folder}/vectorizer").first()
        wf, wr, cf, cr, c, it = json.loads(row.settings)
        vectorizer = Vectorizer(Settings(wf, tuple(wr), cf, tuple(cr), c, it), list(row.words), list(row.chars),
                                list(row.word_idf), list(row.char_idf))
        return RiskModel(vectorizer, list(row.labels), LogisticRegressionModel.load(f"{folder}/classifier"))


_MODEL_SCHEMA = ("settings string, words array<string>, chars array<string>, word_idf array<double>, "
                 "char_idf array<double>, labels array<string>")


def unknown_risks(files: DataFrame) -> DataFrame:
    """What a failed or missing classifier yields."""
    return files.select("repo", "file", F.lit("Unknown").alias("ml_prediction"), F.lit(0.0).alias("confidence"),
                        F.create_map().cast("map<string,double>").alias("all_scores"))


def clean_training(data: DataFrame, order: list[str]) -> DataFrame:
    """Strip, drop incomplete rows, keep the first row of every code."""
    return samples.keep_first(samples.drop_incomplete(data), order)


def _weighted(data: DataFrame, vectorizer: Vectorizer, label: str) -> tuple[DataFrame, list[str], int]:
    counts = {r[label]: r["n"] for r in data.groupBy(label).agg(F.count(F.lit(1)).alias("n")).limit(MAX_CLASSES + 1).collect()}
    if len(counts) > MAX_CLASSES:
        raise ValueError(f"{label} has more than {MAX_CLASSES} values: not a class label")
    labels = sorted(counts)
    total = sum(counts.values())
    weight = F.create_map(*[x for name in labels for x in (F.lit(name), F.lit(total / (len(labels) * counts[name])))])
    index = F.create_map(*[x for i, name in enumerate(labels) for x in (F.lit(name), F.lit(float(i)))])
    rows = vectorizer.transform(data, F.col("code")).select(
        "features", F.element_at(index, F.col(label)).alias("_label"), F.element_at(weight, F.col(label)).alias("_weight"))
    return rows, labels, total


def _fit_classifier(rows: DataFrame, total: int, settings: Settings):
    """Balanced multinomial regression.

    The penalty is stated per data set (C); the optimizer averages the loss,
    and balanced weights sum to the number of rows, hence 1 / (C * rows).
    """
    return LogisticRegression(
        family="multinomial", regParam=1.0 / (settings.c * total), elasticNetParam=0.0, standardization=False,
        maxIter=settings.max_iter, featuresCol="features", labelCol="_label", weightCol="_weight").fit(rows)


def train(data: DataFrame, settings: Settings = Settings(), label: str = "label") -> RiskModel:
    """Fit vectorizer and classifier on cleaned samples, which are stored once, until the model is there: several passes read them."""
    spark, written = data.sparkSession, []
    try:
        data = durable(data.select("code", label), "training", written)
        vectorizer = fit_vectorizer(data, settings)
        rows, labels, total = _weighted(data, vectorizer, label)
        rows = durable(rows, "vectors", written)    # the regression keeps its own blocks: persisted rows would be in memory twice
        return RiskModel(vectorizer, labels, _fit_classifier(rows, total, settings))
    finally:
        remove(spark, written)


def train_and_evaluate(data: DataFrame, key: Column, settings: Settings = Settings()) -> tuple[RiskModel, DataFrame]:
    """Fit on 80 % and score the held-out rows, and fit on all; the steps of both fits fill a cluster together.

    The vectorizer of the evaluation sees training rows only.
    """
    split = durable(samples.stratified_split(data, key), "split")
    held_out = split.filter("is_test")
    model, trial = _at_once(data.sparkSession, lambda rows: train(rows, settings), [data, split.filter("NOT is_test")], 2)
    return model, trial.predict(held_out, "code")


def cross_validate(data: DataFrame, key: Column, settings: Settings = Settings(), folds: int = 5) -> DataFrame:
    """``(fold, rows, accuracy)`` per fold; vectorizer and classifier are fitted inside the fold."""
    dealt = durable(samples.stratified_folds(data, key, folds=folds), "folds")
    parts = []
    for fold in range(folds):
        model = train(dealt.filter(F.col("fold") != fold), settings)
        parts.append(model.predict(dealt.filter(F.col("fold") == fold), "code"))
    scored = samples.merge(*parts)
    hit = (F.col("label") == F.col("ml_prediction")).cast("int")
    return scored.groupBy("fold").agg(F.count(F.lit(1)).alias("rows"), F.avg(hit).alias("accuracy"))


# FIXED VALUES: the settings searched by default.
GRID = {
    "word_features": (3000, 5000), "word_range": ((1, 2), (1, 3)),
    "char_features": (1000, 2000, 3000), "char_range": ((2, 4), (2, 5), (3, 6)), "c": (1.0, 5.0, 10.0, 20.0),
}


def _at_once(spark: SparkSession, work, items: list, parallelism: int) -> list:
    """``work`` of every item, ``parallelism`` of them at a time: the small jobs of several fits fill a cluster together."""
    if parallelism <= 1 or len(items) <= 1:
        return [work(x) for x in items]
    pool = ThreadPool(min(parallelism, len(items)))
    try:
        return pool.map(inheritable_thread_target(spark)(work), items)
    finally:
        pool.close()
        pool.join()


def tune(data: DataFrame, key: Column, grid: dict = GRID, folds: int = 5, max_iter: int = 5000, parallelism: int = 4) -> DataFrame:
    """Mean accuracy of every setting over the folds, best first, and the ``rows`` that it was measured on.

    A vocabulary is ordered by use, so the vocabularies of all sizes are prefixes of the largest: one vectorizer is
    fitted and terms are counted once for each fold and pair of n-gram ranges.  Its features are shared by all values of
    ``c``, and all settings of a pair are fitted ``parallelism`` at a time.  What is stored on the way is deleted.
    """
    with storage(data.sparkSession):
        return _tuned(data, key, grid, folds, max_iter, parallelism)


def _tuned(data: DataFrame, key: Column, grid: dict, folds: int, max_iter: int, parallelism: int) -> DataFrame:
    dealt = durable(samples.stratified_folds(data, key, folds=folds), "folds")
    names = [n for n in grid if n != "c"]
    ranges = [n for n in names if n.endswith("_range")]
    largest = {n: max(grid[n]) for n in names if n not in ranges}
    scores: dict[tuple, list[tuple[int, float]]] = {}
    hit = (F.col("label") == F.col("ml_prediction")).cast("int")
    for fold, shape in itertools.product(range(folds), itertools.product(*[grid[n] for n in ranges])):
        vectorizer = fit_vectorizer(dealt.filter(F.col("fold") != fold), Settings(max_iter=max_iter, **largest, **dict(zip(ranges, shape))))
        # texts are read once for the vocabularies of all sizes, and for the rows of both sides
        counted = durable(vectorizer.counts(dealt, F.col("code")), "counts")
        prepared, fits = {}, []
        for values in itertools.product(*[grid[n] for n in names]):
            chosen = dict(zip(names, values))
            if tuple(chosen[n] for n in ranges) != shape:
                continue
            own = vectorizer.narrowed(Settings(max_iter=max_iter, **chosen))
            rows, labels, total = _weighted(counted.filter(F.col("fold") != fold), own, "label")
            # stored once for all values of ``c``, which read them several times
            rows = durable(rows, "vectors")
            vectors = durable(own.transform(counted.filter(F.col("fold") == fold), F.col("code")).select("label", "features"), "held-vectors")
            prepared[values] = own, rows, labels, total, vectors
            fits += [(values, c) for c in grid["c"]]

        def measured(fit: tuple[tuple, float]) -> tuple[int, float]:
            own, rows, labels, total, vectors = prepared[fit[0]]
            model = RiskModel(own, labels, _fit_classifier(rows, total, replace(own.settings, c=fit[1])))
            return tuple(model.judge(vectors).agg(F.count(F.lit(1)), F.avg(hit)).first())

        for fit, found in zip(fits, _at_once(data.sparkSession, measured, fits, parallelism)):
            scores.setdefault(fit, []).append(found)
    results = [(*map(str, values), float(c), sum(a for _, a in found) / len(found), sum(n for n, _ in found)) for (values, c), found in scores.items()]
    schema = ", ".join(f"{n} string" for n in names) + ", c double, accuracy double, rows long"
    return data.sparkSession.createDataFrame(results, schema).orderBy(F.col("accuracy").desc(), *names, "c")


# --- evaluation -------------------------------------------------------------

def confusion(scored: DataFrame, labels: list[str], actual: str = "label", predicted: str = "ml_prediction") -> DataFrame:
    """Rows are actual labels, columns predicted ones."""
    counts = [F.count_if(F.col(predicted) == name).alias(name) for name in labels]
    return scored.groupBy(F.col(actual).alias("actual")).agg(*counts)


def classification_report(scored: DataFrame, actual: str = "label", predicted: str = "ml_prediction") -> DataFrame:
    """Precision, recall, F1 and support per label, then accuracy, macro and weighted averages.

    The rows are reduced to one count per (actual, predicted) pair first.
    """
    cells = scored.groupBy(F.col(actual).alias("a"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    by_label = (
        cells.select(F.inline(F.array(
            F.struct(F.col("a").alias("label"), F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0).alias("hits"),
                     F.col("n").alias("support"), F.lit(0).cast("bigint").alias("claimed")),
            F.struct(F.col("p").alias("label"), F.lit(0).cast("bigint").alias("hits"),
                     F.lit(0).cast("bigint").alias("support"), F.col("n").alias("claimed")))))
        .groupBy("label").agg(*[F.sum(c).alias(c) for c in ("hits", "support", "claimed")])
    )

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    precision, recall = ratio(F.col("hits"), F.col("claimed")), ratio(F.col("hits"), F.col("support"))
    scores = by_label.withColumns({"precision": precision, "recall": recall}).withColumn(
        "f1", ratio(F.col("precision") * F.col("recall") * 2, F.col("precision") + F.col("recall")))
    measures = ("precision", "recall", "f1")
    support = F.sum("support")
    accuracy = F.sum("hits") / support
    summary = scores.agg(
        *[F.avg(m).alias(f"macro_{m}") for m in measures],
        *[(F.sum(F.col(m) * F.col("support")) / support).alias(f"weighted_{m}") for m in measures],
        accuracy.alias("accuracy"), support.alias("support"))

    def line(name: str, *cols: Column) -> Column:
        return F.struct(F.lit(name).alias("label"), *[c.alias(m) for m, c in zip(measures, cols)], "support")

    averages = summary.select(F.inline(F.array(
        line("accuracy", F.col("accuracy"), F.col("accuracy"), F.col("accuracy")),
        line("macro avg", *[F.col(f"macro_{m}") for m in measures]),
        line("weighted avg", *[F.col(f"weighted_{m}") for m in measures]))))
    return scores.select("label", *measures, "support").unionByName(averages)


def probe(model: RiskModel, probes: DataFrame) -> DataFrame:
    """``(code, expected, ml_prediction, confidence, passed)`` for labelled one-liners."""
    return model.predict(probes, "code").select(
        "code", "expected", "ml_prediction", "confidence", (F.col("expected") == F.col("ml_prediction")).alias("passed"))
