"""The toxicity classifier: held-out accuracy, whole texts, and rows of every kind."""

import numpy as np
import pytest

from riskloom.llm import toxicity
from riskloom.llm.common import table
from riskloom.llm.queries import QUERIES, toxicity_model


@pytest.fixture(scope="module")
def model(spark):
    return toxicity_model(spark, "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def toy():
    rng = np.random.default_rng(5)
    plain = [f"w{i}" for i in range(300)]
    texts, labels = [], []
    for k in range(300):
        words = list(rng.choice(plain, rng.integers(5, 80)))
        if k % 4 == 0:
            words.insert(int(rng.integers(len(words))), ["vile", "vileness", "awful,"][k // 4 % 3])
        texts.append(" ".join(words))
        labels.append(int(k % 4 == 0))
    return toxicity.fit(texts, labels, ["en" if k % 8 < 4 else "fr" for k in range(300)], 0.25)


def test_held_out_accuracy(spark, model):
    rows = QUERIES["op7_toxicity"](spark, "/root/testdata/sf0.01").join(table(spark, "/root/testdata/sf0.01", "labels"), "doc_id").filter("held_out").collect()
    score, truth = np.array([r.score for r in rows]), np.array([r.toxic for r in rows])
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.95
    assert (score[truth == 1][:, None] > score[truth == 0][None]).mean() > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_a_word_decides_wherever_it_stands(toy):
    filler = " ".join(["w1 w2 w3"] * 40_000)        # longer than what is convolved at a time
    clean, first, last, middle = toxicity.Scorer(toy).scores([filler, "vile " + filler, filler + " vile", filler + " vile " + filler])
    assert clean < 0.5 < min(first, last, middle)
    assert first == pytest.approx(last, abs=0.1) and middle == pytest.approx(last, abs=0.1)


def test_score_does_not_depend_on_company(toy):
    texts = ["", None, "w1 vile", "w5", "unseen words only", "vileness. w2 w3"]
    together = toxicity.Scorer(toy).scores(texts)
    alone = [float(toxicity.Scorer(toy).scores([t])[0]) for t in texts]
    assert together == pytest.approx(alone, abs=1e-6)
    assert together[0] == together[1]


def test_cache_is_bounded(toy, monkeypatch):
    texts = [" ".join(f"x{k}y{i}" for i in range(50)) + " vile" * (k % 2) for k in range(40)]
    whole = toxicity.Scorer(toy).scores(texts)
    monkeypatch.setattr(toxicity, "CACHE", 120)
    assert toxicity.Scorer(toy).scores(texts) == pytest.approx(whole, abs=1e-6)


def test_thresholds_part_the_labels(toy):
    assert toy.thresholds and set(toy.thresholds) <= {"en", "fr"}
    assert toxicity._threshold(np.array([0.9, 0.8, 0.3, 0.1]), np.array([1, 1, 0, 0])) == pytest.approx(0.55)
    assert toxicity._threshold(np.array([0.5, 0.5, 0.2]), np.array([1, 0, 0])) == pytest.approx(0.35)


def test_thresholds_are_those_of_the_whole_labelled_table(monkeypatch):
    class Given:            # the texts are the scores
        def __init__(self, model):
            pass

        def scores(self, texts):
            return np.array([float(t or 0) for t in texts])

    def calibrated(ones, zeros, prior):
        model = toxicity.ToxicityModel(*[np.zeros(1, np.float32)] * 4)
        texts, truth = [*ones, *zeros], np.array([1] * len(ones) + [0] * len(zeros))
        toxicity._calibrate(model, [str(x) for x in texts], truth, ["en"] * len(texts), prior)
        return model.threshold, model.thresholds["en"]

    monkeypatch.setattr(toxicity, "Scorer", Given)
    ones, zeros = [0.95, 0.9, 0.85, 0.8, 0.45, 0.4], [0.6, 0.5, 0.3, 0.2, 0.1, 0.05]
    whole = calibrated(ones, zeros * 9, 0.1)
    assert whole == pytest.approx((0.7, 0.7)) and calibrated(ones, zeros, 0.1) == pytest.approx(whole)
    assert calibrated(ones, zeros, 0.5)[0] == pytest.approx(0.35)


def test_without_both_labels():
    for labels in ([], [0, 0, 0], [1, 1]):
        model = toxicity.fit(["a b"] * len(labels), labels, ["en"] * len(labels), float(np.mean(labels)) if labels else 0.0)
        score = toxicity.Scorer(model).scores(["anything", ""])
        assert len(set(score)) == 1 and 0 <= score[0] <= 1


def test_clean_keeps_columns_and_rows(spark, documents, toy):
    docs = documents((1, "w1 vile w2"), (2, "w1 w2"), (None, None), (3, ""), (2, "w1 w2"), (4, "vileness", None, None), (5, "w7", "s", "xx"))
    kept = toxicity.clean(docs, toy)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [2, 2, 3, 5, None]
    assert toxicity.clean(docs.drop("lang"), toy).count() == 5
    assert toxicity.clean(docs.filter("doc_id < 0"), toy).count() == 0


def test_training_rows(spark, documents):
    docs = documents((1, "good w"), (2, "vile w"), (3, None), (None, "x"), clashing=False)
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (3, None), (None, 1), (9, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert 0 <= toxicity.Scorer(model).scores(["w"])[0] <= 1
    empty = toxicity.train(docs.filter("doc_id < 0"), labels.filter("doc_id < 0"))
    assert toxicity.Scorer(empty).scores(["w"])[0] < 0.5
