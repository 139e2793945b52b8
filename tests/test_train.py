"""The classifier on a small set of samples of our own."""

import math

import pytest
from pyspark.sql import functions as F

from riskloom.operators import features
from riskloom.plans import train

NAMES = ("user", "order", "item", "page", "job", "cart", "note", "file", "task", "team", "host", "mail")
TEMPLATES = {
    "High Risk": ("{n} = eval({n}_text)", "os.system('rm ' + {n})", "sql = 'SELECT a FROM {n} WHERE id=' + {n}_id",
                  "{n} = pickle.loads({n}_blob)", "subprocess.call({n}_cmd, shell=True)"),
    "Medium Risk": ("{n}_password = 'secret-{n}'", "{n}_hash = hashlib.md5({n}.encode())", "app.run(debug=True, name='{n}')",
                    "requests.get({n}_url, verify=False)", "{n}_token = 'tok-{n}-123'"),
    "Safe": ("{n} = ast.literal_eval({n}_text)", "subprocess.run(['ls', {n}], shell=False)",
             "db.execute('SELECT a FROM {n} WHERE id=?', ({n}_id,))", "{n} = json.loads({n}_blob)", "{n}_password = os.environ['{n}']"),
}
QUICK = train.Settings(word_features=400, char_features=400, max_iter=40)


@pytest.fixture(scope="module")
def data(spark):
    rows = [(t.format(n=n), label) for label, ts in TEMPLATES.items() for t in ts for n in NAMES]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_id int, code string, label string").repartition(2).persist()


@pytest.fixture(scope="module")
def model(data):
    return train.train(data, QUICK)


def test_probes(spark, model):
    probes = [("result = eval(query_text)", "High Risk"), ("os.system('cp ' + path)", "High Risk"),
              ("admin_password = 'secret-admin'", "Medium Risk"), ("app.run(debug=True)", "Medium Risk"),
              ("db.execute('SELECT a FROM t WHERE id=?', (t_id,))", "Safe"), ("x = json.loads(x_blob)", "Safe")]
    rows = train.probe(model, spark.createDataFrame(probes, "code string, expected string")).collect()
    assert all(r.passed for r in rows) and all(33 < r.confidence <= 100 for r in rows)


def test_prediction_columns(spark, model):
    df = spark.createDataFrame([("r", "a", "x = eval(user_text)")], "repo string, file string, content string")
    row = model.predict(df).first()
    assert row.confidence == max(row.all_scores.values()) and abs(sum(row.all_scores.values()) - 100) < 0.3
    assert sorted(row.all_scores) == ["High Risk", "Medium Risk", "Safe"]


def test_held_out_accuracy(data):
    _, scored = train.train_and_evaluate(data, F.col("row_id"), QUICK)
    report = {r.label: r for r in train.classification_report(scored).collect()}
    assert report["accuracy"].f1 >= 0.8 and report["accuracy"].support == 36


def test_saved_model_predicts_the_same(spark, data, model, tmp_path):
    folder = model.save(str(tmp_path), version="1")
    again = train.RiskModel.load(folder)
    a = {r.row_id: (r.ml_prediction, r.confidence) for r in model.predict(data, "code").collect()}
    assert a == {r.row_id: (r.ml_prediction, r.confidence) for r in again.predict(data, "code").collect()}
    model.save(str(tmp_path))
    assert len(list(tmp_path.glob("version=*"))) == 2


def test_cross_validation_and_tuning(data):
    folds = train.cross_validate(data, F.col("row_id"), train.Settings(word_features=100, char_features=100, max_iter=10), folds=3)
    assert sum(r.rows for r in folds.collect()) == data.count() and min(r.accuracy for r in folds.collect()) > 0.5
    grid = {"word_features": (50,), "word_range": ((1, 2),), "char_features": (50, 80), "char_range": ((3, 6),), "c": (1.0, 10.0)}
    rows = train.tune(data, F.col("row_id"), grid, folds=2, max_iter=5).collect()
    assert len(rows) == 4 and [r.accuracy for r in rows] == sorted((r.accuracy for r in rows), reverse=True)
    assert math.prod(len(v) for v in train.GRID.values()) == 144


def test_no_shuffle_while_scoring(spark, model):
    df = spark.createDataFrame([("r", "a", "x")], "repo string, file string, content string")
    assert "Exchange" not in model.predict(df)._jdf.queryExecution().executedPlan().toString()


def reference_char_ngrams(code: str, low: int, high: int) -> list[str]:
    out = []
    for word in code.lower().split():
        padded = f" {word} "
        for n in range(low, high + 1):
            if n <= len(padded):
                out += [padded[i:i + n] for i in range(len(padded) - n + 1)]
    return out


@pytest.mark.parametrize("code", ["os.system(cmd)", "a", "", "  x\ty z ", "École élève", "don't  stop"])
def test_ngrams_by_definition(spark, code):
    df = features.with_tokens(spark.createDataFrame([(code,)], "code string"), F.col("code"))
    row = df.select(features.char_ngrams(), features.char_ngrams((3, 6)), "_tokens", features.word_ngrams()).first()
    assert sorted(row[0]) == sorted(reference_char_ngrams(code, 2, 5))
    assert sorted(row[1]) == sorted(reference_char_ngrams(code, 3, 6))
    import re
    import unicodedata
    plain = "".join(c for c in unicodedata.normalize("NFKD", code.lower()) if not unicodedata.combining(c))
    tokens = re.findall(r"(?u)\b\w[\w.]+\b", plain)
    assert row[2] == tokens
    assert sorted(row[3]) == sorted(" ".join(tokens[i:i + n]) for n in (1, 2, 3) for i in range(len(tokens) - n + 1))


def test_confusion(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "label string, ml_prediction string")
    assert {r.actual: (r.a, r.b) for r in train.confusion(df, ["a", "b"]).collect()} == {"a": (1, 1), "b": (0, 1)}


@pytest.mark.parametrize("buckets,fullest", [(1 << 12, 3), (8, 1), (64, 1), (1 << 20, 1)])
def test_heavy_terms_equal_counts_of_all(spark, monkeypatch, buckets, fullest):
    """However many terms share a bucket, and when the fullest buckets do not hold all of the most used terms."""
    import random

    rng = random.Random(buckets)
    words = [f"t{i}" for i in range(700)]
    rows = [(" ".join(rng.choices(words, [1 / (i + 1) for i in range(700)], k=rng.randint(0, 60))),) for _ in range(150)]
    df = spark.createDataFrame(rows, "code string").select(F.split("code", " ").alias("terms"))
    monkeypatch.setattr(features, "FULLEST", fullest)
    for size in (5, 40, 5000):
        want = features.vocabulary(features.term_counts(df, F.col("terms")), size).collect()
        assert features.heavy_terms(df, F.col("terms"), size, buckets).collect() == want
    empty = df.filter("false")
    assert features.heavy_terms(empty, F.col("terms"), 5, buckets).count() == 0


TEXTS = ["os.system(cmd) os.system(cmd)", "a", "", None, "  x\ty z ", "École élève élève", "don't  stop", "ΑΣ İx 😀b 😀b", "v" * 3000]


def test_counted_char_ngrams(spark):
    """Different n-grams in order with their uses, in lists that a task makes from words it remembers."""
    df = features.with_tokens(spark.createDataFrame(list(enumerate(TEXTS)), "id int, code string"), F.col("code"))
    whole = {r.id: r.t for r in df.select("id", features.char_ngrams((2, 4)).alias("t")).collect()}
    got = features.char_ngram_counts(df.select("id", "_code"), (2, 4)).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        want = whole[r.id]
        assert (r["_grams"] is None) == (want is None)
        if want is not None:
            assert [g.term for g in r["_grams"]] == sorted(set(want), key=str.encode) and [g.uses for g in r["_grams"]] == [want.count(g.term) for g in r["_grams"]]


def test_char_counts_by_words_equal_counts_of_all(spark):
    df = features.with_tokens(spark.createDataFrame([(t,) for t in TEXTS * 3], "code string"), F.col("code"))
    want = features.vocabulary(features.term_counts(df, features.char_ngrams()), 5000).collect()
    words = features.used_words(df)
    assert words.filter(F.col("_code") == "os.system(cmd)").first().uses == 6
    assert features.vocabulary(features.term_counts(words, features.char_ngrams(), "uses"), 5000).collect() == want
    assert features.heavy_terms(words, features.char_ngrams(), 5000, 64, "uses").collect() == want
    assert features.heavy_terms(words, features.char_ngrams(), 20, 64, "uses").collect() == want[:20]


def test_vectors_are_sparse_and_stored_once(spark, data, monkeypatch):
    """Term vectors by definition, never dense, and no vectors kept in memory beside the regression's own."""
    words, chars = ["os.system", "cmd", "os.system cmd"], [" o", "os", "xy", "s.s"]
    df = features.with_tokens(spark.createDataFrame(list(enumerate(TEXTS)), "id int, code string"), F.col("code"))
    for logs in (False, True):
        rows = features.term_vectors(df, words, chars, (1, 2), (2, 3), logs).collect()
        for r in rows:
            tokens = r["_tokens"] or []
            for vector, vocab, terms in ((r["_word_counts"], words, tokens + [" ".join(p) for p in zip(tokens, tokens[1:])]),
                                         (r["_char_counts"], chars, reference_char_ngrams(r["_code"] or "", 2, 3))):
                uses = {i: terms.count(t) for i, t in enumerate(vocab) if t in terms}
                assert type(vector).__name__ == "SparseVector" and vector.size == len(vocab)
                assert dict(zip(vector.indices.tolist(), vector.values.tolist())) == pytest.approx({i: 1 + math.log(n) if logs else n for i, n in uses.items()})
    fit, plans = train._fit_classifier, []
    monkeypatch.setattr(train, "_fit_classifier", lambda rows, *rest: (plans.append(rows), fit(rows, *rest))[1])
    train.train(data, train.Settings(word_features=30, char_features=30, max_iter=2))
    assert plans[0].inputFiles() and not plans[0].storageLevel.useMemory


def test_held_out_rows_are_vectorized_once_for_all_penalties(data, monkeypatch):
    seen, transform = [], train.Vectorizer.transform
    monkeypatch.setattr(train.Vectorizer, "transform", lambda self, df, code: (seen.append(1), transform(self, df, code))[1])
    grid = {"word_features": (50,), "word_range": ((1, 2),), "char_features": (50,), "char_range": ((2, 3),), "c": (1.0, 5.0, 10.0)}
    rows = train.tune(data, F.col("row_id"), grid, folds=2, max_iter=3).collect()
    assert len(rows) == 3 and {r.rows for r in rows} == {data.count()} and len(seen) == 4


def test_each_word_ngram_equals_the_arrays(spark):
    """The same terms as often, made without lambdas."""
    df = features.with_tokens(spark.createDataFrame([(t,) for t in [*TEXTS, "one", "one two", "one two three four"]], "code string"), F.col("code"))
    for sizes in ((1, 3), (1, 2), (2, 3), (3, 3)):
        want = sorted(r[0] for r in df.select(F.explode(features.word_ngrams(sizes))).collect())
        made = features.each_word_ngram(df, sizes)
        assert sorted(r.term for r in made.collect()) == want and "lambda" not in made._jdf.queryExecution().optimizedPlan().toString()
    want = features.term_counts(df, features.word_ngrams())
    assert sorted(features.heavy_terms(df, features.each_word_ngram, 5000, 64).collect()) == sorted(want.collect())


def test_terms_counted_in_arrays(spark):
    """Vocabularies, document counts and weights of whole arrays of tokens equal those of the columns, and texts are passed over once for both blocks."""
    texts = [*TEXTS, "one", "one two one two", "one two three four", "ﬁne naïve x.y..z _a__ 1.5 a.b.", "\x85a\x1cbb cc d"] * 2
    df = features.with_tokens(spark.createDataFrame(list(enumerate(texts)), "id int, code string"), F.col("code"))
    assert all(features._tokens(None if r["_code"] is None else r.lower) == (r["_tokens"] or []) for r in df.select("_code", "_tokens", F.lower("_code").alias("lower")).collect())
    for sizes, size, buckets in (((1, 3), 5000, 1 << 20), ((1, 3), 9, 8), ((2, 2), 4, 64)):
        want = features.vocabulary(features.term_counts(df, features.word_ngrams(sizes)), size).collect()
        assert features.heavy_word_terms(df, size, sizes, buckets).collect() == want
    want = sorted(features.term_counts(df, features.char_ngrams((2, 4))).collect())
    assert sorted(features.char_term_counts(features.used_words(df), (2, 4)).collect()) == want
    made = train.fit_vectorizer(df.select("code"), train.Settings(20, (1, 2), 30, (2, 3)))
    for name, terms, vocab, idf in (("words", features.word_ngrams((1, 2)), made.words, made.word_idf), ("chars", features.char_ngrams((2, 3)), made.chars, made.char_idf)):
        vocab_df = spark.createDataFrame([(t,) for t in vocab], "term string")
        by_term = {r.term: r.idf for r in features.inverse_document_frequency(df, terms, vocab_df).collect()}
        assert dict(zip(vocab, idf)) == pytest.approx(by_term)
    scored = made.transform(df.select("code"), F.col("code"))
    assert str(scored._jdf.queryExecution().optimizedPlan()).count("ArrowEvalPython") == 1
    for r in scored.collect():
        word = {i: v for i, v in zip(r.features.indices.tolist(), r.features.values.tolist()) if i < 20}
        tokens = features._tokens((r.code or "").lower())
        counts = {i: n for i, t in enumerate(made.words) if (n := (tokens + [" ".join(p) for p in zip(tokens, tokens[1:])]).count(t))}
        weights = {i: (1 + math.log(n)) * made.word_idf[i] for i, n in counts.items()}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        assert r.features.size == len(made.words) + len(made.chars)
        assert {i: v for i, v in word.items()} == pytest.approx({i: w / norm for i, w in weights.items()})


def test_texts_are_counted_once_for_all_sizes(spark, data, monkeypatch):
    """One count of terms a fold, for both sides and all sizes of vocabularies, and the same features as from the texts."""
    seen, counts = [], train.Vectorizer.counts
    monkeypatch.setattr(train.Vectorizer, "counts", lambda self, *args: (seen.append(1), counts(self, *args))[1])
    grid = {"word_features": (20, 50), "word_range": ((1, 2),), "char_features": (30, 50), "char_range": ((2, 3),), "c": (1.0, 10.0)}
    rows = train.tune(data, F.col("row_id"), grid, folds=2, max_iter=2).collect()
    assert len(rows) == 8 and {r.rows for r in rows} == {data.count()} and len(seen) == 2
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, code string")
    whole = train.fit_vectorizer(df, train.Settings(30, (1, 2), 40, (2, 3)))
    small = whole.narrowed(train.Settings(7, (1, 2), 9, (2, 3)))
    want = {r.id: r.features for r in small.transform(df, F.col("code")).collect()}
    got = small.transform(whole.counts(df, F.col("code")), F.col("code"))
    assert got.columns == ["id", "code", "features"] and {r.id: r.features for r in got.collect()} == want


def test_both_fits_of_an_evaluation_run_at_once(data, monkeypatch):
    import threading

    both, fit = threading.Barrier(2, timeout=120), train._fit_classifier
    monkeypatch.setattr(train, "_fit_classifier", lambda *args: (both.wait(), fit(*args))[1])
    model, scored = train.train_and_evaluate(data, F.col("row_id"), train.Settings(50, (1, 2), 50, (2, 3), max_iter=3))
    assert scored.count() == 36 and model.labels == ["High Risk", "Medium Risk", "Safe"] and not both.broken
