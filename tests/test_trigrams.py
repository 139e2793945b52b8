"""The trigram index against a scan."""

import random
import re

import pytest
from pyspark.sql import functions as F

from riskloom.operators.trigrams import TrigramIndex


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(6)
    words = ["select", "SQL", "Éclair", "request.args", "eval(", "x", "", "a\nb", "straße", "İstanbul", "%_", "tab\there"]
    data = [(i, " ".join(rng.choices(words, k=rng.randint(0, 4))), rng.choice([None, "src/SQL.py", "app.py", "q"])) for i in range(3000)]
    return spark.createDataFrame(data, "id long, issue string, file string").repartition(5).persist()


def test_finds_what_a_scan_finds(rows):
    with TrigramIndex(rows, ("issue", "file")) as index:
        for wanted in ("sql", "SQL.p", "clair", "ÉCLAIR", "request.args eval(", "x", "", "zzz", "%_", "straße", "t.a", "l x", "q\nq", "a\nb", "tab\there"):
            scan = rows.filter(F.coalesce(F.contains(F.lower("issue"), F.lit(wanted.lower())), F.lit(False)) | F.coalesce(F.contains(F.lower("file"), F.lit(wanted.lower())), F.lit(False)))
            assert sorted(r.id for r in index.containing(wanted).collect()) == sorted(r.id for r in scan.collect()), wanted


def test_reads_the_lists_of_its_trigrams_only(rows):
    with TrigramIndex(rows, ("issue", "file")) as index:
        plan = index.candidates("request")._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"PushedFilters: \[.*In\(gram", plan)
        assert index.candidates("ab") is None
        assert index.candidates("eval(").count() < rows.count()


def test_empty_table(rows):
    with TrigramIndex(rows.filter("id < 0"), ("issue",)) as index:
        assert index.containing("sql").count() == 0 and index.containing("s").count() == 0
