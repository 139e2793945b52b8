import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from riskloom.functions.ranking import hashed_position, top_per_group
from riskloom.operators import samples


@pytest.fixture
def rows(spark):
    def build(*data):
        return spark.createDataFrame([(i, *d) for i, d in enumerate(data)], "row_id int, code string, label string")
    return build


def test_first_copy_keeps_its_label(rows):
    df = rows((" a ", "H"), ("a", "S"), ("", "S"), ("  ", "S"), ("b", "M"))
    got = {r.row_id: (r.code, r.label) for r in samples.keep_first(df, ["row_id"]).collect()}
    assert got == {0: (" a ", "H"), 4: ("b", "M")}


def test_prefix_width(rows):
    df = rows(("x" * 500 + "1", "H"), ("x" * 500 + "2", "S"), ("x" * 499, "M"))
    assert {r.row_id for r in samples.keep_first(df, ["row_id"], 500).collect()} == {0, 2}
    assert samples.keep_first(df, ["row_id"]).count() == 3
    assert samples.keep_first(df, ["row_id"], 400).count() == 1


def test_copies_are_combined_before_the_shuffle(spark, rows):
    first = samples._first_of_each(rows(("a", "H")), samples.code_key(), ["row_id"])
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan and "HashAggregate" in plan and "SortAggregate" not in plan and "Window" not in plan


def test_no_text_is_shuffled(spark, rows):
    """Rows are picked out by bitmaps where they are read."""
    df = rows(("a", "H"), ("a", "S"), ("b", "S"))
    for kept in (samples.keep_first(df, ["row_id"]), samples.augment(df, rows(("c", "H"), ("a", "S")), ["row_id"])):
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastExchange" in plan and not re.search(r"(?<!Broadcast)Exchange ", plan)


def test_bitmaps_of_any_numbers(spark, monkeypatch):
    """Negative, far apart and dense row numbers, in one piece, in many pieces, and by a join where bitmaps would be larger."""
    rng = random.Random(5)
    numbers = sorted({*range(-40_000, 40_000, 7), 0, -1, 1, 32_767, 32_768, 32_769, -32_767, -32_768, -32_769, 65_536, -65_536, *(rng.randrange(1 << 22) for _ in range(3000))})
    rows = [(n, "ab"[n % 2] + str(n % 900)) for n in numbers]
    df = spark.createDataFrame(rows, "row_id long, code string")
    first = {}
    for n, code in rows:
        first.setdefault(code, n)
    want = sorted(first.values())
    wanted = spark.createDataFrame([(n,) for n in want], "row_id long")
    assert sorted(r.row_id for r in samples.keep_first(df, ["row_id"]).collect()) == want
    monkeypatch.setattr(samples, "PIECE_BYTES", 8192)
    monkeypatch.setattr(samples, "SMALL_BYTES", 1 << 40)
    some = sorted(rng.sample(numbers, 3000))
    many = samples.rows_at(df, spark.createDataFrame([(n,) for n in some], "row_id long"), ["row_id"])
    assert sorted(r.row_id for r in many.collect()) == some and "Union" in many._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(samples, "SMALL_BYTES", 0)
    joined = samples.rows_at(df, spark.createDataFrame([(want[0],), (want[-1],)], "row_id long"), ["row_id"])
    assert sorted(r.row_id for r in joined.collect()) == [want[0], want[-1]]
    assert samples.rows_at(df, wanted.filter("false"), ["row_id"]).count() == 0


def test_earlier_source_wins(rows):
    merged = samples.merge(rows(("a", "old")), rows(("a", "new"), ("b", "new")))
    got = {r.code: r.label for r in samples.keep_first(merged, ["source_rank", "row_id"], 500).collect()}
    assert got == {"a": "old", "b": "new"}


def test_two_order_columns_and_missing_code(spark):
    df = spark.createDataFrame([(1, -5, "a"), (1, -9, "a"), (0, 2 ** 60, "a"), (0, 7, None), (1, 3, None)], "rank int, row_id long, code string")
    got = {(r.rank, r.row_id) for r in samples.keep_first(df, ["rank", "row_id"], keep_empty=True).collect()}
    assert got == {(0, 2 ** 60), (0, 7)}


def test_whole_code_tells_samples_apart_unless_a_width_is_given(rows):
    existing, extra = rows(("x" * 500, "H")), rows(("x" * 500 + "y", "S"))
    assert samples.augment(existing, extra, ["row_id"]).count() == 2
    assert samples.augment(existing, extra, ["row_id"], 400).count() == 1


def test_a_task_passes_on_few_rows_of_a_group(spark):
    plan = top_per_group(spark.range(0, 9000, 1, 9).withColumn("g", F.lit(1)), ["g"], [F.col("id")], 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_augment_keeps_existing_copies(rows):
    existing = rows(("a", "H"), ("a", "H"))
    extra = rows((" a", "S"), ("c", "S"), ("c ", "S"))
    got = sorted((r.code, r.label) for r in samples.augment(existing, extra, ["row_id"]).collect())
    assert got == [("a", "H"), ("a", "H"), ("c", "S")]


def test_top_rows_of_a_hot_group(spark):
    df = spark.range(20000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"), "id")
    got = top_per_group(df, ["g"], [F.col("id").desc()], 7, "n").collect()
    for group in {r.g for r in got}:
        ids = [r.id for r in sorted((r for r in got if r.g == group), key=lambda r: r.n)]
        want = [i for i in range(19999, -1, -1) if (("hot" if i % 3 == 0 else f"g{i % 50}") == group)][:7]
        assert ids == want


def test_hashed_position_is_exact(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("g"), "id")
    got = hashed_position(df, ["g"], F.col("id"), "n", "total").collect()
    for group in "ab":
        mine = sorted((r for r in got if r.g == group), key=lambda r: r.n)
        assert [r.n for r in mine] == list(range(1, len(mine) + 1)) and {r.total for r in mine} == {len(mine)}
        digests = [hashlib.md5(str(r.id).encode()).hexdigest() for r in mine]
        assert digests == sorted(digests)


def test_split_and_folds_are_stratified(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 100, "rare").otherwise("often").alias("label"), "id")
    split = samples.stratified_split(df, F.col("id"))
    assert {(r.label, r.is_test): r["count"] for r in split.groupBy("label", "is_test").count().collect()} == {
        ("rare", True): 20, ("rare", False): 80, ("often", True): 180, ("often", False): 720}
    folds = samples.stratified_folds(df, F.col("id")).groupBy("label", "fold").count().collect()
    assert {r["count"] for r in folds if r.label == "rare"} == {20} and len(folds) == 10


def test_caps_and_distribution(spark):
    df = spark.range(900).select(F.lit("s").alias("source"), "id", F.when(F.col("id") < 300, "a").otherwise("b").alias("label"))
    assert {r.id for r in samples.cap_per_source(df, "source", [F.col("id")], 800).collect()} == set(range(800))
    assert samples.stratified_sample(df, "label", F.col("id"), 80).groupBy("label").count().filter("count = 80").count() == 2
    assert samples.stratified_sample(df, "label", F.col("id"), 80, seed="x").count() == 160
    assert [r.id for r in samples.first_rows(df, [F.col("id")], 3).collect()] == [0, 1, 2]
    assert {r.label: (r.samples, r.percent) for r in samples.label_distribution(df).collect()} == {"a": (300, 33.3), "b": (600, 66.7)}
    assert samples.top_kinds(df, "label", 1).first().label == "b" and samples.class_count(df).first().classes == 2
