"""Positions in whole ordered lists, and who owns stored tables."""

import os
import random

import pytest
from pyspark.sql import functions as F

from catalog.registry import QUERIES
from riskloom.functions.durable import durable, remove, storage
from riskloom.functions.ranking import hashed_position, ranked_position
from riskloom.plans.scan import scan

SF = "/root/testdata/sf0.001"


def test_positions_equal_a_sort(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else rng.choice([None, "a", "b"]), rng.randint(0, 40), i) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, score int, id int").repartition(6)
    got = ranked_position(df, ["g"], [F.col("score").desc(), F.col("id")], "place").collect()
    assert len(got) == len(rows)
    for g in ("hot", "a", "b", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        assert [(r.g, r.score, r.id) for r in sorted((r for r in got if r.g == g), key=lambda r: r.place)] == own
        assert sorted(r.place for r in got if r.g == g) == list(range(1, len(own) + 1))


def test_positions_without_groups_and_of_no_rows(spark):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("id"))
    assert all(r.n == r.id + 1 for r in ranked_position(df, [], [F.col("id")], "n").collect())
    assert ranked_position(df.filter("id < 0").withColumn("g", F.lit(1)), ["g"], [F.col("id")], "n").count() == 0


def test_no_window_over_a_group_alone(spark):
    plan = ranked_position(spark.range(90).withColumn("g", F.lit(1)), ["g"], [F.col("id")], "n")._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and not any("g#" in line for line in windows)


def test_scan_lists(files):
    df = files(("r", "b.py", "x = eval(a)\nverify = False\n"), ("r", "a.py", "x = eval(a)\n"), ("s", "a.py", "ok"))
    with scan(df) as result:
        assert {(r.repo, r.file): r.position for r in result.file_positions().collect()} == {("r", "b.py"): 1, ("r", "a.py"): 2, ("s", "a.py"): 1}
        assert [r.position for r in result.priority_positions().orderBy("repo", "position").collect()] == [1, 2, 3]


def local(paths):
    return [p.removeprefix("file:") for p in paths]


def test_stored_tables_have_an_owner(spark):
    with storage(spark) as owned:
        rows = durable(spark.range(10), "mine")
        with storage(spark) as inner:
            hashed_position(spark.range(100).withColumn("g", F.lit(1)), ["g"], F.col("id"), "n", "all").collect()
            assert len(inner) == 1 and all(map(os.path.exists, local([*owned, *inner])))
        assert not any(map(os.path.exists, local(inner)))
        assert rows.count() == 10 and len(owned) == 1
    assert not any(map(os.path.exists, local(owned)))
    mine: list[str] = []
    with storage(spark) as owned:
        durable(spark.range(3), "kept", mine)
        assert mine == owned and os.path.exists(*local(mine))
        remove(spark, mine)
        assert not os.path.exists(*local(mine))


@pytest.mark.parametrize("name", ["stratified_split", "csv_ranges", "search_findings_index", "dedupe_exact", "json_objects", "ranked_positions", "priority_top200", "folds"])
def test_nothing_is_left_of_a_query(spark, name):
    if not os.path.exists(SF):
        pytest.skip("test tables are not here")
    with storage(spark) as owned:
        assert QUERIES[name](spark, SF).collect()
        assert any(map(os.path.exists, local(owned)))
    assert not any(map(os.path.exists, local(owned)))
