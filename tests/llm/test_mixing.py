"""Mixing: targets against repeated resharing, samples against a sort, and the shape of the sample."""

import math

import pytest
from pyspark.sql import functions as F

from riskloom.llm import mixing
from riskloom.llm.queries import QUERIES


def reshared(sizes, share=1.5, cap=2.0, cycle=(3, 1, 2)):
    """Targets by the words of the rule: share out by weight, cut, share out what was cut, and so on."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: cycle[k % len(cycle)] for k, s in enumerate(order)}
    goal, open_, left = dict.fromkeys(order, 0.0), set(order), share * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total >= cap * sizes[s]}
        if not over:
            goal |= {s: left * weight[s] / total for s in open_}
            break
        goal |= {s: cap * sizes[s] for s in over}
        left -= sum(goal[s] for s in over)
        open_ -= over
    return goal


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 10, "b": 1000, "c": 10, None: 500, "Z": 3}, {"x": 7}, {"a": 0, "b": 50}, {"é": 5, "z": 90, "e": 40, "": 1}])
def test_targets(spark, sizes):
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    assert {r.source: pytest.approx(r.target) for r in got} == reshared(sizes)


def test_taken_words_come_near_the_targets(spark, sf):
    rows = QUERIES["op2_mixing"](spark, sf).collect()
    assert all(0 <= r.taken <= 2 * r["size"] for r in rows)
    assert rows == QUERIES["op2_mixing"](spark, sf).collect()


def test_sample_is_the_sorted_one(spark, documents):
    rows = [(i, " ".join(["word"] * (1 + i * 7 % 23)) + " 123 456" * (i % 3), f"s{i % 4}" if i % 5 else None) for i in range(400)]
    docs = documents(*[(i, t, s, "en") for i, t, s in rows])
    got = mixing.mix(docs)
    inner = [c for c in got.columns if c not in docs.columns]
    assert inner == ["size_", "source_size_", "target_", "epochs_", "taken_", "times_"]
    result = {r.doc_id: r for r in got.collect()}
    keys = {r.doc_id: (r.u, r.q) for r in docs.select("doc_id", mixing.uniform(F.col("doc_id")).alias("u"), mixing.text_quality(F.col("text")).alias("q")).collect()}
    sizes = {}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    goal = reshared(sizes)
    for source in sizes:
        own = sorted((-math.log(keys[i][0]) / keys[i][1], i, len(t.split())) for i, t, s in rows if s == source)
        epochs = int(goal[source] / sizes[source] + 1e-12)
        rest, ahead = goal[source] - epochs * sizes[source], 0
        for _, i, n in own:
            extra = rest > 0 and ahead + n / 2 <= rest
            assert (result[i].times_, result[i].taken_) == (epochs + extra, (epochs + extra) * n), (source, i)
            ahead += n
        assert abs(sum(result[i].taken_ for _, i, _ in own) - goal[source]) <= max(n for *_, n in own) / 2 + 1e-6


def test_better_documents_are_taken_more_often(spark, documents):
    docs = documents(*[(i, "word", "one", "en") for i in range(3000)], *[(5000 + i, "word", s, "en") for s in "pqr" for i in range(3000)], clashing=False)
    weight = F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0)
    taken = mixing.mix(docs, share=0.15, quality=weight).filter("times > 0").groupBy(F.col("doc_id") % 2).count().collect()
    by = {r[0]: r["count"] for r in taken}
    assert by[0] > 1.5 * by[1]


def test_rows_of_every_kind(spark, documents):
    long = "long " * 50_000
    docs = documents((1, None, "a", "en"), (2, "", "a", "en"), (None, "x y", "a", "en"), (None, "p q r", None, "en"), (3, long, "b", "en"), (4, "w w w", "b", "en"), (4, "w w w", "b", "en"))
    rows = mixing.mix(docs).collect()
    assert len(rows) == 7 and all(r.taken_ <= 2 * r.size_ for r in rows)
    assert len({r.taken_ for r in rows if r.doc_id == 4}) == 1
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    times = sorted((r.doc_id or -1, r.times_) for r in rows)
    got = out.groupBy(F.coalesce("doc_id", F.lit(-1)).alias("i")).count().collect()
    assert {r.i: r["count"] for r in got} == {i: sum(t for j, t in times if j == i) for i, t in times if sum(t for j, t in times if j == i)}
    assert mixing.mix(docs.filter("doc_id < 0")).count() == 0
    assert mixing.mix(docs.filter("doc_id = 2")).collect()[0].taken_ == 0


def test_quality_does_not_depend_on_the_script(spark):
    rows = [("latin words here",), ("привет всем тут",), ("你好世界你好世",), ("नमस्ते दुनिया",), ("12 34 !! ??",), ("",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "text string").select(mixing.text_quality(F.col("text"))).collect()]
    assert min(got[:4]) > 1.3 and got[4:] == [0.5, 0.5, 0.5]
