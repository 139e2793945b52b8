"""Lloyd's rounds by column blocks against whole vectors, in Python integers."""

import math
import random
from hashlib import sha256

import pytest

from riskloom.llm import vector_clusters as V
from riskloom.llm.queries import ORACLE, QUERIES


def by_hand(rows, count=8, rounds=10, dimensions=64):
    kept = [(i, [int(v) * 1024 if abs(v) >= 2.0 ** 53 else math.floor(1024 * v) for v in x], x) for i, x in rows
            if x is not None and len(x) == dimensions and all(v is not None and math.isfinite(v) for v in x)]
    first = sorted(kept, key=lambda r: (sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[2]))[:count]
    centroids = [x for _, x, _ in first]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(centroids))

    for _ in range(rounds):
        own = [[] for _ in centroids]
        for _, x, _ in kept:
            own[nearest(x)[1]].append(x)
        centroids = [[sum(v) // len(xs) for v in zip(*xs)] if xs else c for xs, c in zip(own, centroids)]
    found = [(i, *nearest(x)[::-1]) for i, x, _ in kept]
    fits = lambda n: n if n < 1 << 63 else None
    add = lambda ds: None if any(fits(d) is None for d in ds) else fits(sum(ds))
    digests = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, k, fits(d), add([e for _, j, e in found if j == k]), add([e for *_, e in found]), digests[k]) for i, k, d in found]


def table_of(spark, rows):
    return spark.createDataFrame([(i, x, 1, "c") for i, x in rows], "vec_id long, embedding array<double>, cluster int, distance string")


def same(got, rows, **how):
    assert sorted(map(tuple, got), key=str) == sorted(by_hand(rows, **how), key=str)


def test_query_equals_sql(spark, sf):
    from catalog.check import compare

    assert compare(spark, sf, QUERIES["op13_vector_clusters"], ORACLE["op13_vector_clusters"]) == ""


def test_rows_of_every_kind(spark):
    rng = random.Random(1)
    vector = lambda: [rng.gauss(0, 1) for _ in range(64)]
    twin = vector()
    rows = [(k, vector()) for k in range(40)] + [(100, twin), (100, twin), (None, twin), (None, vector()), (7, vector()), (101, None), (102, []), (103, vector()[:63]), (104, [*vector(), 1.0]),
                                                 (105, [None, *vector()[1:]]), (106, [math.nan, *vector()[1:]]), (107, [math.inf, *vector()[1:]]), (108, [-math.inf, *vector()[1:]])]
    got = V.clusters(table_of(spark, rows), rounds=2)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    same(got.collect(), rows, rounds=2)


def test_ties_and_equal_vectors(spark):
    """Few different vectors: centroids coincide, the smaller number wins, clusters stay empty."""
    rows = [(k, [float(k % 3 - 1)] * 64) for k in range(30)]
    same(V.clusters(table_of(spark, rows), rounds=2).collect(), rows, rounds=2)


def test_fewer_vectors_than_clusters(spark):
    rows = [(1, [0.5] * 64), (2, [-0.25] * 64)]
    same(V.clusters(table_of(spark, rows), rounds=1).collect(), rows, rounds=1)
    assert V.clusters(table_of(spark, [(1, None), (2, [1.0])])).count() == 0
    assert V.clusters(table_of(spark, rows).filter("vec_id > 9")).count() == 0


def test_numbers_beyond_64_bits(spark):
    rng = random.Random(5)
    rows = [(k, [rng.choice([1e3, 2.0 ** 40, -1e30, 3.0]) * rng.random() for _ in range(64)]) for k in range(24)]
    got = V.clusters(table_of(spark, rows), rounds=2).collect()
    same(got, rows, rounds=2)
    assert any(r.distance is None for r in got)


@pytest.mark.parametrize("width,count,dimensions", [(5, 3, 7), (64, 2, 6), (1, 4, 3)])
def test_column_blocks_of_any_width(spark, width, count, dimensions):
    rng = random.Random(width)
    rows = [(k, [rng.randint(-9, 9) / 16 for _ in range(dimensions)]) for k in range(60)]
    same(V.clusters(table_of(spark, rows), count=count, rounds=2, dimensions=dimensions, width=width).collect(), rows, count=count, rounds=2, dimensions=dimensions)


def test_many_row_blocks(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(k, [rng.gauss(0, 1) for _ in range(4)]) for k in range(5000)]
    df = table_of(spark, rows).repartition(7)
    same(V.clusters(df, rounds=3, dimensions=4, width=2).collect(), rows, rounds=3, dimensions=4)
