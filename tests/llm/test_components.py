"""Connected components against a search."""

import random

from riskloom.llm.components import components


def test_paths_stars_and_rings(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 260)] + [(300, 301), (301, 302), (302, 300), (7, 7), (301, 300), (-5, 400)]
    links += [(rng.randrange(500, 600), rng.randrange(500, 600)) for _ in range(70)]
    rng.shuffle(links)
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    expected = {}
    for start in sorted(near):
        if start not in expected and len(near[start] - {start}):
            todo = [start]
            while todo:
                node = todo.pop()
                if node not in expected:
                    expected[node] = start
                    todo += near[node]
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(got) == len({r.node for r in got})
    assert {r.node: r.root for r in got} == expected


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
