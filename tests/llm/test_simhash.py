"""SimHash near-duplicates against all pairs."""

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from riskloom.llm import simhash
from riskloom.llm.common import table
from riskloom.llm.components import components
from riskloom.llm.queries import QUERIES


def plain_print(text, shingle=3):
    words = [w for w in (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()]
    grams = [b" ".join(words[i:i + shingle]) for i in range(len(words) - shingle + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def groups(ids, prints, radius):
    parent = {i: i for i in range(len(ids))}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    named = {}
    for i in range(len(ids)):
        if ids[i] is not None:
            named[find(i)] = min(ids[i], named.get(find(i), ids[i]))
    return [named.get(find(i)) for i in range(len(ids))]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB \t\n.É", max_size=40))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == plain_print(text)


def test_long_text_is_counted_in_chunks(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(5000))
    monkeypatch.setattr(simhash, "CHUNK", 64)
    assert simhash.fingerprint(text.encode()) == plain_print(text)


def test_tiles_yield_a_spanning_forest():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
    near = np.unique(np.concatenate([base ^ np.uint64(1 << int(b)) for b in rng.integers(0, 63, 12)] + [base]))
    u, v = simhash.linked(near, None, 2)
    assert len(u) < len(near)
    assert np.all(np.bitwise_count(u ^ v) <= 24)
    left, right = near[:30], near[30:]
    u, v = simhash.linked(left, right, 2)
    assert len(u) < len(near)


def test_steps_cover_each_pair_once():
    steps = {tuple(s) for s in simhash._steps(2, 4)}
    assert (0, 0, 0, 0) in steps and len(steps) == 21
    assert not any(tuple(-x for x in s) in steps for s in steps if any(s))


def test_any_number_of_parts_finds_the_same_groups(spark):
    rng = np.random.default_rng(12)
    base = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    prints = np.unique(np.concatenate([base, *[base[:120] ^ np.uint64(1 << a) ^ np.uint64(1 << b) for a, b in rng.integers(0, 63, (6, 2))]]))
    table = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "print long")
    own = prints.view(np.int64).tolist()
    want = groups(list(range(len(own))), [p & (1 << 64) - 1 for p in own], 2)
    for parts in (4, 8, 16):
        roots = {r.node: r.root for r in components(simhash.near_links(table, 2, parts)).collect()}
        named = {}
        for i, p in enumerate(own):
            named.setdefault(roots.get(p, p), set()).add(want[i])
        assert all(len(x) == 1 for x in named.values()) and len(named) == len(set(want)), parts
    assert [simhash.parts_for(n) for n in (0, 10 ** 6, 1 << 22, 1 << 29, 10 ** 11)] == [4, 4, 8, 16, 16]


def test_query_equals_all_pairs(spark, sf):
    rows = QUERIES["op10_simhash_near_dedup"](spark, sf).collect()
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    assert len(rows) == len(texts)
    prints = [plain_print(texts[r.doc_id]) for r in rows]
    assert [r.fingerprint for r in rows] == [f"{p:016x}" for p in prints]
    assert [r.component_id for r in rows] == groups([r.doc_id for r in rows], prints, 2)


def test_edge_rows(documents):
    long = " ".join(f"word{i}" for i in range(30000))
    docs = documents((5, None), (4, ""), (3, " \n"), (2, long), (1, long), (None, long), (None, "alone here now"), (7, "x y z"), (7, "x y z"), (8, "X Y z"))
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == 10
    by = {(r.doc_id, r["print"]): r.component_id for r in rows}
    assert {by[i, 0] for i in (3, 4, 5)} == {3}
    assert sorted(r.component_id for r in rows if r.doc_id == 7) == [7, 7] and [r.component_id for r in rows if r.doc_id == 8] == [7]
    assert sorted((r.component_id for r in rows if r.doc_id is None), key=str) == [1, None]
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(3, " \n"), (1, long), (None, "alone here now"), (7, "x y z")], key=str)


def test_empty_table(spark, documents):
    none = documents((1, "a b c")).filter("doc_id < 0")
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.keep_first(none).count() == 0


def test_many_near_copies_are_one_group(documents):
    words = [f"w{i}" for i in range(2000)]
    docs = documents(*[(i, " ".join([*words[:500 + i], f"edit{i}", *words[500 + i:]])) for i in range(60)], clashing=False)
    rows = simhash.near_duplicates(docs).collect()
    prints = [plain_print(r.text) for r in docs.collect()]
    expected = dict(zip([r.doc_id for r in docs.collect()], groups(list(range(60)), prints, 2)))
    assert {r.doc_id: r.component_id for r in rows} == expected
