"""Sharding against splitting buckets one bit at a time."""

from collections import defaultdict

import pytest

from riskloom.llm import sharding
from riskloom.llm.common import table
from riskloom.llm.queries import QUERIES, SHARD_BYTES


def split(rows, limit, depth=0):
    """rows: (hash, bytes, key); the shards of extendible hashing, by recursion."""
    if sum(b for _, b, _ in rows) <= limit or len({h for h, _, _ in rows}) == 1:
        name = format(rows[0][0] >> 64 - depth, f"0{depth}b") if depth else "*"
        return {key: name for _, _, key in rows}
    out = {}
    for bit in (0, 1):
        half = [r for r in rows if r[0] >> 63 - depth & 1 == bit]
        out |= split(half, limit, depth + 1) if half else {}
    return out


@pytest.mark.parametrize("limit", [50_000_000, 30_000, 3_000, 400])
def test_shards_equal_recursive_splits(spark, sf, limit):
    docs = table(spark, sf, "documents")
    hashes = {r.doc_id: r.h & (1 << 64) - 1 for r in docs.select("doc_id", sharding._hash("doc_id", "text").alias("h")).collect()}
    rows = sharding.shard(docs, limit).collect()
    expected = split([(hashes[r.doc_id], len(r.text.encode()), r.doc_id) for r in rows], limit)
    assert {r.doc_id: r.shard for r in rows} == expected
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    for name, own in by.items():
        assert {(r.shard_bytes, r.shard_rows) for r in own} == {(sum(r.bytes for r in own), len(own))}
        assert own[0].shard_bytes <= limit or len(own) == 1


def test_query_equals_recursive_splits(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    docs = table(spark, sf, "documents")
    hashes = {r.doc_id: (r.h & (1 << 64) - 1, len((r.text or "").encode())) for r in docs.select("doc_id", "text", sharding._hash("doc_id", "text").alias("h")).collect()}
    rows = QUERIES["op4_sharding"](spark, sf).collect()
    assert {r.doc_id: r.shard for r in rows} == split([(h, n, i) for i, (h, n) in hashes.items()], SHARD_BYTES) and len(rows) == len(hashes)
    assert {r.doc_id: r.bytes for r in rows} == {i: n for i, (_, n) in hashes.items()}
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.shard] += r.bytes
    assert len(sizes) > 10 and max(sizes.values()) <= SHARD_BYTES and all(r.shard_bytes == sizes[r.shard] for r in rows)


def test_very_long_text(documents):
    docs = documents(*[(i, "x" * 100) for i in range(50)], (99, "long " * 400_000), clashing=False)
    rows = sharding.shard(docs, 1000).collect()
    long, = (r for r in rows if r.doc_id == 99)
    assert (long.bytes, long.shard_bytes, long.shard_rows) == (2_000_000, 2_000_000, 1)
    assert all(r.shard_bytes <= 1000 for r in rows if r.doc_id != 99)


def test_equal_rows_are_cut_into_pages(documents):
    docs = documents(*[(1, "ten bytes.", "s", "en")] * 25, (2, "short", "s", "en"), (3, None, "s", "en"), (4, "", "s", "en"))
    rows = sharding.shard(docs, 45).collect()
    assert len(rows) == 28
    pages = defaultdict(list)
    for r in rows:
        if r.doc_id == 1:
            pages[r.shard_].append(r)
    assert sorted(map(len, pages.values())) == [1, 4, 4, 4, 4, 4, 4]
    assert all(r.shard_bytes_ if False else r.shard_rows == len(own) and r.shard_bytes == 10 * len(own) for own in pages.values() for r in own)


def test_rows_of_every_kind(documents):
    docs = documents((None, "a" * 1000), (None, "b" * 10), (1, "c" * 20), (1, "c" * 20), (2, None), (3, ""))
    got = sharding.shard(docs, 100)
    rows = got.collect()
    assert len(rows) == 6 and got.columns[:len(docs.columns)] == docs.columns
    large = [r for r in rows if r.bytes_ == 1000]
    assert large[0].shard_rows == 1
    by = defaultdict(int)
    for r in rows:
        by[r.shard_] += r.bytes_
    assert all(n <= 100 for s, n in by.items() if s != large[0].shard_)
    assert sharding.shard(docs.filter("doc_id < 0")).count() == 0
