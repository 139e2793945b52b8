"""Removal of repeated byte strings against a table of all windows."""

import random
from hashlib import sha256

import numpy as np
import pytest

from riskloom.llm import suffix_dedup as S
from riskloom.llm.common import table
from riskloom.llm.queries import QUERIES


def by_hand(rows, length):
    """rows: (doc_id, text); the expected result of every row, in order."""
    first = {}
    for doc_id, text in rows:
        data = (text or "").encode()
        for k in range(len(data) - length + 1):
            place = S.LAST if doc_id is None else doc_id
            w = data[k:k + length]
            first[w] = min(first.get(w, place), place)
    out = []
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), dtype=bool)
        for k in range(len(data) - length + 1):
            if first[data[k:k + length]] < (S.LAST if doc_id is None else doc_id):
                gone[k:k + length] = True
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(gone)))
        out.append((doc_id, len(data), int(gone.sum()), spans, bytes(b for b, g in zip(data, gone) if not g)))
    return out


def same(got, rows, length):
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted((tuple(r) for r in got), key=key) == sorted(by_hand(rows, length), key=key)


def test_query_equals_all_windows(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    expected = {(i, n, gone, spans, sha256(kept).hexdigest()) for i, n, gone, spans, kept in by_hand(rows, S.LENGTH)}
    got = {tuple(r) for r in QUERIES["op11_suffix_dedup"](spark, sf).collect()}
    assert got == expected and sum(r[2] for r in got) > 10_000


@pytest.mark.parametrize("hot", [1, 3, S.HOT])
def test_shared_passages(spark, documents, hot):
    """One passage in every text, at other places, with neighbours of its own; grams of many documents are dealt out by window."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choices("abcdé ", k=n))
    passages = [word(n) for n in (30, 61, 62, 90, 400)]
    rows = [(k, "".join(rng.choice([*passages, word(rng.randint(0, 120))]) for _ in range(rng.randint(0, 6)))) for k in range(60)]
    got = S.without_repeats(documents(*rows), hot=hot).collect()
    same(got, rows, S.LENGTH)
    assert sum(r.n_removed for r in got)


@pytest.mark.parametrize("length,gram", [(24, 24), (20, 12), (64, 16)])
def test_other_lengths(spark, documents, length, gram):
    rng = random.Random(length)
    rows = [(k, "".join(rng.choices("ab", k=rng.randint(0, 90))) + "ab" * rng.randint(0, 40)) for k in range(30)]
    same(S.without_repeats(documents(*rows), length=length, gram=gram).collect(), rows, length)


def test_rows_of_every_kind(spark, documents):
    line = "the quick brown fox jumps over the lazy dog, and on it goes until the day is done"
    rows = [(None, line), (None, line), (None, line + "!"), (1, None), (2, ""), (3, "short"), (4, line[:49]), (5, line[:50]), (5, "other " + line[:50]), (7, line), (7, line), (6, line + line),
            (8, "é" * 60), (9, "è" + "é" * 40), (10, "a" * 500), (11, "a" * 49), (12, "a" * 51), (-3, "a" * 50), (S.LAST, line)]
    df = documents(*rows)
    got = S.without_repeats(df)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
    same(got.collect(), rows, S.LENGTH)
    same(S.without_repeats(documents((4, line), (9, "x" + line))).collect(), [(4, line), (9, "x" + line)], S.LENGTH)


def test_empty_tables(spark, documents):
    assert S.without_repeats(documents((1, "x")).filter("doc_id > 5")).count() == 0
    assert [tuple(r) for r in S.without_repeats(documents((1, None))).collect()] == [(1, 0, 0, 0, b"")]


def test_very_long_text(spark, documents):
    """Longer than the pieces whose grams are hashed, with a repeat over their border."""
    rng = random.Random(9)
    long = "".join(rng.choices("abcdefgh ", k=S.PIECE + 4000))
    rows = [(1, long[S.PIECE - 700:S.PIECE + 900]), (2, long), (3, "z" * 3000 + long[500:900])]
    got = {r.doc_id: r for r in S.without_repeats(documents(*rows)).collect()}
    assert (got[1].n_removed, got[2].n_removed, got[2].n_spans, got[3].n_removed) == (0, 1600, 1, 400)
    assert bytes(got[2].kept) == (long[:S.PIECE - 700] + long[S.PIECE + 900:]).encode()


def test_many_copies_of_a_row(spark, documents):
    line = "x" * 30 + " " + "y" * 30
    got = S.without_repeats(documents(*[(3, line)] * 500, (1, "no"), (2, line), clashing=False)).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (2, 0), *[(3, 61)] * 500]


def test_merge_sort_by_hashes():
    rng = random.Random(2)
    data = np.frombuffer("".join(rng.choices("ab", k=3000)).encode(), dtype=np.uint8)
    suffixes = S.Suffixes(data, 50, S.BASES[0])
    at = np.arange(len(data) - 49)
    order, equal = suffixes.sorted(at, np.zeros(len(at), dtype=np.int64))
    text = [data[k:k + 50].tobytes() for k in at[order].tolist()]
    assert text == sorted(text) and equal.tolist() == [False, *(a == b for a, b in zip(text, text[1:]))]
    a, b = np.array([0, 5, 9]), np.array([0, 700, 1200])
    expected = [(x > y) - (x < y) for x, y in ((data[i:i + 50].tobytes(), data[j:j + 50].tobytes()) for i, j in zip(a, b))]
    assert suffixes.order(a, b).tolist() == expected


def test_colliding_hashes_are_noticed(monkeypatch):
    """A base of 1 gives all arrangements of the same bytes one hash: such a sort is given up and done with the next base."""
    data = np.frombuffer(b"abcdefgh12" + b"x" * 40 + b"abcdefgh21" + b"x" * 40, dtype=np.uint8)
    args = data, np.array([50, 50]), np.array([0, 0]), np.array([1, 2]), 50
    with pytest.raises(S.Collision):
        S.Suffixes(data, 50, 1).sorted(np.array([0, 50]), np.array([0, 0]))
    monkeypatch.setattr(S, "BASES", (1, *S.BASES))
    assert [x.tolist() for x in S.repeats(*args)] == [[], []]
    monkeypatch.setattr(S, "BASES", (1,))
    with pytest.raises(RuntimeError):
        S.repeats(*args)
