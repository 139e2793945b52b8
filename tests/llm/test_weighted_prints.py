"""Fingerprints: the estimate of generalised Jaccard similarity, and the chain of edited texts."""

from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from riskloom.llm import weighted_prints as W
from riskloom.llm.common import table
from riskloom.llm.queries import QUERIES


def generalised_jaccard(a, b):
    plain = str.maketrans({c: " " for c in map(chr, range(128)) if not c.isalnum()})
    x, y = Counter(a.lower().translate(plain).split()), Counter(b.lower().translate(plain).split())
    words = set(x) | set(y)
    return sum(min(x[w], y[w]) for w in words) / sum(max(x[w], y[w]) for w in words)


def test_collision_rate_is_the_similarity():
    rng = np.random.default_rng(8)
    sampler, errors = W.Sampler(), []
    for trial in range(150):            # other words each time, else all trials share their random numbers
        words = [f"t{trial}w{i}" for i in rng.integers(0, 60, 200)]
        keep = rng.integers(20, 200)
        a, b = " ".join(words), " ".join([*words[:keep], *[f"t{trial}w{i}" for i in rng.integers(0, 90, 200 - keep)]])
        one, two = sampler.signatures([a, b])
        errors.append(W.likeness(one, two) - generalised_jaccard(a, b))
    assert abs(np.mean(errors)) < 0.015
    assert np.sqrt(np.mean(np.square(errors))) < 1.25 * 0.5 / np.sqrt(W.SAMPLES)


def test_sortable_floats():
    x = np.array([-3.5, -0.0, 0.0, 1e-9, 7.25, -1e9, 1e9], dtype=np.float32)
    assert (W._floats(W._sortable(x)) == x).all()
    assert (np.argsort(W._sortable(x), kind="stable") == np.argsort(x, kind="stable")).all()


def test_weights_count():
    sampler = W.Sampler(512)
    a, b = sampler.signatures(["x " * 9 + "y", "x y"])
    assert W.likeness(a, b) == pytest.approx(2 / 10, abs=0.07)


def test_case_and_punctuation_count():
    sampler = W.Sampler(512)
    a, b, c, empty = sampler.signatures(["x = f(y) Z", "x , f[y] z", "+ - ;", ""])
    assert W.likeness(a, b) == pytest.approx(1 / 7, abs=0.07)
    assert c.any() and not empty.any() and W.likeness(c, empty) == 0


def test_gamma_quantiles():
    for p, x in ((0.5, 1.67835), (0.95, 4.74386), (0.05, 0.35536)):
        assert W._GAMMA[int(p * 65536)] == pytest.approx(x, rel=1e-3)


def test_signatures_do_not_depend_on_company_or_cache(monkeypatch):
    texts = ["a b c", "", "d " * 5000, " ".join(f"z{i}" for i in range(3000)), "a b c"]
    whole = W.Sampler().signatures(texts)
    assert (whole[0] == whole[4]).all() and not whole[1].any() and whole[2].any()
    assert all((W.Sampler().signatures([t])[0] == s).all() for t, s in zip(texts, whole))
    monkeypatch.setattr(W, "FLUSH", 100)
    monkeypatch.setattr(W, "TERMS", 150)
    assert (W.Sampler().signatures(texts) == whole).all()


def chain(rows):
    """rows: (doc_id, text) with ids; (edited, following) by id."""
    order = sorted(rows, key=lambda r: -r[0])
    return {i: (W.edited(t, order[(k + 1) % len(order)][1]), order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order)}


def test_query_follows_the_chain(spark, sf):
    rows = {r.doc_id: r for r in QUERIES["op6_weighted_fingerprints"](spark, sf).collect()}
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    assert len(rows) == len(docs)
    follow = chain(docs)
    for i, text in docs:
        changed, after = follow[i]
        assert (rows[i].n_chars, rows[i].edited_sha256) == (len(text), sha256(changed.encode()).hexdigest())
        assert rows[i].near_edited == pytest.approx(generalised_jaccard(text, changed), abs=0.2)
        assert rows[i].near_next == pytest.approx(generalised_jaccard(text, after), abs=0.2)


def test_edited():
    assert W.edited("abcdé", "XYZ") == "abcXY"
    assert W.edited("abcd", "X") == "abX"
    assert W.edited("a", "X") == "a" and W.edited("", "X") == ""


def test_rows_of_every_kind(documents):
    docs = documents((3, "c d e f"), (1, None), (2, ""), (9, "x" * 200_000 + " y"), (3, "c d e f"), (None, "no id a"), (None, "no id b"), clashing=True)
    rows = W.edit_prints(docs).collect()
    assert len(rows) == 7
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[1].n_chars == 0 and set(by[1].fingerprint) == {"0"} and by[2].near_edited == 1.0
    assert by[9].edited_sha256 == sha256(W.edited("x" * 200_000 + " y", "c d e f").encode()).hexdigest()
    assert sorted(r.near_next for r in rows if r.doc_id == 3) == [0.0, 1.0]
    assert {r.doc_id for r in rows} == {1, 2, 3, 9, None} and len(by[3].fingerprint) == 4 * W.SAMPLES
    one = W.edit_prints(documents((5, "alone in here"))).collect()
    assert len(one) == 1 and one[0].near_next == 1.0 and one[0].edited_sha256 == sha256(W.edited("alone in here", "alone in here").encode()).hexdigest()
    assert W.edit_prints(docs.filter("doc_id < 0")).count() == 0


def test_ranges_are_walked_as_one_chain(spark, monkeypatch):
    rows = [(i * 37 % 1000, f"text number {i} " * (1 + i % 5)) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    follow = chain(rows)
    got = {r.doc_id: r.edited_sha256 for r in W.edit_prints(docs, samples=8).collect()}
    assert got == {i: sha256(follow[i][0].encode()).hexdigest() for i, _ in rows}
