"""Decontamination: the index against scoring every unit, the query against all n-grams."""

import math
import random
from collections import Counter

import pytest

from riskloom.llm import decontaminate as D
from riskloom.llm.common import table
from riskloom.llm.queries import QUERIES

FAR = " ".join(f"filler{i}" for i in range(300))


def bm25(units):
    """Shares of every unit's own score, from the formula."""
    df = Counter(w for u in units for w in set(u))
    mean = sum(map(len, units)) / len(units)
    out = []
    for u in units:
        tf = Counter(u)
        weight = {w: math.log(1 + (len(units) - df[w] + 0.5) / (df[w] + 0.5)) * n * (D.K1 + 1) / (n + D.K1 * (1 - D.B + D.B * len(u) / mean)) for w, n in tf.items()}
        out.append({w: x / sum(weight.values()) for w, x in weight.items()})
    return out


@pytest.mark.parametrize("threshold", [0.2, 0.4, 0.6])
def test_block_max_wand_finds_every_unit_above_the_threshold(threshold):
    rng = random.Random(6)
    words = [f"w{i}".encode() for i in range(120)]
    weights = [1 / (i + 1) for i in range(120)]
    units = [rng.choices(words, weights, k=rng.randint(6, 40)) for _ in range(90)]
    shares = bm25(units)
    items = [(i, b" ".join(u).decode()) for i, u in enumerate(units)]
    index = D.Index(items, [(i, 0, w, x) for i, s in enumerate(shares) for w, x in s.items()])
    hits = 0
    for _ in range(60):
        text = rng.choices(words, weights, k=40) + rng.choice(units) + rng.choices(words, weights, k=30)
        ids = index.ids(text)
        found = {}
        for passage, block in index.live(ids, threshold):
            terms = sorted(set(ids[passage * D.PART:passage * D.PART + D.PASSAGE].tolist()) - {len(index.terms)})
            for unit, score in index.search(terms, block, threshold):
                found[passage, unit] = score
        passages = max(1, -(-(len(ids) - D.PART) // D.PART))
        for p in range(passages):
            window = set(text[p * D.PART:p * D.PART + D.PASSAGE])
            for u, s in enumerate(shares):
                score = sum(x for w, x in s.items() if w in window)
                if abs(score - threshold) > 1e-6:
                    assert ((p, u) in found) == (score > threshold)
                    if score > threshold:
                        assert found[p, u] == pytest.approx(score)
                        hits += 1
    assert hits


def test_question_and_answer():
    assert D.question_and_answer("What is it? Answer: a red fox") == ([b"what", b"is", b"it"], [b"a", b"red", b"fox"])
    assert D.question_and_answer("One two. Three four.") == ([b"one", b"two"], [b"three", b"four"])
    assert D.question_and_answer("a b c d e f g h") == ([b"a", b"b", b"c", b"d", b"e", b"f"], [b"g", b"h"])


def held(docs, items):
    """(doc_id, item_id) of all items whose question and answer n-grams a document mostly holds; docs and items are (id, text)."""
    asked = [(i, [(p, min(D.NGRAM, len(p))) for p in D.question_and_answer(t)]) for i, t in items if t and D.words_of(t)]
    out = []
    for doc_id, text in docs:
        words = D.words_of(text)
        grams = {n: {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} for n in range(1, D.NGRAM + 1)}
        out += [(doc_id, item) for item, parts in asked
                if all(sum(tuple(p[i:i + n]) in grams[n] for i in range(len(p) - n + 1)) >= D.OVERLAP * (len(p) - n + 1) for p, n in parts)]
    return out


def test_query_equals_ngram_overlap(spark, sf):
    got = {(r.doc_id, r.item_id) for r in QUERIES["op1_decontamination"](spark, sf).collect()}
    docs, items = (table(spark, sf, t).select(k, "text").collect() for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert got == set(held(docs, items)) and got


def test_one_word_answer_is_found_by_its_question(spark, documents):
    question = "which river runs past the old mill town and its seven bridges"
    items = spark.createDataFrame([(1, f"{question}? Answer: the"), (2, f"of? Answer: {question} today"), (3, "a plain item with words. and an end")], "item_id long, text string")
    docs = documents((1, f"the {FAR} {question}"), (2, f"{FAR} {question} {FAR}"), (3, f"of {FAR} {question} today"), (4, "the of the of"))
    found = sorted((r.doc_id, r.item_id) for r in D.leaks(docs, items).collect())
    assert found == sorted(held([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])) == [(1, 1), (2, 1), (3, 1), (3, 2)]


def test_units_are_the_whole_item_and_its_longer_side():
    assert D.units_of("one two three four? Answer: five") == [(0, [b"one", b"two", b"three", b"four", b"answer", b"five"]), (-2, [b"one", b"two", b"three", b"four"])]
    assert D.units_of("who? Answer: a man of some means")[1:] == [(-2, [b"a", b"man", b"of", b"some", b"means"])]
    assert D.units_of("a b. c d")[1:] == [(-2, [b"a", b"b"])]       # as long: the question
    assert D.units_of("...") == []


@pytest.fixture
def items(spark):
    rows = [(1, "The quick brown fox jumps over the lazy dog near the river bank. It was a sunny day indeed."), (2, None), (3, ""), (4, "one two"),
            (5, " ".join(f"tale{i}" for i in range(150)) + ". The end of tales is near now."), (1, "The quick brown fox jumps over the lazy dog near the river bank. It was a sunny day indeed."),
            (None, "Nameless item with quite some words in it today. Its answer has words as well."), (6, FAR)]
    return spark.createDataFrame(rows, "item_id long, text string")


def test_rows_of_every_kind(documents, items):
    leak = "THE QUICK brown fox, jumps over the lazy dog near the river bank. It was a sunny day indeed!"
    tale = " ".join(f"tale{i}" for i in range(150)) + " the end of tales is near now"
    docs = documents((1, f"{FAR} {leak} {FAR[:200]}"), (2, leak), (2, leak), (3, None), (4, ""), (5, "The quick brown fox jumps over the lazy dog near the river bank. Nothing else follows here today."),
                     (6, f"x {tale} y"), (None, "nameless item with quite some words in it today its answer has words as well"), (7, "one two"), (8, "It was a sunny day indeed."))
    found = sorted(((r.doc_id, r.item_id) for r in D.leaks(docs, items).collect()), key=str)
    assert found == sorted([(1, 1), (1, 6), (2, 1), (2, 1), (6, 5), (None, None)], key=str)
    kept = D.decontaminate(docs, items)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [3, 4, 5, 7, 8]


def test_question_and_answer_far_apart(spark, documents):
    question, answer = " ".join(f"ask{i}" for i in range(12)), " ".join(f"reply{i}" for i in range(12))
    items = spark.createDataFrame([(1, f"{question}? Answer: {answer}"), (2, "another item of some words. with its own end")], "item_id long, text string")
    docs = documents((1, f"{question} {FAR} {answer}"), (2, f"{answer} {FAR} {question}"), (3, f"{question} {FAR}"), (4, f"{answer} {FAR}"))
    assert sorted((r.doc_id, r.item_id) for r in D.leaks(docs, items).collect()) == [(1, 1), (2, 1)]


def test_short_items_and_scripts_without_spaces(spark, documents):
    items = spark.createDataFrame([(1, "Blue whale, 1758"), (2, "ok"), (3, "\u4f60\u597d\u3002"), (4, "\u8fd9\u662f\u4e00\u4e2a\u5f88\u957f\u7684\u95ee\u9898\u3002\u7b54\u6848\u662f\u4e03"), (5, "...")], "item_id long, text string")
    docs = documents((1, f"{FAR} the blue WHALE 1758 swims"), (2, "blue 1758 whale"), (3, "\u6211\u8bf4\u4f60\u597d\u5417"), (4, "\u524d\u6587\u8fd9\u662f\u4e00\u4e2a\u5f88\u957f\u7684\u95ee\u9898\uff0c\u7b54\u6848\u662f\u4e03\u540e\u6587"), (5, "ok."), (6, "okay ..."))
    assert sorted((r.doc_id, r.item_id) for r in D.leaks(docs, items, min_words=1).collect()) == [(1, 1), (3, 3), (4, 4), (5, 2)]
    assert sorted(r.doc_id for r in D.decontaminate(docs, items.filter("item_id < 3"), min_words=1).collect()) == [2, 3, 4, 6]


def test_empty_tables(documents, items):
    docs = documents((1, "a b c d e f"), (2, None))
    assert D.leaks(docs, items.filter("item_id < 0")).count() == 0
    assert D.decontaminate(docs, items.filter("item_id < 0")).count() == 2
    assert D.leaks(docs.filter("doc_id < 0"), items).count() == 0


def test_pieces_of_an_index_find_the_same(spark, sf):
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    size = sum(len(r.text.encode()) for r in items.collect())
    pieces = list(D.build_indexes(items, index_bytes=size))
    assert len(pieces) > 1
    one = next(iter(D.build_indexes(items)))
    for row in docs.limit(60).collect():
        whole = [(m["item_id"], round(m["score"], 9)) for m in one.matches(row.text)]
        assert sorted((m["item_id"], round(m["score"], 9)) for p in pieces for m in p.matches(row.text)) == sorted(whole)


def test_documents_of_an_index_in_pieces(spark, sf, monkeypatch):
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    found = sorted(D.leaks(docs, items, min_words=1).collect())
    kept = sorted(r.doc_id for r in D.decontaminate(docs, items, min_words=1).collect())
    build = D.build_indexes
    monkeypatch.setattr(D, "build_indexes", lambda *a, **k: build(*a, **k, index_bytes=9000))
    assert sorted(D.leaks(docs, items, min_words=1).collect()) == found
    assert sorted(r.doc_id for r in D.decontaminate(docs, items, min_words=1).collect()) == kept
