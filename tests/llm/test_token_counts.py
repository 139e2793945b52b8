"""Token counts against the tokenizers library."""

import json
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from riskloom.llm import token_counts
from riskloom.llm.common import table
from riskloom.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def count(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert token_counts.merger(PATH).count(text) == count(Tokenizer.from_file(PATH) if not hasattr(test_any_text, "lib") else test_any_text.lib, text)


test_any_text.lib = Tokenizer.from_file(PATH)


def test_odd_texts(library):
    rng = random.Random(7)
    parts = [" ", "\n", "\t", "a", "Bc", "é", "12", "²", "'s", "'", "\x1c", "\x85", "\xa0", "　", "😀", "ß", "字", ".", "<|endoftext|>", "<|", "՘", "࢏", "\U000323b0"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(2000)]
    texts += ["a" * 3000, " " * 3000 + "x", "ab" * 2000, "1" * 500, "<|endoftext|>" * 3]
    own = token_counts.merger(PATH)
    assert [own.count(t) for t in texts] == [count(library, t) for t in texts]


def test_merges_follow_rank_then_place(tmp_path):
    symbols = token_counts.byte_symbols()
    vocabulary = {s: k for k, s in enumerate(symbols)} | {"aa": 256, "ab": 257, "aab": 258}
    path = tmp_path / "tiny.json"
    path.write_text(json.dumps({"added_tokens": [], "model": {"vocab": vocabulary, "merges": [["a", "a"], "a b", ["aa", "b"]]}}))
    own = token_counts.PairMerger(str(path))
    assert [own.merged(t) for t in ("aaa", "aab", "ab", "aaab", "abab", "b")] == [2, 1, 1, 2, 2, 1]


def test_long_texts_and_a_full_cache(monkeypatch, library):
    text = " ".join(f"word{i} x{i * 7}" for i in range(3000))
    monkeypatch.setattr(token_counts, "LONG", 100)
    monkeypatch.setattr(token_counts, "CACHE", 50)
    assert token_counts.PairMerger(PATH).count(text) == count(library, text)


def test_query_equals_the_library(spark, sf, library):
    rows = {r.doc_id: r for r in QUERIES["op5_token_counts"](spark, sf).collect()}
    docs = table(spark, sf, "documents").collect()
    assert len(rows) == len(docs)
    for d in docs:
        n = count(library, d.text)
        assert (rows[d.doc_id].n_bytes, rows[d.doc_id].n_tokens, rows[d.doc_id].over_limit) == (len(d.text.encode()), n, n > 512)


def test_rows_of_every_kind(documents):
    docs = documents((1, None), (2, ""), (None, "two words"), (3, "same"), (3, "same"))
    got = token_counts.token_counts(docs, PATH)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect()) == [("1", 0, 0, False), ("2", 0, 0, False), ("3", 4, 1, False), ("3", 4, 1, False), ("None", 9, 2, False)]
    assert token_counts.token_counts(docs.filter("doc_id < 0"), PATH).count() == 0
