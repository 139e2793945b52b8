"""Token files: exact round trips, damage, and the library's identifiers."""

import random
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from riskloom.llm import token_files as T
from riskloom.llm.common import table
from riskloom.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")
BLOCK = T.SEGMENT * T.BLOCK * T.LANES


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("n", [1, 2, 511, 513, T.SEGMENT * T.LANES, T.SEGMENT * T.LANES + 1, BLOCK - 1, BLOCK, BLOCK + 1, 3 * BLOCK + 777])
def test_round_trip(n):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 49_408).astype(np.uint32)
    group = T.pack(ids)
    assert (T.unpack(group) == ids).all()
    last = len(group["checksums"]) - 1
    assert (T.unpack(group, last) == ids[last * BLOCK:]).all()
    assert (T.unpack(group, 0, 1)[:BLOCK] == ids[:BLOCK]).all()


def test_extreme_tables():
    for ids in (np.full(5000, 7), np.arange(60_000), np.r_[np.zeros(300_000), np.arange(1, 400)]):
        ids = ids.astype(np.uint32)
        assert (T.unpack(T.pack(ids)) == ids).all()


def test_size_is_near_the_entropy():
    ids = (np.random.default_rng(1).zipf(1.4, 500_000) % 5000).astype(np.uint32)
    _, n = np.unique(ids, return_counts=True)
    entropy = -(n / n.sum() * np.log2(n / n.sum())).sum()
    group = T.pack(ids)
    assert 8 * len(group["words"]) / len(ids) < 1.02 * entropy + 0.05


def test_damage_is_found():
    group = T.pack(np.arange(3000, dtype=np.uint32))
    words = bytearray(group["words"])
    words[17] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        T.unpack(group | {"words": bytes(words)})


def test_frequencies():
    for counts in ([1], [1, 1, 10 ** 9], list(range(1, 400)), [5] * 1000):
        f = T.scaled(np.array(counts, dtype=np.int64), 12)
        assert f.sum() == 1 << 12 and f.min() >= 1


def test_word_by_word_equals_whole_texts(library):
    rng = random.Random(9)
    parts = [" ", "\n", "\t", "a", "B", "É", "1", "²", "'s", "'T", "'", "\x1c", "\x85", "\xa0", "　", "😀", "ß", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "́", "Σ", "İ", "e", ".", "!", "a.", "'re,"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(3000)]
    got = T.word_encoder(PATH).encode([t.encode() for t in texts], 2)
    assert [g.tolist() for g in got] == [e.ids + [2] for e in library.encode_batch(texts, add_special_tokens=False)]


def expected(rows, library):
    out, start = {}, 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        out[i] = (start, len(ids), crc32(ids.tobytes()))
        start += len(ids)
    return out


def test_query_equals_the_library(spark, sf, library):
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op9_token_files"](spark, sf).collect()}
    assert got == expected([(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()], library)


def test_rows_of_every_kind(documents, library, monkeypatch):
    rows = [(5, "five words are in here"), (1, None), (2, ""), (None, "no id"), (9, "long " * 30_000)]
    docs = documents(*rows, (5, "five words are in here"))
    got = T.token_files(docs, PATH).collect()
    want = expected([*rows], library)
    assert len(got) == 6
    by = {r.doc_id: r for r in got}
    assert [by[i].start for i in (None, 1, 2)] == [want[i][0] for i in (None, 1, 2)] and by[1].n_tokens == 1
    assert by[9].ids_crc32 == want[9][2] and by[9].start == want[9][0] + want[5][1]
    assert sorted(r.start for r in got if r.doc_id == 5) == [want[5][0], want[5][0] + want[5][1]]
    assert T.token_files(docs.filter("doc_id < 0"), PATH).count() == 0


def test_several_groups(spark, library, tmp_path):
    rows = [(i, f"text number {i} has some words") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    T.write_token_files(docs, PATH, str(tmp_path / "files"))
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in T.read_token_files(spark, str(tmp_path / "files")).collect()}
    assert got == expected(rows, library)


def test_rows_without_id_are_spread(spark, documents):
    """A third of all rows without an id: they are read back whole, first in the files, from more than one range."""
    rows = [(None, f"text number {i} of many words") for i in range(300)] + [(i, f"named {i}") for i in range(600)]
    got = T.token_files(documents(*rows, clashing=False), public_tokenizers.path("word_bpe_49k.json")).orderBy("start").collect()
    assert len(got) == 900 and all(r.doc_id is None for r in got[:300]) and [r.doc_id for r in got[300:]] == list(range(600))
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(900)]
