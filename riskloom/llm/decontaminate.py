"""Benchmark decontamination: every training passage is a query against a BM25 index of the test items."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.durable import durable
from riskloom.llm.common import fresh

PART = 64               # words of an item indexed as one unit; longer items are several
PASSAGE = 2 * PART      # words of a passage; passages start every PART words, so one holds any unit whole
K1, B = 1.2, 0.75
THRESHOLD = 0.6         # BM25 score, as a share of the score that the unit has for itself
NGRAM = 5
OVERLAP = 0.8           # share of the n-grams of question and of answer that the document must hold
MIN_WORDS = 5           # shorter items are found by their whole word sequence
BLOCK = 8               # units under one maximum
COMMON = 0.05           # a word of more than this share of the units is common
LIVE = 1 << 21          # bounds (of a passage and a block) held at a time
INDEX_BYTES = 32 << 20  # item text indexed, and broadcast, at a time
ANSWER_MARKS = ("answer:", "réponse:", "antwort:", "respuesta:")
_PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
# Thai to Khmer, kana and Han have no spaces between words: each character counts as a word, their punctuation parts
_UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")
_MARKS = re.compile("[\u3000-\u3004\u3008-\u303f\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]")


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words; ASCII punctuation parts them.  In scripts without spaces every character is one."""
    text = (text or "").lower()
    if not text.isascii() and _UNSPACED.search(text):
        text = _UNSPACED.sub(r" \1 ", _MARKS.sub(" ", text))
    return text.encode().translate(_PLAIN).split()


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """The words of question and answer: what stands after the last answer mark, else the last sentence, else the last quarter."""
    low = text.lower()
    for mark in ANSWER_MARKS:
        if words_of(low[:max(0, low.rfind(mark))]) and words_of(low[low.rfind(mark) + len(mark):]):
            cut = low.rfind(mark)
            return words_of(low[:cut]), words_of(low[cut + len(mark):])
    ends = [i + 1 for i, c in enumerate(low) if c in ".?!\n" and words_of(low[:i]) and words_of(low[i + 1:])]
    if ends:
        return words_of(low[:ends[-1]]), words_of(low[ends[-1]:])
    words = words_of(low)
    cut = len(words) - max(1, len(words) // 4)
    return words[:cut], words[cut:]


def units_of(text: str) -> list[tuple[int, list[bytes]]]:
    """The numbered units of an item: its words by ``PART``, and, below zero, those of the longer of question and answer alone.

    A document may hold question and answer far apart, so that no passage has most of a unit with both.  It must hold
    both, so the longer side, of which more words must agree, finds whatever the shorter one would: an answer of one
    common word would only bring every passage to the check.
    """
    words = words_of(text)
    out = [(k // PART, words[k:k + PART]) for k in range(0, len(words), PART)]
    side = max(question_and_answer(text), key=len) if words else []         # the question where they are alike
    for k in range(0, len(side), PART):
        if all(side[k:k + PART] != unit for _, unit in out):
            out.append((-1 - len(out), side[k:k + PART]))
    return out


def postings(items: DataFrame) -> DataFrame:
    """``(unit, word, share)``: BM25 weights of the words of every unit, as shares of the unit's score for itself.

    ``items`` has ``item`` (a key) and ``text``.  Document frequency and length are taken over all items, each word
    of an item counting once: units of question and answer are left out there.
    """
    @F.pandas_udf("array<struct<part:int,word:binary,tf:int,length:int>>")
    def counted(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            rows = []
            for part, unit in units_of(text):
                rows += [{"part": part, "word": w, "tf": unit.count(w), "length": len(unit)} for w in dict.fromkeys(unit)]
            out.append(rows)
        return pd.Series(out)

    rows = durable(items.select("item", F.explode(counted("text")).alias("w")).select("item", "w.*"), "item-words")
    whole = rows.filter("part >= 0")
    units = whole.select("item", "part", "length").distinct().agg(F.count(F.lit(1)).alias("units"), F.avg("length").alias("average")).first()
    frequency = whole.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(float(units["average"] or 1))))
    idf = F.log(1 + (F.lit(units["units"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = rows.join(frequency, "word").select("item", "part", "word", (tf * idf).alias("weight"))
    own = weighed.groupBy("item", "part").agg(F.sum("weight").alias("own"))
    return weighed.join(own, ["item", "part"]).select("item", "part", "word", (F.col("weight") / F.col("own")).alias("share"))


class Index:
    """Postings of a bounded set of units with a maximum for each block of units, and the items' n-grams for the check.

    Blocks are runs of ``BLOCK`` units, the same for all words.  Words of many units are common; for
    these a block keeps only the largest sum that one of its units has of them.  ``short`` items have no units: they
    are found by a hash of all their words.
    """

    def __init__(self, items: list[tuple[int | None, str]], rows: list[tuple[int, int, bytes, float]], short: list[tuple[int | None, str]] = ()):
        units = sorted({(i, p) for i, p, _, _ in rows})
        number = {u: k for k, u in enumerate(units)}
        self.items = [i for i, _ in items]
        self.owner = [i for i, _ in units]
        self.terms = {w: k for k, w in enumerate(sorted({w for _, _, w, _ in rows} | {w for _, text in short for w in words_of(text)}))}
        self.units: list[list[int]] = [[] for _ in self.terms]
        self.shares: list[list[float]] = [[] for _ in self.terms]
        for i, p, w, share in sorted(rows, key=lambda r: (r[0], r[1])):
            self.units[self.terms[w]].append(number[i, p])
            self.shares[self.terms[w]].append(share)
        self.blocks = -(-len(units) // BLOCK)
        usual = np.zeros(len(units))
        most_common = max(1, int(len(units) * COMMON))
        starts, blocks, tops = [0], [], []
        for own, shares in zip(self.units, self.shares):
            if len(own) > most_common:
                usual[own] += shares
            else:
                best: dict[int, float] = {}
                for u, share in zip(own, shares):
                    best[u // BLOCK] = max(best.get(u // BLOCK, 0.0), share)
                blocks += best.keys()
                tops += best.values()
            starts.append(len(blocks))
        self.starts, self.block, self.top = np.array(starts), np.array(blocks, dtype=np.int64), np.array(tops)
        self.usual = np.maximum.reduceat(usual, np.arange(0, len(units), BLOCK)) if units else usual
        self.listed = np.append(np.diff(self.starts), 0)                # the last: a word of no item
        self.parts = [[self._grams(x) for x in question_and_answer(text)] for _, text in items]
        self.short: dict[int, tuple[np.ndarray, list[int | None]]] = {}
        sequences = [(i, self.ids(words_of(text))) for i, text in short]
        for n in sorted({len(x) for _, x in sequences}):
            own = [(i, rolled(x, n)[0]) for i, x in sequences if len(x) == n]
            self.short[n] = np.array([h for _, h in own], dtype=np.uint64), [i for i, _ in own]

    def ids(self, words: list[bytes]) -> np.ndarray:
        unknown, get = len(self.terms), self.terms.get
        return np.array([get(w, unknown) for w in words], dtype=np.int64)

    def _grams(self, words: list[bytes]) -> tuple[int, np.ndarray]:
        n = min(NGRAM, len(words))
        return n, np.unique(rolled(self.ids(words), n))

    def live(self, ids: np.ndarray, threshold: float) -> list[tuple[int, int]]:
        """The (passage, block) pairs whose maxima add up to the threshold; no other pair can hold a hit."""
        passages = max(1, -(-(len(ids) - PART) // PART))
        at = np.nonzero(self.listed[ids])[0]
        where = np.minimum(at // PART, passages - 1)
        pairs = np.concatenate([where, np.maximum(where - 1, 0)]) * len(self.terms) + np.concatenate([ids[at], ids[at]])
        passage, term = np.divmod(np.unique(pairs), len(self.terms))
        out, span = [], max(1, LIVE // self.blocks)
        for first in range(0, passages, span):
            lo, hi = np.searchsorted(passage, [first, first + span])
            own, counts = term[lo:hi], self.listed[term[lo:hi]]
            ends = np.cumsum(counts)
            entry = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[own] - ends + counts, counts)
            key = np.repeat(passage[lo:hi] - first, counts) * self.blocks + self.block[entry]
            rows = min(span, passages - first)
            bound = np.bincount(key, self.top[entry], rows * self.blocks).reshape(rows, self.blocks) + self.usual
            out += [(int(p) + first, int(b)) for p, b in zip(*np.nonzero(bound >= threshold - 1e-9))]
        return out

    def search(self, terms: list[int], block: int, threshold: float = THRESHOLD) -> list[tuple[int, float]]:
        """All units of a block with a score of at least ``threshold`` for the distinct ``terms``, by pivots (WAND)."""
        found, limit = [], min(len(self.owner), (block + 1) * BLOCK)
        cursors = []            # unit it stands on, position, end, word, the word's maximum in the block
        for t in terms:
            at, end = bisect_left(self.units[t], block * BLOCK), bisect_left(self.units[t], limit)
            if at < end:
                cursors.append([self.units[t][at], at, end, t, max(self.shares[t][at:end])])
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for unit, *_, most in cursors:
                bound += most
                if bound >= threshold - 1e-9:
                    pivot = unit
                    break
            if pivot < 0:
                break           # what is left can't reach the threshold together
            if cursors[0][0] == pivot:
                score = sum(self.shares[c[3]][c[1]] for c in cursors if c[0] == pivot)
                if score >= threshold - 1e-9:
                    found.append((pivot, score))
                pivot += 1
            for c in cursors:
                if c[0] < pivot:
                    c[1] = bisect_left(self.units[c[3]], pivot, c[1], c[2])
                    c[0] = self.units[c[3]][c[1]] if c[1] < c[2] else limit
            cursors = [c for c in cursors if c[0] < limit]
        return found

    def matches(self, text: str | None, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> list[dict]:
        """The items whose question and answer the text holds."""
        ids = self.ids(words_of(text))
        if not len(ids):
            return []
        best: dict[int, float] = {}
        for passage, block in self.live(ids, threshold) if self.owner else ():
            terms = np.unique(ids[passage * PART:passage * PART + PASSAGE])
            for unit, score in self.search(terms[terms < len(self.terms)].tolist(), block, threshold):
                item = self.owner[unit]
                best[item] = max(best.get(item, 0.0), score)
        out = []
        held = {n: np.unique(rolled(ids, n)) for n in {n for item in best for n, _ in self.parts[item] if n}}
        for item, score in sorted(best.items()):
            shares = [float(np.isin(grams, held[n]).mean()) if n else 1.0 for n, grams in self.parts[item]]
            if min(shares) >= overlap - 1e-9:
                out.append({"item_id": self.items[item], "score": score, "question_overlap": shares[0], "answer_overlap": shares[1]})
        for n, (hashes, owners) in self.short.items():
            for k in np.nonzero(np.isin(hashes, rolled(ids, n)))[0]:
                out.append({"item_id": owners[k], "score": 1.0, "question_overlap": 1.0, "answer_overlap": 1.0})
        return out


def rolled(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of ``n`` words."""
    if not n or len(ids) < n:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(ids) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + ids[k:len(ids) - n + 1 + k].astype(np.uint64) + np.uint64(1)
        out ^= out >> np.uint64(29)
    return out


def build_indexes(items: DataFrame, item_id: str = "item_id", text: str = "text", index_bytes: int = INDEX_BYTES, min_words: int = MIN_WORDS) -> Iterator[Index]:
    """The index in pieces of at most about ``index_bytes`` of item text, each small enough for the driver and a broadcast.

    Weights are those of all items together, so the pieces find what one index would.  Items of fewer than ``min_words``
    words are left out, others of fewer than ``MIN_WORDS`` must be held word for word.
    """
    own = items.select(F.col(f"`{item_id}`").cast("long").alias("item_id"), F.col(f"`{text}`").cast("string").alias("text"))
    own = own.filter("text IS NOT NULL").distinct().withColumn("item", F.xxhash64("item_id", "text"))
    own = durable(own, "items")
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    pieces = max(1, -(-size // (index_bytes // 2)))             # half: a hash deals unevenly
    rows = durable(postings(own).withColumn("piece", F.pmod("item", F.lit(pieces))), "postings")
    for piece in range(pieces):
        texts = sorted(own.filter(F.pmod("item", F.lit(pieces)) == piece).collect(), key=lambda r: r["item"])
        short = [(r["item_id"], r["text"]) for r in texts if max(1, min_words) <= len(words_of(r["text"])) < MIN_WORDS]
        texts = [r for r in texts if len(words_of(r["text"])) >= max(MIN_WORDS, min_words)]
        number = {r["item"]: k for k, r in enumerate(texts)}
        found = [(number[r["item"]], r["part"], bytes(r["word"]), r["share"]) for r in rows.filter(F.col("piece") == piece).collect() if r["item"] in number]
        if found or short:
            yield Index([(r["item_id"], r["text"]) for r in texts], found, short)


FOUND = "array<struct<item_id:bigint,score:double,question_overlap:double,answer_overlap:double>>"


def leak_column(spark, index: Index, text: str, threshold: float, overlap: float):
    shared = spark.sparkContext.broadcast(index)

    @F.pandas_udf(FOUND)
    def leaked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([shared.value.matches(t, threshold, overlap) for t in batch], dtype=object)

    return leaked(F.col(f"`{text}`").cast("string"))


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
          item_text: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP, min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc_id, item_id, score, question_overlap, answer_overlap)`` for every test item that a document holds.

    Every passage of every whole text is a query; all units above the
    threshold are retrieved, without a limit on their number, and an item counts when the document holds
    most n-grams of its question and of its answer.  Null and empty texts hold nothing; equal item
    rows count once, repeated document rows each; an empty table on either side gives no rows; rows without id
    keep a null id; other columns are not read.  With ``min_words`` 1 no item is left out.  The documents are read once for
    every piece of the index, so that a task holds one piece at a time, however many items there are.
    """
    found = [docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.explode(leak_column(docs.sparkSession, index, text, threshold, overlap)).alias("f"))
             for index in build_indexes(items, item_id, item_text, min_words=min_words)]
    none = docs.limit(0).select(F.lit(None).cast("long").alias("doc_id"), F.explode(F.lit(None).cast(FOUND)).alias("f"))
    return reduce(DataFrame.unionByName, found or [none]).select("doc_id", "f.*")


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                  threshold: float = THRESHOLD, overlap: float = OVERLAP, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``docs`` that hold no test item, all columns as they are, without a shuffle.

    An index of several pieces is applied piece after piece, what is left being written in between: a task holds one piece at a time.
    """
    found, = fresh(docs, "found")
    kept, before = docs, None
    for index in build_indexes(items, item_id, item_text, min_words=min_words):
        kept = kept if before is None else durable(before, "without-leaks")
        before = kept.withColumn(found, leak_column(docs.sparkSession, index, text, threshold, overlap)).filter(F.coalesce(F.size(found), F.lit(0)) <= 0).drop(found)
    return docs if before is None else before
