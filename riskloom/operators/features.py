"""TF-IDF features of code: word and character n-grams, shared vocabularies, smoothed idf."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from riskloom.functions.durable import durable
from riskloom.functions.matching import SPACE_CLASS, WORD_CLASS
from riskloom.functions.text import WHITESPACE

WORD_FEATURES, CHAR_FEATURES = 4000, 2000
WORD_RANGE, CHAR_RANGE = (1, 3), (2, 5)
BUCKETS = 1 << 20       # hash buckets of terms; a literal of as many bits goes to every task
FULLEST = 3             # times as many buckets as wanted terms are counted at first
# A word character followed by word characters or dots, which keeps os.system whole.
TOKEN = f"{WORD_CLASS}[\\p{{L}}\\p{{N}}_.]*{WORD_CLASS}"


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Characters with a one-character base and that base, then the combining marks, which are dropped; and ligatures with their letters.

    By Unicode decomposition, over all code points that Java strings hold as one character.  Left as they are: other
    characters that decompose into several, such as fractions and Hangul syllables.
    """
    accented, plain, marks, ligatures = [], [], [], []
    for code in (*range(0x80, 0xD800), *range(0xE000, 0x10000)):
        char = chr(code)
        if unicodedata.combining(char):
            marks.append(char)
            continue
        base = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if len(base) == 1 and base != char:
            accented.append(char)
            plain.append(base)
        elif len(base) > 1 and "LIGATURE" in unicodedata.name(char, "") and base.isascii():
            ligatures.append((char, base))
    return "".join(accented) + "".join(marks), "".join(plain), tuple(ligatures)


def without_accents(col: Column) -> Column:
    accented, plain, ligatures = _accent_table()
    ascii_only = F.octet_length(col) == F.length(col)
    out = F.translate(col, accented, plain)
    for char, letters in ligatures:
        out = F.replace(out, F.lit(char), F.lit(letters))
    return F.when(ascii_only, col).otherwise(out)


def word_tokens(code: Column) -> Column:
    return F.regexp_extract_all(without_accents(F.lower(code)), F.lit(TOKEN), F.lit(0))


@lru_cache(maxsize=1)
def _plain_letters() -> dict[int, str | None]:
    accented, plain, ligatures = _accent_table()
    return dict(zip(map(ord, accented), [*plain, *[None] * (len(accented) - len(plain))])) | {ord(c): letters for c, letters in ligatures}


_TOKEN = re.compile(r"\w[\w.]*\w")


def _tokens(lower: str | None) -> list[str]:
    """``word_tokens`` of a text in lower case."""
    if not lower:
        return []
    return _TOKEN.findall(lower if lower.isascii() else lower.translate(_plain_letters()))


def with_tokens(df: DataFrame, code: Column) -> DataFrame:
    """Add ``_code`` and ``_tokens``, the inputs of the n-gram columns.

    They must stay columns of their own, because an expression inside a lambda
    is evaluated again for every element; ``inline`` keeps the optimizer from
    substituting them into a later filter.
    """
    return df.select("*", F.inline(F.array(F.struct(code.alias("_code"), word_tokens(code).alias("_tokens")))))


def word_ngrams(sizes: tuple[int, int] = WORD_RANGE) -> Column:
    """All runs of ``sizes[0]`` to ``sizes[1]`` of the ``_tokens``, joined by a space."""
    tokens = F.col("_tokens")

    def runs(n: int) -> Column:
        if n == 1:
            return tokens
        starts = F.sequence(F.lit(0), F.size(tokens) - n)
        joined = F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(tokens, i + k) for k in range(n)]))
        return F.when(F.size(tokens) >= n, joined).otherwise(F.array().cast("array<string>"))

    return F.concat(*[runs(n) for n in range(sizes[0], sizes[1] + 1)])


def each_word_ngram(samples: DataFrame, sizes: tuple[int, int] = WORD_RANGE) -> DataFrame:
    """``(term)``: the ``word_ngrams`` of all samples, a row each, made from a token's place by compiled code instead of lambdas."""
    tokens, place = F.col("_tokens"), F.col("_place")

    def run(n: int) -> Column:
        return F.when(F.size(tokens) >= place + n, F.concat_ws(" ", *[F.get(tokens, place + k) for k in range(n)]))

    placed = samples.select(F.posexplode(tokens).alias("_place", "_token"), tokens)
    return placed.select(F.explode(F.array(*map(run, range(sizes[0], sizes[1] + 1)))).alias("term")).filter("term IS NOT NULL")


def char_ngrams(sizes: tuple[int, int] = CHAR_RANGE) -> Column:
    """Substrings of every white-space token of ``_code``, padded by one space on each side."""
    words = F.filter(F.split(F.lower("_code"), f"{SPACE_CLASS}+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def windows(word: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(word) - (n - 1))
        cut = F.transform(starts, lambda i: F.substring(word, i, F.lit(n)))
        # A padded token has at least three characters.
        return cut if n <= 3 else F.when(F.length(word) >= n, cut).otherwise(F.array().cast("array<string>"))

    def pieces(word: Column) -> Column:
        return F.concat(*[windows(word, n) for n in range(sizes[0], sizes[1] + 1)])

    return F.flatten(F.transform(padded, pieces))


def used_words(samples: DataFrame) -> DataFrame:
    """``(_code, uses)``: every white-space token of the samples' ``_code`` once, in lower case, combined before the shuffle.

    The ``char_ngrams`` of a text are those of its tokens, so they are cut from different tokens only.
    """
    words = samples.select(F.lower("_code").alias("code")).mapInArrow(_counted_words, "_code string, uses long")
    return words.groupBy("_code").agg(F.sum("uses").alias("uses"))


HELD = 1 << 18          # different terms that a task adds up before it passes them on


def _pairs(counter: Counter, name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(counter.keys(), pa.string()), pa.array(counter.values(), pa.int64())], names=[name, "uses"])


def _counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counter: Counter = Counter()
    for batch in batches:
        for code in batch.column(0).to_pylist():
            counter.update((code or "").split())
            if len(counter) >= HELD:
                yield _pairs(counter, "_code")
                counter.clear()
    yield _pairs(counter, "_code")


def char_term_counts(words: DataFrame, sizes: tuple[int, int] = CHAR_RANGE) -> DataFrame:
    """``(term, uses)``: the ``char_ngrams`` of ``used_words`` and how often they occur in all samples, combined before the shuffle."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter: dict[str, int] = {}
        for batch in batches:
            for word, uses in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for term in _grams(word, *sizes):
                    counter[term] = counter.get(term, 0) + uses
                if len(counter) >= HELD:
                    yield _pairs(counter, "term")
                    counter.clear()
        yield _pairs(counter, "term")

    return words.select("_code", "uses").mapInArrow(counted, "term string, uses long").groupBy("term").agg(F.sum("uses").alias("uses"))


GRAMS = "_grams array<struct<term: string, uses: long>>"
ROWS = 64               # texts whose n-grams leave a task at once
KNOWN_WORDS, KNOWN_LENGTH = 20_000, 32     # words, and their characters, whose n-grams a task remembers


def _grams(word: str, low: int, high: int) -> list[str]:
    padded = f" {word} "
    return [padded[i:i + n] for n in range(low, min(high, len(padded)) + 1) for i in range(len(padded) - n + 1)]


def _counted_grams(batches: Iterator[pa.RecordBatch], low: int, high: int) -> Iterator[pa.RecordBatch]:
    pair = pa.struct([("term", pa.string()), ("uses", pa.int64())])
    known: dict[str, list[str]] = {}

    def grams(word: str) -> list[str]:
        found = known.get(word)
        if found is None:
            found = _grams(word, low, high)
            if len(word) <= KNOWN_LENGTH:
                if len(known) >= KNOWN_WORDS:
                    known.clear()
                known[word] = found
        return found

    for batch in batches:
        for part in (batch.slice(start, ROWS) for start in range(0, batch.num_rows, ROWS)):
            ends, terms, uses, missing = [0], [], [], []
            for code in part.column(part.num_columns - 1).to_pylist():
                found = Counter(chain.from_iterable(map(grams, (code or "").split())))
                ordered = sorted(found)
                terms += ordered
                uses += map(found.__getitem__, ordered)
                ends.append(len(terms))
                missing.append(code is None)
            pairs = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(uses, pa.int64())], fields=list(pair))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs, mask=pa.array(missing, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists], names=[*part.schema.names[:-1], "_grams"])


def char_ngram_counts(samples: DataFrame, sizes: tuple[int, int] = CHAR_RANGE) -> DataFrame:
    """``samples`` with ``_grams``, the different ``char_ngrams`` of a text in order, and how often each occurs.

    Tokens that come again are cut once in a while only; null for a null text.
    """
    kept = [c for c in samples.columns if c not in ("_code", "_tokens")]
    schema = ", ".join([*(f"`{n}` {t}" for n, t in samples.select(*kept).dtypes), GRAMS])
    return samples.select(*kept, F.lower("_code").alias("_lower")).mapInArrow(lambda batches: _counted_grams(batches, *sizes), schema)


Terms = Column | Callable[[DataFrame], DataFrame]       # an array of terms in each sample, or what makes the rows of all


def _each(samples: DataFrame, terms: Terms) -> DataFrame:
    return samples.select(F.explode(terms).alias("term")) if isinstance(terms, Column) else terms(samples)


def term_counts(samples: DataFrame, terms: Terms, uses: str | None = None) -> DataFrame:
    """``(term, uses)`` over all samples, combined before the shuffle; ``uses`` names how often a sample counts, once by default."""
    if uses is None:
        return _each(samples, terms).groupBy("term").agg(F.count(F.lit(1)).alias("uses"))
    return samples.select(F.explode(terms).alias("term"), F.col(uses).alias("uses")).groupBy("term").agg(F.sum("uses").alias("uses"))


def vocabulary(counts: DataFrame, size: int) -> DataFrame:
    """The ``size`` most used terms; equal counts are ordered by the term."""
    return counts.orderBy(F.col("uses").desc(), "term").limit(size)


def _in_buckets(bucket: Column, buckets: list[int], count: int) -> Column:
    """Whether a bucket is among the given ones: a bit of a literal of ``count`` bits, not a join."""
    bits = bytearray(count // 8)
    for b in buckets:
        bits[b >> 3] |= 1 << (b & 7)
    octet = F.conv(F.hex(F.substring(F.lit(bytes(bits)), F.shiftright(bucket, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(octet, bucket.bitwiseAND(F.lit(7))) == 1


def heavy_terms(samples: DataFrame, terms: Terms, size: int, buckets: int = BUCKETS, uses: str | None = None) -> DataFrame:
    """The same ``(term, uses)`` as ``vocabulary`` of ``term_counts``, of which only a few terms are shuffled.

    A first pass adds up uses by hash bucket: a bucket's sum is at least that of each of its terms.  The terms of the
    fullest buckets are counted; the last of the ``size`` most used ones is a bound, and buckets whose sum is below it can hold no
    other.  The rest, seldom any, is counted as well, so the result is exact.  Distinct terms grow with the corpus, buckets do not.
    """
    exploded = _each(samples, terms).withColumn("uses", F.lit(1).cast("long")) if uses is None else \
        samples.select(F.explode(terms).alias("term"), F.col(uses).cast("long").alias("uses"))
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
    def counted_in(chosen: list[int]) -> DataFrame:
        return exploded.filter(_in_buckets(bucket, chosen, buckets)).groupBy("term").agg(F.sum("uses").alias("uses"))

    return _heavy(exploded.groupBy(bucket.alias("bucket")).agg(F.sum("uses").alias("sum")), counted_in, size)


def _heavy(sums: DataFrame, counted_in: Callable[[list[int]], DataFrame], size: int) -> DataFrame:
    sums = durable(sums, "term-buckets")
    fullest = [r["bucket"] for r in sums.orderBy(F.desc("sum"), "bucket").limit(FULLEST * size).collect()]
    counts = durable(vocabulary(counted_in(fullest), size), "heavy-terms")
    found = counts.agg(F.count(F.lit(1)).alias("n"), F.min("uses").alias("least")).first()
    least = found["least"] if found["n"] == size else 0
    rest = [r["bucket"] for r in sums.filter(F.col("sum") >= least).join(F.broadcast(sums.orderBy(F.desc("sum"), "bucket").limit(FULLEST * size)), "bucket", "left_anti").select("bucket").collect()]
    return vocabulary(counts.unionByName(counted_in(rest)) if rest else counts, size)


def heavy_word_terms(samples: DataFrame, size: int, sizes: tuple[int, int] = WORD_RANGE, buckets: int = BUCKETS) -> DataFrame:
    """``heavy_terms`` of the ``word_ngrams`` of all samples, whose buckets are found for whole arrays of tokens."""
    codes = samples.select(F.lower("_code").alias("code"))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, hashes = np.zeros(buckets, np.int64), _Hashes()
        for batch in batches:
            for start, rows in _slices(batch.column(0)):
                for _, _, found in hashes.runs(batch.column(0).slice(start, rows), sizes, buckets):
                    sums += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(sums[used])], names=["bucket", "sum"])

    def counted_in(chosen: list[int]) -> DataFrame:
        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counter, hashes, wanted = Counter(), _Hashes(), np.zeros(buckets, bool)
            wanted[chosen] = True
            for batch in batches:
                for start, rows in _slices(batch.column(0)):
                    for n, begins, found in hashes.runs(batch.column(0).slice(start, rows), sizes, buckets):
                        tokens = hashes.tokens
                        counter.update(" ".join(tokens[i:i + n]) for i in begins[wanted[found]].tolist())
                    if len(counter) >= HELD:
                        yield _pairs(counter, "term")
                        counter.clear()
            yield _pairs(counter, "term")

        return codes.mapInArrow(counted, "term string, uses long").groupBy("term").agg(F.sum("uses").alias("uses"))

    return _heavy(codes.mapInArrow(summed, "bucket int, sum long").groupBy("bucket").agg(F.sum("sum").alias("sum")), counted_in, size)


class _Hashes:
    """Buckets of runs of tokens: the tokens' hashes, the same in every task, are combined."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.tokens: list[str] = []

    def runs(self, codes: pa.Array, sizes: tuple[int, int], buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length the places in ``tokens``, those of all texts, where runs begin, and their buckets."""
        lists = [_tokens(c) for c in codes.to_pylist()]
        self.tokens = tokens = [*chain.from_iterable(lists)]
        if len(self.known) >= HELD:
            self.known.clear()
        known = self.known
        for t in set(tokens).difference(known):
            known[t] = zlib.crc32(t.encode())
        single = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
        text = np.repeat(np.arange(len(lists)), np.fromiter(map(len, lists), np.int64, len(lists)))
        mixed = single
        for n in range(1, sizes[1] + 1):
            if n > 1:
                mixed = mixed[:-1] * np.uint64(0x9E3779B97F4A7C15) + single[n - 1:]
            if not len(mixed):
                return
            if n >= sizes[0]:
                begins = np.flatnonzero(text[:len(mixed)] == text[n - 1:])
                spread = (mixed[begins] ^ mixed[begins] >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)
                yield n, begins, (spread % np.uint64(buckets)).astype(np.int64)


def inverse_document_frequency(samples: DataFrame, terms: Column, vocab: DataFrame) -> DataFrame:
    """``(term, documents, idf)`` with idf = ln((1 + samples) / (1 + documents)) + 1.

    ``vocab`` has a fixed maximum of rows and is broadcast.
    """
    used = (
        samples.select(F.explode(F.array_distinct(terms)).alias("term"))
        .join(F.broadcast(vocab.select("term")), "term", "left_semi")
        .groupBy("term").agg(F.count(F.lit(1)).alias("documents"))
    )
    size = samples.agg(F.count(F.lit(1)).alias("samples")).scalar()
    return used.select("term", "documents", (F.ln((size + 1) / (F.col("documents") + 1)) + 1).alias("idf"))


class _Trie:
    """Terms as walks of symbols: a step leads from the start of a term and its next symbol to a longer start.

    Symbols are numbered from 1, and 0 is any other; a whole array of places goes one step at a time.
    """

    def __init__(self, terms: list[tuple[int, ...]], places: list[int], symbols: int):
        starts: dict[tuple[int, ...], int] = {(): 0}
        for term in terms:
            for n in range(1, len(term) + 1):
                starts.setdefault(term[:n], len(starts))
        self.width, self.depth = symbols + 1, max(map(len, terms), default=0)
        pairs = sorted((starts[t[:-1]] * self.width + t[-1], n) for t, n in starts.items() if t)
        self.keys = np.array([k for k, _ in pairs], np.int64)
        self.to = np.array([n for _, n in pairs], np.int32)
        self.place = np.full(len(starts), -1, np.int64)
        for term, place in zip(terms, places):
            self.place[starts[term]] = place
        self.dense = None
        if len(starts) * self.width <= DENSE_STEPS:
            self.dense = np.zeros(len(starts) * self.width, np.int32)
            self.dense[self.keys] = self.to

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        key = state.astype(np.int64) * self.width + symbol
        if self.dense is not None:
            return self.dense[key]
        if not len(self.keys):
            return np.zeros(len(key), np.int32)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (symbol > 0), self.to[at], 0)

    def found(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where terms begin in a row of symbols, and the terms' places in the vocabulary."""
        at, state, begins, places = np.arange(len(symbols)), np.zeros(len(symbols), np.int32), [], []
        for n in range(self.depth):
            if n:
                at, state = at[at + n < len(symbols)], state[at + n < len(symbols)]
            state = self.step(state, symbols[at + n])
            alive = state > 0
            at, state = at[alive], state[alive]
            place = self.place[state]
            whole = place >= 0
            begins.append(at[whole])
            places.append(place[whole])
        return (np.concatenate(begins), np.concatenate(places)) if begins else (at[:0], at[:0])


DENSE_STEPS = 1 << 22       # steps of a trie that are a table, not a search
CHARACTERS = 1 << 18        # about as many are looked up at a time
_SPACES = np.array([ord(c) for c in WHITESPACE])


class _WordTerms:
    """Word n-grams of texts in lower case."""

    def __init__(self, vocab: list[str], sizes: tuple[int, int]):
        terms = {tuple(t.split(" ")): i for i, t in enumerate(vocab)}
        terms = {t: i for t, i in terms.items() if sizes[0] <= len(t) <= sizes[1]}
        words = {w: k + 1 for k, w in enumerate(sorted({w for t in terms for w in t}))}
        self.words = words
        self.trie = _Trie([tuple(words[w] for w in t) for t in terms], [*terms.values()], len(words))

    def found(self, codes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The texts that terms are in, and their places in the vocabulary, in any order."""
        lists = [_tokens(c) for c in codes.to_pylist()]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        text = np.repeat(np.arange(len(sizes)), sizes)
        # no term goes on behind the end of a text, where a 0 stands
        symbols = np.zeros(len(text) + len(sizes), np.int64)
        symbols[np.arange(len(text)) + text] = [self.words.get(t, 0) for t in chain.from_iterable(lists)]
        begins, places = self.trie.found(symbols)
        return np.repeat(np.arange(len(sizes)), sizes + 1)[begins], places


class _CharTerms:
    """Character n-grams of the white-space tokens of texts in lower case, each with a space on either side."""

    def __init__(self, vocab: list[str], sizes: tuple[int, int]):
        def possible(t: str) -> bool:
            return sizes[0] <= len(t) <= sizes[1] and len(t[1:-1].split()) == bool(t[1:-1]) and not any(c.isspace() for c in t[1:-1]) \
                and not any(c != " " and c.isspace() for c in (t[0], t[-1])) and t != "  "

        terms = {t: i for i, t in enumerate(vocab) if t and possible(t)}
        letters = {c: k + 1 for k, c in enumerate(sorted({" ", *(c for t in terms for c in t)}))}
        self.space = letters[" "]
        self.symbol = np.zeros(0x110000, np.int32)
        self.symbol[[ord(c) for c in letters]] = [*letters.values()]
        self.symbol[_SPACES] = -1
        self.trie = _Trie([tuple(letters[c] for c in t) for t in terms], [*terms.values()], len(letters))

    def found(self, codes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        sizes = pc.fill_null(pc.utf8_length(codes), 0).to_numpy(zero_copy_only=False) + 1
        # a line break ends a text
        joined = "".join(f"{c or ''}\n" for c in codes.to_pylist())
        symbols = self.symbol[np.frombuffer(joined.encode("ascii"), np.uint8) if joined.isascii() else np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
        inside = symbols >= 0
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        # every token gets a space of its own on either side
        at = np.cumsum(inside) + 2 * np.cumsum(begins) - 2
        text = np.repeat(np.arange(len(sizes)), sizes)
        padded = np.full(int(inside.sum() + 2 * begins.sum()), self.space, np.int32)
        padded[at[inside]] = symbols[inside]
        ends = np.cumsum(np.bincount(text, inside + 2 * begins, len(sizes)).astype(np.int64))
        found, places = self.trie.found(padded)
        return np.searchsorted(ends, found, "right"), places


def _counted(texts: np.ndarray, places: np.ndarray, rows: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, place in the vocabulary and number of the terms of ``rows`` texts, by text and place."""
    cells = texts * max(size, 1) + places
    if rows * size <= 4 * len(cells):
        counts = np.bincount(cells)
        used = np.flatnonzero(counts)
        counts = counts[used]
    else:
        used, counts = np.unique(cells, return_counts=True)
    return used // max(size, 1), used % max(size, 1), counts


_VECTOR = pa.struct([("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])


def _sparse(texts: np.ndarray, places: np.ndarray, values: np.ndarray, rows: int, size: int) -> pa.StructArray:
    """Sparse vectors, as ``VectorUDT`` stores them; values come by text and place."""
    ends = pa.array(np.searchsorted(texts, np.arange(rows + 1)).astype(np.int32))
    return pa.StructArray.from_arrays(
        [pa.array(np.zeros(rows, np.int8)), pa.array(np.full(rows, size, np.int32)), pa.ListArray.from_arrays(ends, pa.array(places.astype(np.int32))),
         pa.ListArray.from_arrays(ends, pa.array(values.astype(np.float64)))], names=["type", "size", "indices", "values"])


def _slices(codes: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of texts with about ``CHARACTERS`` together, or of one longer text."""
    before = np.concatenate([[0], np.cumsum(pc.fill_null(pc.utf8_length(codes), 0).to_numpy(zero_copy_only=False) + 1)])
    start = 0
    while start < len(codes):
        end = max(start + 1, int(np.searchsorted(before, before[start] + CHARACTERS, "right")) - 1)
        yield start, end - start
        start = end


def _vectors(df: DataFrame, schema: StructType, words: list[str], chars: list[str], word_range: tuple[int, int], char_range: tuple[int, int],
             made: Callable[[tuple, tuple, int], list[pa.Array]]) -> DataFrame:
    """``df`` with ``_vectors``, what is ``made`` of the counted word terms and character terms of some texts and their number."""
    kind = pa.struct([(f.name, _VECTOR) for f in schema.fields])

    @F.arrow_udf(schema)
    def vectors(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        by_word, by_char = _WordTerms(words, word_range), _CharTerms(chars, char_range)
        for codes in parts:
            done = []
            for start, rows in _slices(codes):
                word = _counted(*by_word.found(codes.slice(start, rows)), rows, len(words))
                char = _counted(*by_char.found(codes.slice(start, rows)), rows, len(chars))
                done.append(pa.StructArray.from_arrays(made(word, char, rows), names=[*schema.names]))
            yield pa.concat_arrays(done) if done else pa.array([], kind)

    return df.withColumn("_vectors", vectors(F.lower("_code")))


def document_counts(df: DataFrame, words: list[str], chars: list[str], word_range: tuple[int, int], char_range: tuple[int, int]) -> tuple[int, list[int], list[int]]:
    """The number of texts, and for each term of both vocabularies the number of those that have it, from ``_code``.

    A task adds up its texts: a row a term leaves it, and no vectors.
    """
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_word, by_char = _WordTerms(words, word_range), _CharTerms(chars, char_range)
        sums = np.zeros(len(words) + len(chars) + 1, np.int64)
        for batch in batches:
            codes = batch.column(0)
            for start, rows in _slices(codes):
                for part, size, first in ((by_word.found(codes.slice(start, rows)), len(words), 0), (by_char.found(codes.slice(start, rows)), len(chars), len(words))):
                    _, places, _ = _counted(*part, rows, size)
                    sums[first:first + size] += np.bincount(places, minlength=size)
                sums[-1] += rows
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(sums[used])], names=["place", "n"])

    found = df.select(F.lower("_code").alias("code")).mapInArrow(counted, "place int, n long").groupBy("place").agg(F.sum("n").alias("n"))
    sums = [0] * (len(words) + len(chars) + 1)
    for row in found.collect():         # at most a row a term
        sums[row["place"]] = row["n"]
    return sums[-1], sums[:len(words)], sums[len(words):-1]


def term_vectors(df: DataFrame, words: list[str], chars: list[str], word_range: tuple[int, int], char_range: tuple[int, int], sublinear: bool = False) -> DataFrame:
    """Add ``_word_counts`` and ``_char_counts``, sparse vectors of term counts over fixed vocabularies, from ``_code``.

    ``sublinear`` has 1 + ln(count) in place of the count.  Terms are looked up for all places of many texts at once.
    """
    def made(word: tuple, char: tuple, rows: int) -> list[pa.Array]:
        return [_sparse(texts, places, np.log(counts) + 1 if sublinear else counts, rows, size)
                for (texts, places, counts), size in ((word, len(words)), (char, len(chars)))]

    schema = StructType([StructField("words", VectorUDT()), StructField("chars", VectorUDT())])
    found = _vectors(df, schema, words, chars, word_range, char_range, made)
    return found.select(*df.columns, F.col("_vectors.words").alias("_word_counts"), F.col("_vectors.chars").alias("_char_counts"))


def tfidf_vectors(df: DataFrame, words: list[str], chars: list[str], word_range: tuple[int, int], char_range: tuple[int, int],
                  word_idf: list[float], char_idf: list[float]) -> DataFrame:
    """Add ``features``, a sparse vector of both vocabularies, from ``_code``.

    1 + ln(count), times idf, each vocabulary's part of length 1.
    """
    made = _weigher(np.array(word_idf, np.float64), np.array(char_idf, np.float64))
    found = _vectors(df, _FEATURES, words, chars, word_range, char_range, made)
    return found.select(*df.columns, F.col("_vectors.features").alias("features"))


_FEATURES = StructType([StructField("features", VectorUDT())])


def _weigher(by_word: np.ndarray, by_char: np.ndarray) -> Callable[[tuple, tuple, int], list[pa.Array]]:
    """Makes ``features`` of counted terms."""
    def weighted(texts: np.ndarray, places: np.ndarray, counts: np.ndarray, idf: np.ndarray, rows: int) -> np.ndarray:
        values = (np.log(counts) + 1) * idf[places]
        return values / np.sqrt(np.bincount(texts, values * values, rows))[texts]

    def made(word: tuple, char: tuple, rows: int) -> list[pa.Array]:
        texts = np.concatenate([word[0], char[0]])
        places = np.concatenate([word[1], char[1] + len(by_word)])
        values = np.concatenate([weighted(*word, by_word, rows), weighted(*char, by_char, rows)])
        order = np.argsort(texts, kind="stable")
        return [_sparse(texts[order], places[order], values[order], rows, len(by_word) + len(by_char))]

    return made


def tfidf_of_counts(df: DataFrame, word_idf: list[float], char_idf: list[float]) -> DataFrame:
    """``tfidf_vectors`` from the ``_word_counts`` and ``_char_counts`` of ``term_vectors``, whose vocabularies may be longer: terms beyond the idf are left out."""
    made = _weigher(np.array(word_idf, np.float64), np.array(char_idf, np.float64))
    sizes = len(word_idf), len(char_idf)

    def counted(vectors: pa.StructArray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lists = vectors.field("indices")
        places = lists.flatten().to_numpy()
        texts = np.repeat(np.arange(len(vectors)), pc.list_value_length(lists).to_numpy())
        kept = places < size
        return texts[kept], places[kept].astype(np.int64), vectors.field("values").flatten().to_numpy()[kept]

    @F.arrow_udf(_FEATURES)
    def vectors(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for word, char in parts:
            yield pa.StructArray.from_arrays(made(counted(word, sizes[0]), counted(char, sizes[1]), len(word)), names=["features"])

    kept = [c for c in df.columns if c not in ("_word_counts", "_char_counts")]
    return df.withColumn("_vectors", vectors(F.unwrap_udt("_word_counts"), F.unwrap_udt("_char_counts"))).select(*kept, F.col("_vectors.features").alias("features"))
