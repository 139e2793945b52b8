"""Token counts by heap-and-linked-list byte-pair merging; no token identifiers are made for the texts."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel

CACHE = 1 << 19         # pieces whose counts a Python worker remembers; longer pieces than KEEP are counted each time
KEEP = 64
LONG = 1 << 22          # characters of a text whose pieces are listed at once; beyond, one at a time
LIMIT = 512

# fixed value: how byte-level vocabularies of this family part a text
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same with ``NEW`` for characters that are letters or digits only in newer Unicode tables than the library's.
PIECES_OLD = r"'s|'t|'re|'ve|'m|'ll|'d| ?[\p{L}--[NEW]]+| ?[\p{N}--[NEW]]+| ?(?:[^\s\p{L}\p{N}]|[NEW])+|\s+(?!\S)|\s+"


def newer_characters() -> list[str]:
    """Letters and digits of this machine's Unicode tables that the tokenizers library does not know as such.

    Only characters that Python itself has no name for are in doubt; these are put to the library.
    """
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    doubt = [c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn"]
    part = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    return [c for c in doubt if len(part("a" + c)) == 2 and len(part("1" + c)) == 2]


def _ranges(characters: list[str]) -> str:
    out: list[list[int]] = []
    for c in map(ord, characters):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    moved = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(moved)) for b in range(256)]


class PairMerger:
    """Counts the tokens of a text from a byte-level BPE file (vocabulary, merges, added tokens)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocabulary = spec["model"]["vocab"]
        self.first = [vocabulary[s] for s in byte_symbols()]
        self.width = max(vocabulary.values()).bit_length()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank = {vocabulary[a] << self.width | vocabulary[b]: k for k, (a, b) in enumerate(pairs)}
        self.made = [vocabulary[a + b] for a, b in pairs]
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.pieces = regex.compile(PIECES)
        self.rare, self.exact = None, self.pieces
        if new := newer_characters():
            self.rare = re.compile(f"[{min(new)}-\U0010ffff]")
            self.exact = regex.compile(PIECES_OLD.replace("NEW", _ranges(new)), regex.V1)
        self.known = _Counts(self.merged)

    def merged(self, piece: str) -> int:
        """Initial symbols less merges: the adjacent pair of lowest rank, leftmost first, is merged until none is left."""
        raw = piece.encode()
        count = len(raw)
        if count == 1:
            return 1
        symbol = [self.first[b] for b in raw]
        after, before = list(range(1, count + 1)), list(range(-1, count - 1))
        width, rank, made = self.width, self.rank, self.made
        heap = [found << 32 | i for i in range(count - 1) if (found := rank.get(symbol[i] << width | symbol[i + 1])) is not None]
        heapify(heap)
        end = count
        while heap:
            entry = heappop(heap)
            i, merge = entry & 0xFFFFFFFF, entry >> 32
            j = after[i]
            if symbol[i] < 0 or j >= end or rank.get(symbol[i] << width | symbol[j]) != merge:
                continue        # one of the two has been merged since
            symbol[i], symbol[j] = made[merge], -1
            after[i] = k = after[j]
            count -= 1
            if k < end:
                before[k] = i
                if (found := rank.get(symbol[i] << width | symbol[k])) is not None:
                    heappush(heap, found << 32 | i)
            if (h := before[i]) >= 0 and (found := rank.get(symbol[h] << width | symbol[i])) is not None:
                heappush(heap, found << 32 | h)
        return count

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        rule = self.exact if self.rare and self.rare.search(text) else self.pieces
        parts = [text] if self.special is None else self.special.split(text)
        total = len(parts) - 1
        for part in parts:
            pieces = rule.findall(part) if len(part) <= LONG else (m[0] for m in rule.finditer(part))
            total += sum(map(self.known.__getitem__, pieces))
        return total


class _Counts(dict):
    """Counts of short pieces, emptied when full."""

    def __init__(self, count):
        super().__init__()
        self.count = count

    def __missing__(self, piece: str) -> int:
        found = self.count(piece)
        if len(piece) <= KEEP:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = found
        return found


@lru_cache(maxsize=2)
def merger(path: str) -> PairMerger:
    """One for each Python worker and vocabulary."""
    return PairMerger(path)


def token_count(path: str, text: str = "text") -> Column:
    """The tokens of a whole text under the vocabulary at ``path`` (a path that every executor has); 0 for null."""

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = merger(path)
        for batch in batches:
            yield pd.Series([own.count(t) for t in batch], dtype="int64")

    return counted(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for every row.

    Texts are counted whole, without begin, end or padding; the strings of added tokens inside a text count as one token.
    Null and empty texts have 0 bytes and 0 tokens; repeated rows and null ids stay; other columns are not read.
    """
    counted = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.octet_length(F.col(f"`{text}`").cast("string")), F.lit(0)).cast("long").alias("n_bytes"),
                          token_count(path, text).alias("n_tokens"))
    return counted.select("*", (F.col("n_tokens") > limit).alias("over_limit"))
