"""Token identifiers as binary files: a static range asymmetric numeral system over interleaved lanes."""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, partial
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.functions.durable import claim, durable
from riskloom.llm.common import shuffle_tasks, slices, utf8

END = 2
CACHE = 5 << 18             # words whose identifiers a Python worker remembers, and as many older ones
MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"      # ASCII punctuation but the apostrophe, which starts pieces
LANES = 512                 # coder states that take turns in a block
SEGMENT = 128               # steps (one symbol for every lane) between two checkpoints
BLOCK = 2                   # segments of a block; a block has its own states, words and checksum
GROUP = 1 << 22             # identifiers under one frequency table, or one document's if it has more
SCALE = 18                  # bits of the frequencies' sum; more where a table has more symbols
LOW = np.uint64(1 << 31)
SCHEMA = ("part int, seq int, n_tokens long, doc_ids array<long>, lengths array<long>, scale int, symbols binary, frequencies binary, "
          "words binary, offsets array<long>, states binary, checksums array<long>")


@lru_cache(maxsize=4096)
def _ends_alike(char: str) -> bool:
    """Whether a word's last character is a letter or digit, and still ends in one when normalised and lower-cased."""
    return char.isalnum() and unicodedata.normalize("NFC", char).lower()[-1].isalnum()


class WordEncoder:
    """Identifiers of whole texts from a tokenizers file.

    For vocabularies that drop white space and never join over it: the library encodes every distinct word, in
    batches, and a text's identifiers are those of its words in a row.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            suffix = json.load(file)["model"].get("end_of_word_suffix") or ""
        vocabulary = self.library.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)        # identifiers that end a word
        self.last[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self.known: dict[bytes, bytes] = {}           # a word's identifiers, four bytes each
        self.older: dict[bytes, bytes] = {}

    def words(self, text: bytes) -> list[bytes]:
        # added tokens are the only words in which the case of ASCII letters counts
        return (text if b"<|" in text else text.lower()).split()

    def learn(self, words: set[bytes]) -> None:
        new = words.difference(self.known)
        if len(self.known) + len(new) > CACHE:
            # words that still occur come over from the older half, the others are forgotten
            self.known, self.older = {}, self.known
            new = words
        back = self.older.keys() & new
        self.known.update((w, self.older[w]) for w in back)
        new = new.difference(back)
        # punctuation that ends a word is a piece of its own after a letter or digit, whatever the letters are
        stems = {w: stem for w in new if (stem := w.rstrip(MARKS)) and len(stem) < len(w) and b"<|" not in w and _ends_alike(stem[-4:].decode(errors="ignore")[-1:])}
        plain = new.difference(stems).union(stems.values()).union(w[len(stem):] for w, stem in stems.items()).difference(self.known)
        letters = [w for w in plain if w.decode().isalpha()]
        for part in self._parts(letters, 1 << 9):
            plain.difference_update(part if self._learn_joined(part) else ())
        for part in self._parts(list(plain), 1 << 14):
            made = self.library.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
            self.known.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(part, made))
        self.known.update((w, self.known[stem] + self.known[w[len(stem):]]) for w, stem in stems.items())

    def _learn_joined(self, words: list[bytes]) -> bool:
        """Learn words of letters from one text: each is one piece, so each has one identifier that ends a word, its last."""
        ids = np.array(self.library.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, "<u4")
        ends = (np.nonzero(self.last[ids])[0] + 1) * 4
        if len(ends) != len(words) or ends[-1] != 4 * len(ids):
            return False
        raw, ends = ids.tobytes(), ends.tolist()
        self.known.update((w, raw[s:e]) for w, s, e in zip(words, [0, *ends], ends))
        return True

    @staticmethod
    def _parts(words: list[bytes], size: int) -> Iterator[list[bytes]]:
        return (words[k:k + size] for k in range(0, len(words), size))

    def encode(self, texts: list[bytes], end: int) -> Iterator[np.ndarray]:
        split = [self.words(t) for t in texts]
        known = self.known.get
        found = [list(map(known, words)) for words in split]
        # most words of a text are known; only the others are gathered, learnt and put in
        gaps = [[k for k, ids in enumerate(own) if ids is None] for own in found]
        missing = {words[k] for words, places in zip(split, gaps) for k in places}
        if missing:
            self.learn(missing)
        last = end.to_bytes(4, "little")
        for words, own, places in zip(split, found, gaps):
            for k in places:
                own[k] = self.known[words[k]]
            own.append(last)
            yield np.frombuffer(b"".join(own), "<u4")


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def scaled(counts: np.ndarray, bits: int) -> np.ndarray:
    """Frequencies in proportion to positive counts, each at least 1, that add up to 2 ** bits."""
    total = 1 << bits
    out = np.maximum(1, counts * total // counts.sum())
    order = np.argsort(-out, kind="stable")
    missing = total - int(out.sum())
    if missing > 0:
        out[order[0]] += missing
    for k in order:
        if missing >= 0:
            break
        cut = min(-missing, int(out[k]) - 1)
        out[k] -= cut
        missing += cut
    return out


def pack(ids: np.ndarray) -> dict:
    """A group of identifiers as one table and independent blocks of interleaved lanes.

    Lanes start at their last symbol, all blocks at once.  Every ``SEGMENT`` steps the states and the place in the
    words are kept, so a reader can start there.
    """
    tally = np.bincount(ids)
    symbols = np.nonzero(tally)[0]
    counts, place = tally[symbols], np.zeros(len(tally), dtype=np.int64)
    place[symbols] = np.arange(len(symbols))
    index = place[ids]
    bits = max(SCALE, int(len(symbols) - 1).bit_length() + 2)
    freq = scaled(counts, bits)
    first = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
    freq64 = freq.astype(np.uint64)
    steps = SEGMENT * BLOCK
    blocks = -(-len(ids) // (steps * LANES))
    full = np.full(blocks * steps * LANES, int(np.argmax(freq)), dtype=np.int64)
    full[:len(ids)] = index
    full = full.reshape(blocks, steps, LANES)
    last = -(-len(ids) // LANES) - (blocks - 1) * steps             # steps that the last block needs
    x = np.full((blocks, LANES), LOW, dtype=np.uint64)
    shift, half = np.uint64(bits), np.uint64(32)
    room = ((LOW >> shift) << half) * freq64
    total = np.uint64(1 << bits)
    written: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    states = np.zeros((blocks, BLOCK, LANES), dtype=np.uint64)
    for t in range(steps - 1, -1, -1):
        live = blocks if t < last else blocks - 1
        if live:
            which, state = full[:live, t], x[:live]
            f = freq64.take(which)
            over = state >= room.take(which)
            words = np.zeros(blocks, dtype=np.int64)
            words[:live] = over.sum(axis=1)
            out = state[over]
            written.append(out.astype(np.uint32))       # the lower half
            sizes.append(words)
            out >>= half
            state[over] = out
            quotient = state // f
            # (quotient << bits) + remainder + start, the remainder being state - quotient * f
            np.subtract(total, f, out=f)
            quotient *= f
            state += quotient
            state += first.take(which)
        else:
            written.append(np.zeros(0, dtype=np.uint32))
            sizes.append(np.zeros(blocks, dtype=np.int64))
        if t % SEGMENT == 0:
            states[:, t // SEGMENT] = x
    written.reverse()
    size = np.array(sizes[::-1])                                    # (steps, blocks)
    owner = np.repeat(np.tile(np.arange(blocks), steps), size.ravel())
    words = np.concatenate(written)[np.argsort(owner, kind="stable")]
    ends = np.concatenate([[0], np.cumsum(size.sum(axis=0))])
    before = np.concatenate([np.zeros((1, blocks), np.int64), np.cumsum(size, axis=0)])[:-1:SEGMENT]      # (BLOCK, blocks)
    offsets = (before + ends[:-1]).T
    raw = words.astype("<u4")
    return {"n_tokens": len(ids), "scale": bits, "symbols": symbols.astype("<u4").tobytes(), "frequencies": freq.astype("<u4").tobytes(),
            "words": raw.tobytes(), "offsets": offsets.ravel().tolist(), "states": states.astype("<u8").tobytes(),
            "checksums": [crc32(states[b].astype("<u8").tobytes(), crc32(raw[ends[b]:ends[b + 1]].tobytes())) for b in range(blocks)]}


def unpack(group: dict, first_block: int = 0, last_block: int | None = None) -> np.ndarray:
    """The identifiers of a group, or of some of its blocks; all segments are decoded side by side.  Damaged blocks raise ValueError."""
    bits, shift, half = group["scale"], np.uint64(group["scale"]), np.uint64(32)
    symbols, freq = np.frombuffer(group["symbols"], "<u4"), np.frombuffer(group["frequencies"], "<u4").astype(np.uint64)
    start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
    slot = np.repeat(np.arange(len(symbols)), freq.astype(np.int64))
    words = np.frombuffer(group["words"], "<u4").astype(np.uint64)
    states = np.frombuffer(group["states"], "<u8").reshape(-1, BLOCK, LANES)
    blocks = len(states)
    last_block = blocks if last_block is None else last_block
    offsets = np.array(group["offsets"], dtype=np.int64).reshape(blocks, BLOCK)
    ends = np.append(offsets[:, 0], len(words))
    for b in range(first_block, last_block):
        found = crc32(states[b].tobytes(), crc32(group["words"][4 * ends[b]:4 * ends[b + 1]]))
        if found != group["checksums"][b]:
            raise ValueError(f"block {b} is damaged")
    steps = SEGMENT * BLOCK
    need = np.full(blocks, steps)
    need[-1] = -(-group["n_tokens"] // LANES) - (blocks - 1) * steps
    need = np.clip(need[first_block:last_block, None] - np.arange(BLOCK) * SEGMENT, 0, SEGMENT).ravel()
    x = states[first_block:last_block].reshape(-1, LANES).copy()
    at = offsets[first_block:last_block].ravel().copy()
    out = np.zeros((len(x), SEGMENT, LANES), dtype=np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for t in range(SEGMENT):
        live = np.nonzero(need > t)[0]
        if not len(live):
            break
        state = x[live]
        low = state & mask
        which = slot.take(low.view(np.int64))
        out[live, t] = symbols.take(which)
        state >>= shift
        state *= freq.take(which)
        low -= start.take(which)
        state += low
        short = state < LOW
        rank = np.cumsum(short, axis=1)
        place = (at[live, None] + rank - 1)[short]
        state[short] = (state[short] << half) | words[place]
        at[live] += rank[:, -1]
        x[live] = state
    return out.reshape(-1)[:group["n_tokens"] - first_block * steps * LANES]


def _packed(batches, path, end):
    encoder, part, seq = word_encoder(path), TaskContext.get().partitionId(), 0
    held: list[tuple[int | None, np.ndarray]] = []
    size = 0

    def group():
        made = pack(np.concatenate([ids for _, ids in held]))
        row = {"part": part, "seq": seq, "doc_ids": [i for i, _ in held], "lengths": [len(ids) for _, ids in held], **made}
        return pa.RecordBatch.from_pylist([row], schema=_arrow())

    for batch in slices(batches):
        names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for name, ids in zip(names, encoder.encode(texts, end)):
            held.append((name, ids))
            size += len(ids)
            if size >= GROUP:
                yield group()
                held, size, seq = [], 0, seq + 1
    if held:
        yield group()


def _arrow() -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split(" ") for x in SCHEMA.split(", "))])


def write_token_files(docs: DataFrame, vocabulary: str, path: str, end: int = END, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode every whole text, append ``end``, and write all identifiers in ascending order of doc_id.

    Texts are shuffled once, into ranges of doc_id (null first) and, for rows that share an id or have none, of a hash of their text.  A range is
    walked in order and written group by group, so a task holds ``GROUP`` identifiers, or one document's.  The files are Parquet, a
    row for each group: documents, lengths, frequency table, checkpoints, checksums and the coder's words.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), utf8(text).alias("text"))
    order = F.asc_nulls_first("doc_id"), F.xxhash64("text"), F.col("text")
    ranged = rows.repartitionByRange(shuffle_tasks(docs.sparkSession), *order[:2]).sortWithinPartitions(*order)
    ranged.mapInArrow(partial(_packed, path=vocabulary, end=end), SCHEMA).write.parquet(path)


def _documents(batches):
    for batch in slices(batches, 1):
        row = batch.to_pylist()[0]
        ids, out, at = unpack(row), [], 0
        for name, length in zip(row["doc_ids"], row["lengths"]):
            out.append((name, row["start"] + at, length, crc32(ids[at:at + length].tobytes())))
            at += length
        yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*out)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document in the files, decoded group by group.

    ``start`` counts the identifiers of all documents before: those of earlier files, then of earlier groups, then of the group.
    """
    files = spark.read.schema(SCHEMA).parquet(path)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select(F.col("part").alias("p"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    own = files.select("part", "seq", "n_tokens")
    inside = own.select("part", "seq", (F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")).alias("ahead"))
    starts = inside.join(parts, F.col("part") == F.col("p")).select(F.col("part").alias("p"), F.col("seq").alias("s"), (F.col("before") + F.col("ahead")).alias("start"))
    # one narrow row a group, written first: when its file is small, Spark broadcasts it and the words stay where they are
    starts = durable(starts, "token-starts")
    placed = files.join(starts, (F.col("part") == F.col("p")) & (F.col("seq") == F.col("s"))).drop("p", "s")
    return placed.mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, vocabulary: str, end: int = END, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the token files of ``docs`` to the shared folder and read every document back from them.

    Null and empty texts have the end identifier alone; null ids and repeated rows keep their rows; an empty table
    gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    path = claim(spark, "token-files")
    write_token_files(docs, vocabulary, path, end, doc_id, text)
    return read_token_files(spark, path)
