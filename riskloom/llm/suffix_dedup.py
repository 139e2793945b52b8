"""Repeated byte strings by a suffix sort whose comparisons are binary searches over prefix hashes.

Every window of ``length`` bytes is known by the smallest hash of its inner grams; equal windows have equal ones.  A run of windows
with the same smallest gram is a fragment.  Fragments whose gram is in one document alone hold no repeat; of all others the
suffixes meet by that gram, and those that share it are sorted together.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from riskloom.functions.durable import durable
from riskloom.llm.common import shuffle_tasks, utf8

LENGTH = 50             # bytes of a repeated string
GRAM = 24               # bytes of a gram
PIECE = 1 << 20         # bytes whose grams are hashed, or whose suffixes are sorted, at a time
TEXT = 8 << 20          # bytes of text that a task describes at a time
RUN = 256               # windows in a fragment at most
HOT = 1 << 11           # a gram in more different fragments than this, and than a sixteenth of a bucket, has its windows dealt out one by one,
MOST = 1 << 15          # and in any case one in more than this, so that what is sorted together stays small
HOT_GRAMS = 1 << 20     # as many grams are treated so at most: those in most fragments
LAST = np.iinfo(np.int64).max       # the place of rows without an id: after all others
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _pack(*arrays) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(arrays, protocol=5))


def _unpack(blob: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The whole numbers of all ranges, one range after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


def _groups(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    return np.nonzero(np.append(True, values[1:] != values[:-1]))[0] if len(values) else np.zeros(0, dtype=np.int64)


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = x * _MIX[1]
    x ^= x >> np.uint64(31)
    x *= _MIX[2]
    x ^= x >> np.uint64(29)
    return x


def _smallest_grams(buffer: np.ndarray, length: int, gram: int) -> np.ndarray:
    """For every window of ``length`` bytes the smallest hash of its grams."""
    count = len(buffer) - gram + 1
    padded = np.concatenate([buffer, np.zeros(8, dtype=np.uint8)])
    words = np.ndarray((len(buffer),), np.uint64, padded, strides=(1,)) * _MIX[0]
    hashes = words[:count].copy()
    for at in [*range(8, gram - 7, 8), *([gram - 8] if gram % 8 else [])]:
        hashes ^= hashes >> np.uint64(29)
        hashes += words[at:at + count]
        hashes *= _MIX[1]
    hashes ^= hashes >> np.uint64(32)
    width, span = length - gram + 1, 1
    while 2 * span <= width:
        hashes = np.minimum(hashes[:-span], hashes[span:])
        span *= 2
    return np.minimum(hashes[:len(hashes) - (width - span)], hashes[width - span:]) if span < width else hashes


def _pieces(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Spans ``(document, first window, first byte, bytes)`` of about ``PIECE`` bytes; a long document has several."""
    made: list[tuple[int, int, int, int]] = []
    size = 0
    for doc in np.nonzero(np.diff(offsets) >= length)[0].tolist():
        windows = int(offsets[doc + 1] - offsets[doc]) - length + 1
        for first in range(0, windows, PIECE):
            made.append((doc, first, int(offsets[doc]) + first, min(PIECE, windows - first) + length - 1))
            size += made[-1][3]
            if size >= PIECE:
                yield tuple(np.array(made, dtype=np.int64).T)
                made, size = [], 0
    if made:
        yield tuple(np.array(made, dtype=np.int64).T)


def fragments(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """``(key, text, first window, windows, ends)`` of all fragments; every window of every text is in one.  ``ends`` hashes a fragment's first and last bytes."""
    out = []
    for doc, window, byte, size in _pieces(data, offsets, length):
        buffer = data[_spread(byte, size)] if len(byte) > 1 else data[byte[0]:byte[0] + size[0]]
        least = _smallest_grams(buffer, length, gram)
        ends = np.cumsum(size)
        first, last = ends - size, ends - length + 1           # windows last .. ends would cross into the next span
        cut = np.zeros(len(least) + 1, dtype=bool)
        cut[1:-1] = least[1:] != least[:-1]
        cut[first] = True
        cut[last] = True
        starts = np.nonzero(cut[:-1])[0]
        counts = np.diff(np.append(starts, len(least)))
        span = np.searchsorted(first, starts, side="right") - 1
        inside = starts < last[span]
        starts, counts, span = starts[inside], counts[inside], span[inside]
        cuts = -(-counts // RUN)
        part = np.repeat(np.arange(len(starts)), cuts)
        skipped = RUN * _spread(np.zeros(len(cuts), dtype=np.int64), cuts)
        begin, count = starts[part] + skipped, np.minimum(RUN, counts[part] - skipped)
        words = np.ndarray((len(buffer) - 7,), np.uint64, buffer, strides=(1,))
        sides = _scrambled(words[begin] + _scrambled(words[begin + count + length - 9] + count.astype(np.uint64)))
        out.append((_scrambled(least[begin]), doc[span][part], window[span][part] + begin - first[span][part], count, sides))
    if not out:
        return np.zeros(0, dtype=np.uint64), *[np.zeros(0, dtype=np.int64)] * 3, np.zeros(0, dtype=np.uint64)
    return tuple(map(np.concatenate, zip(*out)))


def _low(key: np.ndarray) -> np.ndarray:
    """What is shipped of a key; its bucket holds the rest."""
    return (key >> np.uint64(32)).astype(np.uint32)


def _by(groups: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple]:
    """The arrays' rows of every group."""
    order = np.argsort(groups, kind="stable")
    groups, arrays = groups[order], [a[order] for a in arrays]
    starts = _groups(groups)
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(groups)]):
        yield int(groups[s]), *[a[s:e] for a in arrays]


def _rows(rows: list[tuple[int, bytes]], name: str) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=[name, "blob"])


def _texts(batches) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, pa.RecordBatch]]:
    """The different texts of each batch, in parts of about ``TEXT`` bytes: texts, hash, number of the text for each row, and the rows."""
    for batch in batches:
        ends = np.cumsum(np.asarray(pc.binary_length(batch.column("text")), dtype=np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + TEXT, side="right")))
            part = batch.slice(start, stop - start)
            seen: dict[bytes, int] = {}
            number = np.array([seen.setdefault(t, len(seen)) for t in part.column("text").to_pylist()], dtype=np.int64)
            node = np.zeros(len(seen), dtype=np.int64)
            node[number] = np.asarray(part.column("node"))
            yield list(seen), node, number, part
            start = stop


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), dtype=np.uint8), np.append(0, np.cumsum([len(t) for t in texts], dtype=np.int64))


def _gram_rows(batches, buckets, length, gram):
    """Which texts hold which smallest grams: of each gram the first text, and in how many fragments it is, about.

    Texts whose gram another text of the same part holds are known to share it at once: these go along without a count.
    """
    for texts, node, _, _ in _texts(batches):
        key, doc, _, _, ends = fragments(*_joined(texts), length, gram)
        order = np.lexsort((ends, key))
        starts = _groups(key[order])
        other = np.append(True, ends[order][1:] != ends[order][:-1]) if len(key) else np.zeros(0, dtype=bool)
        other[starts] = True
        different = np.add.reduceat(other, starts, dtype=np.int64) if len(starts) else starts
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        starts = _groups(key)
        own = np.append(True, doc[1:] != doc[:-1]) if len(key) else np.zeros(0, dtype=bool)
        own[starts] = True
        key, doc = key[own], doc[own]
        starts = _groups(key)
        holders = np.diff(np.append(starts, len(key)))
        different = np.where(holders > 1, np.maximum(different, 2), 1).astype(np.uint32)        # 1: the text does not know yet whether others have it
        rows = []
        known = np.repeat(holders > 1, holders)
        if known.any():
            rows.append((int(key[starts[0]] % np.uint64(buckets)), _pack(node[doc[known]], _low(key[known]), None)))
        for bucket, first, keys, count in _by((key[starts] % np.uint64(buckets)).astype(np.int64), doc[starts], key[starts], different):
            by = np.argsort(first, kind="stable")
            rows.append((bucket, _pack(node[first[by]], _low(keys[by]), count[by])))
        yield _rows(rows, "bucket")


def _shared(table: pa.Table, bins: int, hot: int) -> pa.Table:
    """The shared grams of the texts that were not known to share them, and the grams of very many fragments."""
    bucket = table.column("bucket")[0].as_py()
    nodes, keys, counts, out = [], [], [], []
    for blob in table.column("blob").to_pylist():
        node, key, count = _unpack(blob)
        if count is None:
            out.append((node, key))
        else:
            nodes.append(node), keys.append(key), counts.append(count)
    rows = []
    if nodes:
        node, key, count = map(np.concatenate, (nodes, keys, counts))
        order = np.argsort(key, kind="stable")
        node, key, count = node[order], key[order], count[order]
        starts = _groups(key)
        size = np.diff(np.append(starts, len(key)))
        fragments_ = np.add.reduceat(count.astype(np.int64), starts)
        told = np.repeat(size > 1, size) & (count == 1)
        out.append((node[told], key[told]))
        most = fragments_ > hot
        if most.any():
            rows.append((-1, _pack((key[starts[most]].astype(np.int64) << 32) | bucket, fragments_[most]), 0))
    node, key = map(np.concatenate, zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.uint32))
    rows += [(b, _pack(*own), len(own[0])) for b, *own in _by(node % bins, node, key)]
    return pa.table({"bin": pa.array([r[0] for r in rows], pa.int32()), "blob": pa.array([r[1] for r in rows], pa.binary()), "grams": pa.array([r[2] for r in rows], pa.int64())})


def _hot_rows(batches):
    for batch in batches:
        for blob in batch.column("blob").to_pylist():
            name, size = _unpack(blob)
            yield pa.record_batch([pa.array(name), pa.array(size)], names=["name", "size"])


def _packed(batches, bins):
    """Different texts in compressed blobs by bin, each with the first place that has it and the rows of that place, with and without an id."""
    for texts, node, number, part in _texts(batches):
        place, nameless = np.asarray(part.column("place")), np.asarray(part.column("nameless"))
        least = np.full(len(texts), LAST, dtype=np.int64)
        np.minimum.at(least, number, place)
        first = place == least[number]
        named, unnamed = (np.bincount(number[first & (nameless == k)], minlength=len(texts)) for k in (0, 1))
        second, size = np.zeros(len(texts), dtype=np.int64), np.array([len(t) for t in texts], dtype=np.int64)
        second[number] = np.asarray(part.column("other"))
        yield _rows([(b, _pack(*own, size[at], b"".join(texts[k] for k in at.tolist())))
                     for b, at, *own in _by(node % bins, np.arange(len(texts)), node, second, least, named, unnamed)], "bin")


class _Bin:
    """The different texts of a bin, in the order of their hashes, so that a text's number is the same whenever the bin is made."""

    def __init__(self, table: pa.Table):
        parts = [_unpack(b) for b in table.column("blob").to_pylist()]
        none = [np.zeros(0, dtype=np.int64)]
        node, other, place, named, unnamed, size = (np.concatenate([p[k] for p in parts] or none) for k in range(6))
        order = np.lexsort((place, other, node))
        node, other, place, named, unnamed = (x[order] for x in (node, other, place, named, unnamed))
        starts = np.nonzero(np.append(True, (node[1:] != node[:-1]) | (other[1:] != other[:-1])))[0] if len(node) else none[0]
        self.node, self.place = node[starts], place[starts]
        first = place == np.repeat(self.place, np.diff(np.append(starts, len(node))))
        self.named, self.unnamed = (np.add.reduceat(np.where(first, x, 0), starts) if len(starts) else x for x in (named, unnamed))
        data = b"".join(p[6] for p in parts)
        ends = np.cumsum(size)
        at = order[starts]
        self.data = b"".join([data[b:e] for b, e in zip((ends[at] - size[at]).tolist(), ends[at].tolist())])
        self.offsets = np.append(0, np.cumsum(size[at]))


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint32) if not len(x) or x.max() < 1 << 32 else x


def _spans(doc: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows that follow each other in a text as one."""
    order = np.lexsort((start, doc))
    doc, start, count = doc[order], start[order], count[order].astype(np.int64)
    new = np.append(True, (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + count[:-1]))[:len(doc)]
    at = np.nonzero(new)[0]
    return _narrow(doc[at]), _narrow(start[at]), _narrow(np.add.reduceat(count, at) if len(at) else count)


def _fragment_rows(left: pa.Table, right: pa.Table, buckets: int, length: int, gram: int, hot: np.ndarray) -> pa.Table:
    """The fragments of one bin's texts that other texts may share: distinct ones, with the texts that are first to hold them.

    A text after the first that holds the same fragment loses all of it.
    """
    docs, cands = _Bin(left), [_unpack(b) for b in right.column("blob").to_pylist()]
    if not cands or not len(docs.node):
        return pa.Table.from_batches([_rows([], "bucket")])
    number = left.column("bin")[0].as_py()
    key, doc, start, count, _ = fragments(np.frombuffer(docs.data, dtype=np.uint8), docs.offsets, length, gram)
    node, low = map(np.concatenate, zip(*cands))
    # texts with the same first hash, of which there is hardly a pair, all take its grams
    first, last = np.searchsorted(docs.node, node), np.searchsorted(docs.node, node, side="right")
    wanted = np.unique((_spread(first, last - first).astype(np.uint64) << np.uint64(32)) | np.repeat(low, last - first).astype(np.uint64))
    own = (doc.astype(np.uint64) << np.uint64(32)) | _low(key)
    shared = np.isin(own, wanted)
    key, doc, start, count = key[shared], doc[shared], start[shared], count[shared]
    dealt = np.isin((_low(key).astype(np.int64) << 32) | (key % np.uint64(buckets)).astype(np.int64), hot)
    if dealt.any():
        each = np.where(dealt, count, 1)
        part = np.repeat(np.arange(len(key)), each)
        start = start[part] + np.where(dealt[part], _spread(np.zeros(len(each), dtype=np.int64), each), 0)
        key, doc, count, dealt = key[part], doc[part], np.where(dealt[part], 1, count[part]), dealt[part]
    begin = docs.offsets[doc] + start
    seen: dict[bytes, int] = {}
    uid = np.array([seen.setdefault(docs.data[b:e], len(seen)) for b, e in zip(begin.tolist(), (begin + count + length - 1).tolist())], dtype=np.int64)
    strings = list(seen)
    one = np.zeros(len(strings), dtype=np.int64)
    one[uid] = np.arange(len(uid))
    keys, alone = key[one], dealt[one]
    keys[alone] = np.array([xxh64_intdigest(strings[k]) for k in np.nonzero(alone)[0].tolist()], dtype=np.uint64)
    place = docs.place[doc]
    least = np.full(len(strings), LAST, dtype=np.int64)
    np.minimum.at(least, uid, place)
    gone = place > least[uid]
    rows = [(number % buckets, _pack("gone", number, *_spans(doc[gone], start[gone], count[gone])))] if gone.any() else []
    heirs = np.nonzero(~gone)[0][np.argsort(uid[~gone], kind="stable")]
    held = np.bincount(uid[heirs], minlength=len(strings))
    first = np.cumsum(held) - held
    for bucket, ids in _by((keys % np.uint64(buckets)).astype(np.int64), np.arange(len(strings))):
        own = heirs[_spread(first[ids], held[ids])]
        rows.append((bucket, _pack("strings", number, _low(keys[ids]), b"".join([strings[k] for k in ids.tolist()]), count[one[ids]].astype(np.uint16), least[ids],
                                   held[ids].astype(np.uint32), _narrow(doc[own]), _narrow(start[own]))))
    return pa.Table.from_batches([_rows(rows, "bucket")])


class Suffixes:
    """Suffixes of a buffer, compared over ``length`` bytes by prefix polynomial hashes modulo 2 ** 64."""

    def __init__(self, buffer: np.ndarray, length: int, base: int):
        self.length, self.base = length, np.uint64(base)
        self.padded = np.concatenate([buffer, np.zeros(8, dtype=np.uint8)])
        self.buffer = buffer
        inverse = np.uint64(pow(base, -1, 1 << 64))
        powers = np.multiply.accumulate(np.append(np.uint64(1), np.full(len(buffer), self.base)))
        self.inverse = np.multiply.accumulate(np.append(np.uint64(1), np.full(len(buffer), inverse)))
        self.prefix = np.append(np.uint64(0), np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * powers[:-1]))

    def heads(self, at: np.ndarray, offset: int = 0) -> np.ndarray:
        """Eight bytes as a number that sorts like them."""
        return np.ndarray((len(self.buffer),), np.uint64, self.padded, strides=(1,))[at + offset].byteswap()

    def order(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 for each pair: the common extension by binary search over hashes, then the byte after it."""
        hash_a, hash_b, turn_a, turn_b = self.prefix[a], self.prefix[b], self.inverse[a], self.inverse[b]

        def alike(size):
            return (self.prefix[a + size] - hash_a) * turn_a == (self.prefix[b + size] - hash_b) * turn_b

        known, over = np.zeros(len(a), dtype=np.int64), np.full(len(a), self.length + 1)
        while len(a) and (over - known).max() > 1:
            middle = np.where(over - known > 1, (known + over) >> 1, known)
            same = alike(middle)
            known, over = np.where(same, middle, known), np.where(same, over, middle)
        whole = known >= self.length
        at = np.where(whole, 0, known)
        x, y = self.buffer[a + at].astype(np.int16), self.buffer[b + at].astype(np.int16)
        return np.where(whole, 0, np.sign(x - y))

    def merged(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Positions sorted within their groups (which are runs) by merging runs of twice the length again and again.

        A suffix finds its place in the neighbouring run by binary search, all suffixes at once.
        """
        at, starts = at.copy(), _groups(group)
        sizes = np.diff(np.append(starts, len(at)))
        run = 1
        while len(sizes) and run < sizes.max():
            open_ = sizes > run
            members = _spread(starts[open_], sizes[open_])
            base, size = np.repeat(starts[open_], sizes[open_]), np.repeat(sizes[open_], sizes[open_])
            place = members - base
            mine = place // run
            other = (mine ^ 1) * run
            low, high = np.minimum(other, size), np.minimum(other + run, size)
            begin, right = low.copy(), (mine & 1).astype(bool)
            while True:
                going = np.nonzero(low < high)[0]
                if not len(going):
                    break
                middle = (low[going] + high[going]) >> 1
                found = self.order(at[(base[going] + middle)], at[members[going]])
                before = (found < 0) | ((found == 0) & right[going])        # equal suffixes of the left run come first
                low[going] = np.where(before, middle + 1, low[going])
                high[going] = np.where(before, high[going], middle)
            moved = base + (mine & ~1) * run + (place - mine * run) + (low - begin)
            out = at.copy()
            out[moved] = at[members]
            at, run = out, 2 * run
        return at

    def sorted(self, at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The indexes of the suffixes in order within their groups, and which equals the one before it, byte for byte.

        Suffixes are told apart by eight bytes first; what is left alike is merged.
        """
        head = self.heads(at)
        order = np.lexsort((head, group))
        alike = np.cumsum(np.append(True, (group[order][1:] != group[order][:-1]) | (head[order][1:] != head[order][:-1]))) if len(at) else order
        # positions are distinct, so a sorted position tells which suffix it is
        made = self.merged(at[order], alike)
        back = np.argsort(at, kind="stable")
        order = back[np.searchsorted(at[back], made)]
        same = np.append(False, alike[1:] == alike[:-1])[:len(at)]
        a, b = made[:-1], made[1:]
        equal, rising = np.ones(max(0, len(at) - 1), dtype=bool), np.zeros(max(0, len(at) - 1), dtype=bool)
        for offset in [*range(0, self.length - 7, 8), *([self.length - 8] if self.length % 8 else [])]:
            x, y = self.heads(a, offset), self.heads(b, offset)
            rising |= equal & (x < y)
            equal &= x == y
        if (same[1:] & ~(rising | equal)).any():
            raise Collision
        hashed = self.order(a[same[1:]], b[same[1:]]) == 0
        if (hashed & ~equal[same[1:]]).any():
            raise Collision
        same[1:] &= equal
        return order, same


class Collision(Exception):
    """Two different strings have the same hash."""


def repeats(data: np.ndarray, sizes: np.ndarray, group: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """``(string, window)`` of all windows that a string of the same group with a smaller place also holds."""
    counts = sizes - length + 1
    at = _spread(np.cumsum(sizes) - sizes, counts)
    owner = np.repeat(np.arange(len(sizes)), counts)
    for base in BASES:
        try:
            order, same = Suffixes(data, length, base).sorted(at, group[owner])
            break
        except Collision:
            continue
    else:
        raise RuntimeError("hashes collide for every base")
    own = owner[order]
    starts = np.nonzero(~same)[0]
    least = np.repeat(np.minimum.reduceat(place[own], starts), np.diff(np.append(starts, len(own)))) if len(own) else own
    gone = order[least < place[own]]
    string = owner[gone]
    return string, at[gone] - (np.cumsum(sizes) - sizes)[string]


def _gone_rows(table: pa.Table, length: int) -> pa.Table:
    """The windows to remove from the texts that hold the strings of one bucket."""
    rows: list[tuple[int, bytes]] = []
    seen: dict[bytes, int] = {}
    parts: list[tuple[np.ndarray, ...]] = []
    for blob in table.column("blob").to_pylist():
        kind, number, *arrays = _unpack(blob)
        if kind == "gone":
            rows.append((number, _pack(*arrays)))
            continue
        key, text, count, place, held, doc, start = arrays
        size = count.astype(np.int64) + length - 1
        ends = np.cumsum(size)
        uid = np.array([seen.setdefault(text[b:e], len(seen)) for b, e in zip((ends - size).tolist(), ends.tolist())], dtype=np.int64)
        parts.append((uid, key, place, held.astype(np.int64), doc.astype(np.int64), start.astype(np.int64), np.full(len(doc), number)))
    if parts:
        uid, key, place, held, doc, start, number = map(np.concatenate, zip(*parts))
        strings = list(seen)
        windows = np.array([len(s) for s in strings], dtype=np.int64) - length + 1
        least = np.full(len(strings), LAST, dtype=np.int64)
        np.minimum.at(least, uid, place)
        group = np.zeros(len(strings), dtype=np.uint32)
        group[uid] = key
        later = np.repeat(place > least[uid], held)
        uid = np.repeat(uid, held)
        out = [(number[later], doc[later], start[later], windows[uid[later]])]
        firsts = np.nonzero(~later)[0][np.argsort(uid[~later], kind="stable")]
        of = np.bincount(uid[firsts], minlength=len(strings))
        begin = np.cumsum(of) - of
        for string, window in _sorted_groups(strings, windows + length - 1, group, least, length):
            string, window, count = (x.astype(np.int64) for x in _spans(string, window, np.ones(len(window), dtype=np.int64)))
            own = firsts[_spread(begin[string], of[string])]
            part = np.repeat(np.arange(len(string)), of[string])
            out.append((number[own], doc[own], start[own] + window[part], count[part]))
        rows += [(b, _pack(*_spans(*own))) for b, *own in _by(*map(np.concatenate, zip(*out)))]
    return pa.Table.from_batches([_rows(rows, "bin")])


def _sorted_groups(strings: list[bytes], size: np.ndarray, group: np.ndarray, place: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``repeats`` of the groups of at least two strings, whole groups of about ``PIECE`` bytes at a time."""
    order = np.argsort(group, kind="stable")
    starts = _groups(group[order])
    counts = np.diff(np.append(starts, len(order)))
    total = np.add.reduceat(size[order], starts) if len(order) else counts
    todo = np.nonzero(counts > 1)[0]
    piece = np.cumsum(total[todo]) // PIECE
    for _, own in _by(piece, todo):
        ids = order[_spread(starts[own], counts[own])]
        data = np.frombuffer(b"".join(strings[k] for k in ids.tolist()), dtype=np.uint8)
        string, window = repeats(data, size[ids], np.repeat(np.arange(len(own)), counts[own]), place[ids], length)
        by = np.lexsort((window, string))
        yield ids[string[by]], window[by]


def _cut_rows(left: pa.Table, right: pa.Table, length: int) -> Iterator[pa.RecordBatch]:
    """Every text of a bin without the bytes that its windows cover, a slice of the bin at a time."""
    docs = _Bin(left)
    gone = [_unpack(b) for b in right.column("blob").to_pylist()]
    none = np.zeros(0, dtype=np.int64)
    doc, start, count = (x.astype(np.int64) for x in map(np.concatenate, zip(*gone))) if gone else (none,) * 3
    order = np.argsort(doc, kind="stable")
    doc, begin, size = doc[order], (docs.offsets[doc] + start)[order], count[order] + length - 1
    at = 0
    while at < len(docs.node):
        stop = max(at + 1, int(np.searchsorted(docs.offsets, docs.offsets[at] + PIECE, side="right")) - 1)
        base, offsets = docs.offsets[at], docs.offsets[at:stop + 1] - docs.offsets[at]
        own = slice(*np.searchsorted(doc, [at, stop]))
        delta = np.zeros(offsets[-1] + 1, dtype=np.int32)
        np.add.at(delta, begin[own] - base, 1)
        np.add.at(delta, begin[own] - base + size[own], -1)
        covered = np.cumsum(delta[:-1]) > 0
        edge = covered.copy()
        edge[1:] &= ~covered[:-1]
        heads = offsets[:-1][np.diff(offsets) > 0]
        edge[heads] = covered[heads]
        removed, spans = (np.diff(np.append(0, np.cumsum(x))[offsets]) for x in (covered, edge))
        kept = np.frombuffer(docs.data, dtype=np.uint8, count=offsets[-1], offset=base)[~covered].tobytes()
        left_ = np.diff(offsets) - removed
        ends = np.cumsum(left_)
        texts = [kept[b:e] for b, e in zip((ends - left_).tolist(), ends.tolist())]
        yield pa.record_batch([pa.array(x, pa.int64()) for x in (docs.place[at:stop], docs.named[at:stop], docs.unnamed[at:stop], np.diff(offsets), removed, spans)] + [pa.array(texts, pa.binary())],
                              names=["place", "named", "unnamed", "n_bytes", "n_removed", "n_spans", "kept"])
        at = stop


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept)`` for every row: its UTF-8 bytes without repeats.

    A byte goes when it is covered by ``length`` bytes that also start in a document with a smaller doc_id; all strings are
    judged on the input.  ``kept`` are the bytes that stay, which need not be UTF-8 any more.

    Null texts are empty; texts of fewer than ``length`` bytes lose nothing.  Rows with the same doc_id take nothing from each other.  Rows without doc_id
    follow all others (as the largest possible id would) and take nothing from each other.  Repeated rows have equal results;
    an empty table gives no rows; other columns are not read.

    Equal texts are one: the first keeps what no other text has, its copies lose everything by a join of hashes.  Different texts are
    read for their grams and shuffled once, compressed; Spark reuses that shuffle to cut fragments and to remove windows.  What meets in one
    task is a bin of different texts, or the distinct fragments of a bucket of grams: equal fragments of a bin are one, and a
    gram of very many fragments is dealt out by whole windows.
    """
    if not gram <= length or gram < 8:
        raise ValueError("a gram has 8 bytes at least and length bytes at most")
    spark = docs.sparkSession
    tasks = shuffle_tasks(spark)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), utf8(text).alias("text"))
    node, other = F.xxhash64("text").bitwiseAND(F.lit((1 << 63) - 1)), F.xxhash64(F.lit(1), "text")
    rows = rows.select("doc_id", node.alias("node"), other.alias("other"), F.coalesce("doc_id", F.lit(int(LAST))).alias("place"), "text")
    blob = "blob binary"
    grams = rows.select("node", "text").mapInArrow(partial(_gram_rows, buckets=tasks, length=length, gram=gram), f"bucket int, {blob}")
    shared = durable(grams.groupBy("bucket").applyInArrow(lambda t: _shared(t, tasks, hot), f"bin int, {blob}, grams long"), "shared-grams")
    most = min(max(hot, (shared.agg(F.sum("grams")).first()[0] or 0) // (16 * tasks)), max(hot, MOST))
    found = shared.filter("bin < 0").select("blob").mapInArrow(_hot_rows, "name long, size long").filter(F.col("size") > most)
    hot_grams = np.array([r["name"] for r in found.orderBy(F.desc("size"), "name").limit(HOT_GRAMS).select("name").collect()], dtype=np.int64)
    texts = rows.withColumn("nameless", F.col("doc_id").isNull().cast("int")).drop("doc_id").mapInArrow(partial(_packed, bins=tasks), f"bin int, {blob}")
    cut = texts.groupBy("bin").cogroup(shared.filter("bin >= 0").select("bin", "blob").groupBy("bin")).applyInArrow(
        lambda a, b: _fragment_rows(a, b, tasks, length, gram, hot_grams), f"bucket int, {blob}")
    gone = cut.groupBy("bucket").applyInArrow(lambda t: _gone_rows(t, length), f"bin int, {blob}")
    made = texts.groupBy("bin").cogroup(gone.groupBy("bin")).applyInArrow(
        lambda a, b: pa.Table.from_batches(_cut_rows(a, b, length), _CUT), "place long, named long, unnamed long, n_bytes long, n_removed long, n_spans long, kept binary")
    ids = F.when(F.col("k") < F.col("named"), F.col("place"))
    firsts = made.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("named") + F.col("unnamed") - 1))).select(ids.alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")
    # later copies, without their texts unless these are too short to lose anything
    size = F.octet_length("text").cast("long")
    copies = durable(rows.select("doc_id", "node", "other", "place", size.alias("n_bytes"), F.when(size < length, F.col("text")).otherwise(F.lit(b"")).alias("kept")), "text-keys")
    # stored, so that Spark may split the rows of a text with very many copies over several tasks of the join
    least = durable(copies.groupBy(F.col("node").alias("n"), F.col("other").alias("o")).agg(F.min("place").alias("least"), F.max("place").alias("most")).filter("least < most"), "copied-texts")
    all_ = F.when(F.col("n_bytes") >= length, F.col("n_bytes")).otherwise(F.lit(0))
    later = copies.join(least, (F.col("node") == F.col("n")) & (F.col("other") == F.col("o"))).filter("place > least") \
        .select("doc_id", "n_bytes", all_.cast("long").alias("n_removed"), (all_ > 0).cast("long").alias("n_spans"), "kept")
    return firsts.unionByName(later)


_CUT = pa.schema([(n, pa.int64()) for n in ("place", "named", "unnamed", "n_bytes", "n_removed", "n_spans")] + [("kept", pa.binary())])
