"""Document fingerprints by consistent weighted sampling: equal samples estimate the generalised Jaccard similarity."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from riskloom.llm.common import shuffle_tasks, slices

SAMPLES = 128
TERMS = 1 << 16         # terms whose random numbers a Python worker remembers
FLUSH = 1 << 13         # weighted terms sampled at a time
BUCKETS = 8             # ranges of doc_id for each shuffle task
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))


def _gamma_quantiles() -> np.ndarray:
    """Gamma(2, 1) at 65,536 evenly spaced probabilities, by Newton steps on 1 - (1 + x) exp(-x)."""
    goal = (np.arange(1 << 16) + 0.5) / (1 << 16)
    x = np.sqrt(2 * goal) + 2 * goal ** 4
    for _ in range(100):
        x = np.clip(x - np.clip((1 - (1 + x) * np.exp(-x) - goal) / (x * np.exp(-x)), -0.5, 0.5), 1e-9, None)
    return x


_GAMMA = _gamma_quantiles().astype(np.float32)
_LOG_GAMMA = np.log(_gamma_quantiles()).astype(np.float32)


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = x * _MIX[0]
    x ^= x >> np.uint64(32)
    x *= _MIX[1]
    x ^= x >> np.uint64(29)
    return x


def _sortable(x: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the 32-bit floats, in the upper half of 64 bits."""
    raw = x.view(np.int32)
    flipped = (raw >> np.int32(31)).view(np.uint32)
    flipped |= np.uint32(0x80000000)
    flipped ^= raw.view(np.uint32)
    out = flipped.astype(np.uint64)
    out <<= np.uint64(32)
    return out


def _floats(keys: np.ndarray) -> np.ndarray:
    """The floats of ``_sortable`` keys."""
    high = (keys >> np.uint64(32)).astype(np.uint32)
    flip = ~(high.view(np.int32) >> np.int32(31)).view(np.uint32) | np.uint32(0x80000000)
    return (high ^ flip).view(np.float32)


class Sampler:
    """Signatures of texts as bags of words, a word's weight being its count; words are what stands between white space, as it is.

    For every word and sample: r and c from Gamma(2, 1) and b from the uniform distribution, all from the word's
    hash.  A weight w gives t = floor(ln w / r + b) and ln a = ln c - r (t - b) - r; the word with
    the smallest a is sampled, together with its t.
    """

    def __init__(self, samples: int = SAMPLES):
        self.samples = samples
        self.seeds = _scrambled(np.arange(1, samples + 1, dtype=np.uint64) * _MIX[2])
        self._empty()

    def _empty(self) -> None:
        self.rows: dict[bytes, int] = {}
        shape = (TERMS, self.samples)
        self.r, self.b, self.key = np.empty(shape, np.float32), np.empty(shape, np.float32), np.empty(shape, np.uint64)

    def _learn(self, words: list[bytes]) -> None:
        start = len(self.rows)
        for first in range(0, len(words), 1024):
            part = words[first:first + 1024]
            own = slice(start + first, start + first + len(part))
            term = np.array([xxh64_intdigest(w) for w in part], dtype=np.uint64)[:, None]
            digits = _scrambled(term ^ self.seeds).view(np.uint16).reshape(len(part), self.samples, 4)
            r, c = _GAMMA.take(digits[..., 0]), _LOG_GAMMA.take(digits[..., 1])
            b = digits[..., 2].astype(np.float32)
            b += np.float32(0.5)
            b *= np.float32(2 ** -16)
            self.r[own], self.b[own] = r, b
            b -= np.float32(1)
            b *= r
            b += c              # ln a for weight 1, where t is 0
            key = _sortable(b)
            key |= digits[..., 3]
            self.key[own] = key
        self.rows.update(zip(words, range(start, start + len(words))))

    def _least(self, words: list[bytes], counts: np.ndarray, starts: list[int]) -> np.ndarray:
        new = list(dict.fromkeys(w for w in words if w not in self.rows))
        if len(self.rows) + len(new) > TERMS:
            self.rows = {}
            new = list(dict.fromkeys(words))
        if new:
            self._learn(new)
        at = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
        keys = self.key[at]
        many = np.nonzero(counts > 1)[0]
        if len(many):
            own = at[many]
            r = self.r[own]
            t = np.floor(np.log(counts[many]).astype(np.float32)[:, None] / r + self.b[own])
            one = keys[many]
            a = _floats(one) - r * t
            keys[many] = _sortable(a) | ((one ^ (t.astype(np.uint64) * _MIX[2])) & np.uint64(0xFFFFFFFF))
        ends = [*starts[1:], len(words)]
        return np.stack([keys[s:e].min(axis=0) for s, e in zip(starts, ends)])

    def signatures(self, texts: list[str]) -> np.ndarray:
        """16 bits for each sample; all zero for a text without words."""
        best = np.full((len(texts), self.samples), np.iinfo(np.uint64).max, dtype=np.uint64)
        words: list[bytes] = []
        counts: list[int] = []
        starts: list[int] = []
        owners: list[int] = []

        def flush() -> None:
            if words:
                best[owners] = np.minimum(best[owners], self._least(words, np.array(counts), starts))
                for x in (words, counts, starts, owners):
                    x.clear()

        for k, text in enumerate(texts):
            bag = Counter(text.encode().split())
            terms, weights = list(bag), list(bag.values())
            for first in range(0, len(terms), FLUSH):
                starts.append(len(words))
                owners.append(k)
                words += terms[first:first + FLUSH]
                counts += weights[first:first + FLUSH]
                if len(words) >= FLUSH:
                    flush()
        flush()
        low = best.astype(np.uint32)
        out = (low ^ (low >> np.uint32(16))).astype(np.uint16)
        out[out == 0] = 1
        out[(best == np.iinfo(np.uint64).max).all(axis=1)] = 0
        return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.mean(a == b))


def edited(text: str, following: str) -> str:
    """The text with its last half (rounded down) replaced by the first as many characters of the following text."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _dealt(batches, tops):
    """Rows with the range they belong to; a range's first row (largest key) goes to the range before it as well.

    ``tops`` has, for rows with and without an id, the largest key of every range, ascending.
    """
    named, nameless = (np.array(t, dtype=np.int64) for t in tops)
    total = len(named) + len(nameless)
    for batch in slices(batches, 2048):
        key, missing = np.asarray(batch.column(0)), np.asarray(batch.column(1).cast(pa.int8())).astype(bool)
        place = np.where(missing, np.searchsorted(nameless, key), np.searchsorted(named, key)) if len(key) else np.zeros(0, dtype=np.int64)
        # ranges are numbered in the order of the chain: ids descending, then rows without one
        bucket = np.where(missing, len(named) + len(nameless) - 1 - place, len(named) - 1 - place)
        first = np.zeros(len(key), dtype=bool)
        for tops_, own in ((named, ~missing), (nameless, missing)):
            if own.any():
                first[own] = tops_[place[own]] == key[own]
        copies = np.concatenate([np.arange(len(key)), np.nonzero(first)[0]])
        rows = batch.take(pa.array(copies))
        buckets = np.concatenate([bucket, (bucket[first] - 1) % total])
        tail = np.concatenate([np.zeros(len(key), bool), np.ones(first.sum(), bool)])
        yield pa.record_batch([pa.array(buckets.astype(np.int32)), pa.array(tail), rows.column(0), rows.column(1), rows.column(2), rows.column(3)],
                              names=["bucket", "tail", "key", "missing", "doc_id", "text"])


def _chained(batches, samples):
    sampler = Sampler(samples)
    carried: tuple | None = None            # a row whose following one has not come yet
    for batch in slices(batches, 256):
        rows = list(zip(*(batch.column(c).to_pylist() for c in ("bucket", "tail", "doc_id", "text"))))
        rows = ([carried] if carried else []) + rows
        carried = rows[-1]
        pairs = [(a, b) for a, b in zip(rows, rows[1:]) if not a[1] and a[0] == b[0]]
        if not pairs:
            continue
        texts = [t for _, _, _, t in rows]
        made = dict(zip(dict.fromkeys(texts), sampler.signatures(list(dict.fromkeys(texts)))))
        changed = [edited(a[3], b[3]) for a, b in pairs]
        after = sampler.signatures(changed)
        out = []
        for (a, b), text, other in zip(pairs, changed, after):
            own = made[a[3]]
            out.append((a[2], len(a[3]), sha256(text.encode()).hexdigest(), own.astype(">u2").tobytes().hex(), other.astype(">u2").tobytes().hex(),
                        likeness(own, other), likeness(own, made[b[3]])))
        yield pa.record_batch([pa.array(x) for x in zip(*out)], schema=pa.schema([
            ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
            ("near_edited", pa.float64()), ("near_next", pa.float64())]))


def _range_tops(batches, cuts):
    for batch in batches:
        key = np.sort(np.asarray(batch.column(0)))
        ends = np.unique(np.searchsorted(key, cuts, side="right"))
        yield pa.record_batch([pa.array(np.searchsorted(cuts, key[ends[ends > 0] - 1]).astype(np.int32)), pa.array(key[ends[ends > 0] - 1])], names=["range", "key"])


def _tops(rows: DataFrame, count: int) -> list[int]:
    """The largest key of each of about ``count`` even ranges, ascending.

    The quantiles that cut the ranges are approximate; the largest keys, one for each range, are exact.
    """
    cuts = rows.agg(F.percentile_approx("key", F.array(*[F.lit((k + 1) / count) for k in range(count)]), 10 * count)).first()[0]
    if not cuts:
        return []
    edges = np.append(np.unique(np.array(cuts, dtype=np.int64)), np.iinfo(np.int64).max)
    found = rows.mapInArrow(partial(_range_tops, cuts=edges), "range int, key long").groupBy("range").agg(F.max("key").alias("key"))
    return sorted(r["key"] for r in found.collect())


def edit_prints(docs: DataFrame, samples: int = SAMPLES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text; see ``edited``.

    ``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``, one row for each row.
    The following text is that of the next row by descending doc_id; the first follows the last.

    Texts are shuffled once, by ranges of doc_id; the first row of a range also goes to the range before it, so each
    range can be walked alone.  Null texts are empty; an empty text has the fingerprint of zeros.  Rows without an id follow all
    others, ordered by a hash of their text; rows that share an id, by that hash too.  One row follows itself; an empty
    table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), body.alias("text"))
    rows = rows.select(F.coalesce("doc_id", F.xxhash64("text")).alias("key"), F.col("doc_id").isNull().alias("missing"), "doc_id", "text")
    tasks = shuffle_tasks(spark)
    tops = [_tops(rows.filter(F.col("missing") == m).select("key"), BUCKETS * tasks) for m in (False, True)]
    dealt = rows.mapInArrow(partial(_dealt, tops=tops), "bucket int, tail boolean, key long, missing boolean, doc_id long, text string")
    walked = dealt.repartition(tasks, "bucket").sortWithinPartitions("bucket", "tail", "missing", F.desc("key"), F.xxhash64("text"))
    return walked.mapInArrow(partial(_chained, samples=samples), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                             "edited_fingerprint string, near_edited double, near_next double")
