"""Line dedup by pairwise alignment: documents that share enough adjacent lines are aligned, and common blocks go from the later one."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest, xxh64_intdigest

from riskloom.functions.durable import durable
from riskloom.llm.common import SLICE, fresh, slices, utf8

RARE = 8                # a window in at most this many shapes is rare: all its pairs are aligned at once
CELL = 16               # holders of a frequent window that are tried together, about
CELLS = 4               # cells tried in the first round; each round goes up to GROWTH times as many
GROWTH = 16
MIN_WORDS = 5           # words of an aligned block that is deleted
SPACE = b" \t\n\r\x0b\x0c"


def filled_lines(text: bytes) -> list[tuple[int, bytes]]:
    """Line numbers and stripped lines of a text, without blank lines."""
    return [(n, s) for n, line in enumerate(text.split(b"\n")) if (s := line.strip(SPACE))]


def sequence(text: str) -> Column:
    """What texts with the same lines have in common, blank lines and outer white space aside: 16 bytes."""
    lines = F.transform(F.split(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(SPACE.decode())))
    return F.unhex(F.md5(F.concat_ws("\n", F.filter(lines, lambda x: x != "")).cast("binary")))


def anchors(a: list[int], b: list[int], alo: int, ahi: int, blo: int, bhi: int) -> list[tuple[int, int]]:
    """Places of the elements that occur once in either range: the longest chain that ascends in both."""
    once_a = {x for x, n in Counter(a[alo:ahi]).items() if n == 1}
    counts_b = Counter(b[blo:bhi])
    place = {b[j]: j for j in range(blo, bhi) if counts_b[b[j]] == 1}
    ends: list[int] = []                # last place in b of the best chain of each length
    tops: list[int] = []
    chain: list[tuple[int, int, int]] = []      # place in a, place in b, the chain's element before
    for i in range(alo, ahi):
        j = place.get(a[i]) if a[i] in once_a else None
        if j is None:
            continue
        k = bisect_left(ends, j)
        chain.append((i, j, tops[k - 1] if k else -1))
        if k == len(ends):
            ends.append(j)
            tops.append(len(chain) - 1)
        else:
            ends[k], tops[k] = j, len(chain) - 1
    out, at = [], tops[-1] if tops else -1
    while at >= 0:
        i, j, at = chain[at]
        out.append((i, j))
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Patience diff: equal elements of two sequences, ascending in both.

    Elements that only one sequence has are set aside first.  Equal ends of a range are matched, then the chain of
    elements that are unique in it; what lies between two of these is a range of its own.
    """
    common = set(a) & set(b)
    at_a = [i for i, x in enumerate(a) if x in common]
    at_b = [j for j, x in enumerate(b) if x in common]
    a, b = [a[i] for i in at_a], [b[j] for j in at_b]
    found: list[tuple[int, int]] = []
    ranges = [(0, len(a), 0, len(b))]
    while ranges:
        alo, ahi, blo, bhi = ranges.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            found.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            found.append((ahi, bhi))
        if alo < ahi and blo < bhi:
            chain = anchors(a, b, alo, ahi, blo, bhi)
            for i, j in chain:
                ranges.append((alo, i, blo, j))
                found.append((i, j))
                alo, blo = i + 1, j + 1
            if chain:
                ranges.append((alo, ahi, blo, bhi))
    return [(at_a[i], at_b[j]) for i, j in sorted(found)]


def common_blocks(earlier: list[tuple[int, int]], later: list[tuple[int, int, int]], min_words: int) -> list[int]:
    """Places in the later text of the lines in aligned blocks of at least ``min_words`` words.

    ``earlier`` has (place, line) and ``later`` (place, line, words), places counted over all lines that are not blank;
    a block is a run of matches that is without a gap in both texts.
    """
    out: list[int] = []
    block: list[int] = []
    words, before = 0, (-2, -2)
    for i, j in patience([x[1] for x in earlier], [x[1] for x in later]):
        here = (earlier[i][0], later[j][0])
        if here != (before[0] + 1, before[1] + 1):
            out += block if words >= min_words else []
            block, words = [], 0
        block.append(here[1])
        words += later[j][2]
        before = here
    return out + (block if words >= min_words else [])


def _lined(batches):
    for batch in slices(batches):
        out = []
        for name, seq, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
            lines = filled_lines(text)
            out.append((name, seq, np.array([xxh64_intdigest(x) for _, x in lines], dtype=np.uint64).view(np.int64), [len(x.split()) for _, x in lines]))
        columns = list(zip(*out)) or [(), (), (), ()]
        kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()))
        yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["doc_id", "seq", "hashes", "words"])


def windows(rows: list[tuple[int, int, int]], min_words: int) -> tuple[list[tuple[int, int, int]], list[int]]:
    """Windows ``(key, start, end)`` of a text's shared lines, and the places in runs of at least ``min_words`` words.

    ``rows`` has (place, line, words), ascending.  A window is a run of adjacent places that has ``min_words`` words and would
    not have them without its first, or without its last line.  A block that two texts share is covered by windows that they
    share, so texts without a common window have no block in common, and lines outside common windows can't go.
    """
    found: dict[tuple[int, int], None] = {}
    full: list[int] = []
    first = 0
    while first < len(rows):
        last = first
        while last + 1 < len(rows) and rows[last + 1][0] == rows[last][0] + 1:
            last += 1
        if sum(x[2] for x in rows[first:last + 1]) >= min_words:
            full += [x[0] for x in rows[first:last + 1]]
            words, end = 0, first
            for start in range(first, last + 1):
                while end <= last and (words < min_words or end == start):
                    words, end = words + rows[end][2], end + 1
                if words < min_words:
                    break
                found[start, end - 1] = None
                words -= rows[start][2]
            words, start = 0, first
            for end in range(first, last + 1):
                words += rows[end][2]
                while start < end and words - rows[start][2] >= min_words:
                    words, start = words - rows[start][2], start + 1
                if words >= min_words:
                    found[start, end] = None
        first = last + 1
    hashes = np.array([x[1] for x in rows], dtype=np.int64)
    keys = [rows[s][1] if s == e else int(np.uint64(xxh64_intdigest(hashes[s:e + 1].tobytes())).view(np.int64)) for s, e in found]
    return [(k, rows[s][0], rows[e][0]) for k, (s, e) in zip(keys, found)], full


def _shaped(batches, min_words):
    names = ["seq", "first", "shape", "full", "keys", "starts", "ends"]
    kinds = (pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()))
    for batch in slices(batches):
        out = []
        for seq, first, lines in zip(*(batch.column(c).to_pylist() for c in ("seq", "first", "lines"))):
            rows = sorted((x["at"], x["hash"], x["n"]) for x in lines)
            found, full = windows(rows, min_words)
            if found:
                at = np.array([x[0] for x in rows])
                shape = xxh3_128_digest(np.array([x[1] for x in rows], dtype=np.int64).tobytes() + (np.diff(at) == 1).tobytes())
                out.append((seq, first, shape, full, *(list(x) for x in zip(*found))))
        columns = list(zip(*out)) or [()] * len(kinds)
        yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)


def _aligned(batches, min_words):
    for batch in slices(batches):
        seqs, gone = [], []
        for seq, later, earlier in zip(*(batch.column(c).to_pylist() for c in ("seq", "later", "earlier"))):
            places = common_blocks(sorted((x["at"], x["hash"]) for x in earlier), sorted((x["at"], x["hash"], x["n"]) for x in later), min_words)
            if places:
                seqs.append(seq)
                gone.append(places)
        yield pa.record_batch([pa.array(seqs, pa.binary()), pa.array(gone, pa.list_(pa.int32()))], names=["seq", "gone"])


def _order(prefix: str = "") -> Column:
    """Texts are ordered by their smallest doc_id, those without one last, then by their lines' hash."""
    return F.struct(F.col(f"{prefix}first").isNull().alias("nameless"), F.col(f"{prefix}first").alias("first"), F.col(f"{prefix}seq").alias("seq"))


def candidate_pairs(held: DataFrame) -> DataFrame:
    """``(seq, earlier)``: texts to be aligned first, from the windows that several texts share.

    A rare window proposes every pair of its at most ``RARE`` texts.  A more frequent one pairs each of its texts with
    the earliest one that has it; what that leaves is for ``further_pairs``.
    """
    rare = held.filter(F.col("df") <= RARE).select("key", "seq", "first").distinct()
    other = rare.select("key", F.col("seq").alias("b_seq"), F.col("first").alias("b_first"))
    near = rare.join(other, "key").filter(_order("b_") < _order()).select("seq", F.col("b_seq").alias("earlier"))
    star = held.filter((F.col("df") > RARE) & (F.col("seq") != F.col("earliest"))).select("seq", F.col("earliest").alias("earlier"))
    return near.union(star).distinct()


def further_pairs(open_: DataFrame, held: DataFrame, low: int, high: int) -> DataFrame:
    """``(seq, earlier)``: texts with a window of ``open_`` and its earlier holders in the cells from ``low`` to before ``high``.

    The holders of a window are dealt to cells of about ``CELL`` by their hash, so no task meets all holders of a window.
    """
    wanted = open_.select("key", "seq", "first", F.explode(F.sequence(F.lit(low), F.least(F.lit(high), F.col("cells")) - 1)).alias("cell")).distinct()
    cell = F.pmod(F.xxhash64("seq"), F.col("cells")).cast("int")
    holders = held.filter(F.col("df") > RARE).select("key", F.col("seq").alias("b_seq"), F.col("first").alias("b_first"), cell.alias("cell")).distinct()
    return wanted.join(holders, ["key", "cell"]).filter(_order("b_") < _order()).select("seq", F.col("b_seq").alias("earlier")).distinct()


def still_open(held: DataFrame, gone: DataFrame, low: int) -> DataFrame:
    """Frequent windows with a line that is not gone, where holders in cells from ``low`` on have not been tried."""
    own = gone.groupBy("seq").agg(F.collect_set("at").alias("gone"))
    rows = held.filter((F.col("df") > RARE) & (F.col("seq") != F.col("earliest")) & (F.col("cells") > low))
    left = F.array_except(F.sequence("start", "end"), F.coalesce("gone", F.array().cast("array<int>")))
    return rows.join(own, "seq", "left").filter(F.size(left) > 0).drop("gone")


def overlaps(docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(seq, first, gone)``: for every different text its smallest doc_id and the places of the lines that an earlier text has.

    Texts with the same lines are one node here.  Only lines that several texts have are aligned, and every
    pair of texts travels on its own: no group of texts is gathered.

    What an alignment finds follows from the shared lines and from which of them are adjacent, the shape of a text.  A text with
    the shape of an earlier one loses all its runs of enough words; only the first text of each shape is aligned, with
    the first texts of others.  A frequent window is compared with more and more of its earlier holders, with all in the
    end, as long as one of its lines is left: the result is that of aligning every text with every earlier one.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), sequence(text).alias("seq"), utf8(text).alias("text"))
    lined = durable(rows.mapInArrow(_lined, "doc_id long, seq binary, hashes array<long>, words array<int>"), "lines")
    texts = durable(lined.groupBy("seq").agg(F.min("doc_id").alias("first"), F.any_value(F.struct("hashes", "words")).alias("l")).select("seq", "first", "l.*"), "texts")
    places = texts.select("seq", "first", F.posexplode(F.arrays_zip("hashes", "words")).alias("at", "line")).select("seq", "first", "at", F.col("line.hashes").alias("hash"), F.col("line.words").alias("n"))
    common = durable(places.select("hash", "seq").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("df")).filter("df > 1").select("hash"), "shared-lines")
    shared = places.join(common, "hash")
    parts = durable(shared.groupBy("seq").agg(F.any_value("first").alias("first"), F.collect_list(F.struct("at", "hash", "n")).alias("lines")), "shared-by-text")
    shaped = durable(parts.mapInArrow(partial(_shaped, min_words=min_words), "seq binary, first long, shape binary, full array<int>, keys array<long>, starts array<int>, ends array<int>"), "shapes")
    nodes = durable(shaped.groupBy("shape").agg(F.min(_order()).alias("top")).select("top.seq"), "nodes")
    each = shaped.join(nodes, "seq", "left_semi").select("seq", "first", F.explode(F.arrays_zip("keys", "starts", "ends")).alias("w")) \
        .select("seq", "first", F.col("w.keys").alias("key"), F.col("w.starts").alias("start"), F.col("w.ends").alias("end"))
    spread = each.select("key", "seq", "first").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("df"), F.min(_order()).alias("least")).filter("df > 1") \
        .select("key", "df", F.col("least.seq").alias("earliest"), F.ceil(F.col("df") / CELL).cast("int").alias("cells"))
    # stored, so that Spark may split the rows of a very frequent window over several tasks of the join
    held = durable(each.join(durable(spread, "window-counts"), "key"), "windows")

    def aligned(pairs: DataFrame) -> DataFrame:
        paired = pairs.join(parts.select(F.col("seq").alias("earlier"), F.col("lines").alias("earlier_lines")), "earlier") \
            .join(parts.select("seq", F.col("lines").alias("later_lines")), "seq").select("seq", F.col("later_lines").alias("later"), F.col("earlier_lines").alias("earlier"))
        found = paired.mapInArrow(partial(_aligned, min_words=min_words), "seq binary, gone array<int>")
        return durable(found.select("seq", F.explode("gone").alias("at")).distinct(), "gone")

    taken = aligned(candidate_pairs(held))
    left, low, high = held, 0, CELLS
    while True:
        left = durable(still_open(left, taken, low), "open")
        if left.isEmpty():
            break
        taken = taken.union(aligned(further_pairs(left, held, low, high)))
        low, high = high, high * GROWTH
    copies = shaped.join(nodes, "seq", "left_anti").select("seq", F.col("full").alias("gone"))
    gone = taken.groupBy("seq").agg(F.collect_set("at").alias("gone")).union(copies)
    return texts.select("seq", "first").join(gone, "seq", "left")


def _cut(text: bytes, gone: list[int] | None, copy: bool, min_words: int) -> tuple[bytes, int, int]:
    """The text without the given places (or, for a later copy, without all its lines), its lines and how many went."""
    lines = filled_lines(text)
    numbers = {lines[k][0] for k in (gone if gone is not None else ())}
    if copy and sum(len(x.split()) for _, x in lines) >= min_words:
        numbers = {n for n, _ in lines}
    every = text.split(b"\n")
    return b"\n".join(x for n, x in enumerate(every) if n not in numbers), len(every) if text else 0, len(numbers)


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``clean_text, n_lines, n_deleted`` (longer names where these exist).

    From every document go the blocks of lines that patience diff aligns with an earlier document, when a block has
    at least ``min_words`` words; earlier means a smaller doc_id.  Lines are compared without outer white space; blank lines are no
    part of a block and stay.  Of documents with the same lines all but the first lose them all.

    Null texts count as empty and stay null; empty ones lose nothing.  Rows without an id come after all others; rows that agree in id
    and lines are one document, neither is later.  Repeated lines inside one document stay.  An empty table gives no rows; other columns stay.
    """
    inner = fresh(docs, "seq", "first", "gone", "copy", "cut")
    seq, first, gone, copy, cut = inner

    @F.arrow_udf("text binary, n_lines int, n_deleted int")
    def cut_out(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kinds = (pa.binary(), pa.int32(), pa.int32())
        for batch in batches:
            parts = [[x.slice(k, SLICE).to_pylist() for x in batch] for k in range(0, len(batch[0]), SLICE)]
            rows = zip(*(_cut(*row, min_words) for part in parts for row in zip(*part)))
            yield pa.StructArray.from_arrays([pa.array(list(c), k) for c, k in zip(list(rows) or [()] * 3, kinds)], ["text", "n_lines", "n_deleted"])

    found = durable(overlaps(docs, min_words, doc_id, text), "overlaps").select(F.col("seq").alias(seq + "_of"), F.col("first").alias(first), F.col("gone").alias(gone))
    keyed = docs.withColumn(seq, sequence(text))
    joined = keyed.join(found, F.col(seq) == F.col(seq + "_of")).withColumn(copy, ~F.col(f"`{doc_id}`").cast("long").eqNullSafe(F.col(first)))
    made = joined.withColumn(cut, cut_out(utf8(text), F.col(gone), F.col(copy)))
    names = fresh(docs, "clean_text", "n_lines", "n_deleted")
    return made.select(*[F.col(f"`{c}`") for c in docs.columns], F.when(F.col(f"`{text}`").isNotNull(), F.col(cut)["text"].cast("string")).alias(names[0]),
                       F.col(cut)["n_lines"].alias(names[1]), F.col(cut)["n_deleted"].alias(names[2]))
