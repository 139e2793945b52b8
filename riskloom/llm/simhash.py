"""SimHash near-duplicates by exact tiled comparison of all fingerprints."""

from __future__ import annotations

from functools import partial
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from riskloom.functions.durable import durable
from riskloom.llm.common import as_long, fresh, slices, utf8
from riskloom.llm.components import components

SHINGLE = 3
RADIUS = 2
SEED = 42
#: A fingerprint's population count is taken in so many parts, from so many different fingerprints on.
PARTS = ((0, 4), (1 << 22, 8), (1 << 29, 16))
TILE = 2048             # fingerprints in a tile, as an average bound
STEP = 256              # rows of a tile compared at a time
CHUNK = 1 << 16         # shingles whose bits are counted at a time


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of a text: bit i is set when more than half of its shingles' hashes have it set.

    A-Z are lower-cased; words lie between ASCII white space; fewer words than
    a shingle make one shingle; no word gives 0.
    """
    words = text.lower().split()
    if not words:
        return 0
    count = max(1, len(words) - shingle + 1)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if count > 1 or len(words) == shingle else iter([b" ".join(words)])
    hashes = map(xxh64_intdigest, grams, repeat(SEED))
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, count, CHUNK):
        part = np.fromiter(hashes, dtype="<u8", count=min(CHUNK, count - start))
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def _fingerprints(batches, shingle):
    for batch in slices(batches):
        made = [fingerprint(t, shingle) for t in batch.column(1).to_pylist()]
        yield pa.record_batch([batch.column(0), as_long(np.array(made, dtype=np.uint64))], names=["doc_id", "print"])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, print)``: the fingerprint of every whole text, as a signed long."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), utf8(text).alias("text"))
    return rows.mapInArrow(partial(_fingerprints, shingle=shingle), "doc_id long, print long")


def hexadecimal(prints: Column) -> Column:
    return F.lpad(F.lower(F.hex(prints)), 16, "0")


def parts_for(count: int) -> int:
    """More parts for more fingerprints: a tile pair is compared more seldom, and each tile goes to more others."""
    return max(parts for least, parts in PARTS if count >= least)


def _steps(radius: int, parts: int) -> list[list[int]]:
    """Differences of part counts that lie within the radius, one of each opposite pair."""
    out: list[list[int]] = [[]]
    for _ in range(parts):
        out = [[*x, d] for x in out for d in range(-radius, radius + 1) if sum(map(abs, x)) + abs(d) <= radius]
    return [x for x in out if x >= [0] * parts]


def linked(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs within the radius between two tiles (or within one, when ``b`` is None)."""
    nodes = a if b is None else np.concatenate([a, b])
    offset = 0 if b is None else len(a)
    other = a if b is None else b
    label = np.arange(len(nodes))
    for start in range(0, len(a), STEP):
        near = np.bitwise_count(a[start:start + STEP, None] ^ other[None, :]) <= radius
        left, right = np.nonzero(near)
        left, right = left + start, right + offset
        while len(left):
            least = np.minimum(label[left], label[right])
            np.minimum.at(label, label[left], least)
            np.minimum.at(label, label[right], least)
            while not np.array_equal(label, jumped := label[label]):
                label = jumped
            open_ = label[left] != label[right]
            left, right = left[open_], right[open_]
    moved = np.nonzero(label != np.arange(len(nodes)))[0]
    return nodes[moved], nodes[label[moved]]


def _links(batches, radius):
    for batch in batches:
        for a, b in zip(batch.column(0), batch.column(1)):
            left = np.asarray(a.values, dtype=np.int64).view(np.uint64)
            right = np.asarray(b.values, dtype=np.int64).view(np.uint64) if b.is_valid else None
            u, v = linked(left, right, radius)
            if len(u):
                yield pa.record_batch([as_long(u), as_long(v)], names=["a", "b"])


def near_links(prints: DataFrame, radius: int = RADIUS, parts: int = 4) -> DataFrame:
    """Links ``(a, b)`` that join all distinct fingerprints within ``radius`` bits of each other.

    Fingerprints lie in tiles by the population counts of their ``parts``.  Two
    fingerprints within the radius have part counts whose differences add up to at most the radius, so
    only such tile pairs are compared, every pair of fingerprints in them exactly: the links are the same for any number of parts.
    A tile pair yields a spanning forest of its links (at most one link for each
    fingerprint), not all its pairs.  Tiles over ``TILE`` are cut by a hash.
    """
    part = [F.bit_count(F.shiftrightunsigned("print", 64 // parts * i).bitwiseAND(F.lit((1 << 64 // parts) - 1))) for i in range(parts)]
    keyed = prints.select("print", F.array(*part).alias("key"))
    sizes = keyed.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(TILE)).alias("cuts"))
    cut = keyed.join(sizes, "key").withColumn("cut", F.pmod(F.xxhash64("print"), F.col("cuts")))
    tiles = durable(cut.groupBy("key", "cut").agg(F.collect_list("print").alias("prints")), "tiles")
    steps = F.array(*[F.array(*map(F.lit, x)) for x in _steps(radius, parts)])
    near = tiles.select("key", "cut", "prints", F.explode(steps).alias("step")).select(
        F.zip_with("key", "step", lambda x, y: x + y).alias("near"), "cut", "prints", (F.col("step") == F.array(*[F.lit(0)] * parts)).alias("same"))
    near = near.join(tiles.select(F.col("key").alias("near"), F.col("cut").alias("cut_b"), F.col("prints").alias("prints_b")), "near")
    pairs = near.filter("NOT same OR cut <= cut_b").select(
        "prints", F.when(~(F.col("same") & (F.col("cut") == F.col("cut_b"))), F.col("prints_b")).alias("prints_b"))
    return pairs.mapInArrow(partial(_links, radius=radius), "a long, b long")


def _grouped(docs: DataFrame, shingle: int, radius: int, doc_id: str, text: str) -> DataFrame:
    """``(doc_id, print, root, component_id)``; the root names a group even when none of its rows has a doc_id."""
    made = durable(fingerprints(docs, shingle, doc_id, text), "prints")
    nodes = durable(made.groupBy("print").agg(F.min("doc_id").alias("first")), "nodes")
    roots = components(near_links(nodes.select("print"), radius, parts_for(nodes.count())))
    named = durable(nodes.join(roots, nodes["print"] == roots["node"], "left").select(
        "print", "first", F.coalesce("root", "print").alias("root")), "named")
    groups = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return made.join(durable(named.join(groups, "root").select("print", "root", "component_id"), "groups"), "print")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, print, component_id)`` for every row of ``docs``.

    Documents are linked when their fingerprints differ in at most ``radius`` bits;
    ``component_id`` is the smallest doc_id that a document reaches over links, itself included.

    Equal fingerprints are one node, so copies never meet in pairs.  Null and
    empty texts have fingerprint 0 and are linked like any other.  Rows without a doc_id
    are grouped too; a group without any doc_id has a null component_id.
    Repeated rows stay repeated; an empty table gives no rows; other columns are not read.
    """
    return _grouped(docs, shingle, radius, doc_id, text).select("doc_id", "print", "component_id")


def keep_first(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of every group, the row with the smallest doc_id.

    When several rows have that doc_id (or none has one), the one with the
    smallest fingerprint and then the smallest text stays, one of equal rows.  All columns are kept as they are.
    """
    found = durable(_grouped(docs, shingle, radius, doc_id, text), "found")
    is_first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    key, made, one, gone, least = fresh(docs, "doc_key", "doc_print", "doc_row", "doc_gone", "doc_least")
    # ids that do not name one row: these rows are told apart by their fingerprint and text
    tied = durable(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR doc_id IS NULL").select(F.col("doc_id").alias(gone)), "tied")
    others = durable(found.filter(~is_first).select(F.col("doc_id").alias(gone)).union(tied).distinct(), "gone")
    keyed = docs.withColumn(key, F.col(f"`{doc_id}`").cast("long"))
    plain = keyed.join(others, F.col(key).eqNullSafe(F.col(gone)), "left_anti").drop(key)
    if tied.isEmpty():
        return plain
    firsts = found.filter(is_first).groupBy("root").agg(F.first("doc_id").alias(gone), F.min("print").alias(least)).drop("root")
    rows = keyed.join(tied, F.col(key).eqNullSafe(F.col(gone)), "left_semi").withColumn(made, _one(shingle)(utf8(text)))
    rows = rows.join(firsts, F.col(key).eqNullSafe(F.col(gone)) & (F.col(made) == F.col(least)), "left_semi")
    picked = rows.groupBy(key, made).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.struct(f"`{text}`")).alias(one))
    return plain.unionByName(picked.select(f"{one}.*"))


def _one(shingle: int):
    @F.pandas_udf("long")
    def made(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))
    return made
