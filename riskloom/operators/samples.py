"""Sets of labelled samples: union, deduplication, caps, splits, distribution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions import text
from riskloom.functions.durable import durable
from riskloom.functions.ranking import hashed_position, top_per_group

BITS = 1 << 15                  # rows under one bitmap, as Spark's bitmap functions have it
PIECE_BYTES = 64 << 20          # bitmaps that are broadcast at a time
SMALL_BYTES = 1 << 20           # bitmaps that are always worth it


def merge(*sources: DataFrame) -> DataFrame:
    """Union in order; ``source_rank`` records it so that earlier sources win later."""
    ranked = [s.withColumn("source_rank", F.lit(i)) for i, s in enumerate(sources)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)


def code_key(width: int | None = None) -> Column:
    """The text that identifies a sample: its stripped code, or the first ``width`` characters of it."""
    key = text.strip(F.col("code"))
    return key if width is None else F.substring(key, 1, width)


def _digest(key: Column) -> Column:
    return F.coalesce(F.sha2(key.cast("binary"), 256), F.lit(""))


def _first_of_each(rows: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """``order`` of the first row of every key: fixed-width values are combined before the shuffle, no text moves."""
    if not 1 <= len(order) <= 2:
        raise ValueError("order is one or two columns")
    keyed = rows.select(_digest(key).alias("_key"), *[F.col(c).cast("bigint").alias(c) for c in order])
    rank, number = order[0], order[-1]
    first = keyed.groupBy("_key", *order[:-1]).agg(F.min(number).alias(number))
    return first if len(order) == 1 else first.groupBy("_key").agg(F.min(rank).alias("_rank"), F.min_by(number, rank).alias(number)).withColumnRenamed("_rank", rank)


def _span(low: int, high: int) -> tuple[int, int]:
    """The smallest and largest number in the bitmap buckets from ``low`` to ``high``."""
    return ((low - 1) * BITS + 1 if low > 0 else low * BITS - BITS + 1), high * BITS


def rows_at(rows: DataFrame, wanted: DataFrame, order: list[str]) -> DataFrame:
    """The rows whose ``order`` columns are in ``wanted``; these columns tell all rows apart.

    Wanted rows become bitmaps, one for each run of 32,768 row numbers, and every task tests the bits of the rows it
    reads: no text is shuffled.  Bitmaps are broadcast in pieces of at most about ``PIECE_BYTES``; a piece reads the files' row
    groups in its range of numbers only.  Where row numbers are so far apart that bitmaps would be larger than the
    numbers themselves, rows are joined by their numbers instead.
    """
    number, rank = order[-1], order[:-1]
    bucket = F.bitmap_bucket_number(number)
    # numbers are dealt to their buckets first, so that no task makes a bitmap that another one makes as well
    dealt = wanted.select(*order).repartition(*rank, bucket)
    bitmaps = durable(dealt.groupBy(*[F.col(c).alias(f"_of_{c}") for c in rank], bucket.alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("_bits"), F.count(F.lit(1)).alias("_rows")), "row-bitmaps")
    found = bitmaps.agg(F.count(F.lit(1)).alias("bitmaps"), F.sum("_rows").alias("rows")).first()
    if found["bitmaps"] * BITS // 8 > max(SMALL_BYTES, 32 * (found["rows"] or 0)):
        return rows.join(wanted.select(*order), order, "left_semi")
    pieces = max(1, -(-found["bitmaps"] * BITS // 8 // PIECE_BYTES))
    shares = [(k + 1) / pieces for k in range(pieces - 1)]
    edges = bitmaps.agg(F.min("_bucket").alias("low"), F.max("_bucket").alias("high"), F.percentile_approx("_bucket", F.array(*map(F.lit, shares)), 100 * pieces).alias("cuts") if shares else F.lit(None).alias("cuts")).first()
    ends = sorted({*(edges["cuts"] or ()), edges["high"]}) if found["bitmaps"] else []
    place = F.bitmap_bit_position(number)
    octet = F.conv(F.hex(F.substring("_bits", F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    out, low = [], edges["low"]
    for high in ends:
        least, most = _span(low, high)
        piece = bitmaps.filter(F.col("_bucket").between(low, high)).drop("_rows")
        same = [F.col(c) == F.col(f"_of_{c}") for c in rank] + [bucket == F.col("_bucket")]
        out.append(rows.filter(F.col(number).between(least, most)).join(F.broadcast(piece), same)
                   .filter(F.getbit(octet, F.pmod(place, F.lit(8)).cast("int")) == 1).select(*rows.columns))
        low = high + 1
    return reduce(DataFrame.unionByName, out) if out else rows.filter("false")


def keep_first(samples: DataFrame, order: list[str], width: int | None = None, keep_empty: bool = False) -> DataFrame:
    """One row per key, the first by ``order``.

    ``order`` names one or two whole-number columns that tell all rows apart.
    Keys and order alone are aggregated, hashed and combined before the
    shuffle, so a sample with very many copies costs one row per task; the rows
    that won are then picked out where they are read (see ``rows_at``).
    """
    key = code_key(width)
    rows = samples if keep_empty else samples.filter(key != "")
    return rows_at(rows, _first_of_each(rows, key, order), order)


def drop_incomplete(samples: DataFrame) -> DataFrame:
    """Strip code and label; drop rows where either is empty."""
    return (
        samples.withColumn("code", text.strip(F.col("code"))).withColumn("label", text.strip(F.col("label")))
        .filter("code <> '' AND label <> ''")
    )


def augment(existing: DataFrame, extra: DataFrame, order: list[str], width: int | None = None) -> DataFrame:
    """Existing rows as they are, plus the extra rows whose key (the whole code, or a prefix on request) does not occur among them."""
    known = existing.select(_digest(code_key(width)).alias("_key")).distinct()
    new = _first_of_each(extra, code_key(width), order).join(known, "_key", "left_anti")
    return existing.unionByName(rows_at(extra, new, order))


def cap_per_source(samples: DataFrame, source: str, order: list[Column], cap: int) -> DataFrame:
    return top_per_group(samples, [source], order, cap)


def stratified_sample(samples: DataFrame, kind: str, key: Column, per_kind: int, seed: str = "") -> DataFrame:
    """At most ``per_kind`` rows of every kind, chosen by a seeded hash of a unique key."""
    drawn = F.md5(F.concat(F.lit(seed), key.cast("string")).cast("binary"))
    return (
        top_per_group(samples.withColumn("_drawn", drawn), [kind], [F.col("_drawn")], per_kind).drop("_drawn")
    )


def first_rows(samples: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows by a total order: every task keeps ``n``, salted parts merge these, and one task merges the parts."""
    return top_per_group(samples, [], order, n)


def stratified_split(samples: DataFrame, key: Column, label: str = "label", test_share: float = 0.2) -> DataFrame:
    """Add ``is_test``: exactly the same share of every label, at most ``test_share``."""
    placed = hashed_position(samples, [label], key, "_position", "_total")
    return placed.withColumn("is_test", F.col("_position") <= F.floor(F.col("_total") * test_share)) \
        .drop("_position", "_total")


def stratified_folds(samples: DataFrame, key: Column, label: str = "label", folds: int = 5) -> DataFrame:
    """Add ``fold``: labels are dealt evenly over the folds."""
    placed = hashed_position(samples, [label], key, "_position", "_total")
    return placed.withColumn("fold", ((F.col("_position") - 1) % folds).cast("int")).drop("_position", "_total")


def label_distribution(samples: DataFrame, label: str = "label") -> DataFrame:
    """Count and percentage per label; the total is summed over the few label rows only."""
    counts = samples.groupBy(label).agg(F.count(F.lit(1)).alias("samples"))
    total = F.sum("samples").over(Window.partitionBy(F.lit(0)))
    return counts.select(label, "samples", F.round(F.col("samples") * 100 / total, 1).alias("percent"))


def top_kinds(samples: DataFrame, kind: str, n: int = 10) -> DataFrame:
    counts = samples.groupBy(kind).agg(F.count(F.lit(1)).alias("samples"))
    return counts.orderBy(F.col("samples").desc(), kind).limit(n)


def class_count(samples: DataFrame, label: str = "label") -> DataFrame:
    return samples.agg(F.count_distinct(label).alias("classes"))
