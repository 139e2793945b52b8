"""Top rows and exact positions per group, without sorting a whole group in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.durable import durable

ROWS_PER_BUCKET = 2048


def salts(df: DataFrame) -> int:
    """Parts of a group: as many as shuffle tasks have a square, so that parts and their merger are alike in size."""
    return max(1, math.isqrt(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, position: str | None = None) -> DataFrame:
    """The first ``k`` rows of every group under a total order; without keys, of all rows.

    Rows are salted by the task that reads them, so a task passes on at most
    ``k`` rows of a group; a salted part gets the rows of its share of the tasks,
    and the final sort at most ``salts * k`` rows of a group however large it is.
    """
    rank = position or "_rank"
    salted = df.withColumn("_salt", F.spark_partition_id() % F.lit(salts(df)))
    first = Window.partitionBy(*keys, "_salt").orderBy(*order)
    final = Window.partitionBy(*keys).orderBy(*order)
    out = (
        salted.withColumn("_part_rank", F.row_number().over(first)).filter(F.col("_part_rank") <= k)
        .drop("_part_rank", "_salt")
        .withColumn(rank, F.row_number().over(final)).filter(F.col(rank) <= k)
    )
    return out if position else out.drop(rank)


def ranked_position(df: DataFrame, groups: list[str], order: list[Column], name: str, written: list[str] | None = None) -> DataFrame:
    """``df`` with the exact 1-based position of each row within its group, under a total order.

    Rows are dealt to range partitions by group and order, and sorted there; a row's number in its task
    plus the sizes of all tasks before is its place among all rows, and less the place of its group's first row its position.  No
    group is sorted in one task, however many rows it has: only task sizes, one row a task, are added up in one.
    The sorted rows are stored once, with their numbers.
    """
    task, number, before, first = "_task", "_number", "_before", "_first"
    keys = [F.col(g).asc_nulls_first() for g in groups]
    ordered = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    # a task's numbers count from its own multiple of 2 ** 33
    stored = durable(ordered.withColumn(number, F.monotonically_increasing_id()), "ranked", written)
    split = stored.withColumn(task, F.shiftright(number, 33)).withColumn(number, F.col(number).bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = split.groupBy(task).agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.select(task, (F.sum("_size").over(Window.orderBy(task)) - F.col("_size")).alias(before))
    placed = split.join(offsets, task).withColumn(number, F.col(number) + F.col(before))
    if not groups:
        return placed.withColumn(name, F.col(number) + 1).drop(task, number, before)
    tops = split.groupBy(*groups, task).agg(F.min(number).alias(number)).join(offsets, task) \
        .groupBy(*[F.col(g).alias(f"_of_{i}") for i, g in enumerate(groups)]).agg(F.min(F.col(number) + F.col(before)).alias(first))
    same = [F.col(g).eqNullSafe(F.col(f"_of_{i}")) for i, g in enumerate(groups)]
    return placed.join(tops, same).withColumn(name, F.col(number) - F.col(first) + 1).select(*df.columns, name)


def hashed_position(df: DataFrame, groups: list[str], key: Column, name: str, total: str) -> DataFrame:
    """Exact 1-based position of each row within its group, in md5 order of a unique key.

    Rows are bucketed by leading hash digits, as many as keep a bucket near
    ``ROWS_PER_BUCKET`` rows.  Only bucket sizes are summed up across a group;
    positions are counted inside a bucket, whose size is even because the hash
    is.  ``df`` is computed once and stored with its hash.  ``groups`` must be few,
    such as class labels.  Spark may broadcast either side of the join by its size.
    """
    hashed = durable(df.withColumn("_hash", F.md5(key.cast("string").cast("binary"))), "hashed")
    digits = max(1, math.ceil(math.log(max(1, hashed.count() / ROWS_PER_BUCKET), 16)))
    hashed = hashed.withColumn("_bucket", F.substring("_hash", 1, digits))
    sizes = hashed.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    ordered = Window.partitionBy(*groups).orderBy("_bucket")
    whole = Window.partitionBy(*groups)
    offsets = sizes.select(
        *groups, "_bucket",
        (F.sum("_size").over(ordered) - F.col("_size")).alias("_offset"),
        F.sum("_size").over(whole).alias(total),
    )
    inside = Window.partitionBy(*groups, "_bucket").orderBy("_hash")
    return (
        hashed.withColumn("_inside", F.row_number().over(inside))
        .join(offsets, [*groups, "_bucket"])
        .withColumn(name, (F.col("_inside") + F.col("_offset")).cast("bigint"))
        .drop("_hash", "_bucket", "_inside", "_offset")
    )
