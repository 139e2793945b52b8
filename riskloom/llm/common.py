"""Small helpers that the operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.durable import claim

#: What counts as white space between words: space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that a Python task holds at a time.
SLICE = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words; null counts as no text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def utf8(text: str = "text") -> Column:
    """A text column as UTF-8 bytes, null as no bytes."""
    return F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until none is a column of ``df`` (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``rows`` rows, so that a task's memory does not follow Spark's batch size."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def shuffle_tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def as_long(values: np.ndarray) -> pa.Array:
    """Unsigned 64-bit values as the long column with the same bits."""
    return pa.array(np.ascontiguousarray(values, dtype=np.uint64).view(np.int64))


def bucketed(df: DataFrame, key: str, name: str, written: list[str]) -> tuple[DataFrame, str]:
    """``df`` as a stored table with a bucket for each shuffle task, so that joins by ``key`` move the other side only, and the table's name.

    The files lie in the shared checkpoint folder, their path is added to ``written``.
    """
    spark, tasks = df.sparkSession, shuffle_tasks(df.sparkSession)
    path = claim(spark, name, written)
    table = f"{name}_{uuid.uuid4().hex}"
    df.repartition(tasks, key).write.bucketBy(tasks, key).option("path", path).format("parquet").saveAsTable(table)
    return spark.table(table), table
