"""Records of quoted CSV files that are read in many ranges, although a value may hold line breaks.

A line alone does not tell whether it starts inside a quoted value.  Every range of lines is a function of two states (inside
quotes, or not) to two states, given by the parity of its quotes.  The functions of a file, combined in order, give each range the state in
which it starts; then all ranges are cut into records side by side, and a record over a border is put together from its pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.functions.durable import durable

CHUNK = 4 << 20             # bytes of lines in a stored chunk, about
HEAD = 1 << 20              # a header is shorter
TASKS = 4                   # tasks a core that read small ranges
TASK_BYTES = 128 << 20      # and the bytes of ranges that one of them reads at most, about
CHUNKS = "file long, block long, chunk int, odd int, closes boolean, head binary, data binary"


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Lines as chunks: the parity of their quotes, and whether an open quote at the start would be closed at the end of a line."""
    at: tuple[int, int] | None = None
    number, lines, length, parity, closes, head = 0, [], 0, 0, False, None

    def made():
        top = head[:HEAD] if head is not None and at[1] == 0 and number == 0 else None
        return pa.RecordBatch.from_pylist([{"file": at[0], "block": at[1], "chunk": number, "odd": parity, "closes": closes, "head": top, "data": b"\n".join(lines)}], schema=_SCHEMA)

    for batch in batches:
        file, block = np.asarray(batch.column("file")), np.asarray(batch.column("block"))
        odd = (np.asarray(pc.count_substring(batch.column("value"), pattern='"')) & 1).tolist()
        for f, b, o, line in zip(file.tolist(), block.tolist(), odd, batch.column("value").to_pylist()):
            if at != (f, b) or length >= size:
                if at is not None:
                    yield made()
                number = number + 1 if at == (f, b) else 0
                at, lines, length, parity, closes, head = (f, b), [], 0, 0, False, None
            lines.append(line)
            length += len(line) + 1
            parity ^= o
            closes = closes or parity == 1
            if head is None and parity == 0 and number == 0 and b == 0:
                head = b"\n".join(lines)
    if at is not None:
        yield made()


_SCHEMA = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("chunk", pa.int32()), ("odd", pa.int32()), ("closes", pa.bool_()), ("head", pa.binary()), ("data", pa.binary())])


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of each chunk: whole ones, the header, the end of one that started before, the start of one that ends later."""
    for batch in batches:
        for row in range(batch.num_rows):
            file, inside, first, data = (batch.column(c)[row].as_py() for c in ("file", "inside", "first", "data"))
            lines = data.split(b"\n")
            parity = np.array([x.count(b'"') & 1 for x in lines]) if b'"' in data else np.zeros(len(lines), dtype=np.int64)
            after = (np.cumsum(parity) + inside) & 1
            before = np.append(inside, after[:-1])
            starts = np.nonzero(before == 0)[0]
            kinds, records = [], []
            lead = int(starts[0]) if len(starts) else len(lines)
            if lead:
                kinds, records = [LATER], [b"\n".join(lines[:lead])]
            ends = [*starts[1:].tolist(), len(lines)]
            if len(starts) == len(lines) - lead:
                records += lines[lead:]
            else:
                records += [b"\n".join(lines[s:e]) for s, e in zip(starts.tolist(), ends)]
            kinds += [WHOLE] * len(starts)
            if first and len(starts):
                kinds[0] = HEADER
            if after[-1] and len(starts):
                kinds[-1] = OPEN_HEADER if kinds[-1] == HEADER else OPEN
            yield pa.record_batch([pa.array([file] * len(records), pa.int64()), pa.array(kinds, pa.int32()), pa.array(records, pa.binary()),
                                   *(pa.array([batch.column(c)[row].as_py()] * len(records), t) for c, t in (("origin", pa.int64()), ("place", pa.int64())))],
                                  names=["file", "kind", "record", "origin", "place"])


WHOLE, HEADER, LATER, OPEN, OPEN_HEADER = range(5)


class Records:
    """``records(file, record)`` without headers, ``heads(file, head)`` with one row a file, and ``files(file, path)``."""

    def __init__(self, records: DataFrame, heads: DataFrame, files: DataFrame):
        self.records, self.heads, self.files = records, heads, files


@contextmanager
def _ranges(spark: SparkSession, size: int | None, total: int) -> Iterator[None]:
    """Files that are read inside, ``total`` bytes of them, are split into ranges of ``size`` bytes, or as the session says.

    Small ranges are dealt to tasks together: to a few for each core, or more where a task would get more than
    a task of the session's does.
    """
    names = "spark.sql.files.maxPartitionBytes", "spark.sql.files.maxPartitionNum", "spark.sql.files.openCostInBytes"
    before = {name: spark.conf.get(name, None) for name in names}
    try:
        if size is not None:
            tasks = max(TASKS * spark.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
            for name, value in zip(names, (size, tasks, 0)):
                spark.conf.set(name, str(value))
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def csv_records(spark: SparkSession, path: str, suffix: str = "*.csv", range_bytes: int | None = None, chunk: int = CHUNK) -> Records:
    """The records of all files below ``path``, as text, however the files are split.

    Lines end with LF or CRLF; quotes inside values are doubled, and stand in quoted values only.  An unclosed quote makes the rest of its file one
    record.  The lines are stored once in chunks with the parity of their quotes, so that both passes see the
    same ranges whatever executors come and go; between them, one narrow row a chunk is put in order for each file.
    """
    lines = spark.read.options(lineSep="\n", pathGlobFilter=suffix).text(path)
    where = F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    lines = lines.select(*where, F.expr("make_valid_utf8(value)").cast("binary").alias("value"))
    listed = spark.read.format("binaryFile").option("pathGlobFilter", suffix).load(path).select(F.col("_metadata.file_path").alias("path"), "length")
    total = 0 if range_bytes is None else listed.agg(F.sum("length")).first()[0] or 0
    with _ranges(spark, range_bytes, total):
        stored = durable(lines.mapInArrow(lambda batches: _chunks(batches, chunk), CHUNKS), "csv-chunks")
    order = Window.partitionBy("file").orderBy("block", "chunk")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    inside = (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).cast("int")
    states = stored.select("file", "block", "chunk", "odd", "closes", inside.alias("inside"), F.row_number().over(order).cast("long").alias("place"))
    # a piece belongs to the record that starts in the last chunk before it in which any record starts
    states = states.withColumn("origin", F.last(F.when((F.col("inside") == 0) | F.col("closes"), F.col("place")), ignorenulls=True).over(before))
    states = durable(states.withColumn("goes_on", ((F.col("inside") + F.col("odd")) % 2) == 1).drop("odd", "closes"), "csv-states")
    keyed = stored.select("file", "block", "chunk", "data").join(states, ["file", "block", "chunk"])
    keyed = keyed.withColumn("first", (F.col("block") == 0) & (F.col("chunk") == 0))
    kinds = "file long, kind int, record binary, origin long, place long"

    def pieces(rows: DataFrame) -> DataFrame:
        return rows.select("file", "inside", "first", "data", "origin", "place").mapInArrow(_records, kinds)

    whole = pieces(keyed).filter(F.col("kind") == WHOLE).select("file", "record")
    heads = stored.filter("head IS NOT NULL").select("file", "head")
    if not states.filter("inside = 1 OR goes_on").isEmpty():
        own = F.when(F.col("kind") == LATER, F.col("origin")).otherwise(F.col("place"))
        border = pieces(keyed.filter("inside = 1 OR goes_on")).filter(F.col("kind").isin(LATER, OPEN, OPEN_HEADER)).withColumn("own", own)
        joined = border.groupBy("file", "own").agg(
            F.array_sort(F.collect_list(F.struct("place", "record"))).alias("parts"), F.max(F.col("kind") == OPEN_HEADER).alias("is_head"))
        text = F.array_join(F.transform("parts", lambda p: p["record"].cast("string")), "\n").cast("binary").alias("text")
        joined = durable(joined.select("file", "is_head", text), "csv-border-records")
        whole = whole.unionByName(joined.filter("NOT is_head").select("file", F.col("text").alias("record")))
        heads = heads.unionByName(joined.filter("is_head").select("file", F.col("text").alias("head")))
    plain = lambda c: F.regexp_replace(F.col(c).cast("string"), "\r$", "").alias(c)
    return Records(whole.select("file", plain("record")).filter(F.trim("record") != ""),
                   heads.select("file", plain("head")), listed.select(F.xxhash64("path").alias("file"), "path"))
