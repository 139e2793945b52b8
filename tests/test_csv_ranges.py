"""CSV files in many ranges against Python's reader."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from riskloom.functions.durable import storage
from riskloom.sources import samples as readers
from riskloom.sources.csv_ranges import csv_records

def plain(text):
    rows = list(csv.reader(io.StringIO(text, newline="")))
    return [tuple(c or None for c in r) for r in rows[1:] if r]


def written(rows, header, end="\n", quoting=csv.QUOTE_MINIMAL):
    out = io.StringIO(newline="")
    w = csv.writer(out, lineterminator=end, quoting=quoting)
    w.writerows([header, *rows])
    return out.getvalue()


def same(spark, path, text, size):
    got = readers.read_csv(spark, str(path), range_bytes=size).drop("origin").collect()
    assert sorted((tuple(c or None for c in r) for r in got), key=str) == sorted(plain(text), key=str)


@pytest.mark.parametrize("size,end", [(90, "\n"), (200, "\r\n"), (1 << 20, "\r\n")])
def test_records_over_the_borders_of_ranges(spark, tmp_path, size, end):
    rng = random.Random(size)
    parts = ["a", "b c", "\n", '"', '""', ",", "é", "\r\n", " ", "\n\n", "x" * 30]
    rows = [(str(i), "".join(rng.choices(parts, k=rng.randint(0, 9))), rng.choice(["", "u", 'v"w'])) for i in range(60)]
    text = written(rows, ("id", "co\nde", 'la"b\nel'), end)
    (tmp_path / "a.csv").write_bytes(text.encode())
    same(spark, tmp_path, text, size)


def test_one_value_over_many_ranges(spark, tmp_path):
    text = written([("1", "\n".join(f"line {i}" for i in range(150))), ("2", "short"), ("3", '"\n' * 100)], ("id", "code"))
    (tmp_path / "a.csv").write_text(text, newline="")
    same(spark, tmp_path, text, 200)


def test_border_between_escaped_quotes(spark, tmp_path):
    """Ranges of a few bytes, so that borders fall into values and between quotes."""
    text = 'id,code\n1,"a""\n""b"\n2,"""\n"""\n3,x\n4,"c\n'
    for k in (5, 11, 12, 19, 27):
        folder = tmp_path / str(k)
        folder.mkdir()
        (folder / "a.csv").write_text(text + '"\n', newline="")
        assert sorted(map(tuple, readers.read_csv(spark, str(folder), range_bytes=k).drop("origin").collect())) == [("1", 'a"\n"b'), ("2", '"\n"'), ("3", "x"), ("4", "c\n")]


def test_files_without_line_end_empty_files_and_byte_order_marks(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿id,code\n1,\"x\ny\"".encode())
    (tmp_path / "b.csv").write_bytes(b"")
    (tmp_path / "c.csv").write_bytes(b"id,code\n")
    (tmp_path / "d.csv").write_bytes(b"id,code\n\n2,z\n\n")
    (tmp_path / "e.csv").write_bytes(b"id,code\n3,\xff\xfe\n")
    got = readers.read_csv(spark, str(tmp_path), range_bytes=5)
    assert sorted((r.id, r.code) for r in got.collect()) == [("1", "x\ny"), ("2", "z"), ("3", "��")]
    assert {r.origin.rsplit("/", 1)[-1] for r in got.collect()} == {"a.csv", "d.csv", "e.csv"}


def test_chunks_of_a_range(spark, tmp_path):
    rows = [(str(i), "one\n\"two\"\nthree " * (i % 4)) for i in range(300)]
    (tmp_path / "a.csv").write_text(written(rows, ("id", "code")), newline="")
    found = csv_records(spark, str(tmp_path), chunk=100)
    assert found.records.count() == 300 and found.heads.count() == 1 and found.files.count() == 1


def test_ranges_are_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "a.csv").write_text(written([(str(i), "v\nw") for i in range(2000)], ("id", "code")), newline="")
    found = csv_records(spark, str(tmp_path), range_bytes=2000)
    assert found.records.count() == 2000 and found.records.select(F.spark_partition_id()).distinct().count() > 1


def test_small_ranges_share_tasks(spark, tmp_path):
    """Ranges stay as small as asked for, but one task reads many of them."""
    (tmp_path / "a.csv").write_text(written([(str(i), "v\nw" * 20) for i in range(4000)], ("id", "code")), newline="")
    with storage(spark) as owned:
        found = csv_records(spark, str(tmp_path), range_bytes=500)
        chunks = spark.read.parquet(next(p for p in owned if "csv-chunks" in p))
        assert chunks.select("block").distinct().count() > 300 and len(chunks.inputFiles()) <= 4 * spark.sparkContext.defaultParallelism + 1
        assert found.records.count() == 4000
    assert spark.conf.get("spark.sql.files.maxPartitionNum", None) is None
