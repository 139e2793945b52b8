"""The data source against the reader of trees."""

from pyspark.sql import functions as F

from riskloom.sources import tree, tree_source
from test_tree import make


def build(tmp_path):
    make(tmp_path, **{
        "one/app.py": b"eval(x)", "one/UPPER.PY": b"a", "one/.env": b"a", "one/prod.env": b"a", "one/readme.md": b"a", "one/..a.py": b"b", "one/...py": b"c", "one/Makefile": b"d",
        "one/node_modules/x.js": b"a", "one/src/.hidden/x.py": b"a", "one/src/build/x.py": b"a", "one/builder/x.py": b"a", "one/src/deep/er/x.js": b"b",
        "one/big.py": b"x" * 5000, ".two/a b%20c.py": b"\xff\r\nok\xe2\x82", "stray.py": b"a", "one/pkg/__init__.py": b"a", "one/_private/_x.py": b"", "three/x.go": b"package"})
    (tmp_path / "one" / "loop").symlink_to(tmp_path / "one", target_is_directory=True)


def test_equals_read_tree(spark, tmp_path):
    build(tmp_path)
    tree_source.register(spark)
    got = spark.read.format("source_tree").load(str(tmp_path))
    want = tree.read_tree(spark, str(tmp_path))
    assert sorted(map(tuple, got.select("repo", "file", "content", "size_bytes").collect())) == sorted(map(tuple, want.select("repo", "file", "content", "size_bytes").collect()))
    one = spark.read.format("source_tree").option("repo", "mine").load(f"{tmp_path}/one")
    assert sorted(r.file for r in one.collect()) == sorted(r.file for r in tree.read_tree(spark, f"{tmp_path}/one", repo="mine").collect())
    assert {r.repo for r in one.collect()} == {"mine"}


def test_filters_reach_the_listing(spark, tmp_path):
    build(tmp_path)
    tree_source.register(spark)
    files = spark.read.format("source_tree").load(str(tmp_path))
    assert [(r.repo, r.file) for r in files.filter("repo = 'three'").collect()] == [("three", "x.go")]
    assert {r.repo for r in files.filter(F.col("repo").isin("three", ".two", "none")).collect()} == {"three", ".two"}
    assert files.filter("repo = 'one' AND size_bytes < 5000").filter("file = 'big.py'").count() == 0
    assert files.filter("size_bytes <= 5000 AND file = 'big.py'").count() == 1
    reader = tree_source.TreeReader(str(tmp_path), None)
    left = list(reader.pushFilters([tree_source.EqualTo(("repo",), "three"), tree_source.LessThan(("size_bytes",), 10)]))
    assert left == [] and reader.most == 9 and {p.repo for p in reader.partitions()} == {"three"}


def test_empty_and_missing(spark, tmp_path):
    tree_source.register(spark)
    assert spark.read.format("source_tree").load(str(tmp_path)).count() == 0
    assert spark.read.format("source_tree").load(str(tmp_path / "nowhere")).count() == 0
