from pyspark.sql import functions as F

from riskloom import scan
from riskloom.sources import tree
from riskloom.sources.samples import labelled_files


def make(root, **content):
    for path, data in content.items():
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data)


def test_tree_rules(spark, tmp_path):
    make(tmp_path, **{
        "one/app.py": b"eval(x)", "one/UPPER.PY": b"a", "one/.env": b"a", "one/prod.env": b"a", "one/readme.md": b"a",
        "one/node_modules/x.js": b"a", "one/src/.hidden/x.py": b"a", "one/src/build/x.py": b"a", "one/builder/x.py": b"a",
        "one/Build/x.py": b"a", "one/venv/x.py": b"a", "one/big.py": b"x" * (1024 * 1024 + 1), "one/limit.py": b"x" * (1024 * 1024),
        ".two/a b%20c.py": b"\xff\r\nok", "stray.py": b"a", "one/pkg/__init__.py": b"a", "one/_private/_x.py": b"",
    })
    (tmp_path / "one" / "loop").symlink_to(tmp_path / "one", target_is_directory=True)
    whole = {(r.repo, r.file): r.size_bytes for r in tree.read_tree(spark, str(tmp_path)).collect()}
    assert whole["one", "big.py"] == 1024 * 1024 + 1
    skipped = {(r.file, r.reason) for r in tree.skipped_files(tree.list_tree(spark, str(tmp_path)), 1024 * 1024).filter("repo = 'one'").collect()}
    assert ("big.py", "size") in skipped and ("readme.md", "extension") in skipped and not any(f == "app.py" for f, _ in skipped)
    got = {(r.repo, r.file): r for r in tree.read_tree(spark, str(tmp_path), max_bytes=1024 * 1024).collect()}
    assert set(got) == {("one", "app.py"), ("one", "UPPER.PY"), ("one", "prod.env"), ("one", "builder/x.py"), ("one", "Build/x.py"),
                        ("one", "limit.py"), (".two", "a b%20c.py"), ("one", "pkg/__init__.py"), ("one", "_private/_x.py")}
    assert got[".two", "a b%20c.py"].content == "�\r\nok" and got["one", "limit.py"].size_bytes == 1048576


def test_one_repository_and_cap(spark, tmp_path):
    make(tmp_path, **{f"d/f{i}.py": b"x" for i in range(5)}, **{"a.py": b"x"})
    got = {(r.repo, r.file) for r in tree.read_tree(spark, str(tmp_path) + "/", repo="mine", max_files=3).collect()}
    assert got == {("mine", "a.py"), ("mine", "d/f0.py"), ("mine", "d/f1.py")}
    capped = tree.skipped_files(tree.list_tree(spark, str(tmp_path), repo="mine"), max_files=3)
    assert sorted((r.file, r.reason) for r in capped.collect()) == [("d/f2.py", "cap"), ("d/f3.py", "cap"), ("d/f4.py", "cap")]


def test_labels_come_with_the_listing(spark, tmp_path):
    make(tmp_path, **{"r/a.py": b"first line of code\nsecond line of code", "r/b.py": b"unlabelled text here", "s/a.py": b"other repository here"})
    categories = spark.createDataFrame([("r", "a.py", "Safe"), ("s", "a.py", "High Risk")], "repo string, file string, label string")
    files = tree.read_tree(spark, str(tmp_path), categories=categories)
    assert {(r.repo, r.file, r.label) for r in files.collect()} == {("r", "a.py", "Safe"), ("r", "b.py", None), ("s", "a.py", "High Risk")}
    assert {(r.repo, r.file, r.label) for r in labelled_files(files).collect()} == {("r", "a.py", "Safe"), ("s", "a.py", "High Risk")}


def test_content_is_not_read_for_rejected_files(spark, tmp_path):
    make(tmp_path, **{"r/a.py": b"x", "r/b.md": b"x"})
    (tmp_path / "r" / "gone.py").symlink_to(tmp_path / "nowhere")
    listing = tree.list_tree(spark, str(tmp_path))
    assert {r.file for r in listing.collect()} >= {"a.py", "b.md"}
    assert {r.file for r in tree.read_tree(spark, str(tmp_path)).collect()} == {"a.py"}


def test_scan_of_a_tree(spark, tmp_path):
    make(tmp_path, **{"r/a.py": b"name = input('n')\neval(name)\n", "clean/b.py": b"x = 1\n"})
    result = scan(tree.read_tree(spark, str(tmp_path)))
    assert {(r.repo, r.file, r.line, r.issue) for r in result.findings.collect()} == {("r", "a.py", 2, "Dangerous Execution (eval)")}
    assert {(r.source, r.source_line) for r in result.attack_chains.collect()} == {("input()", 1)}
    assert {r.repo: r.security_grade for r in result.fingerprint.collect()}["clean"] == "A"
    assert result.stats.agg(F.sum("total_lines")).first()[0] == 3
