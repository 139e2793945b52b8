import re

import pytest
from pyspark.sql import functions as F

from riskloom.functions import text
from riskloom.operators import lines

TEXTS = [
    "", "\n", "a", "a\n", "a\nb", "a\r\nb\rc\n", "a\n\nb\n\n", "a\x0bb\x0cc", "a\x1cb\x1dc\x1ed\x1fe", "a\x85b\u2028c\u2029d",
    "a\u2028", "\u2028", "x\r", "x\r\n", " \t\n\u3000 y \u00a0\n", "é\n\U0001f600\n", "a\n \n",
]


def python_lines(content: str) -> list[str]:
    return re.sub("\r\n?", "\n", content).splitlines()


def test_lines_as_python_splits_them(spark, files):
    rows = lines.lines(files(*[("r", str(i), t) for i, t in enumerate(TEXTS)])).orderBy("file", "line").collect()
    for i, t in enumerate(TEXTS):
        got = [(r.line, r.raw, r.code) for r in rows if r.file == str(i)]
        assert got == [(n, raw, raw.strip()) for n, raw in enumerate(python_lines(t), 1)], repr(t)


def test_file_stats_as_defined(spark, files):
    content = "import os\r\n\r\n# c\n// c\n/* c\n * c\n<!-- c\ndef f():\n    class A:\nfrom x import y\n#include <a>\nasync function g()\nrequire x\nimported = 1\n  \n"
    got = lines.file_stats(files(("r", "a.py", content), ("r", "empty.py", ""))).orderBy("file").collect()
    assert got[0].asDict() == {
        "repo": "r", "file": "a.py", "total_lines": 15, "blank_lines": 2, "comments": 6, "imports": 4, "functions": 2,
        "classes": 1, "total_characters": len(content.replace("\r\n", "\n"))}
    assert got[1].total_lines == 0 and got[1].total_characters == 0


@pytest.mark.parametrize("path, ext, kind", [
    ("a.py", ".py", "Python"), (".env", "", "Unknown"), ("x.env", ".env", "Unknown"), ("a.tar.GZ", ".gz", "Unknown"),
    ("..a.b", ".b", "Unknown"), ("Makefile", "", "Unknown"), ("d.py/Makefile", "", "Unknown"), ("d/b.JS", ".js", "JavaScript"),
    ("a.", ".", "Unknown"), ("d/.x", "", "Unknown"), ("n.txt", ".txt", "Text/Unknown"), ("m.ts", ".ts", "Unknown"),
])
def test_extension_and_language(spark, path, ext, kind):
    df = spark.createDataFrame([(path,)], "file string")
    e = text.extension(F.col("file"))
    assert tuple(df.select(e, text.language(e)).first()) == (ext, kind)


def test_path_key(spark):
    df = spark.createDataFrame([("A\\B/c.PY",)], "file string")
    assert df.select(text.path_key(F.col("file"))).first()[0] == "a/b/c.py"


def test_windows_hold_neighbours(spark, files):
    content = "\n".join(f"l{i}" for i in range(1, 21))
    got = {r.line: (r.first_line, r.context) for r in lines.line_windows(files(("r", "a", content))).collect()}
    assert got[1] == (1, [f"l{i}" for i in range(1, 7)])
    assert got[10] == (5, [f"l{i}" for i in range(5, 16)])
    assert got[20] == (15, [f"l{i}" for i in range(15, 21)])
