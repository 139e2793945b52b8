"""The driver's entry without what the optional subpackage needs."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
PROGRAM = """
import sys
for name in {missing!r}:
    sys.modules[name] = None
import __spark_entry__ as e
names = set(e.queries())
assert len(names) > 95 and "findings" in names and set(e.oracle_sql()) <= names, len(names)
assert not any(n.startswith("op") and n[2].isdigit() for n in names) and "pipeline" not in names
"""


def test_engine_queries_without_the_tokenizer_files():
    for missing in (["public_tokenizers"], ["xxhash"], ["riskloom.llm"]):
        made = subprocess.run([sys.executable, "-c", PROGRAM.format(missing=missing)], cwd=ROOT, capture_output=True, text=True, timeout=120)
        assert made.returncode == 0, made.stderr
