from pathlib import Path

import pytest

SF = "/root/testdata/sf0.001"

#: Names that operators use for their own columns: as columns of the input they must survive.
CLASHING = ("key", "size", "target", "taken", "source_size", "shard", "bytes", "depth", "found", "score", "rule", "verdict", "host", "path", "print",
            "epochs", "times", "clean_text", "n_lines", "seq", "first", "gone", "copy", "cut", "component_id", "Mix_Size")


@pytest.fixture(scope="session")
def sf():
    if not Path(SF).exists():
        pytest.skip("test tables are not here")
    return SF


@pytest.fixture
def documents(spark):
    """Rows of (doc_id, text, source, lang), with every clashing name as a further column."""
    def build(*rows, clashing=True):
        full = [(*r, *(None, "src", "en")[len(r) - 1:]) if len(r) < 4 else r for r in rows]
        df = spark.createDataFrame([tuple(r) for r in full], "doc_id long, text string, source string, lang string")
        if clashing:
            from pyspark.sql import functions as F
            df = df.select("*", *[F.lit(n).alias(c) for n, c in enumerate(CLASHING)])
        return df
    return build
