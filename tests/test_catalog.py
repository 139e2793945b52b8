"""Every registered query against its SQL on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as driver
from catalog import registry
from catalog.check import compare

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = registry.QUERIES, registry.ORACLE

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    assert compare(spark, SF, QUERIES[name], ORACLE[name]) == ""


def test_every_query_reads_the_tables(spark):
    for name in ("findings", "narrative", "label_norm_a", "word_vocab", "tree_filter", "json_extract"):
        assert QUERIES[name](spark, SF).inputFiles(), name


def test_entry(spark):
    df = driver.entry(spark)
    assert df.columns[0] == "repo" and df.count() > 0
