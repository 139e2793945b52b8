import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from catalog.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    spark = session("4")
    yield spark
    spark.stop()


@pytest.fixture
def files(spark):
    def build(*rows):
        """rows: (repo, file, content)"""
        full = [(repo, file, content, len(content.encode())) for repo, file, content in rows]
        return spark.createDataFrame(full, "repo string, file string, content string, size_bytes bigint")
    return build
