"""Tables that several later jobs read, written once to the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
#: What the innermost open ``storage`` deletes at its end.
_OWNED: ContextVar[list[str] | None] = ContextVar("owned", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names; only a local session may fall back to its own."""
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="riskloom-"))
    return context.getCheckpointDir()


def claim(spark: SparkSession, name: str, written: list[str] | None = None) -> str:
    """A new path in the shared folder, known to its owners: ``written`` and the open ``storage``."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    for owner in (written, _OWNED.get()):
        if owner is not None:
            owner.append(path)
    return path


@contextmanager
def storage(spark: SparkSession) -> Iterator[list[str]]:
    """Owns all tables that are stored inside and deletes what is left of them at the end; results are read inside.

        with storage(spark):
            split = stratified_split(samples, F.col("row_id"))
            split.write.parquet(path)
    """
    owned: list[str] = []
    token = _OWNED.set(owned)
    try:
        yield owned
    finally:
        _OWNED.reset(token)
        remove(spark, owned)


def durable(df: DataFrame, name: str, written: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet and read it back.

    Lineage is cut, lost executors cost nothing that is already written, and
    later jobs prune columns and push filters into the files.  The table belongs to ``written``, whose owner
    will ``remove`` it, or to the open ``storage``.
    """
    spark = df.sparkSession
    path = claim(spark, name, written)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete stored tables, in whatever file system they are."""
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
