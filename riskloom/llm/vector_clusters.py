"""Clusters of vectors by Lloyd's rounds over column blocks, in whole numbers."""

from __future__ import annotations

import math
import pickle
from functools import partial
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.durable import durable, remove
from riskloom.llm.common import bucketed, slices

DIMENSIONS, CLUSTERS, ROUNDS = 64, 8, 10
SEED = 3
SCALE = 1024
WIDTH = 16              # components in a column block
ROWS = 2048             # vectors in a row block
SMALL = 1 << 26         # components below it give sums of squares that fit 64 bits


def whole_numbers(x: np.ndarray) -> np.ndarray:
    """floor(1024 x) of doubles: 64-bit, or Python integers where one is too large for that."""
    if not x.size or np.abs(x).max() * SCALE < SMALL:
        return np.floor(SCALE * x).astype(np.int64)
    return np.array([[int(v) * SCALE if abs(v) >= 2.0 ** 53 else math.floor(SCALE * v) for v in row] for row in x.tolist()], dtype=object)


def _pack(x: np.ndarray) -> bytes:
    return pickle.dumps(x, protocol=5)


def _kept(x: np.ndarray) -> np.ndarray:
    """Whole numbers in 64 bits where all are small enough for that."""
    return x.astype(np.int64) if x.dtype == object and max(map(abs, x.ravel().tolist()), default=0) < SMALL else x


def _blocks(batches, dimensions, width):
    """Row blocks of at most ``ROWS`` kept vectors, each as one row per column block, numbered by task and position."""
    task, count = TaskContext.get().partitionId(), 0
    for batch in slices(batches, ROWS):
        vectors = whole_numbers(np.array(batch.column(1).to_pylist(), dtype=np.float64).reshape(-1, dimensions))
        block, count = (task << 32) + count, count + 1
        shards = [_pack(_kept(vectors[:, at:at + width])) for at in range(0, dimensions, width)]
        ids = [pickle.dumps(batch.column(0).to_pylist()), *[None] * (len(shards) - 1)]
        yield pa.record_batch([pa.array([block] * len(shards), pa.int64()), pa.array(range(len(shards)), pa.int32()), pa.array(shards, pa.binary()),
                               pa.array(ids, pa.binary())], names=["block", "shard", "data", "ids"])


def _partial(batches):
    """Exact squared distances of a block's rows to all centroids, over the columns of one shard."""
    for batch in batches:
        for block, data, slice_ in zip(*(batch.column(c).to_pylist() for c in ("block", "data", "slice"))):
            x, c = pickle.loads(data), pickle.loads(slice_)
            if x.dtype != c.dtype:
                x, c = x.astype(object), c.astype(object)
            step = x[:, None, :] - c[None, :, :]
            yield pa.record_batch([pa.array([block], pa.int64()), pa.array([_pack((step * step).sum(axis=2))], pa.binary())], names=["block", "parts"])


def _nearest(table: pa.Table) -> pa.Table:
    """Adds the shards' parts of one block's distances and takes the nearest centroid, the smaller number on ties."""
    parts = [pickle.loads(p) for p in table.column("parts").to_pylist()]
    if any(p.dtype == object for p in parts):
        parts = [p.astype(object) for p in parts]
    total = sum(parts[1:], parts[0])
    nearest = np.array([min(range(len(row)), key=row.__getitem__) for row in total.tolist()]) if total.dtype == object else total.argmin(axis=1)
    distance = total[np.arange(len(total)), nearest]
    return pa.table({"block": table.column("block")[:1].cast(pa.int64()), "labels": pa.array([_pack(nearest.astype(np.int32))], pa.binary()),
                     "distances": pa.array([_pack(distance)], pa.binary())})


def _sums(batches):
    """Sums of one shard's columns by cluster, added up over the blocks of a task before they are shuffled."""
    sums: dict[int, dict[int, list]] = {}
    for batch in batches:
        for shard, data, labels in zip(*(batch.column(c).to_pylist() for c in ("shard", "data", "labels"))):
            x, label = pickle.loads(data), pickle.loads(labels)
            own = sums.setdefault(shard, {})
            for k in np.unique(label).tolist():
                rows = x[label == k]
                at = own.setdefault(k, [0, [0] * x.shape[1]])
                at[0] += len(rows)
                at[1] = [a + int(b) for a, b in zip(at[1], rows.sum(axis=0).tolist())]
    for shard, own in sums.items():
        yield pa.record_batch([pa.array([shard], pa.int32()), pa.array([pickle.dumps(own)], pa.binary())], names=["shard", "sums"])


def _update(left: pa.Table, right: pa.Table) -> pa.Table:
    """A shard's slice of all centroids from its own sums; a cluster without vectors stays."""
    centroids = pickle.loads(left.column("slice")[0].as_py()).tolist()
    counts, sums = [0] * len(centroids), [[0] * len(c) for c in centroids]
    for blob in right.column("sums").to_pylist():
        for k, (n, own) in pickle.loads(blob).items():
            counts[k] += n
            sums[k] = [a + b for a, b in zip(sums[k], own)]
    moved = np.array([[s // n for s in own] if n else c for n, own, c in zip(counts, sums, centroids)], dtype=object)
    return pa.table({"shard": left.column("shard")[:1].cast(pa.int32()), "slice": pa.array([_pack(_kept(moved))], pa.binary())})


def _rows(batches):
    for batch in batches:
        for ids, labels, distances in zip(*(batch.column(c).to_pylist() for c in ("ids", "labels", "distances"))):
            distance = [int(d) for d in pickle.loads(distances).tolist()]
            yield pa.record_batch([pa.array(pickle.loads(ids), pa.int64()), pa.array(pickle.loads(labels)), pa.array([str(d) for d in distance])], names=["vec_id", "cluster", "distance"])


def kept_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``(vec_id, embedding)`` of the rows with exactly ``dimensions`` components, all of them finite."""
    x = F.col(f"`{embedding}`").cast("array<double>")
    fit = (F.size(x) == dimensions) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vectors.filter(F.coalesce(fit, F.lit(False))).select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), x.alias("embedding"))


def clusters(vectors: DataFrame, count: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, width: int = WIDTH,
             vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` for every kept vector.

    A vector is cut into column blocks (shards).  In a round the tasks of a shard give exact partial
    distances to their slice of the centroids; these are added by row block, the argmin taken, and each shard makes its own slice
    anew from sums that every task has added up before.  What is shuffled in a round is distances, labels and sums: the vectors lie in a table bucketed by row block.
    Only the first centroids, of ``count`` vectors, pass through the driver.

    All arithmetic is on integers of any size; a distance or a sum of distances over 2**63 - 1 is null.  Vectors of another length, with
    null or non-finite components, and null vectors are left out.  Rows without id hash as an empty id; repeated rows count each;
    ids that hash alike take their components' order; fewer vectors than ``count`` give as many clusters; none give no rows.  Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = kept_vectors(vectors, dimensions, vec_id, embedding)
    name = F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.select(name.alias("name"), "embedding").orderBy("name", "embedding").limit(count).collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = whole_numbers(np.array([r["embedding"] for r in first], dtype=np.float64))
    slices_ = spark.createDataFrame([(s, _pack(_kept(centroids[:, at:at + width]))) for s, at in enumerate(range(0, dimensions, width))], "shard int, slice binary")
    written: list[str] = []
    blocks, stored = bucketed(rows.mapInArrow(partial(_blocks, dimensions=dimensions, width=width), "block long, shard int, data binary, ids binary"), "block", "vector_blocks", written)
    try:
        data = blocks.select("block", "shard", "data")
        for _ in range(rounds):
            assigned = durable(_assigned(data, slices_).select("block", "labels"), "labels", written)
            sums = data.join(assigned, "block").select("shard", "data", "labels").mapInArrow(_sums, "shard int, sums binary")
            slices_ = durable(slices_.groupBy("shard").cogroup(sums.groupBy("shard")).applyInArrow(_update, "shard int, slice binary"), "slices", written)
        last = _assigned(data, slices_).join(blocks.filter("shard = 0").select("block", "ids"), "block")
        result = durable(last.select("ids", "labels", "distances").mapInArrow(_rows, "vec_id long, cluster int, distance string")
                         .select("vec_id", "cluster", F.expr("try_cast(distance AS long)").alias("distance")), "clusters")
        final = _joined([(r["shard"], pickle.loads(r["slice"]).tolist()) for r in slices_.collect()])
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {stored}")
        remove(spark, written)
    # a sum over a distance that does not fit is null as well
    added = F.when(F.count(F.lit(1)) == F.count("distance"), F.sum(F.col("distance").cast("decimal(38,0)")))
    inertia = result.groupBy("cluster").agg(added.alias("own"))
    total = result.agg(added).first()[0]
    digests = spark.createDataFrame([(k, sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(final)], "cluster int, centroid_sha256 string")
    summed = digests.join(inertia, "cluster").select("cluster", F.expr("try_cast(own AS long)").alias("cluster_inertia"), "centroid_sha256")
    return result.join(F.broadcast(summed), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia",
        F.lit(int(total) if total is not None and total < 1 << 63 else None).cast("long").alias("inertia"), "centroid_sha256")


def _assigned(data: DataFrame, slices_: DataFrame) -> DataFrame:
    """``(block, labels, distances)``; the slices are one row a shard, each ``count`` times ``width`` numbers."""
    parts = data.join(F.broadcast(slices_), "shard").select("block", "data", "slice").mapInArrow(_partial, "block long, parts binary")
    return parts.groupBy("block").applyInArrow(_nearest, "block long, labels binary, distances binary")


def _joined(slices_: list[tuple[int, list[list[int]]]]) -> list[list[int]]:
    parts = [x for _, x in sorted(slices_)]
    return [[v for part in parts for v in part[k]] for k in range(len(parts[0]))]
