"""Sharding by extendible hashing: only oversized buckets split on another hash bit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.durable import durable
from riskloom.llm.common import fresh

BITS = 4                    # bits that the directory grows by in a round
HASH_BITS = 64
LIMIT = 64 << 20            # bytes of text in a shard


def _prefix(hash_: Column, depth: int) -> Column:
    return F.shiftrightunsigned(hash_, HASH_BITS - depth) if depth else F.lit(0).cast("long")


def _hash(doc_id: str, text: str) -> Column:
    """Id and text, so that rows without an id are spread as well."""
    return F.xxhash64(F.col(f"`{doc_id}`"), F.col(f"`{text}`"))


def _size(text: str) -> Column:
    return F.coalesce(F.octet_length(F.col(f"`{text}`").cast("string")), F.lit(0)).cast("long")


def directory(units: DataFrame, limit: int) -> list[DataFrame]:
    """The directory of ``units(hash, bytes)``, in tables that each resolve ``BITS`` more bits.

    A table maps a hash prefix to ``(shard, depth, shard_bytes, shard_rows)``, or to a null shard when the
    bucket is still too large and the next table goes on.  A bucket of all rows with a prefix splits while
    it is over the limit; so a row's shard is its shortest prefix that fits.  A bucket whose rows share one hash cannot split.
    Only sums for each prefix are shuffled; a round reads the rows of its open buckets alone.
    """
    tables: list[DataFrame] = []
    for depth in range(0, HASH_BITS, BITS):
        rows = units.select("hash", "bytes", _prefix(F.col("hash"), depth).alias("open"), _prefix(F.col("hash"), depth + BITS).alias("prefix"))
        if tables:
            still = tables[-1].filter("shard IS NULL").select(F.col("prefix").alias("open"))
            if still.isEmpty():
                break
            rows = rows.join(still, "open", "left_semi")
        sums = rows.groupBy("open", "prefix").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.min("hash").alias("low"), F.max("hash").alias("high"))
        fits, chosen = [], []
        for bits in range(BITS + 1):
            bucket = F.shiftrightunsigned("prefix", BITS - bits)
            over = Window.partitionBy("open", bucket)
            total, count = F.sum("bytes").over(over), F.sum("rows").over(over)
            fits.append((total <= limit) | (F.min("low").over(over) == F.max("high").over(over)))
            name = F.when(F.lit(depth + bits > 0), F.lpad(F.bin(bucket), depth + bits, "0")).otherwise(F.lit("*"))
            chosen.append(F.struct(name.alias("shard"), F.lit(depth + bits).alias("depth"), total.alias("shard_bytes"), count.alias("shard_rows")))
        leaf = reduce(lambda rest, k: F.when(fits[k], chosen[k]).otherwise(rest), reversed(range(BITS + 1)), F.lit(None))
        tables.append(durable(sums.select("prefix", leaf.alias("leaf")).select("prefix", "leaf.*"), "directory"))
    return tables


def shard(docs: DataFrame, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``bytes, shard, depth, shard_bytes, shard_rows`` (longer names where these exist).

    ``shard`` holds the leading bits of the row's hash; ``*`` when everything fits in one shard.  No shard has more
    than ``limit`` bytes of text, but for a single row that is larger: it gets a shard of its own.
    Rows that agree in id and text share their hash; where they exceed the limit together, the
    shard is cut into pages (``0110.0``, ``0110.1`` ...) that fit.

    Null texts have no bytes, null ids are hashed like any value, an empty table gives no rows, other columns stay as they are.
    """
    inner = fresh(docs, "shard_hash", "shard_bytes_of_row")
    key, size = inner
    keyed = docs.withColumn(key, _hash(doc_id, text)).withColumn(size, _size(text))
    units = durable(keyed.select(F.col(key).alias("hash"), F.col(size).alias("bytes")), "units")
    names = fresh(docs, "bytes", "shard", "depth", "shard_bytes", "shard_rows")
    found, parts = keyed, []
    for k, table in enumerate(directory(units, limit)):
        own = fresh(found, f"prefix_{k}", f"leaf_{k}")
        renamed = table.filter("shard IS NOT NULL").select(F.col("prefix").alias(own[0]), F.struct("shard", "depth", "shard_bytes", "shard_rows").alias(own[1]))
        found = found.join(renamed, _prefix(F.col(key), BITS * (k + 1)) == F.col(own[0]), "left")
        parts.append(F.col(own[1]))
    leaf = F.coalesce(*parts)
    kept = [F.col(f"`{c}`") for c in docs.columns]
    rows = found.select(*kept, F.col(key), F.col(size).alias(names[0]), *[leaf[c].alias(n) for c, n in zip(("shard", "depth", "shard_bytes", "shard_rows"), names[1:])])
    alike = durable(units.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("total"), F.max("bytes").alias("most"))
                    .filter((F.col("n") > 1) & (F.col("total") > limit)).withColumn("page_rows", F.greatest(F.lit(1), F.floor(F.lit(limit) / F.col("most"))).cast("long")), "alike")
    if alike.isEmpty():
        return rows.drop(key)
    plain = rows.join(alike.select(F.col("hash").alias("alike")), F.col(key) == F.col("alike"), "left_anti").drop(key)
    return plain.unionByName(_paged(rows, alike, key, names))


def _paged(rows: DataFrame, alike: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Equal rows that exceed the limit together, numbered and cut into pages.

    They are numbered within the tasks that wrote them and offset by those tasks' counts: no task gets all of them.
    """
    task, page_rows, number, offset = fresh(rows, "task", "page_rows", "number", "offset")
    own = durable(rows.join(alike.select(F.col("hash").alias("alike"), F.col("page_rows").alias(page_rows)), F.col(key) == F.col("alike")).drop("alike")
                  .withColumn(number, F.monotonically_increasing_id()).withColumn(task, F.shiftright(F.monotonically_increasing_id(), 33)), "alike-rows")
    counts = own.groupBy(key, task).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(key).orderBy(task)
    counts = counts.select(F.col(key).alias("k"), F.col(task).alias("t"), (F.sum("n").over(before) - F.col("n")).alias(offset))
    placed = own.withColumn(number, F.row_number().over(Window.partitionBy(key, task).orderBy(number)) - 1)
    placed = placed.join(counts, (F.col(key) == F.col("k")) & (F.col(task) == F.col("t")))
    at = F.col(number) + F.col(offset)
    page = F.floor(at / F.col(page_rows))
    size, shard_, depth, shard_bytes, shard_rows = names
    in_page = F.least(F.col(page_rows), F.col(shard_rows) - page * F.col(page_rows))
    return placed.withColumns({shard_: F.concat(F.col(shard_), F.lit("."), page.cast("string")), shard_bytes: in_page * F.col(size), shard_rows: in_page}) \
        .select(*[c for c in rows.columns if c != key])
