"""Attack chains: a source on, or up to 15 lines before, a dangerous call."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import prose
from riskloom import registry as R
from riskloom.functions import matching

# Lines per window group.  A longer file is cut into blocks, so that one huge
# file is never a single window partition.
BLOCK_LINES = 4096


def _blocks(facts: DataFrame) -> DataFrame:
    """Add ``block`` and ``borrowed``: the last lines of a block also serve as context of the next one."""
    own = F.floor(F.col("line") / BLOCK_LINES).cast("int")
    near_end = F.col("line") % BLOCK_LINES >= BLOCK_LINES - R.SOURCE_WINDOW
    return (
        facts.withColumn("own_block", own)
        .withColumn("block", F.explode(
            F.when(near_end & (F.col("src_mask") != 0), F.array("own_block", F.col("own_block") + 1))
            .otherwise(F.array("own_block"))))
        .withColumn("borrowed", F.col("block") != F.col("own_block"))
        .drop("own_block")
    )


# The lines before the current one within the source window, by line number.
_PRECEDING = (f"(PARTITION BY repo, file, block ORDER BY line "
              f"RANGE BETWEEN {R.SOURCE_WINDOW} PRECEDING AND 1 PRECEDING)")


def reach(facts: DataFrame) -> DataFrame:
    """Facts with ``reach_mask``: the sources on the line or before it within the window.

    Every chain of a line is one (source in ``reach_mask``, sink in ``snk_mask``)
    pair, so counts need no chain rows.
    """
    before = F.expr(f"bit_or(src_mask) OVER {_PRECEDING}")
    return (
        _blocks(facts)
        .withColumn("reach_mask", F.col("src_mask").bitwiseOR(F.coalesce(before, F.lit(0))))
        .filter(~F.col("borrowed"))
        .drop("block", "borrowed")
    )


def attack_chains(facts: DataFrame, registry: R.Registry = R.DEFAULT) -> DataFrame:
    """One row per (file, sink line, source, sink).

    A source on the sink's own line wins (``source_line`` is null), else the
    earliest source line of the window.  One shuffle, by file and block.
    """
    flows = facts.filter("src_mask <> 0 OR snk_mask <> 0").drop("vuln_id", "entry_id")
    earliest = F.expr("array(" + ", ".join(
        f"min(CASE WHEN getbit(src_mask, {i}) = 1 THEN line END) OVER {_PRECEDING}" for i in range(len(registry.sources))) + ")")
    pairs = (
        _blocks(flows)
        .withColumn("earliest", earliest)
        .filter(~F.col("borrowed") & (F.col("snk_mask") != 0))
        .select("repo", "file", "line", "code", "src_mask", "snk_mask", F.posexplode("earliest").alias("source_id", "before"))
        .withColumn("same_line", F.expr("getbit(src_mask, source_id) = 1"))
        .filter("same_line OR before IS NOT NULL")
        .withColumn("sink_id", F.explode(F.sequence(F.lit(0), F.lit(len(registry.sinks) - 1))))
        .filter("getbit(snk_mask, sink_id) = 1")
    )
    sink_id = F.col("sink_id")
    attack = [s.kind for s in registry.sinks]
    return pairs.select(
        "repo", "file", "line",
        F.col("code").alias("matched_code"),
        matching.lookup(F.col("source_id"), [s.name for s in registry.sources]).alias("source"),
        matching.lookup(sink_id, [s.name for s in registry.sinks]).alias("sink"),
        matching.lookup(sink_id, attack).alias("attack_type"),
        matching.lookup(sink_id, [prose.CHAIN_DESCRIPTIONS.get(a, a) for a in attack]).alias("description"),
        matching.lookup(sink_id, [prose.CHAIN_ALERTS.get(a, a) for a in attack]).alias("alert_message"),
        matching.lookup(sink_id, [R.ATTACK_SEVERITY.get(a, "High") for a in attack]).alias("severity_label"),
        F.when(~F.col("same_line"), F.col("before")).alias("source_line"),
        "source_id", "sink_id",
    )


CHAIN_COLUMNS = ("repo", "file", "line", "matched_code", "source", "sink", "attack_type", "description",
                 "alert_message", "severity_label", "source_line")


def chain_order() -> list[Column]:
    """Most dangerous attack first; within it file, same-line chains, position."""
    rank = reduce(
        lambda acc, item: acc.when(F.col("attack_type") == item[1], item[0]),
        list(enumerate(R.ATTACK_ORDER))[1:],
        F.when(F.col("attack_type") == R.ATTACK_ORDER[0], 0),
    )
    return [rank, F.col("file"), F.col("source_line").isNotNull(), F.col("line"),
            F.col("source_line"), F.col("source_id"), F.col("sink_id")]


def order_chains(chains: DataFrame) -> DataFrame:
    return chains.orderBy("repo", *chain_order())


def chain_summary(chains: DataFrame) -> DataFrame:
    return chains.groupBy("repo", "attack_type").agg(F.count(F.lit(1)).alias("chains"))
