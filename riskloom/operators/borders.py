"""Shortcut signatures over the joined text of a repository: matches that begin in one file and end in a later one."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import text
from riskloom.functions.automaton import Positions, Relation, relation
from riskloom.functions.matching import fold
from riskloom.functions.ranking import ranked_position
from riskloom.operators.hits import shortcut_mask
from riskloom.registry import DEFAULT, Registry, Signature

WIDTH = 512             # characters on either side of a border that are searched as a text; longer matches are followed by their states
BLOCK = 4096            # files that are walked together

_positions = lru_cache(maxsize=8)(Positions)


def border_masks(files: DataFrame, registry: Registry = DEFAULT, width: int = WIDTH) -> DataFrame:
    """``(repo, file, border_mask)``: the shortcuts that begin in a file and end in a later one, however long, and those
    in the last ``width`` characters of a file and as many of what follows it, where there are any.

    The files of a repository follow each other by name, a line break between them.  Only heads and tails are moved: every file gets its
    position in the whole list, and blocks of ``BLOCK`` positions are walked from their ends.  A head has one
    character at least, so the first ``width`` files of a block, lent to the block before, hold all that may follow its last file.

    A match of any length is followed by its states (see ``automaton``): where the file is read, all of its text becomes a few numbers, which
    tell the states in which matches leave it and what it does to those that come in.  What the files of a block do together is known after
    one walk, what lies behind each block then follows from a row a block, and a second walk has the files.  Signatures
    that are no plain automata, such as those with word edges, are looked for in the whole joined text, a row a
    repository; its first file gets them.
    """
    signatures = tuple(registry.shortcuts)
    folded = fold(text.universal_newlines(F.col("content")))
    whole = files.select("repo", "file", F.inline(F.array(F.struct(folded.alias("_folded")))))
    ends = whole.select("repo", "file", F.concat(F.lit("\n"), F.substring("_folded", 1, width)).alias("head"),
                        F.expr(f"CASE WHEN length(_folded) > {width} THEN right(_folded, {width}) END").alias("tail"), "_folded")
    states = ends.mapInArrow(partial(_states, signatures=signatures), "repo string, file string, head string, tail string, opens string, does string")
    placed = ranked_position(states, ["repo"], [F.col("file")], "position").filter("repo IS NOT NULL")
    size = max(BLOCK, width)
    place = (F.col("position") - 1) % size
    own = F.floor((F.col("position") - 1) / size)
    by_block = placed.select("repo", own.alias("block"), "position", "does").repartition("repo", "block").sortWithinPartitions("repo", "block", F.desc("position"))
    together = by_block.mapInArrow(_together, "repo string, block long, does string")
    behind = together.repartition("repo").sortWithinPartitions("repo", F.desc("block")).mapInArrow(_behind, "repo string, block long, behind string")
    blocks = F.when((place < width) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    dealt = placed.select("repo", "file", "head", "tail", "opens", "does", "position", F.explode(blocks).alias("block"), own.alias("own"))
    lent = F.col("block") < F.col("own")
    dealt = dealt.select("repo", "block", "position", "head", *[F.when(~lent, F.col(c)).alias(c) for c in ("file", "tail", "opens", "does")], lent.alias("lent"))
    walked = dealt.join(behind, ["repo", "block"], "left").repartition("repo", "block").sortWithinPartitions("repo", "block", F.desc("position"))
    border = walked.mapInArrow(partial(_bordered, width=width, signatures=signatures), "repo string, file string, _border string, _crossed int")
    found = F.coalesce(shortcut_mask("_border", registry), F.lit(0)).bitwiseOR(F.col("_crossed"))
    masks = border.select("repo", "file", found.alias("border_mask")).filter("border_mask <> 0")
    irregular = _positions(signatures).irregular
    if irregular:
        masks = masks.unionByName(_in_whole_text(whole, registry, irregular))
    return masks.groupBy("repo", "file").agg(F.bit_or("border_mask").alias("border_mask"))


def _in_whole_text(whole: DataFrame, registry: Registry, chosen: list[int]) -> DataFrame:
    """The chosen signatures of the registry in the joined text of each repository, by its first file."""
    listed = F.sort_array(F.collect_list(F.struct("file", "_folded")))
    joined = whole.filter("repo IS NOT NULL AND _folded IS NOT NULL").groupBy("repo").agg(F.min("file").alias("file"), listed.alias("_files"))
    texts = joined.select("repo", "file", F.inline(F.array(F.struct(F.array_join("_files._folded", "\n").alias("_joined")))))
    few = shortcut_mask("_joined", registry._replace(shortcuts=tuple(registry.shortcuts[i] for i in chosen)))

    def placed(mask: Column) -> Column:
        bits = [F.when(F.getbit(mask, F.lit(k)) == 1, F.lit(1 << i)).otherwise(F.lit(0)) for k, i in enumerate(chosen)]
        return reduce(Column.bitwiseOR, bits)

    return texts.select("repo", "file", few.alias("_few")).select("repo", "file", placed(F.col("_few")).alias("border_mask")).filter("border_mask <> 0")


def _states(batches: Iterator[pa.RecordBatch], signatures: tuple[Signature, ...]) -> Iterator[pa.RecordBatch]:
    """Heads and tails with what the whole text does to matches; a file without a text is passed as if it were not there."""
    positions = _positions(signatures)
    for batch in batches:
        opens, does = [], []
        for folded in batch.column("_folded").to_pylist():
            out, inside = relation(positions, folded) if folded is not None else (None, None)
            opens.append(None if out is None else f"{out:x}")
            does.append(None if inside is None else inside.packed())
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(opens, pa.string()), pa.array(does, pa.string())],
                                         names=["repo", "file", "head", "tail", "opens", "does"])


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What all files of a block do; rows come by block, last file first."""
    def row(block: tuple, done: Relation | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"repo": pa.array([block[0]], pa.string()), "block": pa.array([block[1]], pa.int64()),
                                           "does": pa.array([done and done.packed()], pa.string())})

    block, done = None, None
    for batch in batches:
        for repo, number, does in zip(*(batch.column(c).to_pylist() for c in ("repo", "block", "does"))):
            if (repo, number) != block:
                if block is not None:
                    yield row(block, done)
                block, done = (repo, number), None
            if does is not None:
                own = Relation.unpacked(does)
                done = own if done is None else own.then(done)
    if block is not None:
        yield row(block, done)


def _behind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block the states from which a match becomes whole behind it; rows come by repository, last block first."""
    known, after = None, 0
    for batch in batches:
        out = []
        for repo, number, does in zip(*(batch.column(c).to_pylist() for c in ("repo", "block", "does"))):
            if repo != known:
                known, after = repo, 0
            out.append((repo, number, f"{after:x}"))
            after = after if does is None else Relation.unpacked(does).before(after)
        columns = zip(*out) if out else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string()))], names=["repo", "block", "behind"])


def _bordered(batches: Iterator[pa.RecordBatch], width: int, signatures: tuple[Signature, ...]) -> Iterator[pa.RecordBatch]:
    """The end of every file with what follows it, and the signatures whose matches go over its end; rows come by block, last file first."""
    positions = _positions(signatures)
    owners = [1 << positions.owner[p] for p in positions.crossing]
    block, ahead, after = None, "", 0
    names = ("repo", "block", "head", "file", "tail", "lent", "opens", "does", "behind")
    for batch in batches:
        out = []
        for repo, number, head, file, tail, lent, opens, does, behind in zip(*(batch.column(c).to_pylist() for c in names)):
            if (repo, number) != block:
                block, ahead, after = (repo, number), "", int(behind or "0", 16)
            if not lent and head is not None:
                over = int(opens, 16) & after
                crossed = reduce(int.__or__, (o for k, o in enumerate(owners) if over >> k & 1), 0)
                if ahead or crossed:
                    out.append((repo, file, ((head[1:] if tail is None else tail) + ahead) if ahead else None, crossed))
                after = Relation.unpacked(does).before(after)
            ahead = ((head or "") + ahead)[:width]
        columns = zip(*out) if out else ([], [], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int32()))],
                                         names=["repo", "file", "_border", "_crossed"])


def with_borders(profile: DataFrame, files: DataFrame, registry: Registry = DEFAULT, width: int = WIDTH) -> DataFrame:
    """``profile`` whose ``shortcut_mask`` also has what begins in the file and ends in a later one."""
    masks = border_masks(files, registry, width).select(F.col("repo").alias("_repo"), F.col("file").alias("_file"), "border_mask")
    joined = profile.join(masks, (F.col("repo") == F.col("_repo")) & (F.col("file") == F.col("_file")), "left")
    mask = F.col("shortcut_mask").bitwiseOR(F.coalesce("border_mask", F.lit(0)))
    return joined.withColumn("shortcut_mask", mask).select(*profile.columns)
