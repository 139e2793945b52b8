"""Mixing sources to target weights: weighted sampling without replacement, by Efraimidis and Spirakis, to token budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.durable import durable
from riskloom.llm.common import fresh, word_count

BUCKETS = 4096          # ranges of the sampling key, for each source
SHARE = 1.5             # of all words that the mix takes
CYCLE = (3, 1, 2)       # weights of the sources in their order
CAP = 2.0               # times its words that a source may give
SEED = "mix"


def text_quality(text: Column) -> Column:
    """Between 0.5 and 1.5: half plus the share of the text's characters that are letters or marks of any script; 0.5 for no text.

    Text of digits, symbols and white space is taken later than prose, in whatever script.
    """
    letters = F.length(F.regexp_replace(text, F.lit(r"[^\p{L}\p{M}]+"), F.lit("")))
    return F.coalesce(letters / F.nullif(F.length(text), F.lit(0)), F.lit(0.0)) + 0.5


def uniform(key: Column, seed: str = SEED) -> Column:
    """A number between 0 and 1, both excluded, that follows from the key alone."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary")), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def targets(sizes: DataFrame, share: float = SHARE, cap: float = CAP, cycle: tuple[int, ...] = CYCLE) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``, one row for each source.

    Weights go round over the sources by code point, null last.  A source's target is its weight's part of
    ``share`` of all words, at most ``cap`` times its words; what is cut off goes to the
    others by weight, until none is above.  That is one pass in the order of words for each unit of
    weight: a source is cut when what is left, shared out over it and all after it, would exceed its cap.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    weighed = sizes.withColumn("weight", F.element_at(weights, (F.row_number().over(order) - 1) % len(cycle) + 1))
    filled = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    after = filled.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    pool = weighed.select("*", (F.lit(share) * F.sum("source_size").over(everything)).alias("pool"),
                          F.coalesce(F.sum(F.lit(cap) * F.col("source_size")).over(before), F.lit(0.0)).alias("spent"),
                          F.sum("weight").over(after).alias("heavy"))
    level = (F.col("pool") - F.col("spent")) / F.col("heavy")
    place = F.row_number().over(filled)
    cut = pool.select("*", level.alias("level"), place.alias("place"), (level * F.col("weight") >= F.lit(cap) * F.col("source_size")).alias("cut"))
    # the first that is not cut and all after it share its level
    free = cut.withColumn("free", F.min(F.when(~F.col("cut"), F.struct("place", "level"))).over(everything))
    below = F.col("free").isNull() | (F.col("place") < F.col("free.place"))
    return free.select("source", "source_size", F.when(below, F.lit(cap) * F.col("source_size")).otherwise(F.col("free.level") * F.col("weight")).alias("target"))


def _plan(rows: DataFrame, share: float, cap: float, cycle: tuple[int, ...]) -> DataFrame:
    """For each source: words, target, complete epochs, and the last sampling key that the part epoch takes.

    ``rows`` has ``source, size, key, tie``.  Words are added up for each range of keys; only the range
    in which the budget ends is sorted, so a source with a third of all rows is never in one task.
    """
    ranges = durable(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "key-ranges")
    sizes = ranges.groupBy("source").agg(F.sum("words").alias("source_size"))
    goal = targets(sizes, share, cap, cycle)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(F.lit(1)).cast("long")
    goal = durable(goal.withColumn("epochs", epochs).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("source_size"))), "targets")
    run = Window.partitionBy("source").orderBy("bucket")
    running = ranges.withColumn("before", F.sum("words").over(run) - F.col("words"))
    same = running["source"].eqNullSafe(goal["source"])
    edge = running.join(goal, same).filter("before < rest AND before + words >= rest").select(
        running["source"], "bucket", "before", "rest")
    edge = durable(edge, "edges")
    near = rows.join(edge.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "before", "rest"),
                     F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    inside = Window.partitionBy("source").orderBy("key", "tie")
    added = near.withColumn("ahead", F.col("before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    # the document on the budget's end is taken when that comes nearer than leaving it
    last = added.filter(F.col("ahead") + F.col("size") / 2 <= F.col("rest")).groupBy(F.col("source").alias("s")).agg(F.max(F.struct("key", "tie")).alias("last"))
    whole = edge.select(F.col("source").alias("e"), F.col("bucket").alias("edge"))
    out = goal.join(whole, goal["source"].eqNullSafe(F.col("e")), "left").join(last, goal["source"].eqNullSafe(F.col("s")), "left")
    return durable(out.select("source", "source_size", "target", "epochs", F.coalesce("edge", F.when(F.col("rest") > 0, F.lit(BUCKETS)).otherwise(F.lit(-1))).cast("long").alias("edge"),
                              F.col("last.key").alias("last_key"), F.col("last.tie").alias("last_tie")), "mix-plan")


KEYED = ("source", "size", "key", "bucket", "tie")
ADDED = ("size", "source_size", "target", "epochs", "taken", "times")


def _keyed(docs: DataFrame, names: dict[str, str], doc_id: str, source: str, text: str, quality: Column | None, seed: str,
           kept: list[Column] | None = None) -> DataFrame:
    """``docs`` (or the kept columns) with size and sampling key: exponential, scaled by quality, so that the smallest keys are a weighted sample."""
    body, id_ = F.col(f"`{text}`").cast("string"), F.col(f"`{doc_id}`")
    weight = text_quality(body) if quality is None else quality
    key = F.when(F.coalesce(weight, F.lit(0.0)) > 0, -F.log(uniform(id_, seed)) / weight).otherwise(F.lit(float("inf")))
    whole = [F.col(f"`{c}`") for c in docs.columns] if kept is None else kept
    out = docs.select(*whole, F.col(f"`{source}`").cast("string").alias(names["source"]), word_count(body).alias(names["size"]),
                      key.alias(names["key"]), F.xxhash64(id_, body).alias(names["tie"]))
    return out.withColumn(names["bucket"], F.floor((1 - F.exp(-F.col(names["key"]))) * BUCKETS).cast("long"))


def mix(docs: DataFrame, share: float = SHARE, cap: float = CAP, cycle: tuple[int, ...] = CYCLE, doc_id: str = "doc_id",
        source: str = "source", text: str = "text", quality: Column | None = None, seed: str = SEED) -> DataFrame:
    """``docs`` with ``size, source_size, target, epochs, taken`` (longer names where these exist): how often and how much the mix takes.

    A document counts its words.  Every source gives as many complete epochs as fit in its target, then, for the rest,
    the documents with the smallest keys until the budget is reached, so a document is taken ``epochs`` times or once more.

    Null texts have no words and null ids share one random number; sources may be null, a source of its own.  A weight
    of 0 or null comes last.  Documents without words are taken like others but move no budget.  Rows that agree in id
    and text tie: at the budget's end all or none of them are taken.  An empty table gives no rows; other columns stay.
    """
    inner = dict(zip(KEYED, fresh(docs, *(f"mix_{c}" for c in KEYED))))
    keyed = _keyed(docs, inner, doc_id, source, text, quality, seed)
    plan = _plan(durable(keyed.select(*[F.col(inner[c]).alias(c) for c in KEYED]), "mix-keys"), share, cap, cycle)
    return _taken(keyed, plan, docs.columns, inner, dict(zip(ADDED, fresh(docs, *ADDED))))


def allot(docs: DataFrame, share: float = SHARE, cap: float = CAP, cycle: tuple[int, ...] = CYCLE, doc_id: str = "doc_id",
          source: str = "source", text: str = "text", quality: Column | None = None, seed: str = SEED) -> DataFrame:
    """``mix`` without the documents' own columns but the id: ``(doc_id, size, source_size, target, epochs, taken, times)``.  Texts are read once."""
    keyed = _keyed(docs, dict(zip(KEYED, KEYED)), doc_id, source, text, quality, seed, [F.col(f"`{doc_id}`").alias("doc_id")])
    rows = durable(keyed, "mix-keys")
    own = dict(zip(KEYED, (f"mix_{c}" for c in KEYED)))
    return _taken(rows.withColumnsRenamed(own), _plan(rows, share, cap, cycle), ["doc_id"], own, dict(zip(ADDED, ADDED)))


def _taken(keyed: DataFrame, plan: DataFrame, kept: list[str], inner: dict[str, str], names: dict[str, str]) -> DataFrame:
    """The rows with what the plan takes of each; the plan has one row a source and Spark broadcasts it when its file is small."""
    own = dict(zip(plan.columns, fresh(keyed, *(f"plan_{c}" for c in plan.columns))))
    joined = keyed.join(plan.withColumnsRenamed(own), F.col(inner["source"]).eqNullSafe(F.col(own["source"])))
    key, bucket, edge = F.col(inner["key"]), F.col(inner["bucket"]), F.col(own["edge"])
    last = F.struct(F.col(own["last_key"]), F.col(own["last_tie"]))
    first = (bucket < edge) | ((bucket == edge) & F.col(own["last_key"]).isNotNull() & (F.struct(key, F.col(inner["tie"])) <= last))
    times = F.col(own["epochs"]) + F.coalesce(first, F.lit(False)).cast("long")
    made = {"size": F.col(inner["size"]), "source_size": F.col(own["source_size"]), "target": F.col(own["target"]), "epochs": F.col(own["epochs"]),
            "taken": times * F.col(inner["size"]), "times": times}
    return joined.select(*[F.col(f"`{c}`") for c in kept], *[made[c].alias(names[c]) for c in ADDED])


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix: every row as often as it is taken, all columns as they are."""
    times = fresh(docs, "times")[0]
    each, = fresh(docs, "each")
    found = mix(docs, **options)
    return found.filter(F.col(times) > 0).withColumn(each, F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])
