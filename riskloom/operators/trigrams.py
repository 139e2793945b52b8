"""Substring search through an inverted index of trigrams instead of a scan of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.durable import durable, remove
from riskloom.operators.samples import rows_at

BLOCK = 1 << 15         # rows of which one posting list tells the places


class TrigramIndex:
    """Rows with a number, and for each trigram of the given columns (in lower case) the numbers of the rows that have it.

    Rows are numbered by the tasks that write them.  A posting list covers a block of ``BLOCK`` rows; lists lie in files sorted by
    trigram, so a search reads the row groups of its trigrams only, and of the rows those whose numbers remain.  ``close``, or
    the end of a ``with`` block, deletes the index.
    """

    def __init__(self, rows: DataFrame, columns: tuple[str, ...]):
        self.spark, self.columns, self._names = rows.sparkSession, columns, rows.columns
        self._written: list[str] = []
        self.rows = durable(rows.withColumn("_row", F.monotonically_increasing_id()), "indexed-rows", self._written)
        # a line break lies between two columns, and no trigram goes over it
        text = F.lower(F.concat_ws("\n", *[F.col(c) for c in columns]))
        starts = F.sequence(F.lit(1), F.length("_text") - 2)
        grams = F.when(F.length("_text") >= 3, F.array_distinct(F.transform(starts, lambda i: F.substring("_text", i, F.lit(3)))))
        held = self.rows.select("_row", F.inline(F.array(F.struct(text.alias("_text"))))).select("_row", F.explode(grams).alias("gram")).filter(~F.contains("gram", F.lit("\n")))
        block = F.shiftright("_row", 15).alias("block")
        lists = held.groupBy("gram", block).agg(F.sort_array(F.collect_list(F.col("_row").bitwiseAND(F.lit(BLOCK - 1)).cast("int"))).alias("places"))
        self.lists = durable(lists.repartitionByRange("gram", "block").sortWithinPartitions("gram", "block"), "posting-lists", self._written)

    def __enter__(self) -> TrigramIndex:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        remove(self.spark, self._written)
        self._written.clear()

    def candidates(self, wanted: str) -> DataFrame | None:
        """``_row`` of the rows with all trigrams of a text; None when it has none."""
        low = wanted.lower()
        grams = sorted({low[k:k + 3] for k in range(len(low) - 2)})
        if not grams or "\n" in low:
            return None
        lists = self.lists.filter(F.col("gram").isin(grams)).groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.collect_list("places").alias("lists"))
        common = F.aggregate(F.slice("lists", 2, len(grams)), F.get("lists", F.lit(0)), F.array_intersect)
        return lists.filter(F.col("n") == len(grams)).select(F.explode(F.transform(common, lambda place: F.shiftleft(F.col("block"), 15) + place)).alias("_row"))

    def containing(self, wanted: str) -> DataFrame:
        """The rows of which a column contains the text, whatever its case; texts of fewer than three letters are looked for in all rows."""
        found = self.candidates(wanted)
        rows = self.rows if found is None else rows_at(self.rows, found, ["_row"])
        holds = F.lit(False)
        for c in self.columns:
            holds = holds | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(wanted.lower())), F.lit(False))
        return rows.filter(holds).select(*self._names)
