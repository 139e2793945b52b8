"""The pipeline stage by stage, and the queries with SQL."""

import pytest

import corpus_pipeline as P
from catalog.check import compare
from riskloom.functions.durable import durable
from riskloom.llm import queries
from riskloom.llm.common import table

from test_decontaminate import held
from test_simhash import groups, plain_print


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, sf, name):
    assert compare(spark, sf, queries.QUERIES[name], queries.ORACLE[name]) == ""


def test_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_dedup", "decontamination", "mix", "shards"]


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns, seen = docs.columns, {}
    for name, stage in P.STAGES:
        before = docs
        docs = durable(stage(spark, docs, sf), "test-stage")
        seen[name] = (before.collect(), docs.collect())
        if name != "shards":
            assert docs.columns == columns
    model = queries.toxicity_model(spark, sf)
    scored = {r.doc_id: (r.s, r.t) for r in table(spark, sf, "documents").select("doc_id", P.toxic.score_column(spark, model).alias("s"), P.toxic.threshold_column(model).alias("t")).collect()}
    assert {r.doc_id for r in seen["toxicity"][1]} == {i for i, (s, t) in scored.items() if s < t}
    rows, kept = seen["near_dedup"]
    names = groups([r.doc_id for r in rows], [plain_print(r.text) for r in rows], 2)
    assert sorted(r.doc_id for r in kept) == sorted(set(names))
    rows, kept = seen["decontamination"]
    leaked = {i for i, _ in held([(r.doc_id, r.text) for r in rows], table(spark, sf, "benchmark").select("item_id", "text").collect())}
    assert leaked and sorted(r.doc_id for r in kept) == sorted(r.doc_id for r in rows if r.doc_id not in leaked)
    rows, kept = seen["mix"]
    assert {r.doc_id for r in kept} <= {r.doc_id for r in rows} and max(sum(k.doc_id == r.doc_id for k in kept) for r in rows) <= 2
    rows, kept = seen["shards"]
    assert sorted(r.doc_id for r in kept) == sorted(r.doc_id for r in rows)
    assert P.run(spark, sf).count() == len(kept)


def test_rows_of_every_kind(spark, sf, tmp_path):
    """Nulls in every column, empty texts, repeated rows and ids, a very long text: every stage runs and keeps the columns."""
    docs = table(spark, sf, "documents")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", "src0", 0), (900_001, "", None, None, None), (900_002, None, "en", None, 0), (900_003, "same text here", "en", "s", 14),
                                 (900_003, "same text here", "en", "s", 14), (900_003, "another text of that id", None, "s", 1), (900_004, "word " * 300_000, "en", "long", 1_500_000)], docs.schema)
    folder = str(tmp_path)
    docs.unionByName(odd).write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        table(spark, sf, name).write.parquet(f"{folder}/{name}.parquet")
    rows = table(spark, folder, "documents")
    for name, stage in P.STAGES:
        before, rows = rows, durable(stage(spark, rows, folder), "test-stage")
        own = [r.doc_id for r in rows.select("doc_id").collect()]
        if name == "toxicity":      # texts without words are kept, as often as they are there
            assert (own.count(None), own.count(900_001), own.count(900_002)) == (2, 1, 1)
        if name != "shards":
            assert rows.columns == docs.columns
        if name == "near_dedup":
            assert own.count(900_003) <= 2 and sum(i in (None, 900_001, 900_002) for i in own) <= 1      # texts without words are one group
        if name == "shards":
            assert len(own) == before.count()
    empty = spark.createDataFrame([], docs.schema)
    for name, stage in P.STAGES[1:]:
        assert stage(spark, empty, sf).count() == 0, name
