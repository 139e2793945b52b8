import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from riskloom import registry as R
from riskloom.functions.durable import durable
from riskloom.plans.scan import Scan, scan
from riskloom.sinks import export


@pytest.fixture(scope="module")
def result(spark):
    rows = [("r", f"f{i:03d}.py", "q = request.args\neval(q)\nx = 1 # TODO\n") for i in range(120)] + [("s", "a.py", "verify=False")]
    df = spark.createDataFrame([(*r, len(r[2])) for r in rows], "repo string, file string, content string, size_bytes bigint")
    risks = df.selectExpr("repo", "file", "'High Risk' AS ml_prediction", "50.0D AS confidence")
    return scan(df, file_risks=risks)


def test_bundle_caps_per_repository(result):
    bundle = export.result_bundle(result, R.RESULT_CAPS)
    counts = {name: {r.repo: r["count"] for r in part.groupBy("repo").count().collect()} for name, part in bundle.items()
              if name in ("findings", "prioritized_findings", "entry_points", "attack_chains", "ranked_files", "file_risks")}
    assert counts == {
        "findings": {"r": 200, "s": 1}, "prioritized_findings": {"r": 200, "s": 1}, "entry_points": {"r": 100},
        "attack_chains": {"r": 50}, "ranked_files": {"r": 50, "s": 1}, "file_risks": {"r": 10, "s": 1}}
    first = sorted((r.file, r.line) for r in bundle["findings"].collect() if r.repo == "r")
    assert first == [(f"f{i:03d}.py", n) for i in range(100) for n in (2, 3)]
    assert len(bundle) == 18


def test_bundle_on_disk(spark, result, tmp_path):
    names = export.write_bundle(result, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/findings").count() == 241 and len(names) == 18
    assert spark.read.parquet(f"{tmp_path}/attack_chains").count() == result.chain_rows.count() > 50
    export.write_bundle(result, str(tmp_path), {"findings": 7})
    assert spark.read.parquet(f"{tmp_path}/findings").count() == 8
    assert spark.read.parquet(f"{tmp_path}/fingerprint").count() == 2


def test_csv(spark, result, tmp_path):
    export.write_findings_csv(result.top_prioritized(5), str(tmp_path / "csv"))
    back = spark.read.csv(str(tmp_path / "csv"), header=True)
    assert back.count() == 6 and {"issue", "priority", "priority_score", "file"} <= set(back.columns)
    with pytest.raises(ValueError):
        export.write_findings_csv(result.prioritized.filter("false"), str(tmp_path / "none"))


def test_json(result, tmp_path):
    export.write_json(result, str(tmp_path / "json"), R.RESULT_CAPS)
    rows = {r["repo"]: r for f in (tmp_path / "json").glob("*.txt") for r in map(json.loads, f.read_text().splitlines())}
    assert set(rows) == {"r", "s"} and all(set(r) == {"repo", *export.EXTRACT} for r in rows.values())
    assert len(rows["r"]["attack_chains"]) == 50 and rows["r"]["attack_chains"][0]["file"] == "f000.py"
    assert rows["s"]["attack_chains"] == [] and rows["s"]["fingerprint"]["total_files"] == 1
    with pytest.raises(ValueError):
        export.write_json(result, str(tmp_path / "none"), {})
    export.write_json_lines(result, str(tmp_path / "lines"))
    records = [json.loads(line) for f in (tmp_path / "lines").glob("*.json") for line in f.read_text().splitlines()]
    assert sum(r["part"] == "prioritized_findings" for r in records) == 241


def test_json_objects_of_any_length(spark, result, tmp_path):
    """The files of a repository in order are one object: its lists are whole, ordered, and lie over several files."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        export.write_json_objects(result, str(tmp_path / "objects"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    found = {}
    for folder in (tmp_path / "objects").glob("repo=*"):
        files = sorted(folder.glob("part-*"))
        found[folder.name] = (json.loads("".join(f.read_text() for f in files)), len(files))
    assert set(found) == {"repo=r", "repo=s"} and (tmp_path / "objects" / "_SUCCESS").exists()
    r, files = found["repo=r"]
    assert list(r) == ["repo", *export.EXTRACT] and r["repo"] == "r" and files > 1
    want = [(x.file, x.line, x.priority) for x in sorted((x for x in result.priority_positions().collect() if x.repo == "r"), key=lambda x: x.position)]
    assert [(x["file"], x["line"], x["priority"]) for x in r["prioritized_findings"]] == want and len(want) == 240
    assert len(r["attack_chains"]) == result.chain_rows.filter("repo = 'r'").count() > 50
    assert found["repo=s"][0]["attack_chains"] == [] and found["repo=s"][0]["fingerprint"]["total_files"] == 1


def test_contents_are_read_once_for_facts_and_profile(spark):
    """Matching lines and file profiles come from one pass over the contents, files without content or lines included."""
    texts = [None, "", "\n", "q = request.args\r\neval(q)\n\n", "# x\x0bimport a\u2028def f():\n  pass\u3000", "password\n=\n'abc'", "plain", "eval(" + "x" * 300]
    rows = [("r" if i % 2 else None, f"f{i}.py", t, len(t or "")) for i, t in enumerate(texts)]
    seen = spark.sparkContext.accumulator(0)

    def read(content):
        seen.add(1)
        return content

    df = spark.createDataFrame(rows, "repo string, file string, content string, size_bytes bigint")
    counted = df.withColumn("content", F.udf(read, "string").asNondeterministic()("content"))
    apart = scan(df, code_width=100)
    with scan(counted, file_risks=apart.risks, store=("facts", "profile", "counts"), code_width=100) as stored:
        got = {n: getattr(stored, n) for n in ("facts", "profile")}
        for name, table in got.items():
            want = getattr(apart, name)
            assert table.dtypes == want.dtypes
            assert sorted(map(str, table.collect())) == sorted(map(str, want.collect())), name
        assert got["profile"].count() == len(rows) and got["facts"].count() == 3
        assert export.json_extract(stored).count() == export.json_extract(apart).count()
        assert seen.value == len(rows)


def test_extract_counts_once_and_parses_once(spark, result):
    """Matches are summed up per file once for all parts, and a record is parsed once for all its fields."""
    from catalog.scan_queries import _parsed_records

    def fields(scanned):
        return sorted(map(str, _parsed_records(export.json_extract(scanned)).collect()))

    tables = {n: getattr(result, n) for n in ("facts", "profile", "risks")}
    with Scan(**tables, store=("facts", "profile", "counts")) as stored:
        out = _parsed_records(export.json_extract(stored))
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Window [") == 1 and "get_json_object" not in plan and "json_tuple" in plan
        assert fields(stored) == fields(result) and len(fields(stored)) > 300
    record = '{"file":"a \\"b\\".py","line":7,"issue":"x","priority":null,"priority_score":150,"other":{"issue":"y"}}'
    rows = spark.createDataFrame([("r", "prioritized_findings", record), ("r", "stats", "{")], "repo string, part string, record string")
    assert [tuple(r) for r in _parsed_records(rows).collect()] == [
        ("r", "prioritized_findings", 'a "b".py', 7, "x|150"), ("r", "stats", None, None, "")]


def test_lazy_unless_stored(spark, tmp_path, monkeypatch):
    from riskloom.plans import scan as plan
    written = []
    monkeypatch.setattr(plan, "durable", lambda df, name, paths: written.append(name) or durable(df, name, paths))
    df = spark.createDataFrame([("r", "a.py", "q = request.args\neval(q)\n", 20)], "repo string, file string, content string, size_bytes bigint")
    lazy = scan(df)
    assert lazy.report.count() == 1 and lazy.attack_surface.count() == 1 and written == []
    with scan(df, store=("facts",)) as stored:
        assert stored.prioritized.count() == 1 and stored.fingerprint.count() == 1
        assert written == ["facts"] and Path(stored._written[0].removeprefix("file:")).exists()
        path = stored._written[0].removeprefix("file:")
    assert not Path(path).exists()
    with pytest.raises(ValueError):
        scan(df, store=("fact",))


def test_report_sections(result):
    rows = [r for r in export.report_sections(result).collect() if r.repo == "r"]
    assert {s: sum(r.section == s for r in rows) for s in (1, 2, 3, 4)} == {1: 7, 2: 10, 3: 5, 4: 5}
    assert any(r.text == "security_grade: F" for r in rows)
