import pytest
from pyspark.sql import functions as F

from riskloom.operators import labels
from riskloom.sources import samples as readers

H, M, S = "High Risk", "Medium Risk", "Safe"


def apply(spark, rule, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(rule(F.col("v"))).collect()]


def test_name_rule_and_its_traps(spark):
    got = apply(spark, labels.from_name, "SQL Injection", "not vulnerable", "insecure random", "source", "cwe-798", " Patched ", "zzz", "", None)
    # "vulnerable" is in "not vulnerable", "secure" in "insecure", "rce" in "source", "cwe-79" in "cwe-798"
    assert got == [H, H, S, H, H, S, None, None, None]


def test_weakness_rule(spark):
    got = apply(spark, labels.from_cwe, "CWE-89", "secure", "insecure", "0", "False", "csrf", "1", "TRUE", "vulnerable", "2", None)
    assert got == [H, S, None, S, S, M, H, H, H, None, None]


def test_type_rule_defaults_to_high(spark):
    assert apply(spark, labels.from_type, "csrf", "resource debug", "anything", "") == [M, H, H, H]


def test_flags(spark):
    got = apply(spark, labels.from_flag, "1", " 01 ", "+1", "0", "7", "-1", "99999999999999999999999", "1.0", "Yes", "clean", "x", None)
    assert got == [H, H, H, S, S, S, S, None, H, S, None, None]


def test_dispatch(spark):
    assert apply(spark, labels.from_name_or_flag, "0", "1", "01", "xss") == [S, H, None, H]
    assert apply(spark, labels.from_type_or_flag, "True", "clean", "CLEAN", "csrf") == [H, S, H, M]


def test_cleaners(spark):
    assert apply(spark, labels.clean_code, " a\\nbcd ", "nan", "None", "", "abcd", "x" * 1600, None) == \
        ["a\nbcd", None, None, None, None, "x" * 1600, None]
    assert apply(spark, labels.plain_code, " abcde ", "nan", "abcd", "x" * 2100, "None!") == ["abcde", None, None, "x" * 2100, "None!"]


def test_languages(spark):
    assert apply(spark, labels.allowed_language, " Python ", "", None, "cobol", "C++") == [True, True, False, False, True]


def test_column_discovery():
    columns = ["ID", "Vulnerability_Type", "vulnerable_Code", "Fixed"]
    assert labels.find_column(columns, ("code",)) == "vulnerable_Code"
    assert labels.find_column(columns, ("vuln",), without=("type",)) == "vulnerable_Code"
    assert labels.find_column(columns, ("type", "label")) == "Vulnerability_Type"
    assert labels.find_column(columns, ("snippet",)) is None


def test_chunks_overlap(spark):
    content = "\n".join(f"line {i:02d}" for i in range(10)) + "\n\n"
    df = spark.createDataFrame([("f", content), ("empty", ""), ("short", "abc")], "file string, content string")
    rows = {(r.file, r.chunk): r.code.split("\n") for r in labels.line_chunks(df, "content", ("file",)).collect()}
    assert sorted(rows) == [("f", 0), ("f", 1), ("f", 2)]
    assert rows["f", 1] == [f"line {i:02d}" for i in range(4, 10)] and rows["f", 2] == ["line 08", "line 09"]


@pytest.fixture
def csv(tmp_path):
    def write(name, text):
        (tmp_path / name).write_text(text, encoding="utf-8")
        return str(tmp_path / name)
    return write


def test_training_csv(spark, csv):
    path = csv("t.csv", 'code,label\n"a = ""x""\nb = 1"," Safe "\n"  ","Safe"\n"c = 2",""\n')
    assert [tuple(r) for r in readers.read_training_csv(spark, path).collect()] == [('a = "x"\nb = 1', "Safe")]


def test_training_csv_round_trip(spark, tmp_path):
    from riskloom.sinks.export import write_training_csv

    rows = [('say "hi"\nback\\slash, comma', H), ("plain", S)]
    write_training_csv(spark.createDataFrame(rows, "code string, label string"), str(tmp_path / "out"))
    assert sorted(map(tuple, readers.read_training_csv(spark, str(tmp_path / "out")).collect())) == sorted(rows)


def test_directory_of_csv_files(spark, csv, tmp_path):
    csv("a.csv", "snippet,target,other\nevaluate it,1,x\nharmless,0,y\n")
    csv("b.txt", "not,a,table\n")
    df = readers.read_csv(spark, str(tmp_path), ("snippet", "target"))
    assert set(df.columns) == {"snippet", "target", "origin"}
    assert {tuple(r) for r in readers.discovered_samples(df).collect()} == {("evaluate it", H), ("harmless", S)}


def test_json_array_and_object(spark, csv, tmp_path):
    csv("a.json", '[{"code": "x = eval(a)", "CWE": "cwe-94", "secure_code": "x = parse(a)"}, {"Insecure_code": "y = run(b)"}]')
    csv("b.json", '{"code": "one = object", "CWE": "csrf"}')
    got = {tuple(r) for r in readers.weakness_records(readers.read_json(spark, str(tmp_path))).collect()}
    assert got == {("x = eval(a)", H), ("x = parse(a)", S), ("y = run(b)", H), ("one = object", M)}


def test_fix_pairs(spark):
    df = spark.createDataFrame([("csrf", "old code", "old code"), ("odd", "bad code", "good code"), (None, "abc", None)],
                               "category string, before string, after string")
    assert sorted(map(tuple, readers.curated_fix_pairs(df).collect())) == sorted(
        [("old code", M), ("old code", S), ("bad code", H), ("good code", S)])
    cve = df.withColumnsRenamed({"category": "vuln_type", "before": "vulnerable_code", "after": "patched_code"}).withColumn("language", F.lit("Go"))
    assert sorted(map(tuple, readers.cve_fix_pairs(cve).collect())) == sorted([("old code", M), ("bad code", H), ("good code", S)])


def test_unlabelled(spark):
    df = spark.createDataFrame([("some code",)], "code string")
    assert readers.typed_samples(df).first().label == H and readers.flagged_samples(df).first().label == H
    assert readers.discovered_samples(df).count() == 0
    with pytest.raises(ValueError):
        readers.typed_samples(df.withColumnRenamed("code", "body"))


def test_every_file_is_read_with_its_own_header(spark, csv, tmp_path):
    csv("a.csv", "code,label\nfoo(1) one,sqli\n")
    csv("b.csv", "label,code\nsafe,foo(2) two\n")
    csv("c.csv", "id,snippet,target\n7,foo(3) three,1\n8,foo(9) nine\n")
    csv("d.csv", "code,label,extra\nfoo(4) four,csrf,x\nfoo(5) five,csrf,x,too many\nfoo(6) six\n")
    csv("e.csv", "name,size\nno code here,3\n")
    table = readers.read_csv(spark, str(tmp_path))
    assert set(table.columns) == {"code", "label", "id", "snippet", "target", "extra", "name", "size", "origin"}
    rows = {(r.code, r.label, r.id, r.snippet, r.target, r.extra) for r in table.filter("name IS NULL").collect()}
    assert rows == {("foo(1) one", "sqli", None, None, None, None), ("foo(2) two", "safe", None, None, None, None), (None, None, "7", "foo(3) three", "1", None),
                    (None, None, "8", "foo(9) nine", None, None), ("foo(4) four", "csrf", None, None, None, "x"), ("foo(6) six", None, None, None, None, None)}
    got = {tuple(r) for r in readers.read_samples(spark, str(tmp_path), readers.discovered_samples).collect()}
    assert got == {("foo(1) one", H), ("foo(2) two", S), ("foo(3) three", H), ("foo(4) four", M)}
    with pytest.raises(ValueError):
        readers.read_samples(spark, str(tmp_path), readers.discovered_samples, "e.csv")


def test_training_csv_by_name(spark, csv):
    path = csv("t.csv", "label,code\nSafe,x = 1\n")
    assert [tuple(r) for r in readers.read_training_csv(spark, path).collect()] == [("x = 1", "Safe")]
    with pytest.raises(ValueError):
        readers.read_training_csv(spark, csv("u.csv", "text,label\na,b\n"))


def test_json_fields_keep_their_order(spark, csv, tmp_path):
    csv("a.json", '[{"target": "1", "snippet": "run(x) now", "a_code_id": 77777}]')
    table = readers.read_json(spark, str(tmp_path))
    assert table.columns == ["target", "snippet", "a_code_id", "origin"]
    assert [tuple(r) for r in readers.discovered_samples(table).collect()] == [("run(x) now", H)]


def test_missing_language_is_not_allowed(spark):
    df = spark.createDataFrame([(None,), ("",), ("Go",), ("perl",)], "language string")
    assert [r.language for r in df.filter(labels.allowed_language(F.col("language"))).collect()] == ["", "Go"]


def test_nothing_is_cut_unless_asked(spark):
    df = spark.createDataFrame([("x" * 5000,)], "code string")
    row = df.select(labels.clean_code(F.col("code")).alias("a"), labels.plain_code(F.col("code")).alias("b"), labels.plain_code(F.col("code"), 2000).alias("c")).first()
    assert (len(row.a), len(row.b), len(row.c)) == (5000, 5000, 2000)
