import pytest
from pyspark.sql import functions as F

from riskloom import registry as R
from riskloom.operators import advice, scores
from riskloom.plans.scan import scan

DIRTY = "name = request.args['n']\nvalue = eval(name)\npassword = 'abc123'\nx = 1  # TODO\n"


@pytest.fixture
def scanned(spark, files):
    df = files(("r", "App.py", DIRTY), ("r", "app.py", "verify = False"), ("r", "ok.py", "total = 1"), ("clean", "a.py", "total = 1"),
               ("low", "a.py", "y = 1  # TODO"), ("mid", "a.py", "verify = False"))
    risks = spark.createDataFrame(
        [("r", "App.py", "High Risk", 87.3), ("r", "app.py", "Medium Risk", 55.5), ("r", "ok.py", "Safe", 99.0),
         ("clean", "a.py", "Safe", 90.0), ("low", "a.py", "Medium Risk", 60.0)],
        "repo string, file string, ml_prediction string, confidence double")
    return scan(df, file_risks=risks)


def by(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_paths_differing_by_case_share_bonuses(scanned):
    got = by(scanned.prioritized, "repo", "file", "line")
    # chain, exposed input and the first label (High) hold for both spellings
    assert got["r", "App.py", 2].priority_score == 50 + 30 + 15 + 15
    assert got["r", "app.py", 1].priority_score == 25 + 30 + 15 + 15
    assert got["r", "App.py", 3].priority_score == 25 + 30 + 15 + 20 + 15
    assert got["r", "App.py", 4].priority == "High"
    assert got["mid", "a.py", 1].priority_score == 25
    assert scanned.prioritized.count() == scanned.findings.count()


def test_ranking_takes_the_last_label(scanned):
    got = by(scanned.ranked, "repo", "file")
    assert {got["r", f].ml_prediction for f in ("App.py", "app.py")} == {"Medium Risk"}
    assert got["r", "App.py"].composite_score == got["r", "app.py"].composite_score == 25 + 10 * 2 + 2 + 30 + 10
    assert got["r", "ok.py"].composite_score == 0 and got["mid", "a.py"].ml_prediction == "Safe"


def test_clean_repository_keeps_its_row(scanned):
    row = by(scanned.report, "repo")["clean",]
    assert (row.base_score, row.security_score, row.grade, row.summary_type, row.vibe_score) == (100, 100, "A", "success", 0)
    assert row.maturity_score == 100 and row.indicators == ["+ no findings of high or medium severity"]
    assert by(scanned.attack_surface, "repo")["clean",].total_entry_points == 0


def test_repository_scores(scanned):
    rows = by(scanned.report, "repo")
    r = rows["r",]
    assert (r.high, r.medium, r.low, r.secrets, r.chains) == (1, 2, 1, 1, 1)
    assert r.base_score == 100 - 25 - 20 - 2 and r.security_score == r.base_score - 20
    assert r.vibe_breakdown == {"High Severity Issues": 7, "Hardcoded Secrets": 8, "Attack Chains": 10,
                                "Insecure Shortcuts": 15, "Exposed Attack Surface": 0}
    assert r.maturity_score == 100 - 15 - 14 - 10
    want = {p: sum(x.priority == p and x.repo == "r" for x in scanned.prioritized.collect()) for p in R.PRIORITY_ORDER}
    assert {p: r[f"{p.lower()}_priority"] for p in R.PRIORITY_ORDER} == want
    assert r.grade_score == max(0, r.security_score - 8 * want["Critical"] - 3 * want["High"] - 5)
    assert rows["low",].summary_type == "info" and rows["low",].security_score == 98 - 10
    assert rows["mid",].summary_type == "warning"


def test_thresholds(spark):
    df = spark.createDataFrame([(v,) for v in (80, 79, 50, 49, 20, 19)], "v int")
    assert [r[0] for r in df.select(scores.priority_label(F.col("v"))).collect()] == \
        ["Critical", "High", "High", "Medium", "Medium", "Low"]


def test_texts(scanned):
    log = [r for r in scanned.scan_log.orderBy("seq").collect() if r.repo == "r"]
    assert [r.seq for r in log] == list(range(len(log))) and log[0].level == "INFO"
    assert any(r.level == "CRITICAL" and "path" in r.message for r in log)
    clear = [r.message for r in scanned.narrative.collect() if r.repo == "clean"]
    assert len(clear) == 1
    told = by(scanned.ml_explanations, "repo", "file")
    assert told["r", "App.py"].confidence_pct == 87 and "87%" in told["r", "App.py"].risk_summary
    assert told["low", "a.py"].key_indicators and ("r", "ok.py") not in told


def test_advice_falls_back(spark, scanned):
    issues = spark.createDataFrame([("SQL Injection (% formatting)",), ("Hardcoded Token",)], "issue string")
    got = by(advice.recommend(advice.explain(issues)), "issue")
    assert got["SQL Injection (% formatting)",].title.endswith("SQL Injection (% formatting)")
    assert got["Hardcoded Token",].why_dangerous and got["Hardcoded Token",].steps
    assert scanned.advice.count() == scanned.findings.select("repo", "issue").distinct().count()
    assert len(advice.catalogue()) == 23


def test_without_classifier_risks_are_unknown(files):
    assert scan(files(("r", "a.py", "x"))).risks.first().ml_prediction == "Unknown"
