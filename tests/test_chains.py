import random
import re

from pyspark.sql import functions as F

from riskloom import registry as R
from riskloom.operators import chains, hits, lines, rollup


def facts(files):
    return hits.line_facts(lines.lines(files))


def pairs(files):
    return {(r.file, r.line, r.source, r.sink, r.source_line) for r in chains.attack_chains(facts(files)).collect()}


def brute_force(file: str, content: str) -> set:
    """Every source and sink pair of one file, by definition."""
    sources, sinks = [], []
    for n, raw in enumerate(content.split("\n"), 1):
        code = raw.strip()
        if not code or code.startswith(("#", "//")):
            continue
        sources += [(n, s.name) for s in R.SOURCES if re.search(s.pattern, code, re.I)]
        sinks += [(n, s.name) for s in R.SINKS if re.search(s.pattern, code, re.I)]
    best = {}
    for kn, k in sinks:
        for sn, s in sources:
            if 0 <= kn - sn <= 15:
                key = (file, kn, s, k)
                value = 0 if sn == kn else sn
                best[key] = min(best.get(key, value), value)
    return {(*key, value or None) for key, value in best.items()}


def gap(n: int) -> str:
    return "user_input\n" + "x\n" * (n - 1) + "eval(a)"


def test_window_is_fifteen_lines(files):
    assert pairs(files(("r", "a", gap(15)))) == {("a", 16, "user_input", "eval()", 1)}
    assert pairs(files(("r", "a", gap(16)))) == set()


def test_same_line_wins_and_earliest_source_line_counts(files):
    assert pairs(files(("r", "a", "payload\npayload\neval(payload)"))) == {("a", 3, "payload", "eval()", None)}
    assert pairs(files(("r", "a", "payload\npayload\neval(b)"))) == {("a", 3, "payload", "eval()", 1)}


def test_a_later_source_and_another_file_do_not_count(files):
    assert pairs(files(("r", "a", "eval(b)\npayload"), ("r", "b", "payload"), ("s", "a", "payload"))) == set()


def test_long_file_across_blocks_equals_brute_force(files, monkeypatch):
    monkeypatch.setattr(chains, "BLOCK_LINES", 32)
    rng = random.Random(7)
    options = ["payload", "cmd = x", "eval(b)", "eval(payload)", "os.system(q)", "x", "", "# payload", "request.args", "f.save(p)"]
    content = "\n".join(rng.choice(options) for _ in range(400))
    want = brute_force("a", content)
    got = files(("r", "a", content))
    assert pairs(got) == want and len(want) > 100
    counted = rollup.count_by_file_key(chains.reach(facts(got))).first()
    assert counted.chains == len(want)
    by_type = {}
    kinds = {s.name: s.kind for s in R.SINKS}
    for _, _, _, sink, _ in want:
        by_type[kinds[sink]] = by_type.get(kinds[sink], 0) + 1
    assert {k: counted[c] for k, c in rollup.ATTACK_COLUMNS.items() if counted[c]} == by_type


def test_order_is_by_danger_then_file(files):
    content = "f.save(payload)\nx = 'select' + query = payload\nos.system(payload)\nyaml.load(payload)\nrender_template_string(payload)\neval(payload)"
    rows = chains.order_chains(chains.attack_chains(facts(files(("r", "b", content), ("r", "a", "eval(payload)"))))).collect()
    ranks = [R.ATTACK_ORDER.index(r.attack_type) for r in rows]
    assert ranks == sorted(ranks) and rows[0].file == "a"


def test_clean_file_changes_nothing(files):
    dirty = ("r", "a", gap(3))
    assert pairs(files(dirty)) == pairs(files(dirty, ("r", "z", "total = 1")))


def test_no_shuffle_before_the_window(spark, files):
    plan = chains.attack_chains(facts(files(("r", "a", "x"))))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_summary(files):
    rows = chains.chain_summary(chains.attack_chains(facts(files(("r", "a", "eval(payload)\nexec(payload)"))))).collect()
    assert [(r.repo, r.attack_type, r.chains) for r in rows] == [("r", R.RCE, 2)]


def test_masks_become_rows(files):
    got = hits.source_hits(facts(files(("r", "a", "cmd = payload"))))
    assert {r.source for r in got.collect()} == {"cmd", "payload"}
    assert hits.sink_hits(facts(files(("r", "a", "eval(exec(x))")))).select(F.col("sink")).count() == 2
