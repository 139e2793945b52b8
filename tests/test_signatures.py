"""Every signature against Python's own regular expressions."""

import re

import pytest
from pyspark.sql import functions as F

from catalog.corpus import SNIPPETS
from riskloom import prose
from riskloom import registry as R
from riskloom.plans.scan import scan
from riskloom.functions import matching
from riskloom.operators import hits, lines

# At least one hit per signature, in registry order.
POSITIVE = {
    "vulnerabilities": [
        "x = eval(a)", "exec (a)", "os.system('ls')", "subprocess.getoutput('x')", "pickle.loads(b)", "yaml.load(f)",
        "render_template_string(t)", "redirect( request.values['x'])", "q = 'select a' + b", "f'{x} FROM t WHERE {y}'",
        "'delete from t'.format(a)", "\"insert into t\" % a", "{'$where': data}", "db.find( input", "pwd = 'abc'",
        "api-key = 'abcdef'", "bearer = 'abcdef'", "secret_key = 'abc'", "verify = False", "hashlib.md5(x)",
        "hashlib.sha1 (x)", "random.choice(x)", "app.run(port=1, debug = True)", "cors_origin: '*'", "x = 1 # FIXME",
    ],
    "entries": ["req.body", "$_POST", "req.query", "upload_folder", "request.cookies", "Scanner( System.in )",
                "@api.patch('/x')", "app.all('/x')", "$_SERVER['x']"],
    "sources": ["request.args", "request.form", "request.json", "request.files", "req.body", "$_GET", "$_POST", "$_REQUEST",
                "input (", "sys.argv", "user_input", "user_data", "data =", "payload", "cmd=", "query  ="],
    "sinks": ["eval(", "exec(", "os.system(", "subprocess.run(", "os.popen(", "pickle.loads(", "yaml.load(",
              "f'select {a}", "update t + 1", "open( req", "x.save(", "render_template_string("],
    "shortcuts": ["eval( my_request)", "token = 'abc'", "except :", "shell = True", "print('password')", "'select' + x",
                  "verify=False", "Access-Control-Allow-Origin: *", "md5(password", "# skip the auth"],
}
REGISTRIES = {"vulnerabilities": R.VULNERABILITIES, "entries": R.ENTRY_POINTS, "sources": R.SOURCES, "sinks": R.SINKS,
              "shortcuts": R.SHORTCUTS}
# Near misses and characters on which engines disagree.
TRICKY = [
    "evaluate(x)", "my_eval(x)", "éeval(x)", "x.eval(y)", "eval\u00a0(x)", "eval\x1f(x)", "eval\x85(x)", "EVAL(x)",
    "yaml.safe_load(x)", "os_system(x)", "xos.system(x)", "pa\u017f\u017fword = 'abc'", "to\u212aen = 'abcdefg'",
    "ver\u0131fy = False", "VER\u0130FY = FALSE", "\u0130nput(", "payloads", "apayload", "_payload", "payload2", "payload\u00b2",
    "pwd = 'ab'", "pwd = 'a\"b'", "DEBUG=TRUE", "debugger", "xdebug", "TEMPERATURE", "temp", "a temp b", "hack\u0301", "hack.",
    "request", "requests.args", "request.argsx", "json( )", "json()", "'select' \n + x", "$where", "$wherever user",
    "{request $", "{ user.name }", ".find(x)", "random.randint", "brandom.choice(x)", "random.random ()",
    "cors allowed origin = *", "ALLOWED_HOSTS=['*']", "ALLOWED_HOSTS = '*'", "access-control-allow-origin:*",
    "\u00df eval(", "ΑΣ = verify=false", "f\"from a where {x}\"", "rf'from  a  where  {x}'", "from a where {x}",
    "query==1", "dataset = 1", "mydata = 1", "data\u2003= 1", "subprocess.callx(", "subprocess.call\t(", "open(request", "reopen(request",
    "open($_", "#bypass login", "// remove this\n check", "except\n:", "password\n=\n'abc'", "'select' + '", "plain prose", "",
]


def cases():
    return [c for group in POSITIVE.values() for c in group] + TRICKY + list(SNIPPETS)


@pytest.mark.parametrize("name", REGISTRIES)
def test_positive_examples_are_positive(name):
    for signature, example in zip(REGISTRIES[name], POSITIVE[name], strict=True):
        assert re.search(signature.pattern, example, re.IGNORECASE), signature.name


@pytest.mark.parametrize("name", REGISTRIES)
def test_matches_what_python_matches(spark, name):
    registry = REGISTRIES[name]
    texts = cases() if name == "shortcuts" else [t for t in cases() if "\n" not in t]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, code string") \
        .withColumn("folded", matching.fold(F.col("code"))).withColumn("trigger", matching.triggers())
    if name == "shortcuts":
        mask = hits.shortcut_mask()
    else:
        mask = F.when(matching.may_match(), F.expr(matching.match_mask(registry))).otherwise(0)
    got = {r.i: r.m for r in rows.select("i", mask.alias("m")).collect()}
    for i, t in enumerate(texts):
        want = sum(1 << k for k, s in enumerate(registry) if re.search(s.pattern, t, re.IGNORECASE))
        assert got[i] == want, (t, got[i], want)


def test_words_are_looked_for_beside_their_symbols(spark):
    """A word without the symbols that its signatures need is not looked for; every signature still matches what it matched."""
    own = R.Signature("Own", r"frob\s*@", ("frob", "at"))
    wide = R.Registry(vulnerabilities=(*R.VULNERABILITIES, own), triggers={**R.TRIGGERS, "frob": ("frob",), "at": ("@",)})
    for registry in (R.DEFAULT, wide):
        rows = spark.createDataFrame([(t,) for t in (*cases(), "frob @", "frob", "@ frob")], "code string") \
            .withColumn("folded", matching.fold(F.col("code"))).withColumn("all_triggers", matching.triggers(registry=registry)) \
            .withColumn("symbols", F.expr(matching.symbols_sql(registry=registry))) \
            .withColumn("trigger", F.expr(matching.words_sql(registry=registry)))
        signatures = (registry.vulnerabilities, registry.entry_points, registry.sources, registry.sinks)
        both = [F.expr(matching.match_mask(s, trigger=t, registry=registry)) for s in signatures for t in ("trigger", "all_triggers")]
        found = rows.select("code", F.array(*both).alias("m"), F.col("trigger").alias("t"), F.col("all_triggers").alias("all")).collect()
        assert all(r.m[0::2] == r.m[1::2] and r.t & r["all"] == r.t for r in found) and sum(r.t != r["all"] for r in found) > 5
        assert {r.code: r.t == 0 for r in found if r.code in ("evaluate(x)", "frob", "plain prose")} == {
            "evaluate(x)": False, "frob": True, "plain prose": True}


def test_needs_that_a_head_holds_are_not_looked_for_twice():
    """Words of a file signature are looked for once, and a second choice of words only beside the first."""
    by_name = {s.name: matching.text_mask((s,)) for s in R.SHORTCUTS}
    assert by_name["Hardcoded Credential"].count("'password'") == 1 and by_name["Wildcard CORS"].count("'cors'") == 0
    md5 = by_name["MD5 for Passwords"]
    assert md5.index("'('") < md5.index("'md5'") < md5.index("'pwd'") and md5.count("'md5'") == 1


def test_branches_find_what_the_pattern_finds():
    """A choice of words at the head of a pattern is tried word by word, each a literal."""
    for s in (*R.SHORTCUTS, R.Signature("", r"(a\|b|c+)d|[|(]x|(a|b)*y|(?:e|f(g))h|ab?k", ())):
        found = matching.branches(s.pattern)
        for t in [*cases(), "a|bd", "ccd", "|x", "by", "eh", "fgh", "ak"]:
            assert bool(re.search(s.pattern, t, re.I)) == any(re.search(p, t, re.I) for _, p in found), (s.pattern, t)
            for literal, p in found:
                assert all(m.group().lower().startswith(literal) for m in re.finditer(p.lower(), t.lower())), (p, literal)
    heads = [literal for s in R.SHORTCUTS for literal, _ in matching.branches(s.pattern)]
    assert heads.count("") == 1 and {"eval", "os.system", "password", "console.log", "/*", "+"} <= set(heads)
    for whole in (r"\beval|x", "(?i)a|b", "[]a]|b", r"(a\b|b)c"):
        assert matching.branches(whole) == [("", whole)]


def test_first_match_follows_registry_order(spark):
    texts = [t for t in cases() if "\n" not in t]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, code string") \
        .withColumn("folded", matching.fold(F.col("code"))).withColumn("trigger", matching.triggers())
    first = F.expr(matching.first_match(R.VULNERABILITIES))
    got = {r.i: r.v for r in rows.select("i", first.alias("v")).collect()}
    for i, t in enumerate(texts):
        want = next((k for k, s in enumerate(R.VULNERABILITIES) if re.search(s.pattern, t, re.IGNORECASE)), None)
        assert got[i] == want, t


def test_every_signature_needs_a_trigger():
    for registry in REGISTRIES.values():
        assert all(s.needs and set(s.needs) <= set(R.TRIGGERS) for s in registry)


def test_texts_cover_the_registries():
    assert set(prose.ISSUE_DESCRIPTIONS) == {s.name for s in R.VULNERABILITIES}
    assert set(prose.CHAIN_DESCRIPTIONS) == set(prose.CHAIN_ALERTS) == set(R.ATTACK_ORDER) == {s.kind for s in R.SINKS}
    assert len(prose.EXPLANATIONS) == 14 and len(prose.RECOMMENDATIONS) == 23
    assert all(s.severity == "Medium" for s in R.VULNERABILITIES if s.name in R.SECRET_ISSUES)


def test_generated_methods_can_be_compiled(spark, files):
    """The JVM leaves methods above 8000 bytes to the interpreter."""
    import contextlib
    import io

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            hits.line_facts(lines.lines(files(("r", "a.py", "x")))).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", out.getvalue())]
    assert sizes and max(sizes) < 8000


def test_comment_rules_differ(spark, files):
    rows = hits.line_facts(lines.lines(files(
        ("r", "a.py", "# eval(user_input)\n// eval(user_input)\n/* eval(user_input)\n* eval(user_input)\n  eval(user_input)"))))
    got = {r.line: (r.vuln_id, r.src_mask != 0, r.snk_mask != 0) for r in rows.collect()}
    assert got == {3: (None, True, True), 4: (0, True, True), 5: (0, True, True)}


def test_code_is_whole_unless_a_width_is_given(spark, files):
    table = lines.lines(files(("r", "a.py", "  eval(" + "x" * 300)))
    assert hits.findings(hits.line_facts(table)).first().matched_code == "eval(" + "x" * 300
    assert hits.findings(hits.line_facts(table, code_width=120)).first().matched_code == ("eval(" + "x" * 300)[:120]


def test_severity_of_every_line(spark, files):
    table = lines.lines(files(("r", "a.py", "eval(x)\n\nplain\n# eval(x)\nrequests.get(u, verify=False)")))
    found = {r.line: r.severity for r in hits.findings(hits.line_facts(table)).collect()}
    assert {r.line: r.severity for r in hits.line_severity(table).collect()} == {n: found.get(n) for n in range(1, 6)}
    assert "Join" not in hits.line_severity(table)._jdf.queryExecution().executedPlan().toString()


def test_own_signatures(spark, files):
    own = R.Signature("Own rule", r"zonk\s+\d+", (), "High")
    quick = R.Signature("Quick rule", r"frobnicate\(x", ("frob",), "Low")
    registry = R.Registry(vulnerabilities=(*R.VULNERABILITIES, own, quick), triggers={**R.TRIGGERS, "frob": ("frobnicate",)})
    table = lines.lines(files(("r", "a.py", "zonk 12 plain words\nfrobnicate(x)\neval(q)\nnothing here")))
    rows = hits.findings(hits.line_facts(table, registry=registry), registry=registry).collect()
    assert {(r.line, r.issue, r.severity) for r in rows} == {(1, "Own rule", "High"), (2, "Quick rule", "Low"), (3, "Dangerous Execution (eval)", "High")}
    only = R.Registry(vulnerabilities=(quick,), entry_points=(), sources=(), sinks=(), triggers={"frob": ("frobnicate",)})
    assert matching.gate(only) == ("frobnicate",) and matching.gate(registry) is None and set(matching.gate()) == set(matching.GATE)
    assert {r.issue for r in hits.findings(hits.line_facts(table, registry=only), registry=only).collect()} == {"Quick rule"}
    assert {r.issue for r in scan(table_files(spark), registry=only).prioritized.collect()} == {"Quick rule"}


def table_files(spark):
    return spark.createDataFrame([("r", "a.py", "frobnicate(x)\neval(q)", 20)], "repo string, file string, content string, size_bytes bigint")
