import pytest

from riskloom import prose
from riskloom.operators import patching

X = prose.FIX_TEXT
CASES = [
    ("SSL Verification Disabled", "get(u, verify = false)", "get(u, verify=True)"),
    ("SSL Verification Disabled", "get(u, VERIFY=False)", X["default_note"] + "\nget(u, VERIFY=False)"),
    ("Weak Hashing (MD5)", "h = hashlib.md5(x)", "h = hashlib.sha256(x)"),
    ("Weak Hashing (MD5)", "h = hashlib.md5 (x)", "h = hashlib.md5 (x)"),
    ("Weak Hashing (SHA1)", "h = hashlib.sha1(x)", "h = hashlib.sha256(x)"),
    ("Debug Mode Enabled", "DEBUG = True", "debug=False"),
    ("Insecure Deserialization (yaml)", "c = yaml.load(f, Loader=yaml.Full.X)", "c = yaml.safe_load(f)"),
    ("Insecure Deserialization (pickle)", "o = pickle.loads(b)", "o = json.loads(b)"),
    ("Dangerous Execution (eval)", "x = my_eval(a)", "x = my_ast.literal_eval(a)"),
    ("Dangerous Execution (exec)", "  exec(a)", "  " + X["exec_note"] + "\n  # exec(a)"),
    ("System Command Execution (os.system)", "os.system(f(a))", "subprocess.run(f(a, shell=False), shell=False)"),
    ("Subprocess Execution", "run(a, shell=True)", "run(a, shell=False)"),
    ("Subprocess Execution", "\trun(a)", "\t" + X["default_note"] + "\n\trun(a)"),
    ("Hardcoded Password", "  db_pwd = 'abc'  # x", "  db_pwd = os.getenv('DB_PWD')  # x"),
    ("Hardcoded Token", "const token = \"abcdef\";", "const token = process.env.TOKEN;"),
    ("Hardcoded Secret", "self.secret = 'abc'", X["default_note"] + "\nself.secret = 'abc'"),
    ("Insecure Random (random module)", "random.randint(1, 2)", "secrets.randbelow(1, 2)"),
    ("SQL Injection (Concatenation)", " q = 'select' + a", f" {X['sql_note']}\n {X['sql_original']}q = 'select' + a"),
    ("NoSQL Injection (dynamic operator)", "db.find(req + 1)", f"{X['sql_note']}\n{X['sql_original']}db.find(req + 1)"),
    ("SQL Injection (% formatting)", "'select' % a", X["default_note"] + "\n'select' % a"),
    ("Open Redirect", "  redirect(x)", "  " + X["default_note"] + "\n  redirect(x)"),
]


@pytest.fixture(scope="module")
def fixed(spark):
    rows = [("r", "a", i, issue, raw) for i, (issue, raw, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "repo string, file string, line int, issue string, raw string")
    return {r.line: r for r in patching.line_fixes(df).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_fix(fixed, i):
    assert fixed[i].fixed_line == CASES[i][2] and fixed[i].explanation


def test_files_are_put_together_again(files):
    content = "a = 1\r\n  x = eval(b)\n\n\x0cpickle.loads(c)\n"
    df = files(("r", "a.py", content), ("r", "b.py", "clean\n"))
    patched = patching.patched_files(df)
    rows = patched.collect()
    plan = patched._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert [(r.file, r.fixed_lines, r.patched_content) for r in rows] == \
        [("a.py", 2, "a = 1\n  x = ast.literal_eval(b)\n\n\x0cjson.loads(c)\n")]
