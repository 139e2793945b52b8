"""A code corpus derived from the given tables.

``documents`` holds prose.  Every document becomes one source file in which
each prose line is followed by one line of code, picked by document and line
number from ``SNIPPETS``.  All documents and all of their text are kept, so
the corpus grows with the table.  The same corpus is defined in SQL for the
checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.matching import lookup

# One-line samples: hits and near misses for every signature, comments in
# several styles, blank, import, function and class lines.
SNIPPETS: tuple[str, ...] = (
    "value = eval(user_input)",
    "score = evaluate(model)",
    "exec(compiled_rules)",
    "executor.submit(job)",
    "os.system('tar cf ' + target)",
    "os.sysconf('SC_PAGESIZE')",
    "out = subprocess.check_output(cmd, shell=True)",
    "subprocess.getoutput('uptime')",
    "state = pickle.loads(blob)",
    "state = pickle.load(handle)",
    "conf = yaml.load(stream, Loader=yaml.FullLoader)",
    "conf = yaml.safe_load(stream)",
    "page = render_template_string(body)",
    "page = render_template('home.html')",
    "return redirect(request.args.get('next'))",
    "return redirect('/home')",
    "sql = 'SELECT name FROM users WHERE id=' + uid",
    "rows = db.run(f\"DELETE FROM carts WHERE id={cart}\")",
    "sql = 'UPDATE t SET a={}'.format(a)",
    "sql = \"INSERT INTO t VALUES (%s)\" % row",
    "rows = db.run('SELECT 1')",
    "db.users.find({'$where': 'this.a == ' + query})",
    "db.items.find(req.body)",
    "db.items.find({'a': 1})",
    "password = 'hunter22'",
    "password = os.environ['PW']",
    "API_KEY = \"abcdef123456\"",
    "api_key = load_key()",
    "    auth_token = 'tok-998877'",
    "token = secrets.token_hex(16)",
    "const secret = 'keepme-safe';",
    "let private_key = \"zzzz\";",
    "requests.get(url, verify=False)",
    "requests.get(url, verify=True)",
    "digest = hashlib.md5(password.encode()).hexdigest()",
    "digest = hashlib.sha1(chunk).hexdigest()",
    "digest = hashlib.sha256(chunk).hexdigest()",
    "pick = random.randint(1, 6)",
    "pick = random.choice(names)",
    "app.run(host='0.0.0.0', debug=True)",
    "DEBUG = True",
    "ALLOWED_HOSTS = '*'",
    "Access-Control-Allow-Origin: *",
    "ALLOWED_HOSTS = ['example.org']",
    "total += 1  # TODO check overflow",
    "temporary = 3",
    "body = request.get_json()",
    "data = request.json['item']",
    "name = request.form['name']",
    "name = $_POST['name'];",
    "page_no = request.args.get('page')",
    "$id = $_GET['id'];",
    "$all = $_REQUEST;",
    "upload = request.files['doc']",
    "upload.save(path)",
    "agent = request.headers['User-Agent']",
    "answer = input('continue? ')",
    "target = sys.argv[1]",
    "Scanner in = new Scanner(System.in);",
    "@app.route('/items')",
    "router.get('/items', list)",
    "$sid = $_COOKIE['sid'];",
    "const item = req.body.item;",
    "if (req.query.q) { next(); }",
    "forward(user_data)",
    "send(payload)",
    "cmd = build(target)",
    "query = base + extra",
    "handle = open(request.values['path'])",
    "handle = open('notes.txt')",
    "pipe = os.popen(line)",
    "SELECT a FROM t WHERE b = c + d",
    "try: work()",
    "except:",
    "print('password', password)",
    "# skip the login check for now",
    "// plain remark",
    "/* block remark */",
    " * continued remark",
    "<!-- markup remark -->",
    "",
    "    ",
    "import json",
    "from os import path",
    "#include <stdio.h>",
    "require 'set'",
    "def handler(event):",
    "function draw(ctx) {",
    "public int size() {",
    "async function load() {",
    "class Basket:",
    "return total",
    "for (i = 0; i < n; i++) {",
    "logger.info('done')",
    "x = {'a': [1, 2, 3]}",
    "res.json({ ok: true })",
    "}",
)
# A prime, so that strides over the list reach every sample.
assert len(SNIPPETS) == 97

EXTENSIONS = (".py", ".js", ".php", ".java", ".ts", ".txt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread an input over all cores, whatever its files: the plan is the same at every size."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``files(repo, file, content, size_bytes, doc_id)``"""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id")
    woven = F.transform(
        F.split("text", "\n"),
        lambda prose, i: F.concat(
            prose, F.lit("\n"),
            lookup(((F.col("doc_id") * 7 + i.cast("bigint") * 13) % len(SNIPPETS)).cast("int"), SNIPPETS)),
    )
    ext = lookup((F.col("doc_id") % len(EXTENSIONS)).cast("int"), EXTENSIONS)
    content = F.array_join(woven, "\n")
    return docs.select(
        F.col("source").alias("repo"),
        F.concat(F.lit("src/f"), F.col("doc_id").cast("string"), ext).alias("file"),
        content.alias("content"),
        "doc_id",
    ).withColumn("size_bytes", F.octet_length("content").cast("bigint"))


def file_risks(files_df: DataFrame) -> DataFrame:
    """A deterministic stand-in for classifier output, one row per file."""
    kind = F.col("doc_id") % 5
    return files_df.select(
        "repo", "file",
        F.when(kind == 0, "High Risk").when(kind == 1, "Medium Risk").otherwise("Safe").alias("ml_prediction"),
        (F.col("doc_id") % 50 + 50).cast("double").alias("confidence"),
    )


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_values(rows: list[tuple], columns: str) -> str:
    """A SQL table of literal rows."""
    def literal(v):
        if v is None:
            return "NULL"
        return sql_text(v) if isinstance(v, str) else str(v)

    body = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return f"(VALUES {body}) AS {columns}"


def _ext_case(key: str) -> str:
    whens = " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(EXTENSIONS))
    return f"CASE {key} % {len(EXTENSIONS)} {whens} END"


# FIXED VALUES: Unicode white space for RE2 character classes.
RE2_SPACE = "\\t\\n\\v\\f\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"

SQL_LINES = f"""
snippets AS (SELECT * FROM {sql_values(list(enumerate(SNIPPETS)), "s(snippet_id, snippet)")}),
prose AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS prose,
         generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents),
woven AS (
  SELECT doc_id, source, 2 * i - 1 AS line, prose AS raw FROM prose
  UNION ALL
  SELECT doc_id, source, 2 * i AS line, snippet AS raw
  FROM prose JOIN snippets ON snippet_id = (doc_id * 7 + (i - 1) * 13) % {len(SNIPPETS)}),
lines AS (
  SELECT repo, file, doc_id, line, raw, regexp_replace(regexp_replace(raw, '^[{RE2_SPACE}]+', ''), '[{RE2_SPACE}]+$', '') AS code
  FROM (SELECT source AS repo, 'src/f' || doc_id || {_ext_case('doc_id')} AS file, doc_id, line, raw,
               max(line) OVER (PARTITION BY doc_id) AS last_line FROM woven)
  WHERE NOT (line = last_line AND raw = '')),
contents AS (
  SELECT source AS repo, 'src/f' || doc_id || {_ext_case('doc_id')} AS file, doc_id,
         string_agg(raw, chr(10) ORDER BY line) AS content
  FROM woven GROUP BY source, doc_id),
risks AS (
  SELECT repo, file, CASE doc_id % 5 WHEN 0 THEN 'High Risk' WHEN 1 THEN 'Medium Risk' ELSE 'Safe' END AS ml_prediction,
         CAST(50 + doc_id % 50 AS DOUBLE) AS confidence
  FROM contents)
"""
