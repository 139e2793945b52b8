"""Deterministic fixes for matched lines, and files put together again with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import prose
from riskloom import registry as R
from riskloom.functions import matching, text
from riskloom.functions.matching import java_pattern

_FIX = prose.FIX_TEXT
# FIXED VALUE: assignment of a quoted literal: indent, declaration, name, rest.
ASSIGNMENT = r"^(\s*)(const\s+|let\s+|var\s+)?(\w+)\s*=\s*['\"][^'\"]+['\"](.*)"
_ASSIGNMENT = java_pattern(ASSIGNMENT)


def _has(raw: Column, part: str) -> Column:
    return F.contains(raw, F.lit(part))


def _swap(raw: Column, old: str, new: str) -> Column:
    return F.replace(raw, F.lit(old), F.lit(new))


def _rules(issue: Column, raw: Column) -> list[tuple[Column, Column, Column]]:
    """(guard, fixed line, explanation) in order; guards are case-sensitive although detection is not."""
    stripped = text.strip(raw)
    left = F.ltrim(raw, F.lit(text.WHITESPACE))
    indent = F.substring(raw, F.lit(1), F.length(raw) - F.length(left))

    def is_(name: str) -> Column:
        return issue == name

    def group(i: int) -> Column:
        return F.regexp_extract(raw, _ASSIGNMENT, i)

    env = F.upper(group(3))
    assigned = issue.isin(*R.SECRET_ISSUES) & raw.rlike(_ASSIGNMENT)
    declared = group(2) != ""
    no_loader = F.regexp_replace(_swap(raw, "yaml.load(", "yaml.safe_load("),
                                 java_pattern(r",\s*Loader\s*=\s*\w+(\.\w+)*"), "")
    shell_free = _swap(_swap(raw, "os.system(", "subprocess.run("), ")", ", shell=False)")
    query_text = text.contains_any(raw, ['f"', "f'", ".format(", "+"])
    return [
        (is_("SSL Verification Disabled") & _has(raw, "verify"),
         F.regexp_replace(raw, java_pattern(r"verify\s*=\s*False", ignore_case=True), "verify=True"), F.lit(_FIX["ssl"])),
        (is_("Weak Hashing (MD5)") & _has(raw, "hashlib.md5"),
         _swap(raw, "hashlib.md5(", "hashlib.sha256("), F.lit(_FIX["md5"])),
        (is_("Weak Hashing (SHA1)") & _has(raw, "hashlib.sha1"),
         _swap(raw, "hashlib.sha1(", "hashlib.sha256("), F.lit(_FIX["sha1"])),
        (is_("Debug Mode Enabled"),
         F.regexp_replace(raw, java_pattern(r"debug\s*=\s*True", ignore_case=True), "debug=False"), F.lit(_FIX["debug"])),
        (is_("Insecure Deserialization (yaml)") & _has(raw, "yaml.load("), no_loader, F.lit(_FIX["yaml"])),
        (is_("Insecure Deserialization (pickle)") & _has(raw, "pickle.loads("),
         _swap(raw, "pickle.loads(", "json.loads("), F.lit(_FIX["pickle"])),
        (is_("Dangerous Execution (eval)") & _has(raw, "eval("),
         _swap(raw, "eval(", "ast.literal_eval("), F.lit(_FIX["eval"])),
        (is_("Dangerous Execution (exec)") & _has(raw, "exec("),
         F.concat(indent, F.lit(_FIX["exec_note"] + "\n"), indent, F.lit("# "), stripped), F.lit(_FIX["exec"])),
        (is_("System Command Execution (os.system)") & _has(raw, "os.system("), shell_free, F.lit(_FIX["os"])),
        (is_("Subprocess Execution") & _has(raw, "shell=True"),
         _swap(raw, "shell=True", "shell=False"), F.lit(_FIX["subprocess"])),
        (assigned & ~declared,
         F.concat(group(1), group(3), F.lit(" = os.getenv('"), env, F.lit("')"), group(4)),
         F.format_string(_FIX["env_python"], env)),
        (assigned & declared,
         F.concat(group(1), group(2), group(3), F.lit(" = process.env."), env, group(4)),
         F.format_string(_FIX["env_js"], env)),
        (is_("Insecure Random (random module)") & _has(raw, "random.randint("),
         _swap(raw, "random.randint(", "secrets.randbelow("), F.lit(_FIX["random"])),
        (_has(issue, "SQL Injection") & query_text,
         F.concat(indent, F.lit(_FIX["sql_note"] + "\n"), indent, F.lit(_FIX["sql_original"]), stripped),
         F.lit(_FIX["sql"])),
        (F.lit(True), F.concat(indent, F.lit(_FIX["default_note"] + "\n"), raw), F.lit(_FIX["default"])),
    ]


def line_fixes(findings: DataFrame) -> DataFrame:
    """Fixed line and explanation for every finding that carries its ``raw`` line."""
    fix = None
    for guard, fixed, why in _rules(F.col("issue"), F.col("raw")):
        row = F.struct(fixed.alias("fixed_line"), why.alias("explanation"))
        fix = F.when(guard, row) if fix is None else fix.when(guard, row)
    return findings.select("repo", "file", "line", "issue", F.col("raw").alias("vulnerable_line"),
                           F.inline(F.array(fix)))


def _fixed_line(issue: Column, raw: Column) -> Column:
    fix = None
    for guard, fixed, _ in _rules(issue, raw):
        fix = F.when(guard, fixed) if fix is None else fix.when(guard, fixed)
    return fix


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Columns that are computed once a row: a generator is neither merged with later projections nor passed by later filters."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def patched_files(files: DataFrame, registry: R.Registry = R.DEFAULT) -> DataFrame:
    """``(repo, file, fixed_lines, patched_content)`` of the files with findings, every fixed line in place.

    Lines are searched and fixed inside the row of their file: contents are
    neither shuffled nor joined.  Of all lines only those that pass the gate are tried, and only fixed ones
    are made anew; what lies between them is taken as it is.  Line terminators are kept.
    """
    # Cut before every line that follows a terminator, so that terminators stay with their lines.
    pieces = F.split(text.universal_newlines(F.col("content")), "(?<=" + text.LINE_BREAKS + ")")
    ending = "(?s)" + text.LINE_BREAKS + "?\\z"
    names = [s.name for s in registry.vulnerabilities]

    def searched(piece: Column, i: Column) -> Column:
        return F.struct(i.alias("i"), text.strip(piece).alias("code"))

    def folded(x: Column) -> Column:
        return F.struct(x["i"].alias("i"), matching.fold(x["code"]).alias("folded"))

    def fixed(x: Column) -> Column:
        piece = F.get("pieces", x["i"])
        raw = F.regexp_replace(piece, ending, "")
        return F.struct(x["i"].alias("i"), F.concat(_fixed_line(matching.lookup(x["vuln_id"], names), raw), F.substring(piece, F.length(raw) + 1, F.length(piece))).alias("line"))

    def between(x: Column, k: Column) -> Column:
        start = F.when(k > 0, F.get("fixes", k - 1)["i"] + 1).otherwise(F.lit(0))
        return F.concat(F.array_join(F.slice("pieces", start + 1, x["i"] - start), ""), x["line"])

    gate, triggers = matching.may_match_sql("x.folded", registry), matching.triggers_sql("x.folded", registry)
    lined = _once(files.select("repo", "file", "content"), pieces=pieces).drop("content")
    candidates = F.transform(F.filter(F.transform("pieces", searched), lambda x: (x["code"] != "") & ~text.starts_with_any(x["code"], R.FINDING_COMMENTS)), folded)
    gated = _once(lined, lines=candidates).withColumn("lines", F.expr(f"transform(filter(lines, x -> {gate}), x -> named_struct('i', x.i, 'folded', x.folded, 'trigger', {triggers}))"))
    match = matching.first_match(registry.vulnerabilities, "x.folded", "x.trigger", registry)
    found = _once(gated, hits=F.expr(f"filter(transform(lines, x -> named_struct('i', x.i, 'vuln_id', {match})), x -> x.vuln_id IS NOT NULL)")).drop("lines")
    made = _once(found.filter(F.size("hits") > 0), fixes=F.transform("hits", fixed))
    last = F.element_at("fixes", -1)["i"] + 1
    tail = F.array_join(F.slice("pieces", last + 1, F.size("pieces") - last), "")
    return made.select("repo", "file", F.size("fixes").cast("bigint").alias("fixed_lines"),
                       F.concat(F.array_join(F.transform("fixes", between), ""), tail).alias("patched_content"))
