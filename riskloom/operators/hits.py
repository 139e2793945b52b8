"""One pass over the lines: every signature of every registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import prose
from riskloom import registry as R
from riskloom.functions import matching, text


def line_facts(line_table: DataFrame, carry: tuple[str, ...] = (), code_width: int | None = None, registry: R.Registry = R.DEFAULT,
               kept: Column | None = None) -> DataFrame:
    """``(repo, file, line, code, vuln_id, entry_id, src_mask, snk_mask)`` for lines that match anything.

    ``carry`` names further line columns to keep, such as ``raw``; ``code_width`` cuts the kept code, which is whole by default.
    Rows that are ``kept``, a test of ``line`` or of a carried column, stay without a match.

    Narrow from the file to the result.  ``inline`` keeps the optimizer from
    pushing a filter below the column it tests, which would compute that
    column once per use; it also keeps every generated method small enough to
    be compiled to machine code.
    """
    code = F.col("code")
    searchable = (code != "") & ~text.starts_with_any(code, R.CHAIN_COMMENTS)
    no_block = "NOT startswith(code, '/*')"
    by_line = F.expr(f"""inline(array(named_struct(
        'vuln_id', CASE WHEN {no_block} THEN {matching.first_match(registry.vulnerabilities, registry=registry)} END,
        'entry_id', CASE WHEN {no_block} THEN {matching.first_match(registry.entry_points, registry=registry)} END)))""")
    by_flow = F.expr(f"""inline(array(named_struct(
        'src_mask', {matching.match_mask(registry.sources, registry=registry)}, 'snk_mask', {matching.match_mask(registry.sinks, registry=registry)})))""")
    ids = ["repo", "file", "line", *carry]
    cut = code if code_width is None else F.substring(code, 1, code_width)
    by_symbols = F.expr(f"inline(array(named_struct('symbols', {matching.symbols_sql(registry=registry)})))")

    def wanted(test: Column) -> Column:
        return test if kept is None else kept | test

    return (
        line_table.filter(wanted(searchable))
        .select(*ids, "code", F.inline(F.array(F.struct(F.coalesce(matching.fold(code), F.lit("")).alias("folded")))))
        .filter(wanted(matching.may_match(registry=registry)))
        .select(*ids, "code", "folded", by_symbols)
        .select(*ids, "code", "folded", F.expr(matching.words_sql(registry=registry)).alias("trigger"))
        .select(*ids, "code", "folded", "trigger", by_line)
        .select(*ids, cut.alias("code"), "vuln_id", "entry_id", by_flow)
        .filter(wanted(F.expr("vuln_id IS NOT NULL OR entry_id IS NOT NULL OR src_mask <> 0 OR snk_mask <> 0")))
    )


def line_severity(line_table: DataFrame, carry: tuple[str, ...] = (), registry: R.Registry = R.DEFAULT) -> DataFrame:
    """``(repo, file, line, code, severity)`` of every line; null without a finding.  One narrow pass, no join."""
    code = F.col("code")
    searchable = (code != "") & ~text.starts_with_any(code, R.FINDING_COMMENTS)
    ids = ["repo", "file", "line", *carry]
    severities = [s.severity for s in registry.vulnerabilities]
    first = F.expr(f"inline(array(named_struct('vuln_id', CASE WHEN live THEN {matching.first_match(registry.vulnerabilities, registry=registry)} END)))")
    return (
        line_table.select(*ids, "code", F.inline(F.array(F.struct(F.when(searchable, matching.fold(code)).alias("folded")))))
        .select(*ids, "code", "folded", F.coalesce(matching.may_match(registry=registry), F.lit(False)).alias("live"))
        .select(*ids, "code", "folded", "live", F.when(F.col("live"), matching.triggers(registry=registry)).alias("trigger"))
        .select(*ids, "code", first)
        .select(*ids, "code", matching.lookup(F.col("vuln_id"), severities).alias("severity"))
    )


def _field(signatures: tuple[R.Signature, ...], name: str, index: str) -> Column:
    return matching.lookup(F.col(index), [getattr(s, name) for s in signatures])


def findings(facts: DataFrame, carry: tuple[str, ...] = (), registry: R.Registry = R.DEFAULT) -> DataFrame:
    """First matching vulnerability signature per line."""
    descriptions = [prose.ISSUE_DESCRIPTIONS.get(s.name, s.name) for s in registry.vulnerabilities]
    return facts.filter("vuln_id IS NOT NULL").select(
        "repo", "file", "line",
        _field(registry.vulnerabilities, "name", "vuln_id").alias("issue"),
        _field(registry.vulnerabilities, "severity", "vuln_id").alias("severity"),
        F.col("code").alias("matched_code"),
        matching.lookup(F.col("vuln_id"), descriptions).alias("description"),
        *carry,
    )


def entry_points(facts: DataFrame, registry: R.Registry = R.DEFAULT) -> DataFrame:
    """First matching entry-point signature per line."""
    return facts.filter("entry_id IS NOT NULL").select(
        "repo", "file", "line",
        _field(registry.entry_points, "kind", "entry_id").alias("type"),
        _field(registry.entry_points, "name", "entry_id").alias("name"),
        _field(registry.entry_points, "severity", "entry_id").alias("severity"),
        F.col("code").alias("matched_code"),
    )


def signature_hits(facts: DataFrame, mask: str, signatures: tuple[R.Signature, ...], name: str) -> DataFrame:
    """One row per line and set bit of a signature mask."""
    bit = F.explode(F.sequence(F.lit(0), F.lit(len(signatures) - 1))).alias("bit")
    return (
        facts.filter(F.col(mask) != 0)
        .select("repo", "file", "line", mask, bit)
        .filter(F.expr(f"getbit({mask}, bit) = 1"))
        .select("repo", "file", "line", matching.lookup(F.col("bit"), [s.name for s in signatures]).alias(name))
    )


def source_hits(facts: DataFrame, registry: R.Registry = R.DEFAULT) -> DataFrame:
    return signature_hits(facts, "src_mask", registry.sources, "source")


def sink_hits(facts: DataFrame, registry: R.Registry = R.DEFAULT) -> DataFrame:
    return signature_hits(facts, "snk_mask", registry.sinks, "sink")


def shortcut_mask(folded: str = "folded", registry: R.Registry = R.DEFAULT) -> Column:
    """INT with one bit per shortcut signature found anywhere in a folded text.

    Patterns see the whole text, so a match may span lines.
    """
    return F.expr(matching.text_mask(registry.shortcuts, folded, registry))
