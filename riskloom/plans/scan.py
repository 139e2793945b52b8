"""The scan: from files to findings, chains, scores and reports of many repositories."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom import registry as R
from riskloom.functions.durable import durable, remove
from riskloom.functions.ranking import ranked_position, top_per_group
from riskloom.operators import advice, borders, chains, hits, narrative, rollup, scores
from riskloom.operators import lines as line_ops
from riskloom.plans import train


class Scan:
    """A scan; every result is a DataFrame derived from three tables.

    ``facts`` are the matching lines, ``profile`` one row per file, ``risks``
    the classifier's row per file.  Results are lazy: nothing runs while one is
    built, and a result computes only what it needs.  Tables named in ``store``,
    these or ``counts``, the sums per file key that most results start from,
    are written to the shared checkpoint folder when they are first used, so
    that several results share one pass over the contents; ``close``, or the end
    of a ``with`` block, deletes what was written.  ``both`` has the rows of
    ``facts`` and, with ``line`` 0, of ``profile`` from a single pass over the
    contents; when both are named in ``store``, it is written first and the
    profiles are taken from it.
    """

    def __init__(self, facts: DataFrame, profile: DataFrame, risks: DataFrame, store: tuple[str, ...] = (),
                 registry: R.Registry = R.DEFAULT, both: DataFrame | None = None):
        self._tables = {"facts": facts, "profile": profile, "risks": risks}
        if unknown := set(store) - {*self._tables, "counts"}:
            raise ValueError(f"no tables {sorted(unknown)}")
        self._store, self._registry = store, registry
        self._both = both if {"facts", "profile"} <= set(store) else None
        self._written: list[str] = []

    def _table(self, name: str) -> DataFrame:
        return self._stored(name, self._tables[name])

    def _stored(self, name: str, table: DataFrame) -> DataFrame:
        return durable(table, name, self._written) if name in self._store else table

    def close(self) -> None:
        """Delete the stored tables; results that read them can't be computed any more."""
        remove(self._tables["facts"].sparkSession, self._written)
        self._written.clear()

    def __enter__(self) -> "Scan":
        return self

    def __exit__(self, *_) -> None:
        self.close()

    @cached_property
    def _pass(self) -> DataFrame:
        return durable(self._both, "pass", self._written)

    @cached_property
    def facts(self) -> DataFrame:
        if self._both is None:
            return self._table("facts")
        return self._pass.filter("line > 0").drop(*line_ops.PROFILE)

    @cached_property
    def profile(self) -> DataFrame:
        if self._both is None:
            return self._table("profile")
        return durable(self._pass.filter("line = 0").select("repo", "file", *line_ops.PROFILE), "profile", self._written)

    @cached_property
    def risks(self) -> DataFrame:
        return self._table("risks")

    @cached_property
    def repos(self) -> DataFrame:
        return self.profile.select("repo").distinct()

    @cached_property
    def findings(self) -> DataFrame:
        return hits.findings(self.facts, registry=self._registry)

    @cached_property
    def entry_points(self) -> DataFrame:
        return hits.entry_points(self.facts, self._registry)

    @cached_property
    def chain_rows(self) -> DataFrame:
        return chains.attack_chains(self.facts, self._registry)

    @cached_property
    def attack_chains(self) -> DataFrame:
        return chains.order_chains(self.chain_rows).select(*chains.CHAIN_COLUMNS)

    @cached_property
    def counts(self) -> DataFrame:
        return self._stored("counts", rollup.count_by_file_key(chains.reach(self.facts), self._registry))

    @cached_property
    def risk_by_key(self) -> DataFrame:
        return rollup.risk_by_file_key(self.risks)

    @cached_property
    def prioritized(self) -> DataFrame:
        return scores.prioritize(self.findings, self.counts, self.risk_by_key)

    @cached_property
    def ranked(self) -> DataFrame:
        return scores.ranked_files(self.profile, self.counts, self.risk_by_key)

    @cached_property
    def repo_facts(self) -> DataFrame:
        return scores.repo_facts(self.profile, self.counts, self.risks)

    @cached_property
    def report(self) -> DataFrame:
        return scores.repo_report(self.repo_facts, self._registry)

    @cached_property
    def fingerprint(self) -> DataFrame:
        return scores.fingerprint(self.report)

    @cached_property
    def narrative(self) -> DataFrame:
        return narrative.narrative(self.report)

    @cached_property
    def scan_log(self) -> DataFrame:
        return narrative.scan_log(self.report)

    @cached_property
    def ml_explanations(self) -> DataFrame:
        return narrative.ml_explanations(self.risks, self.counts)

    @cached_property
    def stats(self) -> DataFrame:
        return rollup.project_stats(self.profile)

    @cached_property
    def attack_surface(self) -> DataFrame:
        return rollup.attack_surface(self.repos, self.entry_points)

    @cached_property
    def advice(self) -> DataFrame:
        return advice.issue_advice(self.findings)

    def top_findings(self, n: int) -> DataFrame:
        return top_per_group(self.findings, ["repo"], [F.col("file"), F.col("line")], n, "position")

    def top_prioritized(self, n: int) -> DataFrame:
        return top_per_group(self.prioritized, ["repo"], scores.priority_order(), n, "position")

    def top_entry_points(self, n: int) -> DataFrame:
        return top_per_group(self.entry_points, ["repo"], [F.col("file"), F.col("line")], n, "position")

    def top_chains(self, n: int) -> DataFrame:
        return top_per_group(self.chain_rows, ["repo"], chains.chain_order(), n, "position") \
            .select(*chains.CHAIN_COLUMNS, "position")

    def top_files(self, n: int) -> DataFrame:
        return top_per_group(self.ranked, ["repo"], scores.file_order(), n, "position")

    @cached_property
    def shortcuts(self) -> DataFrame:
        return rollup.shortcut_presence(self.profile, self._registry)

    def _placed(self, rows: DataFrame, order: list) -> DataFrame:
        return ranked_position(rows, ["repo"], order, "position", self._written)

    def file_positions(self) -> DataFrame:
        """Every file with its position in the whole ranked list of its repository."""
        return self._placed(self.ranked, scores.file_order())

    def priority_positions(self) -> DataFrame:
        """Every finding with its position in the whole list of its repository."""
        return self._placed(self.prioritized, scores.priority_order())

    def chain_positions(self) -> DataFrame:
        """Every attack chain with its position in the whole list of its repository."""
        return self._placed(self.chain_rows, chains.chain_order()).select(*chains.CHAIN_COLUMNS, "position")

    def top_risks(self, n: int) -> DataFrame:
        order = [F.col("confidence").desc(), F.col("file")]
        return top_per_group(self.risks, ["repo"], order, n, "position")


def scan(files: DataFrame, model: train.RiskModel | None = None, file_risks: DataFrame | None = None,
         store: tuple[str, ...] = (), code_width: int | None = None,
         registry: R.Registry = R.DEFAULT, joined: bool = False) -> Scan:
    """Scan ``files(repo, file, content, size_bytes)``.

    File risks come from ``file_risks``, else from ``model``, else they are
    unknown.  All passes over the contents are narrow: nothing is shuffled
    before the matching lines are known.  ``store`` names the tables to be
    written when first used; ``code_width`` cuts the code kept with a match.
    ``registry`` replaces the signatures that are looked for, shortcuts and their weights included.  ``joined`` also finds shortcuts that
    begin in one file and end in a later one of its repository.
    """
    facts = hits.line_facts(line_ops.lines(files), code_width=code_width, registry=registry)
    profile = line_ops.file_profile(files, registry)
    both = facts_and_profile(files, code_width, registry)
    if joined:
        profile, both = borders.with_borders(profile, files, registry), None
    if file_risks is None:
        file_risks = train.unknown_risks(files) if model is None else model.predict(files).select(
            "repo", "file", "ml_prediction", "confidence", "all_scores")
    return Scan(facts, profile, file_risks, store, registry, both)


def facts_and_profile(files: DataFrame, code_width: int | None = None, registry: R.Registry = R.DEFAULT) -> DataFrame:
    """The matching lines, and with ``line`` 0 a row with the profile of every file, from one narrow pass over the contents."""
    whole = F.col("line") == 0
    rows = hits.line_facts(line_ops.profiled_lines(files, registry), carry=("profile",), code_width=code_width, registry=registry, kept=whole)
    profile = [F.when(whole, F.col(f"profile.{c}")).alias(c) for c in line_ops.PROFILE]
    return rows.select("repo", "file", "line", "code", "vuln_id", "entry_id", "src_mask", "snk_mask", *profile)
