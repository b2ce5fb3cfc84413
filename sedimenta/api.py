"""One function per report, over canonical tables; gates say whether they hold.

Tables: functions (path, fn, start, end, loc, cognitive, cyclomatic, nesting, coverage, ...), commits (commit, ts, identity),
commit_files (commit, path, lines_added, lines_deleted), edges (source, target, kind), findings (rule, severity, path, ...),
files (path, text). Every report is a DataFrame that nothing has run yet; only a gate's ``holds`` and ``enforce`` look at rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions import metrics as M
from sedimenta.operators import code, drift, gates, graph, history, imports, queryplans, security, snapshots, spans
from sedimenta.operators import hotspots as _hotspots
from sedimenta.operators import project as _project
from sedimenta.operators import risk as _risk
from sedimenta.operators.project import Project
from sedimenta.operators.triage import summary

__all__ = [
    "Gate", "GateFailed", "Project", "analyze", "baseline", "change_risk", "changed", "check", "coupling", "debt", "dependencies", "duplication", "enriched", "explain_metric", "function", "hotspots", "impact",
    "impact_counts", "mutation", "ownership", "policy", "project_summary", "quality_gate", "repo_summary", "risk", "security_report", "select_tests", "selection_totals", "snapshot", "sql", "sql_gate", "sql_plan",
    "test_targets", "unused", "vulnerabilities",
]

LIMITS = {"cognitive": 15, "cyclomatic": 10, "nesting": 4, "loc": 80, "crap": 30.0}


class GateFailed(RuntimeError):
    """A gate has violations."""


@dataclass(frozen=True)
class Gate:
    name: str
    violations: DataFrame

    def holds(self) -> bool:
        return not self.violations.take(1)

    def enforce(self) -> None:
        if not self.holds():
            raise GateFailed(self.name)


def analyze(functions: DataFrame) -> DataFrame:
    """functions with crap."""
    return functions.withColumn("crap", M.crap(F.col("cyclomatic"), F.col("coverage")))


def function(functions: DataFrame, path: str, name: str) -> DataFrame:
    return analyze(functions).where((F.col("path") == path) & (F.col("fn") == name))


def check(functions: DataFrame, limits: dict[str, float] | None = None, suppressed: str | None = None) -> Gate:
    """Functions over a limit, with the reasons; suppressed names a column of metrics that the source exempts."""
    reasons = M.violation_reasons(limits or LIMITS)
    rows = (functions if "crap" in functions.columns else analyze(functions)).withColumn("reasons", M.unsuppressed(reasons, F.col(suppressed)) if suppressed else reasons)
    return Gate("check", rows.where(F.size("reasons") > 0))


def changed(before: DataFrame, after: DataFrame, fingerprint: str) -> DataFrame:
    """Functions (path, fn, start, ...) that are new, gone or have another fingerprint."""
    return drift.changed(drift.paired(before, after, ["path", "fn"], ["start"]), fingerprint)


def baseline(stored: DataFrame, current: DataFrame, allowed: dict[str, float]) -> Gate:
    """Functions on both sides of which a metric grew by more than allowed."""
    pairs = drift.paired(stored, current, ["path", "fn"], ["start"], "inner")
    worse = F.lit(False)
    for metric, most in allowed.items():
        worse = worse | drift.regressed(metric, most)
    return Gate("baseline", pairs.where(worse))


def debt(before: DataFrame, after: DataFrame, limits: dict[str, float]) -> DataFrame:
    return drift.transitions(drift.paired(before, after, ["path", "fn"], ["start"]), ["path", "fn"], limits)


def hotspots(functions: DataFrame, commits: DataFrame, commit_files: DataFrame, days: int = 365, limit: int = 50) -> DataFrame:
    return _hotspots.hotspots(functions, commits, commit_files, days, limit)


def ownership(commits: DataFrame, commit_files: DataFrame, by_module: bool = False) -> DataFrame:
    touches = history.touches(commits, commit_files)
    return history.concentration(history.module_touches(touches), "module") if by_module else history.concentration(touches)


def coupling(commit_files: DataFrame, target: object = None, least: int = 2) -> DataFrame:
    return history.coupling(commit_files, least) if target is None else history.coupled_with(commit_files, target, least)


def change_risk(files: DataFrame, changes: DataFrame, impact: DataFrame, owners: DataFrame, violations: DataFrame, limit: int | None = None) -> DataFrame:
    """Files by risk, the greatest first, with their components."""
    return _risk.ranked(_risk.rows(files, changes, impact, owners, violations), limit)


def project_summary(project: Project) -> DataFrame:
    return _project.summary(project)


def enriched(findings: DataFrame, project: Project, changed: DataFrame | None = None) -> DataFrame:
    """Findings with the function and the risk of where they are, or the reason why there is none."""
    return _project.enriched(findings, project, changed)


def quality_gate(functions: DataFrame, limits: dict[str, float], conditions: dict[str, str | int], severities: DataFrame | None = None) -> Gate:
    """Conditions that don't pass, or whose value is unknown."""
    return Gate("quality", gates.quality_gate(analyze(functions) if "crap" not in functions.columns else functions, limits, conditions, severities).where("NOT passed"))


def explain_metric(spark: SparkSession, name: str | None = None) -> DataFrame:
    """(metric, unit, explanation, unknown_when) of a metric, or of all."""
    rows = spark.createDataFrame([(k, *v) for k, v in M.EXPLAINED.items()], "metric string, unit string, explanation string, unknown_when string")
    return rows if name is None else rows.where(F.col("metric") == name)


def risk(before: DataFrame, after: DataFrame, renames: DataFrame | None = None) -> DataFrame:
    return drift.risk_changes(before, after, renames)


def dependencies(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, imports that aren't resolved, fan-in and fan-out) of files (path, text)."""
    found = imports.resolved(imports.extracted(files), files)
    edges = imports.edges(found)
    return edges, found.where("state IN ('ambiguous', 'not_found')"), graph.fan(files.select(F.col("path").alias("node")), edges)


def impact(edges: DataFrame, target: object) -> DataFrame:
    """What depends on a target, by distance."""
    start = edges.sparkSession.range(1).select(F.lit(target).cast(edges.schema["source"].dataType).alias("node"))
    return graph.distances(edges, start, reverse=True).where("distance > 0").select("node", "distance").orderBy("distance", "node")


def select_tests(changed_files: DataFrame, tests: DataFrame, files: DataFrame, edges: DataFrame, always_run: tuple[str, ...] = ()) -> DataFrame:
    return graph.select_tests(changed_files, tests, files, edges, always_run)


def selection_totals(changed_files: DataFrame, tests: DataFrame, files: DataFrame, edges: DataFrame, always_run: tuple[str, ...] = ()) -> DataFrame:
    return graph.selection_totals(changed_files, tests, files, edges, always_run)


def impact_counts(edges: DataFrame, files: DataFrame) -> DataFrame:
    """How many files depend on each of files (node), directly and in all."""
    return graph.impact_counts(edges, files)


def test_targets(functions: DataFrame, lines: DataFrame) -> DataFrame:
    return spans.test_targets(functions, lines)


def unused(nodes: DataFrame, edges: DataFrame, entries: DataFrame) -> DataFrame:
    return graph.unused(nodes, edges, entries)


def policy(edges: DataFrame, rules: list[tuple[str, str, str, str]], before: DataFrame | None = None) -> DataFrame:
    """Violations of rules, or, with the edges of an earlier state, which are new, existing or resolved."""
    now = drift.policy_violations(edges, rules)
    return now if before is None else drift.keyed_drift(drift.policy_violations(before, rules), now, ["rule", "source", "target"])


def security_report(findings: DataFrame, earlier: DataFrame | None = None, least: str = "high", key: tuple[str, ...] = ("rule", "path")) -> Gate:
    """Findings of a severity and above; with an earlier report the new ones."""
    stated = findings if earlier is None else security.against_baseline(findings, earlier, list(key))
    return Gate("security", security.gate(stated, least, new_only=earlier is not None))


def vulnerabilities(findings: DataFrame, changed_imports: DataFrame, earlier: DataFrame, least: str = "high") -> Gate:
    """New vulnerabilities of a severity and above that may be reachable from what changed."""
    key = ["ecosystem", "package", "version", "advisory"]
    return Gate("vulnerabilities", security.vulnerability_gate(security.reachable(security.against_baseline(findings, earlier, key), changed_imports), least))


def mutation(mutants: DataFrame, by: str = "path") -> DataFrame:
    return security.mutation_summary(mutants, by)


def duplication(files: DataFrame, tokens: int = 100) -> tuple[DataFrame, DataFrame]:
    """(stretches that are found elsewhere, groups of equal stretches) of files (path, language, text)."""
    grams = code.repeated_kgrams(files, "path", "language", "text", tokens)
    return code.repeated_runs(grams, tokens), code.repeated_groups(grams, tokens)


def sql(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(risky statements, unknown tables, calls in host code) of files (path, text)."""
    scripts = files.where(F.lower("path").endswith(".sql"))
    return code.sql_findings(scripts), code.unknown_tables(scripts), code.sql_in_host(files.where(~F.lower("path").endswith(".sql")))


def sql_gate(files: DataFrame, least: str = "high") -> Gate:
    """Risky statements of a severity and above, of files (path, text)."""
    return Gate("sql", security.gate(code.sql_findings(files), least))


def sql_plan(before: DataFrame, after: DataFrame) -> Gate:
    """Plans (file, text) that got worse."""
    changes = queryplans.regressions(queryplans.facts(queryplans.flattened(before)), queryplans.facts(queryplans.flattened(after)))
    return Gate("sql-plan", changes.where("fails"))


def snapshot(path: str, point: DataFrame, key: list[str], fingerprint: str, replace: bool = False) -> dict[str, int]:
    return snapshots.append_points(path, point, key, fingerprint, replace)


def repo_summary(functions: DataFrame, n: int = 50) -> DataFrame:
    return summary(functions if "crap" in functions.columns else analyze(functions), ["cognitive", "cyclomatic", "crap"], n)
