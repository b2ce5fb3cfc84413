"""Scanner and vulnerability findings: provenance, gates, evidence; mutation scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.functions.metrics import severity_rank

STATUSES = ("killed", "timed_out", "survived", "no_coverage", "ignored", "compile_error", "error", "unknown")


def merged(findings: DataFrame, key: list[str], report: str, first: list[str]) -> DataFrame:
    """A row per semantic key: sorted names of the reports that have it, and the columns ``first`` of the least report's row."""
    return findings.groupBy(*key).agg(
        F.array_join(F.array_sort(F.collect_set(report)), ",").alias("reports"),
        F.count("*").alias("seen"),
        F.min(F.struct(report, *first)).alias("_first"),
    ).select(*key, "reports", "seen", *(F.col(f"_first.{c}").alias(c) for c in first))


def against_baseline(current: DataFrame, baseline: DataFrame, key: list[str]) -> DataFrame:
    """current with ``state``: existing if the baseline has the key, else new."""
    known = baseline.select(*key).distinct().withColumn("_known", F.lit(True))
    return current.join(known, key, "left").withColumn("state", F.when(F.col("_known"), "existing").otherwise("new")).drop("_known")


def gate(findings: DataFrame, least: str, new_only: bool = False) -> DataFrame:
    """Findings of at least a severity; with new_only those whose state is new."""
    from sedimenta.functions.metrics import SEVERITIES

    out = findings.where(severity_rank(F.col("severity")) >= SEVERITIES.index(least))
    return out.where(F.col("state") == "new") if new_only else out


def reachable(findings: DataFrame, changed_imports: DataFrame) -> DataFrame:
    """findings (…, ecosystem, package) with evidence: the changed files that import the package.

    reachable is true with such files, false for npm packages without, and unknown for other ecosystems.
    """
    files = changed_imports.groupBy("package").agg(F.array_join(F.array_sort(F.collect_set("file")), ",").alias("evidence"))
    joined = findings.join(files, "package", "left")
    npm = F.col("ecosystem") == "npm"
    return joined.withColumn("reachable", F.when(npm, F.col("evidence").isNotNull())).withColumn("evidence", F.when(npm, F.col("evidence")))


def vulnerability_gate(findings: DataFrame, least: str) -> DataFrame:
    """New findings of at least a severity, unless they're known not to be reachable."""
    return gate(findings, least, new_only=True).where(~F.col("reachable").eqNullSafe(F.lit(False)))


# How tools spell a mutant's status, without underscores and hyphens, in lower case.
SPELLINGS = {
    "killed": "killed", "timedout": "timed_out", "timeout": "timed_out", "survived": "survived", "nocoverage": "no_coverage", "ignored": "ignored", "pending": "ignored",
    "nonviable": "compile_error", "compileerror": "compile_error", "runerror": "error", "runtimeerror": "error", "memoryerror": "error",
}


def mutation_status(raw: Column) -> Column:
    """Normalised status of a mutant, see SPELLINGS; any other spelling is unknown."""
    plain = F.lower(F.translate(raw, "_-", ""))
    out = F.lit("unknown")
    for name, status in SPELLINGS.items():
        out = F.when(plain == name, status).otherwise(out)
    return out


def mutation_summary(mutants: DataFrame, by: str, path: str = "path") -> DataFrame:
    """Per group: counts by status, all mutants, those without a path, those that are scored, and the score.

    The score is the share of killed and timed out ones among these and the survived and uncovered, in percent; unknown without any.
    """
    counted = mutants.groupBy(by).agg(
        *(F.count(F.when(F.col("status") == s, 1)).alias(s) for s in STATUSES), F.count("*").alias("mutants"), F.count(F.when(F.col(path).isNull(), 1)).alias("unresolved"),
        F.count(F.when(F.col("status").isin("killed", "timed_out", "survived", "no_coverage"), 1)).alias("scored_mutants"),
    )
    return counted.withColumn("score", F.round(F.try_divide((F.col("killed") + F.col("timed_out")) * 100.0, F.col("scored_mutants")), 6))
