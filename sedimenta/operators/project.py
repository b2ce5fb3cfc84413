"""One view of a project: its summary, findings with the function and the risk of where they are, symbol keys."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.operators import spans

#: Width of the buckets in which lines meet functions; longer functions stand in several.
LINES = 64


@dataclass(frozen=True)
class Project:
    """The canonical sections of a project, each a relation of its own; what wasn't read is None and never empty."""

    files: DataFrame  # path, language, parse_errors
    functions: DataFrame  # path, id, start, end, cognitive, cyclomatic, crap, coverage
    edges: DataFrame | None = None  # source, target
    cycles: DataFrame | None = None  # node, cycle
    risk: DataFrame | None = None  # path, score, fan_in, blast_radius, concentration
    duplication: DataFrame | None = None  # group_id, path, start, end
    policy: DataFrame | None = None  # rule, source, target
    mutation: DataFrame | None = None  # status

    def sections(self) -> dict[str, DataFrame]:
        return {f.name: df for f in fields(self) if (df := getattr(self, f.name)) is not None}


def summary(project: Project) -> DataFrame:
    """One row of what a project has. Each section is counted on its own, so none multiplies another; a section that is missing is null.

    coverage_percent is the share of functions whose coverage is known, null if none is.
    """
    known = F.count("coverage")
    out = project.files.agg(F.count("*").alias("files"), F.coalesce(F.sum("parse_errors"), F.lit(0)).cast("long").alias("parse_errors"))
    out = out.crossJoin(project.functions.agg(F.count("*").alias("functions"), F.round(F.when(known > 0, known * 100.0 / F.count("*")), 6).alias("coverage_percent")))
    none = F.lit(None).cast("long")

    def counted(df: DataFrame | None, column, name: str) -> None:
        nonlocal out
        out = out.withColumn(name, none) if df is None else out.crossJoin(df.agg(column.alias(name)))

    counted(project.edges, F.count("*"), "dependency_edges")
    counted(project.cycles, F.countDistinct("cycle"), "dependency_cycles")
    counted(project.duplication, F.countDistinct("group_id"), "duplication_groups")
    lines = None if project.duplication is None else spans.interval_union(project.duplication, "path", "start", "end")
    counted(lines, F.coalesce(F.sum(F.col("end") - F.col("start") + 1), F.lit(0)).cast("long"), "duplicated_lines")
    counted(project.policy, F.count("*"), "policy_violations")
    if project.mutation is None:
        return out.withColumn("mutation_score", F.lit(None).cast("double"))
    detected, scored = (F.count(F.when(F.col("status").isin(*s), 1)) for s in (("killed", "timed_out"), ("killed", "timed_out", "survived", "no_coverage")))
    return out.crossJoin(project.mutation.agg(F.round(F.try_divide(detected * 100.0, scored), 6).alias("mutation_score")))


def enriched(findings: DataFrame, project: Project, changed: DataFrame | None = None) -> DataFrame:
    """findings (finding_id, path, line, ...) with function_id, the function's metrics, the file's risk, changed and reason.

    The function is the innermost one around the line. reason says why a finding has none: no-path, path-not-in-project or
    no-function-at-location. changed is whether the path is among changed (path), null without it or without a path.
    """
    metrics = ["cognitive", "cyclomatic", "crap", "coverage"]
    functions = project.functions.select("path", F.col("id").alias("function_id"), "start", "end", *metrics)
    places = findings.where("path IS NOT NULL AND line IS NOT NULL").select("finding_id", "path", "line")
    around = spans.containing(places, functions.select("path", "function_id", "start", "end"), "path", "line", "start", "end", LINES)
    best = spans.innermost(around, ["finding_id", "path"], "start", "end", "function_id").select("finding_id", "path", "function_id")
    own = best.join(functions.drop("start", "end"), ["path", "function_id"]).drop("path")
    paths = project.functions.select("path")
    out = findings.join(own, "finding_id", "left")
    if project.risk is not None:
        paths = paths.union(project.risk.select("path"))
        out = out.join(project.risk.select("path", F.col("score").alias("risk_score"), *(c for c in project.risk.columns if c not in ("path", "score"))), "path", "left")
    known = paths.distinct().withColumn("_known", F.lit(True))
    out = out.join(known, "path", "left")
    if changed is None:
        out = out.withColumn("changed", F.lit(None).cast("boolean"))
    else:
        touched = changed.select("path").distinct().withColumn("_changed", F.lit(True))
        out = out.join(touched, "path", "left").withColumn("changed", F.when(F.col("path").isNotNull(), F.coalesce("_changed", F.lit(False)))).drop("_changed")
    why = F.when(F.col("function_id").isNotNull(), F.lit(None)).when(F.col("path").isNull(), "no-path").when(F.col("_known").isNull(), "path-not-in-project").otherwise("no-function-at-location")
    return out.withColumn("reason", why).drop("_known")


def symbols(relations: DataFrame, functions: DataFrame) -> DataFrame:
    """relations (symbol_key, ...) with reason: null where exactly one function has the key, else unknown or ambiguous. Rows are kept."""
    counts = functions.groupBy("symbol_key").agg(F.count("*").alias("_n"))
    reason = F.when(F.col("_n") == 1, F.lit(None)).when(F.col("_n") > 1, "ambiguous symbol key").otherwise("unknown symbol key")
    return relations.join(counts, "symbol_key", "left").withColumn("reason", reason).drop("_n")


def parse_errors_by_language(files: DataFrame) -> DataFrame:
    """(language, files, parse_errors) of files (path, language, parse_errors); a language without errors has a row too."""
    return files.groupBy("language").agg(F.count("*").alias("files"), F.coalesce(F.sum("parse_errors"), F.lit(0)).cast("long").alias("parse_errors"))


def untracked(found: DataFrame, tracked: DataFrame, ignored) -> DataFrame:
    """Paths that were found, aren't tracked, and aren't ignored by the column expression given."""
    return found.select("path").distinct().where(~ignored).join(tracked.select("path"), "path", "left_anti")
