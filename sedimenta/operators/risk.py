"""Change risk of files: six components, their weighted mean, and the report's order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.functions import metrics as M

_LEVELS = tuple(M.POLICY_RISK)


def rows(files: DataFrame, changes: DataFrame, impact: DataFrame, owners: DataFrame, violations: DataFrame) -> DataFrame:
    """(path, score, and the six components) of every file, rounded to six places, the score to four.

    files has cognitive, cyclomatic and crap, the greatest of its functions; changes the changes in the window; impact
    the blast_radius_percent; owners the concentration; violations (path, severity) of current rules, of which the worst counts.
    Each but files and violations has a row per path. A file without changes, owners or coverage keeps these unknown.
    """
    rank = F.array_position(F.array(*map(F.lit, _LEVELS)), F.col("severity"))
    worst = violations.groupBy("path").agg(F.max(rank).alias("_rank")).select("path", F.get(F.array(*map(F.lit, _LEVELS)), (F.col("_rank") - 1).cast("int")).alias("policy_severity"))
    joined = files.join(changes, "path", "left").join(impact, "path", "left").join(owners, "path", "left").join(worst, "path", "left")
    parts = M.risk_components(*map(F.col, ("cognitive", "cyclomatic", "crap", "changes", "blast_radius_percent", "concentration", "policy_severity")))
    return joined.select("path", F.round(M.weighted_score(parts), 4).alias("score"), *(F.round(c, 6).alias(n) for n, c in parts.items()))


def ranked(risks: DataFrame, limit: int | None = None) -> DataFrame:
    """risks by score, then path, with their place; a limit makes it a top-k report."""
    order = [F.desc("score"), F.asc("path")]
    top = risks.orderBy(*order) if limit is None else risks.orderBy(*order).limit(limit)
    return top.withColumn("place", F.row_number().over(Window.partitionBy().orderBy(*order)))
