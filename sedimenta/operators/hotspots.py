"""Complexity times churn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.operators import history


def hotspots(functions: DataFrame, commits: DataFrame, commit_files: DataFrame, days: int = 365, limit: int = 50) -> DataFrame:
    """Files ranked by max_cognitive times changes within the window.

    A file without history keeps its row with unknown changes and score; it ranks as score 0. Ties go
    by complexity, then path. Coverage is the mean weighted by lines (one at least); null if no
    function's coverage is known. The limit is part of the report; ``truncated`` says whether it cut rows.
    """
    weight = F.greatest(F.col("loc"), F.lit(1)).cast("double")
    files = functions.groupBy("path").agg(
        F.max("cognitive").alias("max_cognitive"),
        F.max("cyclomatic").alias("max_cyclomatic"),
        F.count("*").alias("functions"),
        (F.sum(F.when(F.col("coverage").isNotNull(), weight * F.col("coverage"))) / F.sum(F.when(F.col("coverage").isNotNull(), weight))).alias("coverage"),
    )
    changes = history.touched(commits, commit_files).groupBy("path").agg(F.count(F.when(history.within(days), 1)).alias("changes"))
    ranked = files.join(changes, "path", "left").withColumn("score", F.col("max_cognitive").cast("long") * F.col("changes"))
    cut = ranked.agg((F.count("*") > limit).alias("truncated"))
    return (
        ranked.crossJoin(F.broadcast(cut))
        .orderBy(F.coalesce("score", F.lit(0)).desc(), F.desc("max_cognitive"), F.desc("max_cyclomatic"), F.asc("path"))
        .limit(limit)
        .select("path", "max_cognitive", "max_cyclomatic", "functions", F.round("coverage", 6).alias("coverage"), "changes", "score", "truncated")
    )
