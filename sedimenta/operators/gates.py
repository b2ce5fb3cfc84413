"""Quality gate: configured conditions on one set of functions, each of which fails closed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.functions import metrics as M

GRADES = "ABCDE"


def quality_gate(functions: DataFrame, limits: dict[str, float], conditions: dict[str, str | int], severities: DataFrame | None = None) -> DataFrame:
    """(metric, threshold, actual, passed, gate): a row per condition, in the order given; gate is whether all pass.

    functions has loc and the metrics that limits names. conditions are maintainability_rating and security_rating, the worst grade that
    passes, and effort_minutes, the most that passes. severities (severity) are the findings that scanners gave; without it, and if
    all of them are unknown, the security rating is unknown, as is the maintainability rating without limits. An unknown value doesn't pass.
    """
    minutes = sum(M.effort(limits).values(), F.lit(0).cast("long"))
    told = functions.agg(F.coalesce(F.sum(minutes), F.lit(0).cast("long")).alias("minutes"), F.coalesce(F.sum("loc"), F.lit(0)).alias("loc"))
    if severities is None:
        told = told.withColumn("security", F.lit(None).cast("string"))
    else:
        counts = severities.agg(*(F.count(F.when(F.col("severity") == s, 1)).alias(s) for s in M.SEVERITIES))
        told = told.crossJoin(F.broadcast(counts.select(M.security_rating({s: F.col(s) for s in M.SEVERITIES}).alias("security"))))
    maintainability = M.maintainability_rating(F.col("minutes"), F.col("loc")) if limits else F.lit(None).cast("string")
    values = {"maintainability_rating": maintainability, "security_rating": F.col("security"), "effort_minutes": F.col("minutes")}
    rows = F.array(*(_condition(metric, values[metric], limit) for metric, limit in conditions.items()))
    gate = told.select(rows.alias("rows")).select(F.forall("rows", lambda r: r["passed"]).alias("gate"), F.posexplode("rows").alias("place", "r"))
    return gate.orderBy("place").select("r.metric", "r.threshold", "r.actual", "r.passed", "gate")


def _condition(metric: str, actual: Column, limit: str | int) -> Column:
    if metric == "effort_minutes":
        passed = actual <= limit
    else:
        passed = F.instr(F.lit(GRADES), actual) <= GRADES.index(str(limit)) + 1
    return F.struct(F.lit(metric).alias("metric"), F.lit(str(limit)).alias("threshold"), actual.cast("string").alias("actual"), F.coalesce(passed, F.lit(False)).alias("passed"))
