"""Ranking with judgments as an input table, and the aggregates that dashboards show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCEPT, ACT = 0.4, 0.6
# What a role weighs, and what stands for a judgment that is missing.
ROLES = {"critical_path": 1.0, "core_domain": 0.9, "adapter_or_integration": 0.6, "tooling_or_script": 0.4, "unclear": 0.5}
NO_ROLE, NO_INHERENT, NO_ATTENTION = 0.5, 1.5, 1.0


def normalized(df: DataFrame, value: str) -> DataFrame:
    """df with ``normalized``: min-max over all rows, 0.5 where all are equal; the extremes are one broadcast row, so rows don't move."""
    ends = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    scaled = F.when(F.col("_hi") > F.col("_lo"), (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(F.lit(0.5))
    return df.crossJoin(F.broadcast(ends)).withColumn("normalized", scaled).drop("_lo", "_hi")


def role_weight(role: Column) -> Column:
    out = F.lit(NO_ROLE)
    for name, weight in ROLES.items():
        out = F.when(role == name, weight).otherwise(out)
    return out


def priority(weight: Column, role: Column, inherent: Column, attention: Column) -> Column:
    """weight * the role's weight * (0.2 + 0.8 (1 - inherent / 3)) * attention; judgments that are missing have defaults."""
    known = F.coalesce(inherent, F.lit(NO_INHERENT))
    return weight * role_weight(role) * (0.2 + 0.8 * (1 - known / 3)) * F.coalesce(attention, F.lit(NO_ATTENTION))


def bucket(attention: Column, confidence: Column) -> Column:
    """Little attention is standing debt, little confidence goes to review, and all else, unknown values too, is acted on."""
    return F.when(attention < ACCEPT, "accept").when(confidence < ACT, "review").otherwise("act")


def equal_width(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """(bin, n) of all bins between the least and the greatest value."""
    ends = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("_lo")) / width).cast("int"))).otherwise(F.lit(0))
    counted = df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def worst_by(df: DataFrame, group: str, rank: Column, label: str) -> DataFrame:
    """(group, n, worst): the label of the highest rank in each group."""
    return df.groupBy(group).agg(F.count("*").alias("n"), F.max_by(label, rank).alias("worst"))


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= n)


def check_severity(cognitive: Column, cyclomatic: Column, nesting: Column) -> Column:
    return cognitive + cyclomatic + 2 * nesting


def changed_weight(deltas: list[Column]) -> Column:
    """Sum of what grew; an unknown delta adds nothing."""
    out = F.lit(0.0)
    for d in deltas:
        out = out + F.greatest(F.coalesce(d, F.lit(0)), F.lit(0))
    return out


def debt_severity(after: Column, threshold: Column, delta: Column) -> Column:
    """What is over the threshold, or, without one, what grew."""
    return F.when(threshold.isNotNull(), F.greatest(after - threshold, F.lit(0.0))).otherwise(F.greatest(F.coalesce(delta, F.lit(0.0)), F.lit(0.0)))


def exposed_priority(priority_: Column, exposure: Column, reachable: Column) -> Column:
    return priority_ * exposure * (0.2 + 0.8 * reachable)


def summary(functions: DataFrame, keys: list[str], n: int = 50) -> DataFrame:
    """(key, rank, path, fn, value): the worst rows by each key, n at most, unknown values left out; a top-k report."""
    out = None
    for key in keys:
        top = functions.where(F.col(key).isNotNull()).orderBy(F.desc(key), "path", "fn").limit(n)
        ranked = top.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(F.desc(key), "path", "fn"))).select(F.lit(key).alias("key"), "rank", "path", "fn", F.col(key).cast("double").alias("value"))
        out = ranked if out is None else out.unionAll(ranked)
    return out
