"""Two states of the same entities: pairing, regressions, debt, policies, drift.

Entities pair by their key and their ordinal among equal keys, so repeated names pair in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df with ``nth``: 1 for the first of equal keys."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def paired(before: DataFrame, after: DataFrame, keys: list[str], order: list[str], how: str = "full") -> DataFrame:
    """keys, nth, and all other columns as before_* and after_*; of an entity on one side the other's are null."""
    sides = []
    for name, df in (("before", before), ("after", after)):
        ranked = numbered(df, keys, order).withColumn("present", F.lit(True))
        sides.append(ranked.select(*keys, "nth", *(F.col(c).alias(f"{name}_{c}") for c in ranked.columns if c not in (*keys, "nth"))))
    return sides[0].join(sides[1], [*keys, "nth"], how)


def changed(pairs: DataFrame, fingerprint: str) -> DataFrame:
    """Pairs whose fingerprints differ, one-sided ones included."""
    return pairs.where(~F.col(f"before_{fingerprint}").eqNullSafe(F.col(f"after_{fingerprint}")) | F.col("before_present").isNull() | F.col("after_present").isNull())


def regressed(metric: str, allowed: float = 0) -> Column:
    """Did a metric grow by more than allowed? An unknown side is no regression."""
    a, b = F.col(f"after_{metric}"), F.col(f"before_{metric}")
    return F.coalesce(F.greatest(a - b, F.lit(0)) > allowed, F.lit(False))


def direction(metrics: list[str]) -> Column:
    """``regressed`` if any metric went up, else ``improved`` if any went down, else ``unchanged``; null if one-sided."""
    up = down = F.lit(False)
    for m in metrics:
        up = up | F.coalesce(F.col(f"after_{m}") > F.col(f"before_{m}"), F.lit(False))
        down = down | F.coalesce(F.col(f"after_{m}") < F.col(f"before_{m}"), F.lit(False))
    both = F.col("before_present").isNotNull() & F.col("after_present").isNotNull()
    return F.when(both, F.when(up, "regressed").when(down, "improved").otherwise("unchanged"))


def transitions(pairs: DataFrame, keys: list[str], limits: dict[str, float]) -> DataFrame:
    """(keys, nth, dimension, before, after, transition) of every dimension that violates, or may, on a side.

    An absent entity is known not to violate; a present one with a missing metric is unknown.
    """

    def violates(side: str, metric: str, limit: float) -> Column:
        return F.when(F.col(f"{side}_present").isNull(), False).otherwise(F.col(f"{side}_{metric}") > limit)

    rows = F.array(*(
        F.struct(F.lit(m).alias("dimension"), F.col(f"before_{m}").cast("double").alias("before"), F.col(f"after_{m}").cast("double").alias("after"), violates("before", m, x).alias("was"), violates("after", m, x).alias("is"))
        for m, x in limits.items()
    ))
    state = (
        F.when(F.col("was").isNull() | F.col("is").isNull(), "unknown")
        .when(~F.col("was") & F.col("is"), "new")
        .when(F.col("was") & F.col("is"), "existing")
        .when(F.col("was") & ~F.col("is"), "resolved")
    )
    return pairs.select(*keys, "nth", F.inline(rows)).withColumn("transition", state).where("transition IS NOT NULL").drop("was", "is")


def keyed_drift(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, status): new, existing or resolved; null keys are keys."""
    b = before.select(*keys).distinct().withColumn("_b", F.lit(1))
    a = after.select(*keys).distinct().withColumn("_a", F.lit(1))
    tagged = b.select(*keys, "_b", F.lit(None).cast("int").alias("_a")).unionAll(a.select(*keys, F.lit(None).cast("int").alias("_b"), "_a"))
    joined = tagged.groupBy(*keys).agg(F.max("_b").alias("_b"), F.max("_a").alias("_a"))
    return joined.select(*keys, F.when(F.col("_b").isNull(), "new").when(F.col("_a").isNull(), "resolved").otherwise("existing").alias("status"))


def policy_violations(edges: DataFrame, rules: list[tuple[str, str, str, str]]) -> DataFrame:
    """(rule, severity, source, target) of edges (source, target) that a rule (name, source pattern, target pattern, severity) forbids.

    Rules are configuration held by the driver, so each is a column expression and no join.
    """
    cases = [
        F.when(F.col("source").cast("string").rlike(s) & F.col("target").cast("string").rlike(t), F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity")))
        for name, s, t, severity in rules
    ]
    found = edges.select("source", "target", F.explode(F.filter(F.array(*cases), lambda r: r.isNotNull())).alias("r"))
    return found.select("r.rule", "r.severity", "source", "target")


def risk_changes(before: DataFrame, after: DataFrame, renames: DataFrame | None = None) -> DataFrame:
    """(path, before, after, delta, change) of (path, score); renames (old, new) move the older rows."""
    b = before.select("path", F.col("score").alias("before"))
    if renames is not None:
        b = b.join(renames, b["path"] == renames["old"], "left").select(F.coalesce("new", "path").alias("path"), "before")
    both = b.join(after.select("path", F.col("score").alias("after")), "path", "full")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("after") > F.col("before"), "increased").when(F.col("after") < F.col("before"), "decreased").otherwise("unchanged")
    return both.select("path", "before", "after", F.round(F.coalesce("after", F.lit(0.0)) - F.coalesce("before", F.lit(0.0)), 6).alias("delta"), change.alias("change"))


def clone_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """(group_id, path, fingerprint, status) of clone occurrences (group_id, path, fingerprint) in two states.

    A group on one side only is new or removed as a whole; in one that is on both, an occurrence is existing if its path and
    fingerprint are, and is removed only if its fingerprint isn't in the group any more.
    """
    groups = keyed_drift(before, after, ["group_id"]).withColumnRenamed("status", "_group")
    b = before.select("group_id", "path", "fingerprint").distinct().withColumn("_b", F.lit(True))
    a = after.select("group_id", "path", "fingerprint").distinct().withColumn("_a", F.lit(True))
    prints = after.select("group_id", "fingerprint").distinct().withColumn("_there", F.lit(True))
    both = b.join(a, ["group_id", "path", "fingerprint"], "full").join(groups, "group_id").join(prints, ["group_id", "fingerprint"], "left")
    status = (
        F.when(F.col("_group") == "new", "new").when(F.col("_group") == "resolved", "removed").when(F.col("_b") & F.col("_a"), "existing").when(F.col("_a"), "new").when(F.col("_there").isNull(), "removed")
    )
    return both.select("group_id", "path", "fingerprint", status.alias("status")).where("status IS NOT NULL")
