"""Connected components of any size, by alternating large and small stars over checkpointed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.tables import discard, staged


def _least(rows: DataFrame) -> DataFrame:
    """rows of (u, v), with m: the least of u and all v of u. The minima are summed before they are joined."""
    least = rows.groupBy("u").agg(F.min("v").alias("_m"))
    return rows.join(least, "u").select("u", "v", F.least("u", "_m").alias("m"))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    found = _least(down)
    return found.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(found.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for each end of edges (u, v): root is the least node of its component.

    A node that is its own root has a row too. Ends are numbers; loops are dropped; no edges, no rows.
    """
    now = staged(edges.select("u", "v").where("u <> v").distinct())
    state = None
    for _ in range(most_rounds):
        before, now = now, staged(_small(_large(now)))
        discard(before)
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (seen["n"], seen["h"]) == state:
            break
        state = (seen["n"], seen["h"])
    else:
        raise RuntimeError("components didn't settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
