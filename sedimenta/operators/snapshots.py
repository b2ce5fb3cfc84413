"""Stored states: baselines, trend points, incremental indexes; single-writer tables of parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Conflict(ValueError):
    """A key is stored with another fingerprint."""


def merge_points(stored: DataFrame, fresh: DataFrame, key: list[str], fingerprint: str, replace: bool = False) -> DataFrame:
    """(all columns of both, outcome) of a keyed append: kept, unchanged, added, replaced, or conflict if replace is off."""
    rest = [c for c in fresh.columns if c not in key]
    old = stored.select(*key, *(F.col(c).alias(f"_old_{c}") for c in rest), F.lit(True).alias("_is_old"))
    new = fresh.select(*key, *rest, F.lit(True).alias("_is_new"))
    same = F.col(fingerprint).eqNullSafe(F.col(f"_old_{fingerprint}"))
    outcome = (
        F.when(F.col("_is_new").isNull(), "kept").when(F.col("_is_old").isNull(), "added").when(same, "unchanged").otherwise("replaced" if replace else "conflict")
    )
    taken = outcome.isin("added", "replaced")
    return old.join(new, key, "full").select(*key, *(F.when(taken, F.col(c)).otherwise(F.col(f"_old_{c}")).alias(c) for c in rest), outcome.alias("outcome"))


def append_points(path: str, fresh: DataFrame, key: list[str], fingerprint: str, replace: bool = False) -> dict[str, int]:
    """Appends to the parquet table at path; how many rows had each outcome. Any conflict raises and writes nothing.

    The new table is written beside the old one and then takes its place, so a reader never sees half of one.
    """
    spark = fresh.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    old, new = hadoop(path), hadoop(f"{path}.next")
    fs = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stored = spark.read.schema(fresh.schema).parquet(path) if fs.exists(old) else spark.createDataFrame([], fresh.schema)
    merged = merge_points(stored, fresh, key, fingerprint, replace)
    fs.delete(new, True)
    merged.write.parquet(f"{path}.next")
    counts = {r["outcome"]: r["count"] for r in spark.read.schema(merged.schema).parquet(f"{path}.next").groupBy("outcome").count().collect()}
    if counts.get("conflict"):
        fs.delete(new, True)
        raise Conflict(f"{counts['conflict']} keys are stored with another fingerprint")
    past = hadoop(f"{path}.past")
    fs.delete(past, True)
    if fs.exists(old):
        fs.rename(old, past)  # if this breaks off, the old table is still there under that name
    fs.rename(new, old)
    fs.delete(past, True)
    return counts


def to_refresh(sources: DataFrame, index: DataFrame) -> DataFrame:
    """Sources (path, content_key) whose content the index (path, content_key) doesn't have: what is to be analysed again."""
    return sources.join(index.select("path", "content_key"), ["path", "content_key"], "left_anti")


def refreshed(index: DataFrame, sources: DataFrame, analysed: DataFrame) -> DataFrame:
    """The index after a refresh: rows of unchanged sources, and those analysed; what has no source any more goes."""
    return index.join(sources.select("path", "content_key"), ["path", "content_key"], "left_semi").unionByName(analysed)
