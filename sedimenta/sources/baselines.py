"""Baselines: stored metrics of functions, written beside the old ones and then moved, read with their identities checked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("path", "id", "name", "line", "cognitive", "cyclomatic", "crap", "max_nesting")


class Duplicate(ValueError):
    """A baseline has an identity twice."""


def _checked(rows: DataFrame) -> DataFrame:
    """rows, if no (path, id) is there twice; one small job."""
    again = rows.groupBy("path", "id").agg(F.count("*").alias("n")).where("n > 1").orderBy("path", "id").limit(1).collect()
    if again:
        raise Duplicate(f"duplicate function {again[0].path} {again[0].id}")
    return rows


def write(path: str, functions: DataFrame) -> None:
    """Stores functions (see COLUMNS). A reader sees the old baseline or the new one; if writing fails the old one stays."""
    spark = functions.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    now, fresh, past = hadoop(path), hadoop(f"{path}.next"), hadoop(f"{path}.past")
    fs = now.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(fresh, True)
    _checked(functions.select(*COLUMNS)).write.parquet(str(fresh))
    fs.delete(past, True)
    if fs.exists(now):
        fs.rename(now, past)
    fs.rename(fresh, now)
    fs.delete(past, True)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The stored functions. Missing columns, and an identity that is there twice, are errors."""
    rows = spark.read.parquet(path)
    missing = [c for c in COLUMNS if c not in rows.columns]
    if missing:
        raise ValueError(f"baseline without {', '.join(missing)}")
    return _checked(rows.select(*COLUMNS))
