"""Intervals: containment, coverage of spans, unions, and unique matches by suffix, basename or prefix.

Range joins are equi-joins on (key, bucket): a span stands in every bucket it reaches into and a point in
one, so that a key with many spans is divided, and no side is crossed with the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.operators.history import ancestors


def containing(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, width: int) -> DataFrame:
    """Every pair of a point and a span of its key with start <= at <= end; buckets are ``width`` wide.

    A longer span has buckets of width times a power of two, so it stands in three at most however long it is; a point looks into
    one bucket of each power that there is, which are a few dozen at most.
    """
    longer = F.ceil(F.log2((F.col(end) - F.col(start) + 1) / width)).cast("int")
    bucket = lambda c: F.floor(F.col(c) / (width * F.pow(F.lit(2.0), F.col("_level")))).cast("long")
    s = spans.withColumn("_level", F.greatest(longer, F.lit(0)))
    p = points.crossJoin(F.broadcast(s.select("_level").distinct())).withColumn("_bucket", bucket(at))
    s = s.withColumn("_bucket", F.explode(F.sequence(bucket(start), bucket(end))))
    return p.join(s, [key, "_level", "_bucket"]).where(F.col(at).between(F.col(start), F.col(end))).drop("_bucket", "_level")


def innermost(pairs: DataFrame, point: list[str], start: str, end: str, span_id: str) -> DataFrame:
    """Of each point the smallest span; of equally small ones the least id."""
    return pairs.groupBy(*point).agg(F.min_by(F.struct(span_id, start, end), F.struct(F.col(end) - F.col(start), F.col(span_id))).alias("_s")).select(*point, "_s.*")


def unique_innermost(pairs: DataFrame, point: list[str], start: str, end: str, span_id: str) -> DataFrame:
    """Of each point the smallest span and ``resolved``, or no span and ``ambiguous`` if several are equally small."""
    size = F.col(end) - F.col(start)
    least = pairs.groupBy(*point).agg(F.min(size).alias("_least"))
    smallest = pairs.join(least, point).where(size == F.col("_least")).groupBy(*point).agg(F.countDistinct(span_id).alias("_n"), F.min(span_id).alias("_id"))
    return smallest.select(*point, F.when(F.col("_n") == 1, F.col("_id")).alias(span_id), F.when(F.col("_n") == 1, "resolved").otherwise("ambiguous").alias("state"))


def coverage_ratio(lines: DataFrame, spans: DataFrame, width: int = 50) -> DataFrame:
    """(path, fn, known, covered, ratio) of spans (path, fn, start, end) from lines (path, line, hits, branches, branches_covered).

    Branches count beside lines. A span without known lines has an unknown ratio.
    """
    inside = containing(lines, spans, "path", "line", "start", "end", width)
    branches = F.coalesce("branches", F.lit(0))
    told = inside.groupBy("path", "fn").agg(
        F.sum(1 + branches).cast("long").alias("known"),
        F.sum((F.col("hits") > 0).cast("int") + F.coalesce("branches_covered", F.lit(0))).cast("long").alias("covered"),
    )
    return spans.select("path", "fn").join(told, ["path", "fn"], "left").select("path", "fn", F.coalesce("known", F.lit(0)).alias("known"), F.coalesce("covered", F.lit(0)).alias("covered"), F.round(F.col("covered") / F.col("known"), 6).alias("ratio"))


def merged_lines(*reports: DataFrame) -> DataFrame:
    """(path, line, hits): hits of several reports summed by line."""
    rows = reports[0]
    for more in reports[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("path", "line").agg(F.sum("hits").alias("hits"))


def interval_union(intervals: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, start, end) of merged intervals with closed ends; those that only touch by one stay apart. One without a start is by itself."""
    order = Window.partitionBy(key).orderBy(F.asc_nulls_last(start), F.asc_nulls_last(end))
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = intervals.withColumn("_new", F.when(F.col(start) <= reach, 0).otherwise(1)).withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def by_suffix(reported: DataFrame, known: DataFrame) -> DataFrame:
    """(reported, path) for paths (reported) and sources (path): an equal path, else the only one that ends in /reported; else null.

    Every suffix of a known path is a row, so the match is an equi-join.
    """
    parts = F.split("path", "/")
    suffixes = known.select("path", F.explode(F.transform(parts, lambda _, i: F.array_join(F.slice(parts, i + 1, F.size(parts)), "/"))).alias("_suffix"))
    found = reported.distinct().join(suffixes, F.col("reported") == F.col("_suffix")).groupBy("reported").agg(
        F.max(F.when(F.col("path") == F.col("reported"), F.col("path"))).alias("_equal"), F.countDistinct("path").alias("_n"), F.min("path").alias("_only")
    )
    return reported.join(found, "reported", "left").select("reported", F.coalesce("_equal", F.when(F.col("_n") == 1, F.col("_only"))).alias("path"))


def by_basename(names: DataFrame, known: DataFrame) -> DataFrame:
    """(name, path, state) where a path's last part is name: resolved if there is one, ambiguous if several, else unknown."""
    last = known.select("path", F.substring_index("path", "/", -1).alias("name")).distinct().groupBy("name").agg(F.count("*").alias("_n"), F.min("path").alias("_path"))
    return names.join(last, "name", "left").select("name", F.when(F.col("_n") == 1, F.col("_path")).alias("path"), F.when(F.col("_n") == 1, "resolved").when(F.col("_n") > 1, "ambiguous").otherwise("unknown").alias("state"))


def nearest_ancestor(files: DataFrame, directories: DataFrame) -> DataFrame:
    """(path, directory): the longest listed directory above each path, ``.`` being the root; null if none is."""
    up = files.select("path").distinct().select("path", F.explode(ancestors(F.col("path"))).alias("directory"))
    found = up.join(directories.select("directory").distinct(), "directory").groupBy("path").agg(F.max_by("directory", F.when(F.col("directory") == ".", 0).otherwise(F.length("directory"))).alias("directory"))
    return files.join(found, "path", "left")


def test_targets(functions: DataFrame, lines: DataFrame, width: int = 50) -> DataFrame:
    """functions (path, fn, start, end, crap) with the lines of theirs that have no hit; worst crap first, unknown last."""
    bare = containing(lines.where("hits = 0"), functions.select("path", "fn", "start", "end"), "path", "line", "start", "end", width)
    listed = bare.groupBy("path", "fn").agg(F.array_join(F.array_sort(F.collect_set("line")), ",").alias("uncovered"), F.countDistinct("line").alias("n_uncovered"))
    return functions.join(listed, ["path", "fn"], "left").select("path", "fn", "crap", F.coalesce("n_uncovered", F.lit(0)).alias("n_uncovered"), "uncovered").orderBy(F.desc_nulls_last("crap"), "path", "fn")


def state_of(found: Column) -> Column:
    """0, 1 or more candidates."""
    return F.when(found == 0, "not_found").when(found == 1, "resolved").otherwise("ambiguous")
