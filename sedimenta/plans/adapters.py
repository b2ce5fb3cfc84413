"""Canonical relations over the stored tables: commits, files touched by commits, functions, edges, findings.

The tables hold no source code, so each operator runs on a relation of the same shape: an order is a commit by
its customer, a part a file that the order's lines touch, a line item a function of its part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedimenta.functions.metrics import severity_of_score


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(commit, ts, identity)."""
    return load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("commit"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_custkey").alias("identity"),
    )


def commit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(commit, path, lines_added, lines_deleted): one row per file of a commit."""
    return (
        load(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("path"))
        .agg(
            F.sum("l_quantity").cast("long").alias("lines_added"),
            F.round(F.sum(F.round(F.col("l_tax") * 100))).cast("long").alias("lines_deleted"),
        )
    )


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, fn, line, loc, cognitive, cyclomatic, coverage): a line item is a function of its part's file."""
    return load(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("path"),
        F.col("l_orderkey").alias("fn"),
        F.col("l_linenumber").alias("line"),
        F.col("l_quantity").cast("int").alias("loc"),
        F.round(F.col("l_discount") * 100).cast("int").alias("cognitive"),
        F.col("l_linenumber").alias("cyclomatic"),
        F.when(F.col("l_returnflag") != "N", 1 - F.round(F.col("l_tax") * 100) / 10).alias("coverage"),
    )


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c_custkey, path): region/nation/customer."""
    customer, nation, region = (load(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    joined = customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"]).join(region, nation["n_regionkey"] == region["r_regionkey"])
    return joined.select("c_custkey", F.concat_ws("/", "r_name", "n_name", "c_name").alias("path"))


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, target, kind): a part and the next one in an order."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return load(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("source"),
        F.lead("l_partkey").over(order).alias("target"),
        F.when(F.col("l_linenumber") % 2 == 0, "import").otherwise("call").alias("kind"),
    ).where("target IS NOT NULL")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, tool, rule, path, ts, value, score, severity): an event is a scanner's finding."""
    score = F.round(F.col("value") / 50, 4)
    return load(spark, sf_dir, "events").select(
        "event_id",
        F.col("event_type").alias("tool"),
        F.get_json_object("props", "$.k").cast("long").alias("rule"),
        F.col("user_id").alias("path"),
        "ts",
        "value",
        score.alias("score"),
        severity_of_score(score).alias("severity"),
    )
