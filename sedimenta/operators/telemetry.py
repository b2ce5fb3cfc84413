"""Counters, gauges and cumulative histograms of event streams; quantiles, rates, rings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BOUNDS = (1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0)


def cumulative(events: DataFrame, key: str, value: str, bounds: tuple[float, ...] = BOUNDS) -> DataFrame:
    """(key, le, n): how many values are at most each bound; the last bound, null, stands for infinity."""
    counts = events.groupBy(key).agg(*(F.sum((F.col(value) <= b).cast("long")).alias(f"b{i}") for i, b in enumerate(bounds)), F.count(value).alias("all"))
    rows = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)]
    return counts.select(key, F.inline(F.array(*rows, F.struct(F.lit(None).cast("double").alias("le"), F.col("all").alias("n")))))


def buckets(histogram: DataFrame, key: str) -> DataFrame:
    """(key, le, n) with what is in each bucket instead of below its bound."""
    below = F.lag("n", 1, 0).over(Window.partitionBy(key).orderBy(F.asc_nulls_last("le")))
    return histogram.select(key, "le", F.greatest(F.col("n") - below, F.lit(0)).alias("n"))


def quantiles(histogram: DataFrame, key: str, shares: tuple[float, ...]) -> DataFrame:
    """(key, share, value): interpolated in the first bucket whose cumulative count reaches share * total.

    A bucket begins at the bound before, the first at 0; what falls into the infinite one is the last bound. Unknown without values.
    """
    order = Window.partitionBy(key).orderBy(F.asc_nulls_last("le"))
    every = Window.partitionBy(key)
    rows = histogram.withColumns({
        "lower": F.coalesce(F.lag("le").over(order), F.lit(0.0)), "before": F.lag("n", 1, 0).over(order), "total": F.max("n").over(every), "last": F.max("le").over(every),
    }).withColumn("share", F.explode(F.array(*map(F.lit, shares))))
    hit = rows.where((F.col("total") > 0) & (F.col("n") >= F.col("share") * F.col("total"))).groupBy(key, "share").agg(F.min_by(F.struct("le", "lower", "before", "n", "total", "last"), F.coalesce("le", F.lit(float("inf")))).alias("b"))
    width = F.col("b.n") - F.col("b.before")
    value = F.when(F.col("b.le").isNull(), F.col("b.last")).when(width <= 0, F.col("b.le")).otherwise(F.col("b.lower") + (F.col("b.le") - F.col("b.lower")) * (F.col("share") * F.col("b.total") - F.col("b.before")) / width)
    return hit.select(key, "share", F.round(value, 6).alias("value"))


def costs(events: DataFrame, key: str, value: str, limit: int, bounds: tuple[float, ...] = BOUNDS) -> DataFrame:
    """The operations called most, with calls, total and p90; a top-k report."""
    calls = events.groupBy(key).agg(F.count("*").alias("calls"), F.round(F.sum(value), 4).alias("total"))
    p90 = quantiles(cumulative(events, key, value, bounds), key, (0.9,)).select(key, F.col("value").alias("p90"))
    return calls.join(p90, key, "left").orderBy(F.desc("calls"), F.asc(key)).limit(limit)


def rates(samples: DataFrame, key: str, ts: str, counter: str) -> DataFrame:
    """samples with events per minute since the sample before; unknown at the first, or if no time has passed. A counter that fell began again from 0."""
    order = Window.partitionBy(key).orderBy(ts)
    dt = F.unix_micros(ts) - F.unix_micros(F.lag(ts).over(order))
    grown = F.greatest(F.col(counter) - F.lag(counter).over(order), F.lit(0))
    return samples.withColumn("per_minute", F.when(dt > 0, F.round(grown * 60e6 / dt, 6)))


def ring(events: DataFrame, ts: str, seconds: int, size: int) -> DataFrame:
    """(slot, n): events by tumbling window, the newest ``size`` windows that have any. Times are unix seconds."""
    slots = events.groupBy((F.floor(F.unix_timestamp(ts) / seconds) * seconds).cast("long").alias("slot")).agg(F.count("*").alias("n"))
    return slots.orderBy(F.desc("slot")).limit(size)


def gauges(events: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """(key, value, peak, increments): the last value, by time and then value; the highest; and how often it was set."""
    return events.groupBy(key).agg(F.max(F.struct(ts, value)).alias("_l"), F.max(value).alias("peak"), F.count("*").alias("increments")).select(key, F.col(f"_l.{value}").alias("value"), "peak", "increments")


def sessions(events: DataFrame, key: str, ts: str, gap_seconds: int) -> DataFrame:
    """(key, start, end, n) of runs of events with gaps of at most gap_seconds."""
    order = Window.partitionBy(key).orderBy(ts)
    apart = F.unix_timestamp(ts) - F.unix_timestamp(F.lag(ts).over(order)) > gap_seconds
    numbered = events.withColumn("_n", F.sum(F.coalesce(apart, F.lit(False)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "_n").agg(F.unix_timestamp(F.min(ts)).alias("start"), F.unix_timestamp(F.max(ts)).alias("end"), F.count("*").alias("n")).drop("_n")


def valid(rows: DataFrame, allowed: dict[str, tuple[str, ...]], metric: str, labels: list[str], most: int = 4096) -> DataFrame:
    """rows whose labels all have allowed values, null labels aside; the first ``most`` by metric and labels, a store's bound."""
    fits = F.lit(True)
    for name in labels:
        fits = fits & (F.col(name).isNull() | F.col(name).isin(*allowed[name]))
    return rows.where(fits).orderBy(metric, *labels).limit(most)


def merged(stored: DataFrame, fresh: DataFrame, key: list[str], value: str) -> DataFrame:
    """Monotone counters of two stores, summed by key."""
    return stored.unionByName(fresh).groupBy(*key).agg(F.sum(value).alias(value))
