"""Queries on event streams: histograms, quantiles, rates, rings, sessions, trends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedimenta.operators import snapshots, telemetry
from sedimenta.plans import adapters as A
from sedimenta.plans.registry import query

_B = "bounds AS (SELECT unnest([1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0]::DOUBLE[]) AS le)"
_H = f"""{_B}, h AS (SELECT event_type, le, count(*) FILTER (WHERE value <= le) AS n FROM events, bounds GROUP BY ALL UNION ALL SELECT event_type, NULL, count(value) FROM events GROUP BY 1)"""


def _histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.cumulative(A.load(spark, sf_dir, "events"), "event_type", "value")


@query(f"WITH {_H} SELECT * FROM h")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _histogram(spark, sf_dir)


@query(f"WITH {_H} SELECT event_type, le, greatest(n - coalesce(lag(n) OVER (PARTITION BY event_type ORDER BY le NULLS LAST), 0), 0) AS n FROM h")
def bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.buckets(_histogram(spark, sf_dir), "event_type")


_Q = f"""{_H}, q AS (SELECT unnest({{shares}}::DOUBLE[]) AS share), w AS (SELECT *, coalesce(lag(le) OVER o, 0) AS lower_, coalesce(lag(n) OVER o, 0) AS before, max(n) OVER (PARTITION BY event_type) AS total, max(le) OVER (PARTITION BY event_type) AS last_
  FROM h WINDOW o AS (PARTITION BY event_type ORDER BY le NULLS LAST)),
f AS (SELECT event_type, share, le, lower_, before, n, total, last_ FROM w, q WHERE n >= share * total QUALIFY row_number() OVER (PARTITION BY event_type, share ORDER BY le NULLS LAST) = 1),
v AS (SELECT event_type, share, round(CASE WHEN le IS NULL THEN last_ WHEN n <= before THEN le ELSE lower_ + (le - lower_) * (share * total - before) / (n - before) END, 6) AS value FROM f)"""


@query(f"WITH {_Q.format(shares='[0.5, 0.9, 0.99]')} SELECT event_type, share, value FROM v")
def histogram_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.quantiles(_histogram(spark, sf_dir), "event_type", (0.5, 0.9, 0.99))


@query(f"WITH {_Q.format(shares='[0.9]')} SELECT e.event_type, count(*) AS calls, round(sum(e.value), 4) AS total, any_value(v.value) AS p90 FROM events e JOIN v USING (event_type) GROUP BY 1 ORDER BY calls DESC, 1 LIMIT 3")
def op_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.costs(A.load(spark, sf_dir, "events"), "event_type", "value", 3)


@query("""WITH s AS (SELECT event_type, date_trunc('hour', ts) AS ts, count(*) AS n FROM events GROUP BY ALL), c AS (SELECT event_type, ts, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY ts) AS BIGINT) AS counter FROM s)
SELECT event_type, ts, counter, round(greatest(counter - lag(counter) OVER w, 0) * 60.0::DOUBLE / (epoch(ts) - epoch(lag(ts) OVER w)), 6) AS per_minute FROM c WINDOW w AS (PARTITION BY event_type ORDER BY ts)""")
def event_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = A.load(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("ts")).agg(F.count("*").alias("n"))
    counted = hours.select("event_type", "ts", F.sum("n").over(Window.partitionBy("event_type").orderBy("ts")).alias("counter"))
    return telemetry.rates(counted, "event_type", "ts", "counter")


@query("SELECT CAST(floor(floor(epoch(ts)) / 5) * 5 AS BIGINT) AS slot, count(*) AS n FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 720")
def sample_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.ring(A.load(spark, sf_dir, "events"), "ts", 5, 720)


@query("SELECT event_type, arg_max(value, ts) AS value, max(value) AS peak, count(*) AS increments FROM events GROUP BY 1")
def gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.gauges(A.load(spark, sf_dir, "events"), "event_type", "ts", "value")


@query("""WITH l AS (SELECT user_id, floor(epoch(ts)) AS t, CASE WHEN floor(epoch(ts)) - floor(epoch(lag(ts) OVER w)) > 3600 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM l)
SELECT user_id, CAST(min(t) AS BIGINT) AS "start", CAST(max(t) AS BIGINT) AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.sessions(A.load(spark, sf_dir, "events"), "user_id", "ts", 3600)


@query("SELECT event_type, CAST(floor(floor(epoch(ts)) / 3600) * 3600 AS BIGINT) AS \"start\", count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    windowed = A.load(spark, sf_dir, "events").groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return windowed.select("event_type", F.unix_timestamp("w.start").alias("start"), "n", "total")


@query("""WITH y AS (SELECT CAST(year(o_orderdate) AS INT) AS y, count(*) AS orders, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 6) AS mean, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1)
SELECT *, orders - lag(orders) OVER (ORDER BY y) AS grown FROM y""")
def trend_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = A.load(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(
        F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.round(F.avg("o_totalprice"), 6).alias("mean"), F.countDistinct("o_custkey").alias("customers")
    )
    return years.withColumn("grown", F.col("orders") - F.lag("orders").over(Window.partitionBy().orderBy("y")))


@query("""WITH s AS (SELECT o_orderkey AS k, o_orderstatus AS f, o_totalprice AS v FROM orders WHERE o_orderkey % 3 <> 0), n AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS f, o_totalprice + 1 AS v FROM orders WHERE o_orderkey % 2 = 0)
SELECT k, CASE WHEN s.f IS NULL OR s.f <> n.f THEN coalesce(n.f, s.f) ELSE s.f END AS f, CASE WHEN n.f IS NULL OR s.f = n.f THEN s.v ELSE n.v END AS v,
CASE WHEN n.f IS NULL THEN 'kept' WHEN s.f IS NULL THEN 'added' WHEN s.f = n.f THEN 'unchanged' ELSE 'replaced' END AS outcome FROM s FULL JOIN n USING (k)""")
def trend_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = A.load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("f"), F.col("o_totalprice").alias("v"))
    stored = orders.where("k % 3 <> 0")
    fresh = orders.where("k % 2 = 0").select("k", F.when(F.col("k") % 5 == 0, "X").otherwise(F.col("f")).alias("f"), (F.col("v") + 1).alias("v"))
    return snapshots.merge_points(stored, fresh, ["k"], "f", replace=True)


@query("""SELECT d.doc_id AS path FROM documents d WHERE NOT (d.doc_id % 3 = 0 AND d.doc_id % 4 <> 0)""")
def index_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is to be analysed again, where the index has every third document, and every twelfth with another content."""
    sources = A.load(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("content_key"))
    index = sources.where("path % 3 = 0").withColumn("content_key", F.when(F.col("path") % 4 == 0, "stale").otherwise(F.col("content_key")))
    return snapshots.to_refresh(sources, index).select("path")
