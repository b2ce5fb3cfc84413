"""Event streams as Structured Streaming: windowed counts, a ring of samples, merged counters, incremental analysis.

The batch operators on the same tables are the definition; late data beyond the watermark is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Event files of parquet as they come into a folder."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def tumbling(events: DataFrame, width: str, late: str = "1 hour", key: str = "event_type") -> DataFrame:
    """(key, start, n, total) by tumbling window."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(key, F.col("w.start").alias("start"), "n", "total")


def sliding(events: DataFrame, width: str, step: str, late: str = "1 hour", key: str = "event_type") -> DataFrame:
    """(key, start, n) by windows that overlap."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", width, step).alias("w"), key).agg(F.count("*").alias("n"))
    return counted.select(key, F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str, late: str = "1 hour", key: str = "user_id") -> DataFrame:
    """(key, start, end, n) of sessions that a gap ends."""
    counted = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return counted.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """events without repeats of a key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def ring(events: DataFrame, path: str, seconds: int = 5, size: int = 720) -> DataStreamWriter:
    """A writer that keeps the newest windows' counts as parquet at path, replaced as a whole with each batch.

    A batch's counts are added to what is stored, under the batch's number: a batch that is run again after
    a failure finds its number and changes nothing.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.groupBy((F.floor(F.unix_timestamp("ts") / seconds) * seconds).cast("long").alias("slot")).agg(F.count("*").alias("n"))
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        old, new = f"{path}/batch={number - 1}", f"{path}/batch={number}"
        if fs.exists(hadoop(f"{new}/_SUCCESS")):
            return
        rows = fresh
        if fs.exists(hadoop(old)):
            rows = spark.read.schema(fresh.schema).parquet(old).unionAll(fresh)
        rows.groupBy("slot").agg(F.sum("n").alias("n")).orderBy(F.desc("slot")).limit(size).write.mode("overwrite").parquet(new)
        fs.delete(hadoop(f"{path}/batch={number - 2}"), True)

    return events.writeStream.foreachBatch(put).outputMode("append")


def counters(events: DataFrame, key: str = "event_type") -> DataFrame:
    """(key, n, total): sums that only grow, for update or complete mode."""
    return events.groupBy(key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
