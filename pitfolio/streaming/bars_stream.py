"""Streaming form of the bar builder: events to bars by event-time windows.

``event_bars`` drops what comes later than its watermark. ``keep_bars`` drops nothing: each
batch adds the partial bars of its events, and a bar is the merge of its parts, in whatever
order they came.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_bars(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Bars by event type and window; works on a batch and on a stream (append after ``late``)."""
    at = F.struct("ts", "event_id")
    return (
        events.where("value is not null").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
        .groupBy(F.window("ts", width), F.col("event_type").alias("ticker"))
        .agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count("*").alias("volume"))
        .select("ticker", F.col("window.start").alias("start"), "open", "high", "low", "close", "volume")
    )


def read_event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def partial_bars(events: DataFrame, width: str = "1 day") -> DataFrame:
    """ticker, start, first, last (struct ts, event_id, value), high, low, volume of some events; parts merge to whole bars."""
    e = events.where("value is not null").withColumn("ts", F.col("ts").cast("timestamp"))
    tick = F.struct("ts", "event_id", "value")
    return e.groupBy(F.col("event_type").alias("ticker"), F.window("ts", width).alias("w")).agg(
        F.min(tick).alias("first"), F.max(tick).alias("last"), F.max("value").alias("high"), F.min("value").alias("low"), F.count("*").alias("volume")
    ).select("ticker", F.col("w.start").alias("start"), "first", "last", "high", "low", "volume")


def merge_partials(parts: DataFrame) -> DataFrame:
    """Partial bars of one ticker and start as one."""
    return parts.groupBy("ticker", "start").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("high").alias("high"), F.min("low").alias("low"), F.sum("volume").alias("volume"))


def keep_bars(events: DataFrame, root: str, checkpoint: str, width: str = "1 day", **trigger):
    """Start a query that adds the partial bars of every batch of a stream of events under root.

    A batch writes its own folder, named by its number, so a batch that is run again after a
    failure replaces what it had written: each event counts once, however late it comes.
    """

    def add(batch: DataFrame, number: int) -> None:
        partial_bars(batch, width).write.mode("overwrite").parquet(f"{root}/batch={number:012d}")

    return events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _folders(spark: SparkSession, root: str, kind: str) -> list[int]:
    """Numbers of the complete folders of one kind under root, in order."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    done = lambda p: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
    return sorted(int(s.getPath().getName().partition("=")[2]) for s in fs.listStatus(at) if s.getPath().getName().startswith(f"{kind}=") and done(s.getPath()))


def kept_partials(spark: SparkSession, root: str) -> DataFrame:
    """All partial bars under root: the latest compacted table and the batches after it."""
    base = _folders(spark, root, "upto")[-1:]
    paths = [f"{root}/upto={n:012d}" for n in base] + [f"{root}/batch={n:012d}" for n in _folders(spark, root, "batch") if not base or n > base[0]]
    if not paths:
        raise ValueError(f"no bars under {root}")
    return spark.read.parquet(*paths)


def compact_bars(spark: SparkSession, root: str) -> None:
    """Merge all batches so far into one table; readers take it once it is complete."""
    done = _folders(spark, root, "batch")
    if done and done[-1:] != _folders(spark, root, "upto")[-1:]:
        merge_partials(kept_partials(spark, root)).write.mode("overwrite").parquet(f"{root}/upto={done[-1]:012d}")


def kept_bars(spark: SparkSession, root: str) -> DataFrame:
    """ticker, start, open, high, low, close, volume of all events so far."""
    return merge_partials(kept_partials(spark, root)).select("ticker", "start", F.col("first.value").alias("open"), "high", "low", F.col("last.value").alias("close"), "volume")
