"""Streaming twins of the counters, and micro-batch jobs.

State lives in the checkpoint, and goes when its window has ended by the watermark. Sinks are idempotent, so a replayed
batch changes nothing. Retractions of labels are ignored: an exclusion stays.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Partitions of an ingested table, by a hash of the key.
KEY_BUCKETS = 64

COUNTED = T.StructType([T.StructField("key", T.StringType()), T.StructField("event_id", T.LongType()), T.StructField("s", T.DoubleType()), T.StructField("n", T.LongType())])
ANCHOR = T.StructType([T.StructField("start", T.DoubleType()), T.StructField("n", T.LongType())])


def counters(events: DataFrame, ttl: float, rolling: bool, watermark: str = "1 hour") -> DataFrame:
    """Running count of a key in its window: anchored at the first event, or kept alive by every one.

    events: key string, event_id long, ts timestamp. Events of one micro-batch count in order of time and id.
    """
    rows = events.withWatermark("ts", watermark).select("key", "event_id", "ts", F.unix_micros("ts").alias("us"))

    def step(key, batches: Iterator, state: GroupState):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        start, n = state.get if state.exists else (float("-inf"), 0)
        pdf = pd.concat(list(batches)).sort_values(["us", "event_id"])
        out = []
        for event_id, us in zip(pdf["event_id"], pdf["us"], strict=True):
            s = us / 1e6
            if s - start >= ttl:
                start, n = s, 0
            elif rolling:
                start = s
            n += 1
            out.append((key[0], int(event_id), s, n))
        state.update((start, n))
        state.setTimeoutTimestamp(int((start + ttl) * 1000) + 1 if (start + ttl) * 1000 > state.getCurrentWatermarkMs() else state.getCurrentWatermarkMs() + 1)
        yield pd.DataFrame(out, columns=["key", "event_id", "s", "n"])

    return rows.groupBy("key").applyInPandasWithState(step, COUNTED, ANCHOR, "append", GroupStateTimeout.EventTimeTimeout)


def counts_by_window(events: DataFrame, size: str = "1 hour", slide: str | None = None, watermark: str = "1 hour") -> DataFrame:
    """Counts by key and window of event time, once the watermark has passed it."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", watermark).groupBy(w, "key").agg(F.count("*").alias("n"))


def ingest(posts: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Append posts to a Parquet table, each (source, source_id) once, whatever is replayed.

    The table is partitioned by a hash of the key, so a micro-batch reads the keys of its own partitions alone.
    """
    spark = posts.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        fresh = batch.dropDuplicates(["source", "source_id"]).withColumn("bucket", F.pmod(F.xxhash64("source", "source_id"), F.lit(KEY_BUCKETS)).cast("int"))
        fresh = fresh.persist()
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
                buckets = [r[0] for r in fresh.select("bucket").distinct().collect()]  # at most KEY_BUCKETS
                old = spark.read.parquet(path).filter(F.col("bucket").isin(buckets)).select("source", "source_id")
                new = fresh.join(old, ["source", "source_id"], "left_anti")
            else:
                new = fresh
            new.write.mode("append").partitionBy("bucket").parquet(path)
        finally:
            fresh.unpersist()

    writer = posts.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")).start()
