"""Streaming forms of the history operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.session import shared_dir


def burst_windows(events: DataFrame, gap: str = "2 hours", late: str = "1 day", key: str = "user_id", ts: str = "ts") -> DataFrame:
    """``(key, first_ts, last_ts, n)`` of a key's events that follow each other within the gap.

    Works on a stream and on a table. On a stream a burst is given out once the watermark has passed it, and its state
    is dropped then; events later than ``late`` don't count. Touching windows are one burst, so a gap of exactly ``gap``
    doesn't end it.
    """
    timed = events.select(key, F.col(ts).cast("timestamp").alias(ts)).filter(F.col(ts).isNotNull() & F.col(key).isNotNull())
    if timed.isStreaming:
        timed = timed.withWatermark(ts, late)
    w = timed.groupBy(F.session_window(ts, gap), key).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n"))
    return w.select(key, "first_ts", "last_ts", "n")


def append_to(stream: DataFrame, folder: str, state: str) -> None:
    """Runs a stream over all files there are, appending what is final; it goes on from ``state`` when called again.

    A batch writes a folder of its own, so one that is repeated after a failure replaces what it wrote before.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    stream.writeStream.outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()


def finished_bursts(events: DataFrame, key: str = "user_id", ts: str = "ts", **how: str) -> DataFrame:
    """All bursts of a stream that has ended, as a table in the shared folder.

    After the stream's files comes one row far ahead in time: it moves the watermark past every burst but its own, so
    that those still open are given out too.
    """
    spark = events.sparkSession
    base = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    value = {key: "0", ts: "9000-01-01"}
    blank = spark.range(1).select(*[F.lit(value.get(f.name)).cast(f.dataType).alias(f.name) for f in events.schema])
    blank.limit(0).write.parquet(f"{base}/end")
    found = burst_windows(events.unionByName(spark.readStream.schema(blank.schema).parquet(f"{base}/end")), key=key, ts=ts, **how)
    append_to(found, f"{base}/out", f"{base}/state")
    blank.write.mode("append").parquet(f"{base}/end")
    append_to(found, f"{base}/out", f"{base}/state")
    return spark.read.schema(found.schema).parquet(f"{base}/out/batch=*")
