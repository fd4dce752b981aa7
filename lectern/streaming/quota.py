"""Usage limits over a stream of requests, in event time.

Late requests count for the day they were made if they arrive within ``lateness``; what comes later is dropped by the
watermark, as no day can stay open for ever.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_usage(requests: DataFrame, client: str, ts: str, limit: int = 2000, lateness: str = "7 days") -> DataFrame:
    """Streaming twin of the batch operator: ``client, day, hits, accepted, limit_reached``, final when a day closes."""
    timed = requests.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", lateness)
    n = timed.groupBy(F.window("_ts", "1 day").alias("_day"), F.col(client).alias("client")).agg(F.count("*").alias("hits"))
    accepted = F.lit(0) if limit < 0 else F.col("hits") if limit == 0 else F.least("hits", F.lit(limit))
    return n.select("client", F.to_date("_day.start").alias("day"), "hits", accepted.cast("long").alias("accepted"), (F.lit(limit < 0) | (F.lit(limit > 0) & (F.col("hits") >= limit))).alias("limit_reached"))


def throttle(requests: DataFrame, client: str, ts: str, per_minute: int = 60, lateness: str = "10 minutes") -> DataFrame:
    """``client, minute, hits, rejected`` of tumbling minutes."""
    timed = requests.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", lateness)
    n = timed.groupBy(F.window("_ts", "1 minute").alias("_minute"), F.col(client).alias("client")).agg(F.count("*").alias("hits"))
    return n.select("client", F.col("_minute.start").alias("minute"), "hits", F.greatest(F.col("hits") - per_minute, F.lit(0)).alias("rejected"))


def run_complete(stream: DataFrame, sink: str, checkpoint: str) -> None:
    """Process what is there and write the whole aggregate, days that are still open included, to ``sink``; executors write it."""
    write = lambda batch, _: batch.write.mode("overwrite").parquet(sink)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("complete").trigger(availableNow=True).start().awaitTermination()


def run_available(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there, then stop; the checkpoint makes the next call go on from here."""
    query = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
