"""Structured Streaming: rate limits, usage counts and job states.

Counters are state of the query, checkpointed by Spark, and expire when the
watermark has passed their window.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foilframe.operators.relational import latest, rate_limited
from foilframe.operators.tables import folder

LIMITED = "user_id long, bucket long, event_id long, ts timestamp, allowed boolean"


def rate_limit(events: DataFrame, limit: int, width: int = 60, late: str = "10 minutes") -> DataFrame:
    """user_id, bucket, event_id, ts and whether each request passes: in a window the first limit of a key do.

    Within a batch requests are taken by time and id; a request that comes after a
    later one was counted takes the next place. Rejected requests are not counted.
    """
    keyed = events.select("user_id", F.floor(F.unix_timestamp("ts") / width).cast("long").alias("bucket"), "event_id", "ts").withWatermark("ts", late)

    def count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        used = int(state.get[0]) if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        rows["allowed"] = [used + k < limit for k in range(len(rows))]
        state.update((min(limit, used + len(rows)),))
        state.setTimeoutTimestamp(max((int(key[1]) + 1) * width * 1000, int(state.getCurrentWatermarkMs()) + 1))
        yield rows[["user_id", "bucket", "event_id", "ts", "allowed"]]

    return keyed.groupBy("user_id", "bucket").applyInPandasWithState(count, LIMITED, "used int", "append", GroupStateTimeout.EventTimeTimeout)


def rate_limit_in_order(events: DataFrame, limit: int, width: int = 60, late: str = "10 minutes") -> DataFrame:
    """rate_limit() with requests taken by time and id whatever the order and the batches in which they come.

    A window's requests are kept until the watermark has passed it and are sent
    then, so no later request can take a place before them; what is later than the
    watermark is left out. The state is one window's requests for each key.
    """
    timed = events.select("user_id", "event_id", "ts").withWatermark("ts", late)
    window = F.window("ts", f"{width} seconds")
    request = F.struct("ts", "event_id")
    closed = timed.groupBy(window, "user_id").agg(F.sort_array(F.collect_list(request)).alias("requests"))
    each = closed.select("user_id", F.floor(F.unix_timestamp("window.start") / width).cast("long").alias("bucket"), F.posexplode("requests").alias("k", "r"))
    return each.select("user_id", "bucket", "r.event_id", "r.ts", (F.col("k") < limit).alias("allowed"))


def limited_so_far(spark: SparkSession, path: str, limit: int, width: int, late: str = "10 minutes", files_per_batch: int | None = None) -> DataFrame:
    """rate_limit_in_order() over the events of a table (a pattern, as a stream takes a plain path for a folder) that are there now; checkpoint and output go to the folder named in spark.checkpoint.dir.

    Each batch replaces its own output, so one that runs again counts once. Windows
    that the watermark hasn't passed at the end are ranked as they are.
    """
    out = folder(spark, "rate-limit")
    now = spark.read.parquet(path)
    reader = spark.readStream.schema(now.schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    timed = lambda df: df.withColumn("ts", F.col("ts").cast("timestamp"))
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")
    query = rate_limit_in_order(timed(reader.parquet(path)), limit, width, late).writeStream.outputMode("append").option("checkpointLocation", f"{out}/query").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    # the watermark of the last batch, which closed what ends before it
    passed = max((p["eventTime"]["watermark"] for p in query.recentProgress if "watermark" in p["eventTime"]), default="1970-01-01T00:00:00.000Z")
    bucket = F.floor(F.unix_timestamp("ts") / width).cast("long")
    open_ = timed(now).filter((bucket + 1) * width > F.unix_timestamp(F.lit(passed).cast("timestamp")))
    ranked = rate_limited(open_, "user_id", bucket, [F.col("ts"), F.col("event_id")], limit).select("user_id", "bucket", "event_id", "ts", "allowed")
    closed = spark.read.schema(LIMITED).parquet(f"{out}/rows").select(*ranked.columns) if query.recentProgress else ranked.limit(0)
    return closed.unionByName(ranked)


def usage(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Requests and errors of each key in each window, sent when the window is closed."""
    timed = events.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "user_id").agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("event_type") == "error").alias("errors")).select("window.start", "user_id", "requests", "errors")


def append_jobs(events: DataFrame, path: str, checkpoint: str):
    """Status events appended as they come, one folder for each batch, so a batch that runs again replaces its own."""
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
    return events.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def job_states(log: DataFrame) -> DataFrame:
    """The current state of each job: its last event. Completed and failed jobs carry when they ended."""
    now = latest(log, "job_id", [F.col("ts"), F.col("seq")])
    return now.withColumn("completed_at", F.when(F.col("status").isin("completed", "failed"), F.col("ts")))
