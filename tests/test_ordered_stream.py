"""The ordered rate limit over events that come shuffled, in many files and batches, against the batch operator."""

from pyspark.sql import functions as F

from foilframe.operators import relational as R
from foilframe.streaming import queries


def test_shuffled_files_give_the_batch_rows(spark, tmp_path):
    events = spark.range(600).select(F.col("id").alias("event_id"), (F.col("id") % 3).alias("user_id"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 7 % 1800 + F.col("id") % 2).alias("ts"))
    events.orderBy(F.xxhash64("event_id")).repartition(6).write.parquet(str(tmp_path / "in"))
    found = queries.limited_so_far(spark, str(tmp_path / "{in}"), 5, 60, late="2 hours", files_per_batch=1)
    bucket = F.floor(F.unix_timestamp("ts") / 60).cast("long")
    want = R.rate_limited(events, "user_id", bucket, [F.col("ts"), F.col("event_id")], 5).select("user_id", "bucket", "event_id", "ts", "allowed")
    rows = lambda df: sorted(map(tuple, df.select("user_id", "bucket", "event_id", "ts", "allowed").collect()))
    assert rows(found) == rows(want)


def test_windows_close_while_the_stream_runs(spark, tmp_path):
    """Events in about the order of time, many batches, a short watermark: most windows are sent by the stream itself, each request once."""
    for k in range(5):
        part = spark.range(k * 200, k * 200 + 200).select(F.col("id").alias("event_id"), F.lit(1).cast("long").alias("user_id"), F.timestamp_seconds(1_700_000_040 + F.col("id") * 3 + F.hash("id") % 20).alias("ts"))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    found = queries.limited_so_far(spark, str(tmp_path / "{in}"), 4, 60, late="1 minute", files_per_batch=1)
    all_ = spark.read.parquet(str(tmp_path / "in"))
    bucket = F.floor(F.unix_timestamp("ts") / 60).cast("long")
    want = R.rate_limited(all_, "user_id", bucket, [F.col("ts"), F.col("event_id")], 4)
    rows = lambda df: sorted(map(tuple, df.select("event_id", "bucket", "allowed").collect()))
    assert rows(found) == rows(want)
