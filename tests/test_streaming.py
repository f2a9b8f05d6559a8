import os
import tempfile
from datetime import datetime, time, timedelta

from pyspark.sql import functions as F

from ledgerspark.streaming.rates import daily_mean_stream


def test_daily_mean_stream_matches_batch(spark):
    src = "/root/testdata/sf0.001/events.parquet"
    schema = spark.read.parquet(src).schema
    d = tempfile.mkdtemp(prefix="ls-stream-")
    stream = (spark.readStream.schema(schema).option("basePath", os.path.dirname(src)).parquet(src.replace(".parquet", "*.parquet"))
                  .where("event_type = 'purchase'")
                  .select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("currency"),
                          F.col("value").alias("exchange_rate")))
    q = (daily_mean_stream(stream).writeStream.outputMode("append").format("memory").queryName("daily_s")
         .option("checkpointLocation", d).start())
    q.processAllAvailable()
    q.stop()
    got = {(r.currency, r.exchange_date): (r.exchange_rate, r.num_observations) for r in spark.table("daily_s").collect()}
    ev = (spark.read.parquet(src).where("event_type = 'purchase'")
               .select(F.col("user_id").alias("currency"), F.to_date("ts").alias("d"), "ts", "value"))
    batch = {(r.currency, r.d): (r.m, r.n) for r in ev.groupBy("currency", "d").agg(
        F.avg("value").alias("m"), F.count(F.lit(1)).alias("n")).collect()}
    # append mode emits the days that the watermark has closed: all but those that end within the allowed lateness
    last = ev.agg(F.max("ts")).first()[0]
    closed = {k for k in batch if datetime.combine(k[1], time()) + timedelta(days=1) <= last - timedelta(days=1)}
    assert closed and closed <= set(got) <= set(batch)
    for k, (m, n) in got.items():
        assert n == batch[k][1] and abs(m - batch[k][0]) < 1e-9
