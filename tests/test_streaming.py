from pyspark.sql import functions as F

from tidemill.operators import events
from tidemill.streaming import live


def test_cusum_stream_equals_batch(spark, tmp_path):
    rows = spark.range(400).select(F.lit("P").alias("pair"), F.timestamp_seconds(F.lit(1704700000) + F.col("id") * 60).alias("ts"), F.sin(F.col("id") * 0.7).alias("r"), F.lit(0.5).alias("s"), F.col("id"))
    for i in range(4):
        rows.filter(F.col("id").between(100 * i, 100 * i + 99)).drop("id").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.drop("id").schema).option("maxFilesPerTrigger", 4).parquet(str(tmp_path / "in"))
    q = live.cusum_events(stream, "r", "s", k=2.0, spacing_seconds=120).writeStream.format("memory").queryName("cusum").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.ts, r.direction) for r in spark.sql("select * from cusum").collect()}
    batch = events.cusum_events(rows.withColumn("ts", F.col("ts").cast("timestamp_ntz")), "r", "s", k=2.0, spacing_seconds=120)
    assert got == {(r.ts, r.direction) for r in batch.collect()} and got


def test_daily_stream(spark, tmp_path):
    rows = spark.range(96).select(F.lit("s").alias("strategy"), F.timestamp_seconds(F.lit(1704672000) + F.col("id") * 3600).alias("t0"), F.lit(1.0).alias("ret"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = live.daily_returns(stream, "1 hour").writeStream.format("memory").queryName("daily").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [r.ret for r in spark.sql("select * from daily order by day").collect()] == [24.0] * 3
