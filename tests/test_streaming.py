from pyspark.sql import functions as F

from aeroframe.streaming.running import windowed_statistics


def test_windows_over_a_stream(spark, tmp_path):
    source = tmp_path / "in"
    spark.range(40).select(F.timestamp_seconds(F.col("id") * 60).alias("time"), F.col("id").cast("double").alias("wind"), F.lit("a").alias("station")).write.parquet(str(source))
    stream = spark.readStream.schema("time timestamp, wind double, station string").parquet(str(source))
    out = windowed_statistics(stream, "wind", by=["station"], window="10 minutes")
    query = out.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    got = [r["mean"] for r in spark.table("windows").orderBy("start").collect()]
    assert got == [4.5, 14.5, 24.5, 34.5]
