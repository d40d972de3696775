"""Streams agree with the batch."""

from pyspark.sql import functions as F

from tidewatt.streaming import bins


def drained(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return stream.sparkSession.table(name)


def test_bins_equal_batch(spark, tmp_path):
    rows = spark.sql("SELECT concat('s', id % 2) AS s, timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(id * 7 AS INT)) AS ts, CAST(id AS double) AS v FROM range(400)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    got = drained(bins.binned(stream, "s", "ts", "v"), "bins_out", "complete").collect()
    want = rows.groupBy("s", F.date_trunc("hour", "ts").alias("ts")).agg(F.avg("v").alias("mean"), F.max("v").alias("max"), F.count("*").alias("n")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_gaps_keep_state_between_batches(spark, tmp_path):
    for i, hours in enumerate(([0, 1, 4], [5, 9], [9, 10])):
        df = spark.createDataFrame([("a", h) for h in hours], "s string, h int").select("s", F.timestamp_micros(F.col("h").cast("long") * 3_600_000_000).alias("ts"))
        df.coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    stream = spark.readStream.schema("s string, ts timestamp").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {(r.start_us // 3_600_000_000, r.end_us // 3_600_000_000, r.length) for r in drained(bins.gaps(stream, "s", "ts", 3_600_000_000), "gaps_out").collect()}
    assert got == {(2, 3, 2), (6, 8, 3)}
