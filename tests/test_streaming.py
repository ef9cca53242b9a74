from pyspark.sql import functions as F

from sparktn.streaming.running import windowed_sums


def test_stream_gives_the_rows_of_the_table(spark, tmp_path):
    rows = [(i, f"2024-01-0{1 + i % 3} 0{i % 9}:00:00", "ab"[i % 2], i) for i in range(20)]
    df = spark.createDataFrame(rows, "event_id bigint, ts string, event_type string, n bigint").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(f"file://{tmp_path}/events")
    stream = spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/events")
    q = windowed_sums(stream, ["event_type"], "n").writeStream.outputMode("complete").format("memory").queryName("sums").option("checkpointLocation", f"file://{tmp_path}/state").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.table("sums").collect()) == sorted(windowed_sums(df, ["event_type"], "n").collect())


def test_late_rows_count_until_the_watermark(spark, tmp_path):
    """Batches one by one: rows late by less than the bound are added to their window, later ones are dropped, others stay."""
    kind = "event_id bigint, ts timestamp, event_type string, n bigint"
    batches = [
        [(1, "2024-01-01 10:00:00", "a", 1), (2, "2024-01-02 10:00:00", "a", 2)],
        [(3, "2024-01-05 09:00:00", "a", 4), (4, "2024-01-01 23:00:00", "a", 8)],  # a day late
        [(5, "2024-01-01 05:00:00", "a", 16), (6, "2024-01-04 05:00:00", "b", 32)],  # the watermark has passed the first
        [(7, "2024-01-09 05:00:00", "a", 64)], [(8, "2024-01-12 05:00:00", "a", 128)],
    ]
    q = None
    for k, rows in enumerate(batches):
        df = spark.createDataFrame(rows, kind.replace("timestamp", "string")).withColumn("ts", F.to_timestamp("ts"))
        df.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        if not k:
            stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
            q = windowed_sums(stream, ["event_type"], "n").writeStream.outputMode("append").format("memory").queryName("late").option("checkpointLocation", f"file://{tmp_path}/late").start()
        q.processAllAvailable()
    q.stop()
    got = sorted((str(r["start"].date()), r["event_type"], r["v"]) for r in spark.table("late").collect())
    assert got == [("2024-01-01", "a", 9), ("2024-01-02", "a", 2), ("2024-01-04", "b", 32), ("2024-01-05", "a", 4), ("2024-01-09", "a", 64)]
