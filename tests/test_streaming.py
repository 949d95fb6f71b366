"""The ticker gives the same counts over a stream as over a batch."""

from lodestone.streaming.ticker import event_counts


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    query = event_counts(stream, late="3650 days").writeStream.outputMode("complete").format("memory").queryName("ticks").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("ticks").collect())) == sorted(map(tuple, event_counts(batch).collect()))
