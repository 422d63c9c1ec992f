"""The streaming forms give what the batch forms give."""

from pyspark.sql import functions as F

from loomgraph.operators import timeseries
from loomgraph.streaming import scans as streams

SCHEMA = "id long, repository_id long, status string, started_at timestamp, completed_at timestamp, node_count long, edge_count long"


def scans(spark):
    rows = spark.range(400).select("id", (F.col("id") % 5).alias("repository_id"), F.when(F.col("id") % 7 == 0, "failed").otherwise("completed").alias("status"), F.timestamp_seconds(1704067200 + F.col("id") * 3600).alias("started_at"))
    done = F.when(F.col("id") % 11 != 0, F.timestamp_seconds(F.unix_timestamp("started_at") + F.col("id") % 600))
    return rows.select("*", done.alias("completed_at"), (F.col("id") % 13).alias("node_count"), (F.col("id") % 17).alias("edge_count"))


def test_closed_buckets_of_a_stream_are_the_batch_s(spark, tmp_path):
    scans(spark).repartitionByRange(4, "id").write.parquet(str(tmp_path / "in"))
    stream = streams.rolled_stream(streams.read_scans(spark, str(tmp_path / "in"), SCHEMA, 10), "1 day", "1 day", "repository_id")
    run = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {tuple(r) for r in timeseries.rolled(scans(spark), "1 day", "repository_id").collect()}
    assert got and got <= want and len(want) - len(got) <= 15  # the last days stay open


def test_batches_are_handled_and_small_scans_skipped(spark, tmp_path):
    scans(spark).coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = streams.finished_scans(streams.read_scans(spark, str(tmp_path / "in"), SCHEMA), 5)
    streams.each_batch(stream, lambda df, n: seen.append((n, df.count())), str(tmp_path / "c")).awaitTermination()
    assert sum(n for _, n in seen) == scans(spark).filter("status = 'completed' and node_count >= 5").count()


def test_refresh_replaces_buckets_from_a_day_on(spark):
    whole = timeseries.rolled(scans(spark), "1 day")
    stale = whole.withColumn("scans", F.lit(0).cast("long"))
    got = {tuple(r) for r in timeseries.refreshed(stale, scans(spark), "2024-01-05", "1 day").collect()}
    want = {tuple(r) for r in stale.filter("bucket < timestamp '2024-01-05'").union(whole.filter("bucket >= timestamp '2024-01-05'")).collect()}
    assert got == want
