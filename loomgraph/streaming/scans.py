"""Streams of scan events: time buckets with watermarks, and tables kept by batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.timeseries import sums


def read_scans(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of Parquet files of scans; event times must be TIMESTAMP for watermarks."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def rolled_stream(scans: DataFrame, width: str = "1 day", late: str = "3 days", *keys: str) -> DataFrame:
    """The batch form's (bucket, keys, sums) over a stream; a bucket is final once `late` has passed after it."""
    on = scans.withWatermark("started_at", late).filter("completed_at is not null")
    return on.groupBy(F.window("started_at", width).alias("w"), *keys).agg(*sums()).select(F.col("w.start").alias("bucket"), *keys, "scans", "completed", "failed", "nodes", "edges", "seconds")


def each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Handle all data there is, batch by batch; after a restart each batch comes again with its number."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finished_scans(stream: DataFrame, least_nodes: int = 1) -> DataFrame:
    """Events of completed scans with enough nodes to index."""
    return stream.filter((F.col("status") == "completed") & (F.col("node_count") >= least_nodes))
