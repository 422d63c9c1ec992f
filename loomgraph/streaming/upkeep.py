"""A stored index of external objects kept up with scan events: what a finished scan refers to, less what deleted scans did."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import external
from ..sources.tables import checkpointed, delete_folder, folders
from .scans import each_batch


def index_of(spark: SparkSession, path: str) -> DataFrame:
    """The entries of the index."""
    return spark.read.parquet(f"{path}/entries")


def apply(path: str, events: DataFrame, batch: int, nodes: Callable[[DataFrame], DataFrame]) -> None:
    """Bring the index to the state after events (event_id, scan_id, kind, at); kind is completed or deleted.

    Of each scan the last event counts, ties by event_id, among all batches so
    far: the log of applied events says what was last, so that an event that
    comes late changes nothing. A scan's entries are a folder that is replaced
    or deleted as a whole. A batch that comes again writes the same log and
    the same folders. `nodes` gives the nodes of scans (scan_id).
    """
    spark = events.sparkSession
    known = events.filter("event_id is not null and scan_id is not null and at is not null").select("scan_id", F.struct("at", "event_id", "kind").alias("e"))
    last = checkpointed(known.groupBy("scan_id").agg(F.max("e").alias("e")), "events")
    earlier = None
    if [f for f in folders(spark, f"{path}/log") if f.startswith("batch=") and f != f"batch={batch}"]:
        log = spark.read.parquet(f"{path}/log").filter(F.col("batch") != batch)
        earlier = log.join(last.select("scan_id"), "scan_id", "left_semi").groupBy("scan_id").agg(F.max("e").alias("before"))
    new = last if earlier is None else last.join(earlier, "scan_id", "left").filter("before is null or e > before").select("scan_id", "e")
    new = checkpointed(new, "events")
    completed = new.filter("e.kind = 'completed'").select("scan_id")
    entries = external.references(nodes(completed)).withColumn("scan", F.col("scan_id"))
    entries = checkpointed(entries.join(completed, "scan_id", "left_semi"), "entries")
    entries.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scan").parquet(f"{path}/entries")
    emptied = new.join(entries.select("scan_id").distinct(), "scan_id", "left_anti")
    here = set(folders(spark, f"{path}/entries"))
    for row in emptied.select("scan_id").toLocalIterator():  # scans of the batch whose entries go, one at a time
        if f"scan={row['scan_id']}" in here:
            delete_folder(spark, f"{path}/entries/scan={row['scan_id']}")
    last.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/log")


def keep_up(path: str, events: DataFrame, nodes: Callable[[DataFrame], DataFrame], checkpoint: str, late: str = "3 days") -> StreamingQuery:
    """Apply a stream of scan events to the index, each event once by its id."""
    once = events.withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])
    return each_batch(once, lambda batch, number: apply(path, batch, number, nodes), checkpoint)
