"""Scan history in time buckets, in batch; `streaming` has the same over streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import delete_folder, folders


def seconds(start: str = "started_at", end: str = "completed_at") -> Column:
    return F.unix_timestamp(end) - F.unix_timestamp(start)


def sums() -> list[Column]:
    """Scans, completed, failed, and rounded averages of nodes, edges and seconds."""
    return [F.count("*").alias("scans"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), *[F.round(F.avg(c)).cast("long").alias(n) for c, n in (("node_count", "nodes"), ("edge_count", "edges"))], F.round(F.avg(seconds())).cast("long").alias("seconds")]


def rolled(scans: DataFrame, width: str = "1 day", *keys: str) -> DataFrame:
    """(bucket, keys, sums) of finished scans."""
    return scans.filter("completed_at is not null").groupBy(F.window("started_at", width).alias("w"), *keys).agg(*sums()).select(F.col("w.start").alias("bucket"), *keys, "scans", "completed", "failed", "nodes", "edges", "seconds")


def trends(scans: DataFrame, width: str = "1 day", *keys: str) -> DataFrame:
    """(bucket, keys, scans, success_rate): percent of completed scans to two places."""
    return scans.groupBy(F.window("started_at", width).alias("w"), *keys).agg(F.count("*").alias("scans"), F.round(100 * F.count_if(F.col("status") == "completed") / F.count("*"), 2).alias("success_rate")).select(F.col("w.start").alias("bucket"), *keys, "scans", "success_rate")


def history(scans: DataFrame, repository: int, start: str, end: str) -> DataFrame:
    """Scans of a repository that began in [start, end], with their seconds."""
    inside = (F.col("repository_id") == repository) & (F.col("started_at") >= F.lit(start).cast("timestamp")) & (F.col("started_at") <= F.lit(end).cast("timestamp"))
    return scans.filter(inside).select("id", "status", "node_count", "edge_count", seconds().alias("seconds"))


def refreshed(old: DataFrame, scans: DataFrame, since: str, width: str = "1 day", *keys: str) -> DataFrame:
    """A rolled table with all buckets from `since` on made anew."""
    edge = F.lit(since).cast("timestamp")
    return old.filter(F.col("bucket") < edge).unionByName(rolled(scans.filter(F.col("started_at") >= edge), width, *keys))


def refresh(path: str, scans: DataFrame, since: str, until: str, width: str = "1 day", *keys: str) -> None:
    """Make the buckets in [since, until) of a stored table anew from the scans, late and deleted ones included; buckets outside stay as they are, their files untouched.

    A folder of the table holds one day. `since` and `until` have to be days'
    beginnings; refreshing again with the same scans changes nothing.
    """
    spark = scans.sparkSession
    begin, end = (F.lit(x).cast("timestamp") for x in (since, until))
    made = rolled(scans.filter((F.col("started_at") >= begin) & (F.col("started_at") < end)), width, *keys).withColumn("day", F.date_format("bucket", "yyyy-MM-dd"))
    made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    inside = {d for d in folders(spark, path) if d.startswith("day=") and since[:10] <= d[4:] < until[:10]}
    for day in inside - {f"day={r['day']}" for r in made.select("day").distinct().collect()}:  # days of the window of which nothing is left
        delete_folder(spark, f"{path}/{day}")


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The buckets of a table that `refresh` keeps."""
    return spark.read.parquet(path).drop("day")
