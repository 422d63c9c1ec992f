"""Reading tables, and keeping intermediate results where every executor sees them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Schemas of input tables by path, so that a table's files are asked for theirs once.
_SCHEMAS: dict[str, T.StructType] = {}
#: Numbers of buckets of tables that are `kept_together`, by their folders.
_BUCKETS: dict[str, int] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table; it keeps the schema that it had when it was first read by this process."""
    path = f"{sf_dir}/{name}.parquet"
    if path in _SCHEMAS:
        return spark.read.schema(_SCHEMAS[path]).parquet(path)
    df = spark.read.parquet(path)
    _SCHEMAS[path] = df.schema
    return df


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder for an intermediate table in the cluster's shared folder (`spark.checkpoint.dir`). Without that setting a local session gets a temporary folder, and a cluster, where executors could not read one another's files, an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="loomgraph-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/loomgraph/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame, name: str = "step") -> DataFrame:
    """`df` written to the shared folder and read again.

    This cuts the lineage of loops, and lost executors lose nothing.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def wide(df: DataFrame) -> DataFrame:
    """`df` as a side of joins that grows with the input and is shuffled, never broadcast.

    Spark takes the size of a side from its compressed files and columns. Rows
    of a few repeated texts take some bytes each there and a hundred in memory,
    and exploded ones count as one; such sides went through the driver.
    """
    return df.hint("merge")


def once(value: Column | str, of: Callable[[Column], Column]) -> Column:
    """`of` a value that is worked out once for a row, however often `of` names it; Spark would put its whole expression in each place."""
    return F.transform(F.array(value), of)[0]


def known(df: DataFrame, row: Column, good: Callable[[Column], Column]) -> DataFrame:
    """The fields of the struct `row` as columns, where `good` holds of it; worked out once for a row, as a filter behind a select would work them out for itself again."""
    return df.select(F.explode(F.filter(F.array(row), good)).alias("row")).select("row.*")


def bucketed(df: DataFrame, key: str, name: str = "bucketed", buckets: int | None = None, once_by: list[str] | None = None) -> tuple[DataFrame, str]:
    """`df` written as a table in buckets by `key`, each sorted by it, and read again, with the table's name; a join on the key doesn't shuffle it. With `once_by`, which has the key among them, only one row of each of these."""
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = f"loomgraph_{name}_{uuid.uuid4().hex}"
    dealt_out = df.repartition(n, key)
    dealt_out = dealt_out.dropDuplicates(once_by) if once_by else dealt_out
    dealt_out.write.format("parquet").bucketBy(n, key).sortBy(key).option("path", fresh_path(spark, name)).saveAsTable(named)
    return spark.table(named), named


def kept_together(df: DataFrame, key: str, name: str = "together", buckets: int | None = None, once_by: list[str] | None = None) -> DataFrame:
    """`df` in buckets by `key`, as many as those that it is read from, as a side of joins (see `wide`) that `together` leaves where it is. Only the files stay, no table of the catalog."""
    buckets = buckets or max((_BUCKETS.get(f.rsplit("/", 2)[1], 0) for f in df.inputFiles()), default=0) or parts_of(df)
    found, named = bucketed(df, key, name, buckets, once_by)
    df.sparkSession.sql(f"DROP TABLE {named}")
    _BUCKETS.update((f.rsplit("/", 2)[1], buckets) for f in found.inputFiles())
    return wide(found)


@contextmanager
def together(spark: SparkSession) -> Iterator[None]:
    """Joins that are run within take sides that lie in equal buckets by one of the join's keys as they lie; otherwise Spark shuffles both sides by all keys. What is run later is planned as ever, so results are to be written within."""
    setting = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def numbered(df: DataFrame, order: list[Column], to: str, of: Column | None = None) -> DataFrame:
    """`df` with the number of rows before each in an order, or their sum of `of`: ranges are sorted by themselves, and only a number for each range goes through the driver."""
    ranged = checkpointed(df.repartitionByRange(*order).withColumns({"_part": F.spark_partition_id(), "_of": F.lit(1).cast("long") if of is None else of}), "numbered")
    starts, before = [], 0
    for row in ranged.groupBy("_part").agg(F.sum("_of").alias("n")).orderBy("_part").collect():
        starts.append((row["_part"], before))
        before += row["n"]
    begins = df.sparkSession.createDataFrame(starts, "_part int, _start long")
    place = F.sum("_of").over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_of")
    return ranged.join(F.broadcast(begins), "_part").withColumn(to, F.col("_start") + place).drop("_part", "_of", "_start")


def dealt(df: DataFrame, *keys: str, mb: int = 8) -> DataFrame:
    """`df` dealt out by the keys to a part for each `mb` MB of the files that it comes from, at least one for each core.

    A fixed number of parts, or parts that Spark puts together by their
    compressed size, would have the tasks that count them keep more the more
    comes in.
    """
    return df.repartition(parts_of(df, mb), *keys)


def parts_of(df: DataFrame, mb: int = 8) -> int:
    """A part for each `mb` MB of the files that `df` comes from, at least one for each core."""
    spark = df.sparkSession
    size = 0
    for path in df.inputFiles():
        at, store = _folder(spark, path)
        size += store.getFileStatus(at).getLen()
    return max(spark.sparkContext.defaultParallelism, -(-size // (mb << 20)))


def _folder(spark: SparkSession, path: str):
    """A path and its file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if it isn't there."""
    at, store = _folder(spark, path)
    return [x.getPath().getName() for x in store.listStatus(at)] if store.exists(at) else []


def delete_folder(spark: SparkSession, path: str) -> None:
    at, store = _folder(spark, path)
    store.delete(at, True)


def discard(*frames: DataFrame) -> None:
    """Delete the intermediate tables that `frames` were read from, once nothing reads them any more."""
    for df in frames:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/loomgraph/" in f}:
            delete_folder(df.sparkSession, folder)


class Levels:
    """A table that grows by one level at a time: each level is written once, and all are read as one table with a column `depth`."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.schema = spark, fresh_path(spark, name), None

    def add(self, df: DataFrame, depth: int) -> DataFrame:
        """The rows of `df` as level `depth`, read again, with that column last."""
        path = f"{self.path}/depth={depth}"
        df.write.parquet(path)
        self.schema = T.StructType([*df.schema.fields, T.StructField("depth", T.IntegerType())])
        return self.spark.read.schema(df.schema).parquet(path).withColumn("depth", F.lit(depth))

    def all(self) -> DataFrame:
        """All levels so far."""
        return self.spark.read.schema(self.schema).parquet(self.path)
