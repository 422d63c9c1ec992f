"""Whole texts as inputs of kernels, and the tables that stages keep where every executor sees them."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import checkpointed as materialize
from ..sources.tables import discard, fresh_path, table
from .words import slices

__all__ = ["discard", "fresh_path", "materialize", "numbered", "table", "tidy", "unused", "whole_text", "with_columns"]


def whole_text(column: str = "text") -> F.Column:
    """The text, a null counting as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def tidy() -> None:
    """Give memory that this worker holds but doesn't use back to the machine, as idle workers stay for later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # there with the GNU C library
    if trim:
        trim(0)


Kernel = Callable[[pa.Array], list[pa.Array]]


def with_columns(docs: DataFrame, column: str, added: dict[str, T.DataType], kernel: Callable[[], Kernel], keep: list[str] | None = None, limit: int = 1 << 20) -> DataFrame:
    """`docs`, or its columns `keep`, with the columns `added` that a kernel makes of the whole texts in `column`, nulls as empty.

    A column named as an added one is replaced, as by withColumn, whatever its
    case; every other name may be used. `kernel` is called once in each task
    and gives a function of an array of texts of about `limit` bytes. The text
    goes to Python once, and comes back only if it is kept.
    """
    replaced = {name.lower() for name in added}
    fields = [f for f in docs.schema.fields if f.name.lower() not in replaced and (keep is None or f.name in keep)]
    names = [f.name for f in fields]
    kept = column in names and isinstance(docs.schema[column].dataType, T.StringType)
    sent = [F.col(f"`{name}`") for name in names]
    if not kept:
        sent.append(whole_text(f"`{column}`").cast("string").alias(unused(docs, "text")))
    at = names.index(column) if kept else len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = kernel()
        for whole in batches:
            for batch in slices(whole, at, limit):
                columns = made(pc.fill_null(batch.column(at), ""))
                yield pa.record_batch([*batch.columns[: len(names)], *columns], [*names, *added])
        tidy()

    return docs.select(*sent).mapInArrow(run, T.StructType([*fields, *(T.StructField(name, kind) for name, kind in added.items())]))


def numbered(df: DataFrame, order: list[Column], to: str, count: Column | None = None) -> tuple[DataFrame, int]:
    """`df` with the number of rows (or the sum of `count`) before each in an order, and the number of all: ranges are sorted by themselves, and only a number for each range goes through the driver."""
    part, n = unused(df, "part"), F.lit(1).cast("long") if count is None else count.cast("long")
    ranged = materialize(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "numbered")
    each = {r["part"]: r["n"] for r in ranged.groupBy(F.col(part).alias("part")).agg(F.sum(n).alias("n")).collect()}
    starts, before = [], 0
    for number in sorted(each):
        starts.append((number, before))
        before += each[number]
    line = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    begins = df.sparkSession.createDataFrame(starts, "part int, start long")
    met = ranged.join(F.broadcast(begins), ranged[part] == begins["part"])
    return met.select(*[ranged[c] for c in df.columns], (begins["start"] + F.coalesce(F.sum(n).over(line), F.lit(0))).alias(to)), before


def unused(df: DataFrame, name: str) -> str:
    """A column name that `df` doesn't have yet, made of `name`."""
    taken = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name in taken:
        name = f"_{name}"
    return name
