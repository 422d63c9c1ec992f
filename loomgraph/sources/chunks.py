"""A sink that writes rows in chunks, each of which succeeds or fails by itself, and tells of each what became of it.

`write_chunks` hands the rows to a data source whose tasks cut them into chunks
and write each as a Parquet file. A chunk that can't be written (a value that
doesn't fit its column, a null where none may be) costs only its own rows. The
files and states of the chunks come with the tasks' commits, and only what is
committed counts, so that failed attempts leave nothing behind that is read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from .tables import fresh_path

NAME = "loomgraph_chunks"
STATUS = "partition int, chunk int, rows long, file string, error string"


@dataclass
class Written(WriterCommitMessage):
    """What became of a task's chunks."""

    chunks: list[tuple[int, int, int, str | None, str | None]]


class ChunkWriter(DataSourceArrowWriter):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.schema, self.path, self.size = schema, options["path"], int(options.get("chunk", "1000"))
        self.required = json.loads(options.get("required", "[]"))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = pafs.FileSystem.from_uri(self.path)
        partition, done = TaskContext.get().partitionId(), []
        for number, chunk in enumerate(self._chunks(iterator)):
            name = f"part-{partition:05}-{number:05}-{uuid.uuid4().hex}.parquet"
            try:
                lacking = [c for c in self.required if chunk.column(c).null_count]
                if lacking:
                    raise ValueError(f"null in {', '.join(lacking)}")
                store.create_dir(root, recursive=True)
                pq.write_table(chunk.cast(to_arrow_schema(self.schema)), f"{root}/{name}", filesystem=store)
                done.append((partition, number, chunk.num_rows, name, None))
            except (ValueError, pa.ArrowException) as error:
                done.append((partition, number, chunk.num_rows, None, str(error)))
        return Written(done)

    def _chunks(self, iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, rows = [], 0
        for batch in iterator:
            at = 0
            while at < batch.num_rows:
                piece = batch.slice(at, self.size - rows)
                held.append(piece)
                rows, at = rows + piece.num_rows, at + piece.num_rows
                if rows == self.size:
                    yield pa.Table.from_batches(held)
                    held, rows = [], 0
        if held:
            yield pa.Table.from_batches(held)

    def commit(self, messages: list[Written | None]) -> None:
        """Keep the states of all chunks, a row of numbers and a name for each, beside the files."""
        store, root = pafs.FileSystem.from_uri(self.path)
        store.create_dir(f"{root}/_status", recursive=True)
        with store.open_output_stream(f"{root}/_status/{uuid.uuid4().hex}.json") as out:
            for message in messages:
                for row in message.chunks if message else ():
                    out.write((json.dumps(dict(zip(("partition", "chunk", "rows", "file", "error"), row, strict=True))) + "\n").encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Delete what the tasks that did end have written."""
        store, root = pafs.FileSystem.from_uri(self.path)
        for message in messages:
            for *_, file, _ in message.chunks if message else ():
                if file:
                    store.delete_file(f"{root}/{file}")


class Chunks(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema: T.StructType, overwrite: bool) -> ChunkWriter:
        return ChunkWriter(schema, self.options)


def write_chunks(rows: DataFrame, path: str | None = None, chunk: int = 1000, required: list[str] | None = None) -> str:
    """Append rows to a folder in chunks, in which the columns `required` must hold no null; gives the folder. No rows, no chunks."""
    spark, path = rows.sparkSession, path or fresh_path(rows.sparkSession, "chunks")
    spark.dataSource.register(Chunks)
    uri = path if "://" in path or path.startswith("file:") else f"file://{path}"
    rows.write.format(NAME).mode("append").option("path", uri).option("chunk", str(chunk)).option("required", json.dumps(required or [])).save()
    return path


def chunk_status(spark: SparkSession, path: str) -> DataFrame:
    """(partition, chunk, rows, file, error): a row for each chunk that was tried; error is null for those that were written."""
    return spark.read.schema(STATUS).json(f"{path}/_status")


def read_chunks(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The rows of all chunks that were written: files that no commit names aren't read."""
    named = chunk_status(spark, path).filter("file is not null").select(F.col("file").alias("_file"))
    files = spark.read.schema(schema).parquet(path).withColumn("_file", F.col("_metadata.file_name"))
    return files.join(named, "_file", "left_semi").drop("_file")
