"""WARC records in ZIP packages: written from rows, located and range-read without extraction.

A package is a ZIP file whose members are stored as they are: `archive/data.warc.gz`,
one gzip member for each record, and `indexes/index.cdxj`, a line for each
record with its offset and length. The reader takes the end of a package, its
central directory (or the ZIP64 one), the index member, and then only the
ranges of the records that are wanted. Packages lie in a folder that the driver
and all executors share; any store that pyarrow's file systems open will do.
"""

from __future__ import annotations

import base64
import binascii
import gzip
import hashlib
import io
import json
import struct
import urllib.parse
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import fresh_path, materialize

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Params:
    """Equal payloads of `least_bytes` or more become revisits. A package is closed once it holds `package_bytes`; ranges that lie together are read `span_bytes` at a time. Records bear `date`."""

    least_bytes: int = 1000
    package_bytes: int = 16 << 20
    span_bytes: int = 2 << 20
    level: int = 6
    date: str = "1970-01-01T00:00:00Z"


# ---- ZIP packages


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    local_header: int


def _from_extra(extra: bytes, values: list[int]) -> list[int]:
    """The values of a directory entry, those at their 32-bit limit taken from the ZIP64 extra field in order."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            wide = iter(struct.unpack_from(f"<{size // 8}Q", extra, at + 4))
            return [next(wide) if v == 0xFFFFFFFF else v for v in values]
        at += 4 + size
    return values


def read_directory(file) -> dict[str, Member]:
    """The members of a package by name, from the central directory alone."""
    size = file.size()
    tail_at = max(0, size - 65557)
    tail = file.read_at(size - tail_at, tail_at)
    end = tail.rfind(b"PK\5\6")
    if end < 0:
        raise ValueError("no end of a central directory: not a ZIP file")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    if 0xFFFF == count or 0xFFFFFFFF in (length, start):
        locator = tail.rfind(b"PK\6\7", 0, end)
        if locator < 0:
            raise ValueError("no ZIP64 locator")
        (at,) = struct.unpack_from("<Q", tail, locator + 8)
        record = file.read_at(56, at)
        if record[:4] != b"PK\6\6":
            raise ValueError("no ZIP64 end record")
        count, length, start = struct.unpack_from("<QQQ", record, 32)
    directory, at, found = file.read_at(length, start), 0, {}
    for _ in range(count):
        if directory[at : at + 4] != b"PK\1\2":
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", directory, at + 8)
        packed, plain, names, extras, notes = struct.unpack_from("<IIHHH", directory, at + 20)
        (header,) = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + 46 : at + 46 + names].decode("utf-8" if flags & 0x800 else "cp437")
        plain, packed, header = _from_extra(directory[at + 46 + names : at + 46 + names + extras], [plain, packed, header])
        found[name] = Member(name, method, packed, header)
        at += 46 + names + extras + notes
    return found


def data_start(file, member: Member) -> int:
    """Where the bytes of a stored member begin."""
    if member.method:
        raise ValueError(f"{member.name} is not stored")
    header = file.read_at(30, member.local_header)
    if header[:4] != b"PK\3\4":
        raise ValueError(f"{member.name} has no local header")
    names, extras = struct.unpack_from("<HH", header, 26)
    return member.local_header + 30 + names + extras


# Schemes of Spark's file systems whose stores have other names here.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasbs": "abfss", "wasb": "abfs"}


def store_uri(path: str) -> str:
    """The URI by which pyarrow's file systems know a path of Spark's."""
    scheme, mark, rest = path.partition("://")
    return f"{SCHEMES.get(scheme.lower(), scheme)}{mark}{rest}"


def _opened(path: str):
    system, inner = pa.fs.FileSystem.from_uri(store_uri(path))
    return system.open_input_file(inner)


# ---- WARC records


def _clean(url: str | None) -> str:
    return urllib.parse.quote(url or "", safe="".join(map(chr, range(33, 127))))


def record_bytes(page: int | None, url: str | None, digest: bytes, n: int, payload: bytes | None, refers: int | None, date: str) -> bytes:
    """A response record, or a revisit record (with the response's HTTP headers only) where `refers` names a page."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    block = http if refers is not None else http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}"]
    head += [f"WARC-Target-URI: {_clean(url)}"] if url else []
    head += [f"WARC-Refers-To: <urn:page:{refers}>", f"WARC-Profile: {IDENTICAL}"] if refers is not None else []
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}


def _page_of(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def parse_record(raw: bytes) -> dict:
    """A record's page, URL, type, the page it refers to, payload size and digest, and payload (null for revisits). Fails if the payload doesn't have the digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    fields = _fields(head)
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:"))
    revisit = fields["warc-type"] == "revisit"
    if not revisit and hashlib.sha1(payload).digest() != digest:
        raise ValueError(f"the payload of {fields['warc-record-id']} doesn't have its digest")
    return {
        "page_id": _page_of(fields["warc-record-id"]),
        "url": fields.get("warc-target-uri"),
        "record_type": fields["warc-type"],
        "refers_to": _page_of(fields.get("warc-refers-to")),
        "payload_bytes": int(_fields(http)["content-length"]),
        "payload_digest": binascii.hexlify(digest).decode(),
        "payload": None if revisit else payload,
    }


# ---- Writing


def _revisits(pages: DataFrame, p: Params) -> DataFrame:
    """(page_id, digest, refers_to) of pages whose payload a page of a larger id has too."""
    sized = pages.filter(F.col("n") >= p.least_bytes).filter("page_id is not null").select("page_id", "digest")
    groups = sized.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    return sized.join(groups, "digest").filter("page_id < refers_to").distinct()


def write_packages(pages: DataFrame, folder: str, params: Params | None = None) -> DataFrame:
    """Write the rows of `pages` (page_id, url, html) to packages in `folder`; gives (path, records, bytes) of each.

    A null html is an empty payload. Of payloads that are equal and long enough
    the page of the largest id is the response and the others revisit it; a row
    whose page_id is null is a response that no other refers to; a row repeated
    with the same page_id and payload is written as often, and alike. Each run
    of a task writes files of its own; those that are listed are whole.
    """
    p = params or Params()
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("payload")).withColumn("digest", F.unhex(F.sha1("payload"))).withColumn("n", F.octet_length("payload"))
    rows = rows.join(_revisits(rows, p), ["page_id", "digest"], "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = pa.fs.FileSystem.from_uri(store_uri(folder))
        system.create_dir(inner, recursive=True)
        data, index, count = io.BytesIO(), [], 0

        def close() -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.wacz"
            with system.open_output_stream(f"{inner}/{name}") as out:
                with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as package:
                    package.writestr(DATA, data.getvalue())
                    package.writestr(INDEX, "".join(index))
                size = out.tell()
            return pa.record_batch([pa.array([f"{folder}/{name}"]), pa.array([count], pa.int64()), pa.array([size], pa.int64())], ["path", "records", "bytes"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                raw = gzip.compress(record_bytes(row["page_id"], row["url"], row["digest"], row["n"], row["payload"], row["refers_to"], p.date), p.level, mtime=0)
                entry = {"offset": data.tell(), "length": len(raw), "page_id": row["page_id"], "mime": "warc/revisit" if row["refers_to"] is not None else "text/html"}
                index.append(f"{_clean(row['url']) or '-'} {p.date} {json.dumps(entry)}\n")
                data.write(raw)
                count += 1
                if data.tell() >= p.package_bytes:
                    yield close()
                    data, index, count = io.BytesIO(), [], 0
        if count:
            yield close()

    return rows.select("page_id", "url", "payload", "digest", "n", "refers_to").mapInArrow(write, "path string, records long, bytes long")


# ---- Reading


def locate(packages: DataFrame) -> DataFrame:
    """(path, offset, length, url, page_id, mime) of each record, offsets counting from the package's start, from the packages' directories and indexes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with _opened(path) as file:
                    members = read_directory(file)
                    start, lines = data_start(file, members[DATA]), file.read_at(members[INDEX].size, data_start(file, members[INDEX])).decode()
                rows = [(line.split(" ", 1)[0], json.loads(line.split(" ", 2)[2])) for line in lines.splitlines()]
                for at in range(0, len(rows), 10_000):
                    some = rows[at : at + 10_000]
                    columns = [[path] * len(some), [start + e["offset"] for _, e in some], [e["length"] for _, e in some], [u for u, _ in some], [e["page_id"] for _, e in some], [e["mime"] for _, e in some]]
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()), strict=True)], ["path", "offset", "length", "url", "page_id", "mime"])

    return packages.select("path").mapInArrow(run, "path string, offset long, length long, url string, page_id long, mime string")


_RECORD = {"page_id": T.LongType(), "url": T.StringType(), "record_type": T.StringType(), "refers_to": T.LongType(), "payload_bytes": T.LongType(), "payload_digest": T.StringType(), "payload": T.BinaryType()}
_ARROW = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "payload": pa.binary()}


def read_records(located: DataFrame, payload: bool = True, params: Params | None = None) -> DataFrame:
    """The records at the ranges of `located` (path, offset, length), parsed and their payloads checked against their digests."""
    p = params or Params()
    names = [c for c in _RECORD if payload or c != "payload"]

    def spans(rows: list[dict]) -> Iterator[list[dict]]:
        """Runs of ranges that follow each other in one package, `span_bytes` at most unless a record is longer."""
        run: list[dict] = []
        for row in rows:
            if run and (row["path"] != run[-1]["path"] or row["offset"] != run[-1]["offset"] + run[-1]["length"] or row["offset"] + row["length"] - run[0]["offset"] > p.span_bytes):
                yield run
                run = []
            run.append(row)
        if run:
            yield run

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file = None, None
        for batch in batches:
            for run in spans(batch.select(["path", "offset", "length"]).to_pylist()):
                if run[0]["path"] != path:
                    path = run[0]["path"]
                    file = _opened(path)
                begin = run[0]["offset"]
                raw = file.read_at(run[-1]["offset"] + run[-1]["length"] - begin, begin)
                found = [parse_record(zlib.decompress(raw[r["offset"] - begin : r["offset"] - begin + r["length"]], 31)) for r in run]
                yield pa.record_batch([pa.array([f[c] for f in found], _ARROW[c]) for c in names], names)

    return located.select("path", "offset", "length").mapInArrow(read, T.StructType([T.StructField(c, _RECORD[c]) for c in names]))


def round_trip(pages: DataFrame, params: Params | None = None, payload: bool = False) -> DataFrame:
    """`pages` written to packages in the shared folder and read back: one record for each row. An empty table gives none."""
    packages = materialize(write_packages(pages, fresh_path(pages.sparkSession, "packages"), params), "manifest")
    spread = packages.repartition(max(1, packages.count()), "path")
    return read_records(locate(spread), payload, params)
