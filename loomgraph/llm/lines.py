"""Line dedup: repeated runs of lines by a suffix array over line ids.

Every document is a sequence of line ids (a 128-bit hash of each line that has
a word). Distributed prefix doubling ranks the suffixes: in round k suffixes
are ordered by their first 2**k lines, by pairs of the ranks before. Suffixes
that no other shares a prefix with drop out. Suffixes that agree on m lines
form the interval of common prefixes of length m, named by two overlapping
ranks; all but its first suffix start later copies of that run. A run is
deleted if it has `min_words` words at least: so it is enough to look at the
shortest such run from each line on, and the shortest that ends at each line,
which together cover every maximal repeated run. Sorting by more lines than
the longest of these has can't change a decision, so there the rounds end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import discard, materialize, tidy, unused, whole_text
from .words import WORD, slices


@dataclass(frozen=True)
class Params:
    """Later copies of runs of lines with `min_words` words in all are deleted."""

    min_words: int = 50


def line_ids(docs: DataFrame) -> DataFrame:
    """(doc, mark, at, line, h, g, w): the lines that have a word, in order (at), with their number in the text, the halves of a hash without outer white space, and their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                row, at, line, words, digests = [], [], [], [], []
                for i, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                    n = 0
                    for number, raw in enumerate(text.split(b"\n")):
                        parts = raw.split()  # at the bytes that separate words
                        if parts:
                            row.append(i)
                            at.append(n)
                            line.append(number)
                            words.append(len(parts))
                            digests.append(xxhash.xxh3_128_digest(raw.strip()))
                            n += 1
                h, g = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2).T
                own = pa.array(row, pa.int64())
                yield pa.record_batch([batch.column("doc").take(own), batch.column("mark").take(own), pa.array(at, pa.int32()), pa.array(line, pa.int32()), pa.array(h), pa.array(g), pa.array(words, pa.int32())], ["doc", "mark", "at", "line", "h", "g", "w"])
        tidy()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("mark"), whole_text().alias("text")).filter("doc is not null")
    return rows.mapInArrow(run, "doc long, mark long, at int, line int, h long, g long, w int")


def _ranked(rows: DataFrame, keys: list[str], keep: list[str], name: str) -> DataFrame:
    """`keep` and the rank of those rows whose keys other rows have too, ranks in the order of the keys."""
    groups = rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    order = materialize(groups.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("rank", F.monotonically_increasing_id()), f"{name}-order")
    ranked = materialize(rows.join(order, keys).select(*keep, "rank"), name)
    discard(order)
    return ranked


def _windows(shared: DataFrame, p: Params) -> DataFrame:
    """(doc, mark, start, m, lines): the shortest runs of shared lines with enough words from each line on, and up to each line."""
    by_doc = shared.groupBy("doc", "mark").agg(F.array_sort(F.collect_list(F.struct("at", "line", "w"))).alias("x"))
    by_doc = by_doc.select("doc", "mark", F.col("x.at").alias("at"), F.col("x.line").alias("line"), F.col("x.w").alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column("at").offsets.to_numpy())
            owner = np.repeat(np.arange(batch.num_rows), sizes)
            at, line, w = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("at", "line", "w"))
            same = owner[1:] == owner[:-1]
            once = np.append(True, ~same | (at[1:] != at[:-1]))[: len(at)]  # rows alike in id and text are one document
            owner, at, line, w = (x[once] for x in (owner, at, line, w))
            run_of = np.cumsum(np.append(True, (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1))[: len(at)])
            total, n = np.concatenate([[0], np.cumsum(w)]), np.arange(len(at))
            ends = np.searchsorted(total, total[:-1] + p.min_words)  # the first end with enough words
            begins = np.searchsorted(total, total[1:] - p.min_words, side="right") - 1
            a, b = np.concatenate([n[ends <= len(at)], begins[begins >= 0]]), np.concatenate([ends[ends <= len(at)], n[begins >= 0] + 1])
            inside = run_of[a] == run_of[b - 1]
            a, b = np.divmod(np.unique(a[inside] * (len(at) + 1) + b[inside]), len(at) + 1)
            bounds = np.concatenate([[0], np.cumsum(b - a)])
            lines = line[np.repeat(a - bounds[:-1], b - a) + np.arange(bounds[-1])]
            own = pa.array(owner[a])
            listed = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(lines, pa.int32()))
            yield pa.record_batch([batch.column("doc").take(own), batch.column("mark").take(own), pa.array(at[a], pa.int32()), pa.array(b - a, pa.int32()), listed], ["doc", "mark", "start", "m", "lines"])
        tidy()

    return by_doc.mapInArrow(run, "doc long, mark long, start int, m int, lines array<int>")


def suffix_ranks(docs_lines: DataFrame, depth: int, first: DataFrame | None = None) -> Iterator[tuple[int, DataFrame]]:
    """(k, (doc, mark, at, rank)) for prefixes of 2**k lines up to `depth` lines: the ranks of suffixes that share such a prefix with others."""
    keys = ["doc", "mark", "at"]
    ranks = first if first is not None else _ranked(docs_lines, ["h", "g"], keys, "ranks")
    k = 0
    while True:
        yield k, ranks
        if 2 ** (k + 1) > depth:
            return
        ahead = ranks.select("doc", "mark", (F.col("at") - 2**k).alias("at"), F.col("rank").alias("r2"))
        pairs = materialize(ranks.select(*keys, F.col("rank").alias("r1")).join(ahead, keys), "pairs")
        if pairs.isEmpty():
            return
        ranks, k = _ranked(pairs, ["r1", "r2"], keys, "ranks"), k + 1
        discard(pairs)


def later_copies(docs: DataFrame, params: Params | None = None) -> DataFrame:
    """(doc_id, mark, removed): the numbers of the lines, from zero, that a later copy of a repeated run holds, for documents with any.

    Documents are in the order of doc_id (and a hash of the text). Of a run
    that overlaps its first copy only what is beyond that copy counts. Lines
    without a word don't count and don't interrupt a run. mark is the hash of
    the text: rows alike in both are one document; rows without a doc_id take
    no part. Null and empty texts have no lines.
    """
    p = params or Params()
    lines = materialize(line_ids(docs), "lines")
    shared = _ranked(lines, ["h", "g"], ["doc", "mark", "at", "line", "w"], "ranks").distinct()
    shared = materialize(shared, "shared")
    windows = materialize(_windows(shared, p), "windows")
    depth = windows.agg(F.max("m")).first()[0] or 0
    levels, kept = None, [lines, shared, windows]
    for k, ranks in suffix_ranks(lines, depth, shared.select("doc", "mark", "at", "rank")):
        kept.append(ranks)
        level = ranks.distinct().withColumn("k", F.lit(k))
        levels = level if levels is None else levels.unionByName(level)
    named = windows.withColumn("k", F.floor(F.log2("m") + 1e-9).cast("int")).withColumn("last", F.expr("start + m - (1 << k)"))
    at = lambda column, to: levels.select("doc", "mark", "k", F.col("at").alias(column), F.col("rank").alias(to))
    named = named.join(at("start", "r1"), ["doc", "mark", "k", "start"]).join(at("last", "r2"), ["doc", "mark", "k", "last"])
    named = materialize(named.select("doc", "mark", "start", "m", "lines", "r1", "r2"), "intervals")
    discard(*kept)
    firsts = named.groupBy("m", "r1", "r2").agg(F.min(F.struct("doc", "mark", "start")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    firsts = materialize(firsts, "firsts")  # by itself, so that a large interval can be split in the join
    copies = named.join(firsts, ["m", "r1", "r2"]).filter(F.struct("doc", "mark", "start") != F.col("first"))
    same = (F.col("doc") == F.col("first.doc")) & (F.col("mark") == F.col("first.mark"))
    inside = F.when(same, F.greatest(F.lit(0), F.col("first.start") + F.col("m") - F.col("start"))).otherwise(0)
    gone = F.slice("lines", inside + 1, F.greatest(F.col("m") - inside, F.lit(0)))
    found = copies.select("doc", "mark", F.explode(gone).alias("line")).distinct()
    return found.groupBy(F.col("doc").alias("doc_id"), "mark").agg(F.sort_array(F.collect_list("line")).alias("removed"))


def _without(removed: str | F.Column) -> F.Column:
    """The text without the lines whose numbers `removed` holds."""
    kept = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), removed)
    return F.transform(F.array(F.split("text", "\n", -1)), lambda lines: F.array_join(F.transform(kept(lines), lambda i: F.get(lines, i)), "\n"))[0]


def dedup_lines(docs: DataFrame, params: Params | None = None, drop_emptied: bool = True) -> DataFrame:
    """`docs` without the lines that `later_copies` finds, n_chars (if it is a column) counted anew.

    A document of which no line with a word is left goes, if `drop_emptied`;
    documents that lose nothing stay as they are, also null and empty ones.
    """
    mark, key, removed = (unused(docs, n) for n in ("mark", "key", "removed"))
    found = later_copies(docs, params)
    rows = docs.withColumns({mark: F.xxhash64("text"), key: F.col("doc_id").cast("long")})
    rows = rows.join(found, (rows[key] == found["doc_id"]) & (rows[mark] == found["mark"]), "left").select(*[rows[c] for c in docs.columns], found["removed"].alias(removed))
    rows = rows.withColumn("text", F.when(F.col(removed).isNull(), F.col("text")).otherwise(_without(F.col(removed))))
    if drop_emptied:
        rows = rows.filter(F.col(removed).isNull() | F.regexp_like("text", F.lit(WORD)))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col(removed).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return rows.select(*docs.columns)


def report(docs: DataFrame, params: Params | None = None) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256) of each row: lines, those deleted, and the digest of the text that is left.

    A null text counts as empty and has one line. Of equal runs the one of the
    least doc_id, and in it the first, stays; repeated rows are one document
    and get equal results; rows without a doc_id lose nothing. An empty table
    gives no rows.
    """
    found = later_copies(docs, params)
    rows = docs.select("doc_id", whole_text().alias("text"), F.xxhash64("text").alias("mark"))
    rows = rows.join(found, (rows["doc_id"].cast("long") == found["doc_id"]) & (rows["mark"] == found["mark"]), "left").select(rows["doc_id"], "text", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))
    text = F.when(F.size("removed") == 0, F.col("text")).otherwise(_without(F.col("removed")))
    return rows.select("doc_id", F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"), F.sha2(text, 256).alias("kept_sha256"))
