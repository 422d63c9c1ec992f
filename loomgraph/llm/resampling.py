"""Importance resampling towards a target corpus by inverted postings of hashed features.

Both corpora are counted by bucket and meet there: a bucket's gain is the
logarithm of how much more often the target has it. The postings (bucket,
document, count), in lists by bucket and block of documents, are shuffled to
the buckets' gains; what they contribute is summed by document, and the highest
scores, perturbed by seeded Gumbel noise, are drawn.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import materialize, numbered, tidy, whole_text
from .words import slices

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

#: Bytes of text in a block of postings.
_BLOCK = 4 << 20
_POSTING = ["bucket", "block", "n", "at", "counts", "doc_ids"]
_CONTRIBUTION = ["block", "at", "total", "n", "doc_ids", "words"]


@dataclass(frozen=True)
class Params:
    """Features are runs of 1 to `longest` words, in `buckets` buckets. Of the documents with `least_words` words `percent` of a hundred are drawn."""

    longest: int = 1
    buckets: int = 10_000
    least_words: int = 20
    percent: int = 10
    seed: int = 2024


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts as bytes, A-Z lower-cased, and each word's text. A word is a run of digits, small letters and whatever isn't ASCII."""
    parts = texts.cast(pa.large_binary()).to_pylist()
    raw = _LOWER[np.frombuffer(b" ".join(parts), np.uint8)]
    inside = _IN_WORD[raw]
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    ends = np.flatnonzero(inside & ~np.concatenate([inside[1:], [False]])) + 1
    owner = np.searchsorted(np.cumsum([len(p) + 1 for p in parts]), starts, side="right")
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])]), owner


def features(texts: pa.Array, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket) of each feature, and the number of words of each text."""
    words, owner = words_of(texts)
    owners, found = [], []
    runs = words
    for n in range(1, p.longest + 1):
        if n > 1:  # the runs so far with the word after them
            runs = pc.binary_join_element_wise(runs.slice(0, max(0, len(words) - n + 1)), words.slice(min(n - 1, len(words))), b" ")
        coded = runs.dictionary_encode()
        bucket = np.fromiter((zlib.crc32(w) % p.buckets for w in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        within = owner[: len(runs)] == owner[len(owner) - len(runs) :]
        owners.append(owner[: len(runs)][within])
        found.append(bucket[coded.indices.to_numpy(zero_copy_only=False)[within]] if len(runs) else np.empty(0, np.int64))
    return np.concatenate(owners), np.concatenate(found), np.bincount(owner, minlength=len(texts))


def bucket_counts(texts: DataFrame, p: Params) -> DataFrame:
    """(bucket, n) of all features of (text): each task counts what it has seen, so that a bucket moves once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(p.buckets, np.int64)
        for whole in batches:
            for batch in slices(whole, "text"):
                seen += np.bincount(features(batch.column("text"), p)[1], minlength=p.buckets)
        own = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(own, pa.int32()), pa.array(seen[own], pa.int64())], ["bucket", "n"])
        tidy()

    return texts.select(whole_text().alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(counts: DataFrame, target: DataFrame, p: Params) -> DataFrame:
    """(bucket, gain) of the buckets that the corpus (bucket, n) or the target (text) has, `buckets` rows at most."""
    none = F.lit(0).cast("long")
    both = counts.select("bucket", F.col("n").alias("s"), none.alias("t")).union(bucket_counts(target, p).select("bucket", none, F.col("n")))
    both = materialize(both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "counts")
    whole = both.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("whole_s"), F.coalesce(F.sum("t"), F.lit(0)).alias("whole_t"))
    real = lambda c: F.col(c).cast("double")
    ratio = (real("t") + 1) * (real("whole_s") + p.buckets) / ((real("s") + 1) * (real("whole_t") + p.buckets))
    return both.crossJoin(F.broadcast(whole)).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))  # with one row


def _lists(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def postings(docs: DataFrame, p: Params) -> DataFrame:
    """(bucket, block, n, at, counts, doc_ids): the inverted lists of the features of (doc_id, text), block by block of some megabytes of text.

    In a block the bucket occurs `n` times: `counts` times in the rows `at`.
    A block's row without a bucket lists the doc_ids of its rows, and in
    `counts` their numbers of words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in slices(whole, "text", _BLOCK):
                rows = batch.num_rows
                owner, bucket, words = features(batch.column("text"), p)
                codes, n = np.unique(bucket * rows + owner, return_counts=True)
                kind = codes // rows
                starts = np.flatnonzero(np.diff(kind, prepend=-1))
                ends = np.append(starts[1:], len(kind)).astype(np.int64) if len(starts) else starts
                sums = np.concatenate([[0], np.cumsum(n)])
                lists = np.concatenate([starts, [len(kind), len(kind) + rows]])
                yield pa.record_batch(
                    [
                        pa.array([*kind[starts].tolist(), None], pa.int32()),
                        pa.array(np.full(len(starts) + 1, block), pa.int64()),
                        pa.array(np.append(sums[ends] - sums[starts], 0), pa.int64()),
                        _lists(lists, pa.array(np.concatenate([codes % rows, np.arange(rows)]).astype(np.int32))),
                        _lists(lists, pa.array(np.concatenate([n, words]).astype(np.int32))),
                        pa.array([None] * len(starts) + [batch.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                    ],
                    _POSTING,
                )
                block += 1
        tidy()

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return own.mapInArrow(run, "bucket int, block long, n long, at array<int>, counts array<int>, doc_ids array<long>")


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """The rows of one block after another, of batches sorted by block."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        block = batch.column("block").to_numpy()
        starts = [*np.flatnonzero(np.diff(block, prepend=block[0] - 1) != 0).tolist(), len(block)]
        for a, b in zip(starts, starts[1:]):
            if held and held[0].column("block")[0].as_py() != block[a]:
                yield held
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield held


def _flat(parts: list[pa.RecordBatch], column: str) -> np.ndarray:
    return np.concatenate([x.column(column).flatten().to_numpy(zero_copy_only=False) for x in parts]).astype(np.int64)


def weighed(docs: DataFrame, target: DataFrame, p: Params) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row of `docs` (doc_id, text). The weight is the floored mean of the gains of the features."""
    lists = materialize(postings(docs, p), "postings")  # so that a block's rows are the same whoever reads them
    features_of = lists.filter("bucket is not null")
    found = materialize(gains(features_of.groupBy("bucket").agg(F.sum("n").alias("n")), target, p), "gains")
    # both sides are exchanges, so a bucket with many lists is split by the adaptive skew join
    met = features_of.select("bucket", "block", "at", "counts").join(found.hint("shuffle_hash"), "bucket").select("block", "at", "counts", "gain")

    def contributions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What the buckets of a task add to the rows of each block."""
        for parts in _by_block(batches):
            sizes = np.concatenate([pc.list_value_length(x.column("at")).to_numpy() for x in parts])
            gain = np.repeat(np.concatenate([x.column("gain").to_numpy() for x in parts]), sizes)
            at, n = _flat(parts, "at"), _flat(parts, "counts")
            rows, place = np.unique(at, return_inverse=True)
            total, count = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
            np.add.at(total, place, gain * n)
            np.add.at(count, place, n)
            one = np.array([0, len(rows)])
            yield pa.record_batch([parts[0].column("block").slice(0, 1), *(_lists(one, pa.array(x)) for x in (rows.astype(np.int32), total, count)), pa.nulls(1, pa.list_(pa.int64())), pa.nulls(1, pa.list_(pa.int32()))], _CONTRIBUTION)

    schema = "block long, at array<int>, total array<long>, n array<long>, doc_ids array<long>, words array<int>"
    added = met.sortWithinPartitions("block").mapInArrow(contributions, schema)
    nothing = F.array()
    heads = lists.filter("bucket is null").select("block", nothing.cast("array<int>").alias("at"), nothing.cast("array<long>").alias("total"), nothing.cast("array<long>").alias("n"), "doc_ids", F.col("counts").alias("words"))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of a block with the sums of all contributions."""
        for parts in _by_block(batches):
            head, words = (next(x.column(c)[i].values for x in parts for i in range(x.num_rows) if x.column(c)[i].is_valid) for c in ("doc_ids", "words"))
            total, count = np.zeros(len(head), np.int64), np.zeros(len(head), np.int64)
            at = _flat(parts, "at")
            np.add.at(total, at, _flat(parts, "total"))
            np.add.at(count, at, _flat(parts, "n"))
            weight = np.where(count > 0, total // np.maximum(count, 1), 0)  # rounds down
            yield pa.record_batch([head, words.cast(pa.int64()), pa.array(count), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    every = added.union(heads).repartition("block").sortWithinPartitions("block")
    return every.mapInArrow(summed, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, params: Params | None = None) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of each row of `docs` (doc_id, text), drawn towards `target` (text).

    Null and empty texts have no features and a weight of 0. Of the rows with
    enough words the highest scores are drawn, `percent` of a hundred rounded
    down, ties to the smaller doc_id, then to fewer words; a null doc_id hashes
    like an empty one and is the last of its ties. Rows that repeat
    count each. The rank is null for rows not drawn. An empty table gives no
    rows, an empty target gains by how rare a bucket is. Other columns are
    ignored.
    """
    p = params or Params()
    hashed = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{p.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((hashed + 0.5) / 4294967296)))
    rows = weighed(docs, target, p).groupBy("doc_id", "n_words", "n_features", "weight").agg(F.count("*").alias("copies"))
    scored = materialize(rows.withColumn("score", F.col("weight") + noise), "scored")
    enough = F.col("n_words") >= p.least_words
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last(), F.col("n_words"), F.col("n_features")]
    own, whole = numbered(scored.filter(enough), order, "start", F.col("copies"))
    drawn = p.percent * whole // 100
    rank = F.explode(F.transform(F.sequence(F.lit(1).cast("long"), F.col("copies")), lambda i: F.when(F.col("start") + i <= drawn, F.col("start") + i)))
    rest = scored.filter(~enough).select("doc_id", "n_features", "weight", "score", F.explode(F.array_repeat(F.lit(None).cast("long"), F.col("copies").cast("int"))).alias("rank"))
    return own.select("doc_id", "n_features", "weight", "score", rank.alias("rank")).union(rest)
