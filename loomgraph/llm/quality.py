"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Words give unigrams and bigrams, and their shapes (runs of capitals, small
letters and digits folded, punctuation kept, a word that repeats the one
before marked) give unigrams to trigrams. All are hashed to one weight table;
a text's counts, scaled to unit length, form a sparse vector, and its score is
the logistic function of that vector's dot product with the weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .labelled import labelled_sample
from .tables import Kernel, tidy, with_columns
from .words import gram_hashes, hash_words, mix, slices, split_words


@dataclass(frozen=True)
class Params:
    """`max_rows` bounds the labelled rows that are fitted on; the table has 2**bits weights, whatever the corpus."""

    bits: int = 18
    max_rows: int = 20_000
    shards: int = 8
    epochs: int = 4
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.02


def _shapes(words: pa.Array) -> pa.Array:
    for pattern, to in ((r"\p{Lu}{2,}", "A"), (r"\p{Lu}", "T"), (r"[\p{Ll}\p{Lo}\p{Lm}\p{M}]+", "a"), (r"\p{N}+", "9")):
        words = pc.replace_substring_regex(words, pattern, to)
    return words


def sparse_rows(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, indices, values): the logarithms of each text's hashed n-gram counts, scaled to unit length."""
    words, offsets = split_words(texts)
    coded = words.dictionary_encode()
    at = coded.indices.to_numpy(zero_copy_only=False) if len(words) else np.empty(0, np.int32)
    lower, shape = (hash_words(x)[at] for x in (pc.utf8_lower(coded.dictionary), _shapes(coded.dictionary)))
    repeats = np.concatenate([[False], at[1:] == at[:-1]])[: len(at)]
    shape = np.where(repeats, mix(shape), shape)
    counts = np.diff(offsets)
    owner = np.repeat(np.arange(len(counts)), counts)
    ends = offsets[1:][owner] if len(owner) else owner
    keys, owners = [], []
    for kind, (stream, k) in enumerate(((lower, 1), (lower, 2), (shape, 1), (shape, 2), (shape, 3))):
        starts = np.flatnonzero(np.arange(len(stream)) + k <= ends)
        keys.append(mix(gram_hashes(stream, starts, k) + np.uint64(kind)) >> np.uint64(64 - bits))
        owners.append(owner[starts])
    width = np.uint64(1 << bits)
    cells, n = np.unique(np.concatenate(owners).astype(np.uint64) * width + np.concatenate(keys).astype(np.uint64), return_counts=True)
    rows, index = (cells // width).astype(np.int64), (cells % width).astype(np.int32)
    value = np.log1p(n)
    length = np.sqrt(np.bincount(rows, value * value, len(counts)))
    bounds = np.searchsorted(rows, np.arange(len(counts) + 1))
    return bounds, index, value / length[rows] if len(rows) else value


def _features(sample: DataFrame, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                bounds, index, value = sparse_rows(batch.column("text"), bits)
                lists = lambda x: pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x))
                yield pa.record_batch([batch.column("label"), batch.column("draw"), lists(index), lists(value.astype(np.float32))], ["label", "draw", "index", "value"])
        tidy()

    return sample.select("label", "draw", "text").mapInArrow(run, "label int, draw long, index array<int>, value array<float>")


def train_shard(rows: pd.DataFrame, p: Params) -> tuple[np.ndarray, float]:
    """FTRL-proximal passes over the rows by rising draw: weights, and the constant's weight."""
    rows = rows.sort_values("draw", kind="stable")
    z, n = np.zeros((1 << p.bits) + 1), np.zeros((1 << p.bits) + 1)
    data = [(np.append(i, 1 << p.bits), np.append(v, 1.0).astype(float), y) for i, v, y in zip(rows["index"], rows["value"], rows["label"], strict=True)]

    def weights(at: np.ndarray | slice) -> np.ndarray:
        w = -(z[at] - np.sign(z[at]) * p.l1) / ((p.beta + np.sqrt(n[at])) / p.alpha + p.l2)
        return np.where(np.abs(z[at]) <= p.l1, 0.0, w)

    for _ in range(p.epochs):
        for at, value, label in data:
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - label) * value
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / p.alpha * w
            n[at] += g * g
    w = weights(slice(None))
    return w[:-1], float(w[-1])


def train(sample: DataFrame, params: Params | None = None) -> tuple[np.ndarray, float]:
    """Fit on (text, label, draw): each shard of the sample trains by itself, the weights are averaged.

    Without any row all weights are zero, and every score is a half.
    """
    p = params or Params()

    def shard(rows: pd.DataFrame) -> pd.DataFrame:
        w, bias = train_shard(rows, p)
        at = np.flatnonzero(w)
        return pd.DataFrame({"at": np.append(at, -1).astype(np.int64), "w": np.append(w[at], bias), "shards": 1})

    by = _features(sample, p.bits).withColumn("shard", F.pmod("draw", F.lit(p.shards)))
    sums = by.groupBy("shard").applyInPandas(shard, "at long, w double, shards long").groupBy("at").agg(F.sum("w").alias("w"), F.sum("shards").alias("n")).toArrow()
    at, w, n = (sums[c].to_numpy() for c in ("at", "w", "n"))
    table, shards = np.zeros(1 << p.bits), max(1, int(n[at == -1].sum()))
    table[at[at >= 0]] = w[at >= 0] / shards
    return table, float(w[at == -1].sum()) / shards


def score(docs: DataFrame, model: tuple[np.ndarray, float], params: Params | None = None, to: str = "quality_score") -> DataFrame:
    """`docs` with a double column `to`; null and empty texts get the constant's score, repeated rows the same.

    A column of that name is replaced; others stay, whatever their names.
    """
    p = params or Params()
    shared = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), model[1]))

    def kernel() -> Kernel:
        weights, bias = shared.value

        def made(texts: pa.Array) -> list[pa.Array]:
            bounds, index, value = sparse_rows(texts, p.bits)
            dot = np.concatenate([[0.0], np.cumsum(weights[index].astype(float) * value)])[bounds]
            return [pa.array(1 / (1 + np.exp(-np.clip(np.diff(dot) + bias, -35, 35))))]

        return made

    return with_columns(docs, "text", {to: T.DoubleType()}, kernel)


def fit_and_score(docs: DataFrame, labels: DataFrame, keep: F.Column, corpus: DataFrame | None = None, params: Params | None = None, to: str = "quality_score") -> DataFrame:
    """Fit on labelled rows of `corpus` (or `docs`) for which `keep` holds, then score every row of `docs`.

    Only texts are features. Labels for absent ids, null ids and null labels are
    left out; of several labels of one id the larger counts. Null and empty
    texts get the constant's score, repeated rows the same each. Without labels
    every score is a half; without documents there are no rows. A column named
    as `to` is replaced.
    """
    p = params or Params()
    sample = labelled_sample(docs if corpus is None else corpus, labels, "quality", keep, p.max_rows)
    return score(docs, train(sample, p), p, to)
