"""Filter interaction audit: what filters remove in every order, from one count of their outcomes.

Each document is a mask of the filters that it fails. A part's documents make
three histograms over the masks (all, good, toxic), which stack up as rows;
the product with integer matrices of masks by (order, step) gives every
outcome of every order at once, so that the corpus is read once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import Kernel, materialize, unused, whole_text, with_columns
from .words import split_words

FILTERS = "ABCDE"
ORDERS = tuple(map("".join, permutations(FILTERS)))
SYMBOLS = b"#$%&*|"
MASKS, STEPS = 1 << len(FILTERS), len(FILTERS)
_RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and the offsets at which each text's start (one more than texts)."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    raw = np.frombuffer(b"".join(texts.cast(pa.large_binary()).to_pylist()), np.uint8)
    return offsets, raw


def text_masks(texts: pa.Array) -> np.ndarray:
    """Bits of the filters that look at one text: 1 (A) under 200 words, 2 (B) under half of the words distinct, 4 (C) over 2 % capitals A-Z, 8 (D) a symbol."""
    words, offsets = split_words(texts)
    count = np.diff(offsets)
    code = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(words) else np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(count)), count)
    distinct = np.bincount(np.unique(owner * (code.max(initial=0) + 1) + code) // (code.max(initial=0) + 1), minlength=len(count))
    at, raw = _flat(texts)
    within = lambda hit: np.diff(np.concatenate([[0], np.cumsum(hit, dtype=np.int64)])[at])
    letters, capitals = within((raw & 0xC0) != 0x80), within((raw >= 65) & (raw <= 90))
    symbols = within(np.isin(raw, np.frombuffer(SYMBOLS, np.uint8)))
    fails = (count < 200, 100 * distinct < 50 * count, 100 * capitals > 2 * letters, symbols > 0)
    return sum(f.astype(np.int32) << i for i, f in enumerate(fails))


def outcome_matrices() -> dict[str, np.ndarray]:
    """Integer matrices of masks by (order, step), step changing fastest: kept after the step, removed there, redundant there, failing its filter alone."""
    mask = np.arange(MASKS)
    out = {name: np.zeros((MASKS, len(ORDERS) * STEPS), np.int64) for name in ("kept", "removed", "redundant", "unique")}
    for o, order in enumerate(ORDERS):
        before = 0
        for s, letter in enumerate(order):
            bit, column = 1 << FILTERS.index(letter), o * STEPS + s
            fails, gone = (mask & bit) > 0, (mask & before) > 0
            before |= bit
            out["kept"][:, column] = (mask & before) == 0
            out["removed"][:, column] = fails & ~gone
            out["redundant"][:, column] = fails & gone
            out["unique"][:, column] = mask == bit
    return out


def masked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part that fail just the filters of each mask, of these the good and the toxic ones.

    Only counts cross the last shuffles, and equal rows are counted before
    they are sent, so that a text or a source with a third of all rows takes
    no task to itself. Labels join by doc_id; of several labels of one id the
    larger counts.
    """
    part, mask, digest = (unused(docs, n) for n in ("part", "mask", "digest"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias(part), F.unhex(F.sha2(whole_text(), 256)).alias(digest), whole_text().alias("text"))

    def kernel() -> Kernel:
        return lambda texts: [pa.array(text_masks(texts), pa.int32())]

    seen = with_columns(own, "text", {mask: T.IntegerType()}, kernel, ["doc_id", part, digest]).select("doc_id", F.col(part).alias("part"), F.col(digest).alias("digest"), F.col(mask).alias("mask"))
    said = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").filter("doc_id is not null").groupBy("doc_id").agg(said("quality"), said("toxic"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    keys = ["digest", "part", "mask", "quality", "toxic"]
    each = seen.join(known, "doc_id", "left").select("doc_id", "digest", "part", "mask", yes("quality"), yes("toxic")).groupBy("doc_id", *keys).agg(F.count("*").alias("n"))
    # of the rows with one text, those of the least doc_id pass filter E; rows without an id do too, as no id is smaller than null
    texts = each.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNotNull(), F.col("n"))).alias("named"), F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("at_first"))
    texts = materialize(texts, "texts")
    least = texts.groupBy("digest").agg(F.min("first").alias("least"))
    copies = F.coalesce(F.col("named"), F.lit(0)) - F.when(F.col("first") == F.col("least"), F.col("at_first")).otherwise(0)
    both = texts.join(least, "digest").withColumn("copies", copies)
    split = F.explode(F.array(F.struct(F.col("mask").alias("mask"), (F.col("n") - F.col("copies")).alias("n")), F.struct((F.col("mask") + (1 << FILTERS.index("E"))).alias("mask"), F.col("copies").alias("n"))))
    rows = both.select("part", "quality", "toxic", split.alias("x")).select("part", "quality", "toxic", "x.mask", "x.n")
    total = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), total("quality").alias("good"), total("toxic").alias("toxic"))


def _histogram(column: str) -> Column:
    """Counts by mask, in a list of one for each mask."""
    found = F.map_from_entries(F.collect_list(F.struct("mask", column)))
    return F.transform(F.array(found), lambda m: F.transform(F.sequence(F.lit(0), F.lit(MASKS - 1)), lambda i: F.coalesce(m[i], F.lit(0))))[0]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for each part, each order of the filters and each of its steps.

    A part is a source of `docs` (doc_id, text, source), a null source and the
    empty one being the part "". Null texts count as empty ones, so that they
    are copies of one another. Rows that repeat count each; of rows with one
    text those of the least doc_id are no copies, and rows without a doc_id
    never are. `labels` (doc_id, quality, toxic) may lack documents. An empty
    table has no parts. Other columns are ignored.
    """
    columns = ("n", "good", "toxic")
    stacked = masked(docs, labels).groupBy("part").agg(*[_histogram(c).alias(c) for c in columns])

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrices = outcome_matrices()
        own = np.array([[o * STEPS + order.index(f) for o, order in enumerate(ORDERS)] for f in FILTERS])
        filter_of = np.array([FILTERS.index(f) for order in ORDERS for f in order])
        orders, steps = [order for order in ORDERS for _ in range(STEPS)], list(range(1, STEPS + 1)) * len(ORDERS)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows = {c: np.array(batch.column(c).to_pylist(), np.int64).reshape(-1, MASKS) for c in columns}
                made = {name: rows["n"] @ matrix for name, matrix in matrices.items()}
                lost = [rows[c] @ matrices["removed"] for c in ("good", "toxic")]
                shapley = np.stack([made["removed"][:, columns].sum(1) for columns in own], 1)[:, filter_of]
                n, width = batch.num_rows, len(orders)
                parts = batch.column("part").take(pa.array(np.repeat(np.arange(n), width)))
                numbers = [x.reshape(-1) for x in (made["kept"], made["removed"], made["redundant"], made["unique"], *lost, shapley)]
                yield pa.record_batch([parts, pa.array(orders * n), pa.array(steps * n, pa.int32()), *(pa.array(x, pa.int64()) for x in numbers)], [c.split()[0] for c in _RESULT.split(", ")])

    return stacked.mapInArrow(product, _RESULT)
