"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last eight bytes sets chunk boundaries, so that an edit
moves only the boundaries near it; a chunk of over twice the block size is cut
at that length. The block size follows from the length of the text, halved if
the signature is under half of the aim, doubled while it is too long. Every chunk gives one of 64 letters; a
fingerprint holds the letters at a block size and at twice that size. Two
fingerprints are compared at a block size they share, by edit distance
(insertions and deletions), if they have a run of letters in common.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import Kernel, materialize, tidy, whole_text, with_columns
from .words import slices

LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
#: Letters in a signature at most, the aim for their number, and letters that two signatures need to have in a row.
MOST, AIM, RUN = 64, 48, 7
_NONE = 64

_TABLE = np.random.default_rng(17).integers(0, 1 << 32, 256, np.uint32)
_TABLE[0] = 0
_PAD = bytes(8)


class Fingerprints:
    """Block size levels (the size is 2**level), and the letters at that size and at twice that size, one row for each text."""

    def __init__(self, texts: list[bytes]):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        usual = np.maximum(0, np.ceil(np.log2(np.maximum(sizes, 1) / AIM))).astype(np.int64)
        raw = np.frombuffer(_PAD + _PAD.join(texts) + _PAD, np.uint8)
        starts = len(_PAD) + np.concatenate([[0], np.cumsum(sizes + len(_PAD))[:-1]]).astype(np.int64) if len(texts) else sizes
        rolled = _TABLE[raw]
        for by in (1, 2, 4):
            rolled[by:] += rolled[:-by].copy() << np.uint32(by)
        rolled = rolled * np.uint32(0x9E3779B1)
        rolled ^= rolled >> np.uint32(15)
        rolled = rolled * np.uint32(0x85EBCA77)
        total = np.cumsum(rolled, dtype=np.uint64)
        levels = usual.copy()
        at, owner, bounds = self._boundaries(rolled, levels, starts, sizes)
        one = self._filled(at, owner, 2 << np.minimum(levels, usual), starts, sizes)
        few = (np.bincount(one[1], minlength=len(sizes)) < AIM // 2) & (levels > 0)
        levels -= few
        again = True
        while again:  # then longer chunks, while signatures are too long
            at, owner, bounds = self._boundaries(rolled, levels, starts, sizes)
            one = self._filled(at, owner, 2 << np.minimum(levels, usual), starts, sizes)
            over = np.bincount(one[1], minlength=len(sizes)) >= np.where(sizes > MOST, MOST, MOST + 1)
            levels += over
            again = over.any()
        self.levels = levels
        self.one = self._letters(*one, total, starts, sizes)
        half = rolled[at].astype(np.uint64) < (bounds[owner] >> np.uint64(1))
        self.two = self._letters(*self._filled(at[half], owner[half], 4 << np.minimum(levels, usual), starts, sizes), total, starts, sizes)

    @staticmethod
    def _boundaries(rolled: np.ndarray, levels: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the boundaries that the text sets, the text of each, and the bound of each text."""
        limit = np.zeros(len(rolled), np.uint32)
        bounds = np.uint64(1) << (np.uint64(32) - levels.astype(np.uint64))
        most = np.minimum(bounds - np.uint64(1), np.uint64(0xFFFFFFFF)).astype(np.uint32)
        if len(sizes):
            limit[len(_PAD) :] = np.repeat(most, sizes + len(_PAD))
            limit[((starts + sizes)[:, None] + np.arange(len(_PAD))).ravel()] = 0
        at = np.flatnonzero((rolled <= limit) & (limit > 0))
        return at, np.searchsorted(starts, at, side="right") - 1, bounds

    @staticmethod
    def _filled(at: np.ndarray, owner: np.ndarray, longest: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Boundaries and their texts, with more of them where a chunk is longer than `longest`, so many bytes after the last."""
        own = np.arange(len(sizes))
        marks, texts = np.concatenate([at, starts - 1, starts + sizes]), np.concatenate([owner, own, own])
        order = np.argsort(marks, kind="stable")
        marks, texts = marks[order], texts[order]
        more = np.where(texts[1:] == texts[:-1], (marks[1:] - marks[:-1] - 1) // longest[texts[:-1]], 0) if len(marks) else marks
        whose = np.repeat(texts[:-1], more)
        nth = np.arange(len(whose)) - np.repeat(np.cumsum(more) - more, more) + 1
        every = np.concatenate([at, np.repeat(marks[:-1], more) + nth * longest[whose]])
        order = np.argsort(every, kind="stable")
        return every[order], np.concatenate([owner, whose])[order]

    @staticmethod
    def _letters(at: np.ndarray, owner: np.ndarray, total: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        out = np.full((len(sizes), MOST), _NONE, np.uint8)
        if not len(sizes):
            return out
        first = np.searchsorted(owner, np.arange(len(sizes)))
        place = np.arange(len(at)) - first[owner]
        early = place < MOST - 1
        at, owner, place = at[early], owner[early], place[early]
        count = np.bincount(owner, minlength=len(sizes))
        last = np.full(len(sizes), -1, np.int64)
        last[owner] = at  # in order, so that the last one stays
        ends = starts + sizes - 1
        open_ = np.flatnonzero((sizes > 0) & (last < ends))
        before = np.where(place > 0, np.concatenate([[0], at[:-1]])[: len(at)], starts[owner] - 1)
        out[owner, place] = _letter(total[at] - total[before])
        tail = np.where(last[open_] >= 0, last[open_], starts[open_] - 1)
        out[open_, count[open_]] = _letter(total[ends[open_]] - total[tail])
        return out

    def text(self) -> list[str]:
        words = [[LETTERS[row[row < _NONE]].tobytes().decode() for row in side] for side in (self.one, self.two)]
        return [f"{1 << int(level)}:{a}:{b}" for level, a, b in zip(self.levels, *words, strict=True)]

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.levels[rows], self.one[rows], self.two[rows]


def _letter(sums: np.ndarray) -> np.ndarray:
    return ((sums * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(58)).astype(np.uint8)


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each pair of rows, all letters of a row in one machine word."""
    rows, every = np.arange(len(a)), np.zeros((len(a), _NONE + 1), np.uint64)
    for j in range(MOST):
        every[rows, a[:, j]] |= np.uint64(1 << j)
    every[:, _NONE] = 0
    left = np.full(len(a), np.iinfo(np.uint64).max)
    for j in range(MOST):
        hit = left & every[rows, b[:, j]]
        left = (left + hit) | (left - hit)
    return np.bitwise_count(~left).astype(np.int64)


def _meet(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Whether the rows have RUN letters in a row in common, or half of the shorter one's if that is less."""
    out = np.zeros(len(a), bool)
    need = np.minimum(RUN, (np.minimum(size_a, size_b) + 1) // 2)
    for n in np.unique(need[need > 0]).tolist():
        own = np.flatnonzero(need == n)
        grams = []
        for side, sizes, none in ((a, size_a, -1), (b, size_b, -2)):
            codes = np.zeros((len(own), MOST - n + 1), np.int64)
            for j in range(n):
                codes = codes << 6 | side[own, j : MOST - n + 1 + j]
            codes[np.arange(MOST - n + 1)[None] + n > sizes[own, None]] = none
            grams.append(codes)
        for at in range(0, len(own), 256):
            out[own[at : at + 256]] = (grams[0][at : at + 256, :, None] == grams[1][at : at + 256, None]).any((1, 2))
    return out


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One less the edit distance over both lengths, for rows with a common run; else zero."""
    size_a, size_b = (a < _NONE).sum(1), (b < _NONE).sum(1)
    out = np.zeros(len(a))
    own = np.flatnonzero(_meet(a, b, size_a, size_b))
    distance = size_a[own] + size_b[own] - 2 * common(a[own], b[own])
    out[own] = 1 - distance / (size_a[own] + size_b[own])
    return out


def likeness(a: tuple[np.ndarray, np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """0 to 1 for each pair of fingerprints (levels, letters, letters at twice the size); 0 if no block size is shared, 1 if they are equal."""
    (la, a1, a2), (lb, b1, b2) = a, b
    out = np.zeros(len(la))
    for step, sides in ((0, ((a1, b1), (a2, b2))), (1, ((a2, b1),)), (-1, ((a1, b2),))):
        own = np.flatnonzero(lb - la == step)
        for x, y in sides:
            out[own] = np.maximum(out[own], similarity(x[own], y[own]))
    out[(la == lb) & (a1 == b1).all(1) & (a2 == b2).all(1)] = 1.0
    return out


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [c.split()[0] for c in _RESULT.split(", ")]


def _compared(ids: list, texts: list[str], following: list[str]) -> pa.RecordBatch:
    """Results of documents whose next documents' texts are `following`."""
    thirds = [len(t) // 3 for t in texts]
    edited = [(t[: len(t) - k] + n[:k]).encode() for t, n, k in zip(texts, following, thirds, strict=True)]
    prints = Fingerprints([*(t.encode() for t in texts), *(n.encode() for n in following[-1:])])
    changed, own = Fingerprints(edited), np.arange(len(texts))
    mine = prints.take(own)
    # each following text is the next of `texts`, but for the last
    near = [likeness(mine, changed.take(own)), likeness(mine, prints.take(own + 1))]
    shas = [hashlib.sha256(e).hexdigest() for e in edited]
    return pa.record_batch([pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(shas, pa.string()), pa.array(prints.text()[: len(texts)], pa.string()), pa.array(changed.text(), pa.string()), *map(pa.array, near)], _NAMES)


def fingerprint(docs: DataFrame, column: str = "text", to: str = "fingerprint") -> DataFrame:
    """`docs` with the fingerprint of each whole text, a null counting as empty ("1::").

    Equal texts have equal fingerprints. A column named as `to` is replaced;
    others stay, whatever their names.
    """

    def kernel() -> Kernel:
        return lambda texts: [pa.array(Fingerprints([t.encode() for t in texts.to_pylist()]).text(), pa.string())]

    return with_columns(docs, column, {to: T.StringType()}, kernel)


def edited_and_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how like they and the next document's are.

    The edited text has its last third (rounded down, in characters) replaced
    by as many first characters of the next document, or all it has. Documents
    are ordered by falling doc_id, then by a hash of the text, a null doc_id
    last; after the last comes the first, and a single document is its own
    next. Null and empty texts have the fingerprint "1::". Rows that repeat
    count each; other columns are ignored.

    The texts are shuffled once, into ranges of doc_id. Each range is compared
    as it streams by; only its first and last rows wait for a join by range.
    """
    keys = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)

    def edge(part: int, first: bool, doc_id: int | None, text: str) -> pa.RecordBatch:
        blank = pa.record_batch([pa.array([None], t) for t in (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())], _NAMES)
        return pa.record_batch([pa.array([doc_id], pa.int64()), *blank.columns[1:], pa.array([part], pa.int32()), pa.array([first]), pa.array([text], pa.string())], [*_NAMES, "part", "first", "text"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), None
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
                if held is None:
                    yield edge(part, True, ids[0], texts[0])
                else:
                    ids, texts = [held[0], *ids], [held[1], *texts]
                held = ids[-1], texts[-1]
                if len(ids) > 1:
                    done = _compared(ids[:-1], texts[:-1], texts[1:])
                    none = [pa.nulls(done.num_rows, t) for t in (pa.int32(), pa.bool_(), pa.string())]
                    yield pa.record_batch([*done.columns, *none], [*_NAMES, "part", "first", "text"])
        if held is not None:
            yield edge(part, False, *held)

    streamed = materialize(ranged.mapInArrow(stream, f"{_RESULT}, part int, first boolean, text string"), "fingerprints")
    edges = streamed.filter("part is not null")
    parts = sorted(r["part"] for r in edges.filter("first").select("part").collect())  # a number for each range that has rows
    follows = docs.sparkSession.createDataFrame(list(zip(parts, [*parts[1:], *parts[:1]], strict=True)), "part int, next_part int")
    heads = edges.filter("first").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    tails = edges.filter("not first").select("part", "doc_id", "text").join(follows, "part").join(heads, "next_part").select("doc_id", "text", "next_text")

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield _compared([row["doc_id"]], [row["text"]], [row["next_text"]])

    return streamed.filter("part is null").select(*_NAMES).unionByName(tails.mapInArrow(rest, _RESULT))
