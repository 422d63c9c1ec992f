"""Byte-level BPE: encoding texts to ids and decoding ids to bytes.

Two encoders give the same ids. `encode` streams texts through Arrow batches
and merges each distinct word of a batch once, so it moves no text between
tasks. `encode_native` folds the merges with Spark's higher-order functions
over the distinct words of the whole table and joins the ids back; README says
what its joins cost. `decode` is made of Spark functions only.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
import zlib
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import Kernel, whole_text, with_columns

#: White space as Unicode defines it; \s differs between regex libraries.
SPACE = r"\t-\r \x85\xa0  -     　"
_LONG = 256
NEVER = np.iinfo(np.int32).max


def read_ranks(path: str) -> dict[bytes, int]:
    """Piece -> rank from a file of base64 pieces and ranks, read on the driver; its size is the vocabulary's."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


class Pairs:
    """A hash table of pairs of ids that merge: the priority (lowest first) and the id that comes of it."""

    def __init__(self, left: np.ndarray, right: np.ndarray, priority: np.ndarray, result: np.ndarray):
        bits = max(4, int(len(left) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.priority, self.result = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NEVER, np.int32), np.full(1 << bits, -1, np.int32)
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slot, left_over = self._slot(keys), np.arange(len(keys))
        while len(left_over):
            free = left_over[self.keys[slot[left_over]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[slot[won]], self.priority[slot[won]], self.result[slot[won]] = keys[won], priority[won], result[won]
            left_over = np.setdiff1d(left_over, won, assume_unique=True)
            slot[left_over] = (slot[left_over] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The slot of each pair; that of an absent pair has the priority NEVER."""
        keys = (left.astype(np.int64) << 32) | right
        slot = self._slot(keys)
        off = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] >= 0))
        while len(off):
            slot[off] = (slot[off] + 1) & self.mask
            off = off[(self.keys[slot[off]] != keys[off]) & (self.keys[slot[off]] >= 0)]
        return slot

    def merge(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of words after all merges, all words at a time: in each round every word merges its best pair wherever it has it."""
        word = np.repeat(np.arange(len(sizes)), sizes)
        ids, done_words, done_ids = ids.astype(np.int32), [], []
        while len(ids):
            slot = self.find(ids[:-1], ids[1:])
            rank = np.append(self.priority[slot], NEVER)
            rank[:-1][word[:-1] != word[1:]] = NEVER
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(word))))
            over = best == NEVER
            done_words.append(word[over])
            done_ids.append(ids[over])
            hit = (rank == best) & ~over
            at = np.flatnonzero(hit)
            run = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) > 1, np.arange(len(at)), 0)) if len(at) else at
            at = at[(np.arange(len(at)) - run) % 2 == 0]  # of overlapping places the first, third, ...
            ids[at] = self.result[slot[at]]
            over[at + 1] = True
            ids, word = ids[~over], word[~over]
        words, ids = (np.concatenate(x) if x else np.empty(0, np.int32) for x in (done_words, done_ids))
        order = np.argsort(words, kind="stable")
        return np.concatenate([[0], np.cumsum(np.bincount(words.astype(np.int64), minlength=len(sizes)))]), ids[order]


Merges = dict[tuple[int, int], tuple[int, int]]


def merge_by_agenda(ids: list[int], merges: Merges) -> list[int]:
    """Ids of one word after all merges (pair -> rank, result), the lowest rank first, of equal ones the leftmost, by a heap of the adjacent pairs in n log n steps."""
    n, ids = len(ids), list(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    agenda = [(merges[pair][0], i, *pair) for i, pair in enumerate(zip(ids, ids[1:])) if pair in merges]
    heapq.heapify(agenda)
    while agenda:
        _, i, a, b = heapq.heappop(agenda)
        j = after[i]
        if ids[i] != a or j >= n or ids[j] != b:
            continue  # one of the two has been merged since
        ids[i], ids[j], after[i] = merges[a, b][1], -1, after[j]
        if after[i] < n:
            before[after[i]] = i
        for left in (before[i], i):
            pair = (ids[left], ids[after[left]]) if left >= 0 and after[left] < n else None
            if pair in merges:
                heapq.heappush(agenda, (merges[pair][0], left, *pair))
    return [x for x in ids if x >= 0]


def gather(offsets: np.ndarray, values: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, values) of the lists that `codes` name, one after another."""
    sizes = np.diff(offsets)[codes]
    out = np.concatenate([[0], np.cumsum(sizes)])
    return out, values[np.repeat(offsets[:-1][codes] - out[:-1], sizes) + np.arange(out[-1])]


def coded(values: list) -> tuple[list, np.ndarray]:
    """The distinct values, and each value's place among them."""
    place = {v: i for i, v in enumerate(dict.fromkeys(values))}
    return list(place), np.fromiter(map(place.__getitem__, values), np.int64, len(values))


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one long piece: the adjacent pair of the lowest rank first, leftmost first, with a heap in n log n steps."""
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = bytearray(b"\1" * n)
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not alive[i] or j >= n or not alive[j] or end[j] != stop:
            continue
        alive[j] = 0
        end[i] = stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if i and (r := ranks.get(piece[before[i] : stop])) is not None:
            heapq.heappush(heap, (r, before[i], stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


def units_of() -> Callable[[str], list[str]]:
    """Cuts a text into units of white space and the other characters after it; no match of the pattern crosses units."""
    return re.compile(rf"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+").findall


def pattern_of(pattern: str) -> Callable[[str], list[str]]:
    """findall of a pattern whose \\s and \\S are made explicit."""
    assert r"\s\S" not in pattern
    inside = regex.sub(r"\[\^\\s", rf"[^{SPACE}", pattern)
    return regex.compile(inside.replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]")).findall


class Encoder:
    """Ids of whole texts; of a batch, each distinct word is merged once."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pieces, self.units = ranks, pattern_of(pattern), units_of()
        self.plain = r"| ?\p{L}+|" in pattern  # a unit of one space at most and letters is one match then
        self.bytes = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int32)
        splits = [(ranks[p[:i]], ranks[p[i:]], r) for p, r in ranks.items() for i in range(1, len(p)) if p[:i] in ranks and p[i:] in ranks]
        left, right, rank = np.array(splits or np.empty((0, 3)), np.int64).T
        self.pairs = Pairs(left, right, rank, rank)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of words, each merged by itself. A word that is a piece is that piece."""
        whole = np.fromiter((self.ranks.get(w, -1) for w in words), np.int64, len(words))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        long, short = np.flatnonzero((whole < 0) & (sizes > _LONG)), np.flatnonzero((whole < 0) & (sizes <= _LONG))
        raw = np.frombuffer(b"".join(words[i] for i in short), np.uint8)
        bounds, ids = self.pairs.merge(self.bytes[raw], sizes[short])
        lists = [_merge_long(words[i], self.ranks) for i in long]
        values = np.concatenate([ids, whole[whole >= 0], *lists]).astype(np.int32)
        starts = np.concatenate([bounds, bounds[-1] + np.cumsum(np.concatenate([np.ones((whole >= 0).sum(), np.int64), np.array([len(x) for x in lists], np.int64)]))])
        codes = np.empty(len(words), np.int64)
        codes[np.concatenate([short, np.flatnonzero(whole >= 0), long])] = np.arange(len(words))
        return gather(starts.astype(np.int64), values, codes)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of texts."""
        cut = [self.units(t) for t in texts]
        units, unit_of = coded(list(chain.from_iterable(cut)))
        cut_at = np.concatenate([[0], np.cumsum([len(x) for x in cut])]).astype(np.int64)
        found = [[u] if u[1:].isalpha() and (u[0] == " " or u.isalpha()) and self.plain else self.pieces(u) for u in units]
        pieces, piece_of = coded(list(chain.from_iterable(found)))
        found_at = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)
        offsets, ids = self.merge([p.encode() for p in pieces])
        inner, ids = gather(offsets, ids, piece_of)
        bounds, ids = gather(inner[found_at], ids, unit_of)
        return bounds[cut_at], ids


_ENCODERS: dict[str, Encoder] = {}


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, column: str = "text", to: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """`docs`, or its columns `keep`, with the ids of the whole text as array<int>, as ordinary text without special tokens.

    Null and empty texts give no ids, repeated rows the same ids each. A column
    named as `to` is replaced; others stay, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    key = f"{pattern} {len(ranks)} {zlib.crc32(repr(sorted(ranks.items(), key=lambda x: x[1])).encode())}"

    def kernel() -> Kernel:
        if key not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[key] = Encoder(shared.value, pattern)

        def made(texts: pa.Array) -> list[pa.Array]:
            offsets, ids = _ENCODERS[key](texts.to_pylist())
            return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))]

        return made

    return with_columns(docs, column, {to: T.ArrayType(T.IntegerType())}, kernel, keep)


def decode(ids: F.Column, ranks: dict[bytes, int]) -> F.Column:
    """The bytes of an array of ids: the pieces, from a literal array by rank, concatenated. Null for null; fails for an unknown id."""
    pieces = [""] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.hex()
    table = F.split(F.lit(" ".join(pieces)), " ")
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.element_at(table, i + 1)), ""))


def rank_map(ranks: dict[bytes, int], buckets: int = 8192) -> F.Column:
    """The ranks as one literal: an array of small maps by crc32, as Spark looks a map's keys up one after another."""
    rows: list[dict[str, int]] = [{} for _ in range(buckets)]
    for piece, rank in ranks.items():
        rows[zlib.crc32(piece) % buckets][piece.hex().upper()] = rank
    return F.from_json(F.lit(json.dumps(rows, separators=(",", ":"))), "array<map<string,int>>")


def merge_column(word: F.Column, ranks: dict[bytes, int], buckets: int = 8192) -> F.Column:
    """Ids of a binary word by folding the merges over its bytes with higher-order functions.

    The fold keeps the pieces and the rank of each adjacent pair, so that a
    merge looks up the two pairs that it makes; without a pair left a step does
    nothing. A word that is a piece is that piece.
    """
    table = rank_map(ranks, buckets)
    rank = lambda piece: F.element_at(F.element_at(table, (F.crc32(piece) % buckets + 1).cast("int")), F.hex(piece))
    known = lambda a, b: F.coalesce(rank(F.concat(a, b)), F.lit(int(NEVER)))
    state = lambda parts, pairs: F.struct(parts.alias("parts"), pairs.alias("pairs"))

    def merged(s: F.Column, best: F.Column) -> F.Column:
        at = F.array_position(s["pairs"], best).cast("int")
        piece = F.concat(F.get(s["parts"], at - 1), F.get(s["parts"], at))
        before, after = F.slice(s["parts"], F.lit(1), at - 1), F.slice(s["parts"], at + 2, F.size(s["parts"]))
        left = F.slice(s["pairs"], F.lit(1), F.greatest(at - 2, F.lit(0)))
        right = F.slice(s["pairs"], at + 2, F.size(s["pairs"]))
        one = F.when(at > 1, F.array(known(F.get(s["parts"], at - 2), piece))).otherwise(F.array().cast("array<int>"))
        two = F.when(at + 1 < F.size(s["parts"]), F.array(known(piece, F.get(s["parts"], at + 1)))).otherwise(F.array().cast("array<int>"))
        return state(F.concat(before, F.array(piece), after), F.concat(left, one, two, right))

    def step(s: F.Column, _: F.Column) -> F.Column:
        return F.transform(F.array(F.array_min(s["pairs"])), lambda best: F.when(best < int(NEVER), merged(s, best)).otherwise(s))[0]

    n = F.octet_length(word)
    bytes_of = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(word, i, F.lit(1)))
    pairs_of = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: known(F.substring(word, i, F.lit(1)), F.substring(word, i + 1, F.lit(1))))).otherwise(F.array().cast("array<int>"))
    ids = F.transform(F.aggregate(F.sequence(F.lit(1), n), state(bytes_of, pairs_of), step)["parts"], rank)
    return F.when(rank(word).isNotNull(), F.array(rank(word))).otherwise(ids)


def encode_native(docs: DataFrame, ranks: dict[bytes, int], pattern: str, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, ids) for rows with distinct keys, by Spark functions only: distinct words are merged once and joined back."""
    words = docs.select(key, F.posexplode(F.regexp_extract_all(whole_text(column), F.lit(f"(?U){pattern}"), F.lit(0))).alias("at", "word"))
    merged = words.select("word").distinct().withColumn("part", merge_column(F.col("word").cast("binary"), ranks))
    ids = words.join(merged, "word").groupBy(key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"])).alias("ids"))
    return docs.select(key).join(ids, key, "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<int>")))
