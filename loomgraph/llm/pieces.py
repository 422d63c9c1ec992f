"""SentencePiece encoding and decoding for merge-type vocabularies.

A text is normalised (a space in front, spaces as "▁") and cut into units that
no piece of the vocabulary crosses. Each distinct unit of a batch is merged by
an agenda of its adjacent symbol pairs: the pair whose piece has the highest
score goes first, of equal ones the leftmost. Short units advance together,
one merge of each at a time, as arrays; long ones have a heap each. Characters
without a piece become their UTF-8 bytes' pieces.
"""

from __future__ import annotations

import codecs
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import NEVER, Pairs, coded, gather, merge_by_agenda
from .tables import Kernel, with_columns

SPACE = "▁"
# Kinds of pieces in a model file, its number for the merge type, what an unknown piece decodes to.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MERGE_TYPE = 2
UNKNOWN_TEXT = " ⁇ "

#: Symbols from here on are characters without a piece.
_CHARACTERS = 1 << 24
#: Units of more symbols get a heap each.
_LONG = 64


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a serialised message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        size = {1: 8, 5: 4}.get(key & 7)
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = number() if size is None else size
        yield key >> 3, data[at : at + size]
        at += size


@dataclass(frozen=True)
class Model:
    """Texts, scores and kinds of the pieces by id, and whether a space is put in front of a text."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]
    dummy_prefix: bool = True
    end_id: int = 2


def read_model(path: str) -> Model:
    """From a model file, on the driver. Refused are models that aren't of the merge type, that map characters or strip spaces, or that have pieces set by the user or unused."""
    with open(path, "rb") as file:
        fields = list(_fields(file.read()))
    rows = [dict(_fields(v)) for k, v in fields if k == 1]
    trainer, normalizer = (dict(chain.from_iterable(_fields(v) for k, v in fields if k == number)) for number in (2, 3))
    kinds = tuple(r.get(3, NORMAL) for r in rows)
    if trainer.get(3, 1) != MERGE_TYPE or normalizer.get(2, b"") or normalizer.get(4, 1) or not normalizer.get(5, 1) or {USER_DEFINED, UNUSED} & set(kinds):
        raise ValueError(f"{path}: not a merge-type model that keeps its input as it is")
    scores = tuple(struct.unpack("<f", r[2])[0] if 2 in r else 0.0 for r in rows)
    return Model(tuple(r[1].decode() for r in rows), scores, kinds, bool(normalizer.get(3, 1)), trainer.get(42, 2))


class Encoder:
    """Ids of whole texts; of a batch, each distinct unit is merged once."""

    def __init__(self, model: Model):
        self.model = model
        ids = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k == NORMAL}
        letters = {c for p in ids for c in p}
        self.symbols = {c: _CHARACTERS + ord(c) for c in letters} | ids
        order = {s: i for i, s in enumerate(sorted({model.scores[i] for i in ids.values()}, reverse=True))}
        split = [(self.symbols[p[:i]], self.symbols[p[i:]], order[model.scores[n]], n) for p, n in ids.items() for i in range(1, len(p)) if p[:i] in self.symbols and p[i:] in self.symbols]
        left, right, rank, made = np.array(split or np.empty((0, 4)), np.int64).T
        self.pairs = Pairs(left, right, rank, made)
        self.merges = {(a, b): (r, n) for a, b, r, n in split}
        self.of_char = np.arange(_CHARACTERS, _CHARACTERS + 0x110000, dtype=np.int32)
        for c in letters & ids.keys():
            self.of_char[ord(c)] = ids[c]
        crossed = any(SPACE in p.lstrip(SPACE) for p in ids)  # then a text is one unit
        breaks = "".join(c for c in "\n\r\t" if c not in letters)
        self.units = (lambda t: [t]) if crossed else re.compile(rf"{SPACE}*[^{SPACE}{breaks}]+|{SPACE}+|[{breaks or SPACE}]+").findall
        self.bytes = np.array([next((i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k == BYTE and p == f"<0x{b:02X}>"), -1) for b in range(256)], np.int32)
        self.unknown = next((i for i, k in enumerate(model.kinds) if k == UNKNOWN), 0)

    def _together(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of units after all merges: in each round the first pair on every unit's agenda is merged."""
        unit = np.repeat(np.arange(len(sizes)), sizes)
        ids, done_units, done_ids = ids.astype(np.int32), [], []
        slot = np.full(len(ids), -1, np.int64)
        slot[:-1] = self.pairs.find(ids[:-1], ids[1:])
        rank = np.append(self.pairs.priority[slot[:-1]], NEVER)[: len(ids)]
        rank[:-1][unit[:-1] != unit[1:]] = NEVER
        while len(ids):
            starts = np.flatnonzero(np.diff(unit, prepend=-1))
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(unit))))
            over = best == NEVER
            if over.any():
                done_units.append(unit[over])
                done_ids.append(ids[over])
            at = np.flatnonzero((rank == best) & ~over)
            at = at[np.diff(unit[at], prepend=-1) > 0]  # the leftmost of each unit
            ids[at] = self.pairs.result[slot[at]]
            gone = over.copy()
            gone[at + 1] = True
            moved = np.cumsum(~gone) - 1  # the new place of what stays
            ids, unit, rank, slot, at = ids[~gone], unit[~gone], rank[~gone], slot[~gone], moved[at]
            near = np.unique(np.concatenate([at, at[at > 0] - 1]))
            near = near[near < len(ids) - 1] if len(ids) else near
            slot[near] = self.pairs.find(ids[near], ids[near + 1])
            rank[near] = np.where(unit[near] == unit[near + 1], self.pairs.priority[slot[near]], NEVER)
            if len(ids):
                rank[-1] = NEVER
        units, ids = (np.concatenate(x) if x else np.empty(0, np.int32) for x in (done_units, done_ids))
        order = np.argsort(units, kind="stable")
        return np.concatenate([[0], np.cumsum(np.bincount(units.astype(np.int64), minlength=len(sizes)))]), ids[order]

    def merge(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of units."""
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        long, short = np.flatnonzero(sizes > _LONG), np.flatnonzero(sizes <= _LONG)
        chars = lambda text: self.of_char[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        bounds, ids = self._together(chars("".join(units[i] for i in short)), sizes[short])
        lists = [merge_by_agenda(chars(units[i]).tolist(), self.merges) for i in long]
        starts = np.concatenate([bounds, bounds[-1] + np.cumsum(np.array([len(x) for x in lists], np.int64))]).astype(np.int64)
        codes = np.empty(len(units), np.int64)
        codes[np.concatenate([short, long])] = np.arange(len(units))
        return gather(*self._spelled(starts, np.concatenate([ids, *lists]).astype(np.int32)), codes)

    def _spelled(self, offsets: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lists in which characters without a piece have become their bytes' pieces, or the unknown piece where a byte has none."""
        bare = np.flatnonzero(ids >= _CHARACTERS)
        if not len(bare):
            return offsets, ids
        spelled = [self.bytes[list(chr(c).encode())] for c in (ids[bare] - _CHARACTERS).tolist()]
        spelled = [x if (x >= 0).all() else np.array([self.unknown], np.int32) for x in spelled]
        sizes = np.ones(len(ids), np.int64)
        sizes[bare] = [len(x) for x in spelled]
        at = np.concatenate([[0], np.cumsum(sizes)])
        out = np.repeat(ids, sizes)
        for i, x in zip(bare.tolist(), spelled, strict=True):
            out[at[i] : at[i + 1]] = x
        return at[offsets], out

    def __call__(self, texts: list[str], end: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of texts, with the end id after each unless `end` is false."""
        front = SPACE if self.model.dummy_prefix else ""
        cut = [self.units(front + t.replace(" ", SPACE)) if t else [] for t in texts]
        units, unit_of = coded(list(chain.from_iterable(cut)))
        cut_at = np.concatenate([[0], np.cumsum([len(x) for x in cut])]).astype(np.int64)
        bounds, ids = gather(*self.merge(units), unit_of)
        bounds = bounds[cut_at]
        if end:
            ids = np.insert(ids, bounds[1:], self.model.end_id)
            bounds = bounds + np.arange(len(bounds))
        return bounds, ids


def _single(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("loomgraph_single_bytes", _single)


class Decoder:
    """Texts of ids: pieces with spaces for "▁" but for the first space, runs of byte pieces as UTF-8, each byte that isn't valid as U+FFFD."""

    def __init__(self, model: Model):
        self.strip, self.is_byte = model.dummy_prefix, [k == BYTE for k in model.kinds]
        shown = {UNKNOWN: lambda p: UNKNOWN_TEXT.encode(), CONTROL: lambda p: b"", BYTE: lambda p: bytes([int(p[3:5], 16)])}
        self.pieces = [shown.get(k, lambda p: p.replace(SPACE, " ").encode())(p) for p, k in zip(model.pieces, model.kinds, strict=True)]
        self.silent = [not p for p in self.pieces]

    def __call__(self, ids: list[int]) -> str:
        if any(i < 0 or i >= len(self.pieces) for i in ids):
            raise ValueError("an id is not of the vocabulary")
        first = next((i for i in ids if not self.silent[i]), None)
        raw = b"".join(map(self.pieces.__getitem__, ids))
        if self.strip and first is not None and not self.is_byte[first] and self.pieces[first] != UNKNOWN_TEXT.encode():
            raw = raw.removeprefix(b" ")
        return raw.decode("utf-8", "loomgraph_single_bytes")


_BUILT: dict[int, tuple[Encoder, Decoder]] = {}


def _tools(model: Model, key: int) -> tuple[Encoder, Decoder]:
    """Encoder and decoder of the model used last in this process."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Encoder(model), Decoder(model)
    return _BUILT[key]


def _key(model: Model) -> int:
    return zlib.crc32(repr(model).encode())


def _listed(offsets: np.ndarray, ids: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))


def encode(docs: DataFrame, model: Model, column: str = "text", to: str = "ids", decoded: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """`docs`, or its columns `keep`, with the ids of the whole text and the end id as array<int>; with `decoded` also the text that they decode to.

    Null and empty texts give the end id alone, repeated rows the same ids
    each; an empty table stays empty. Columns named as an added one are
    replaced; others stay, whatever their names.
    """
    shared, key = docs.sparkSession.sparkContext.broadcast(model), _key(model)

    def kernel() -> Kernel:
        encoder, decoder = _tools(shared.value, key)

        def made(texts: pa.Array) -> list[pa.Array]:
            offsets, ids = encoder(texts.to_pylist())
            out = [_listed(offsets, ids)]
            if decoded:
                flat, at = ids.tolist(), offsets.tolist()
                out.append(pa.array([decoder(flat[a:b]) for a, b in zip(at, at[1:])], pa.string()))
            return out

        return made

    added = {to: T.ArrayType(T.IntegerType())} | ({decoded: T.StringType()} if decoded else {})
    return with_columns(docs, column, added, kernel, keep)


def decode(rows: DataFrame, model: Model, column: str = "ids", to: str = "decoded") -> DataFrame:
    """`rows` with the text of the array of ids in `column`. Null and empty arrays give the empty text, null ids count as absent; an id that the vocabulary lacks fails. A column named as `to` is replaced; others stay."""
    shared, key = rows.sparkSession.sparkContext.broadcast(model), _key(model)
    fields = [f for f in rows.schema.fields if f.name.lower() != to.lower() or f.name == column]
    names = [f.name for f in fields if f.name.lower() != to.lower()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, decoder = _tools(shared.value, key)
        for batch in batches:
            texts = [decoder([i for i in ids or () if i is not None]) for ids in batch.column(column).to_pylist()]
            yield pa.record_batch([*(batch.column(n) for n in names), pa.array(texts, pa.string())], [*names, to])

    kept = [f for f in fields if f.name in names]
    return rows.select(*[f"`{f.name}`" for f in fields]).mapInArrow(run, T.StructType([*kept, T.StructField(to, T.StringType())]))
