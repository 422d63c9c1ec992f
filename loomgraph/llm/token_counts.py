"""Token counts of whole texts under a word-level BPE vocabulary, without making the tokens.

Offline, every vocabulary string that ends a word is merged by itself; those
that come out as one token are proven. In a text, distinct pre-tokens that are
proven count one, and only the rest is merged.
"""

from __future__ import annotations

import json
import re
import unicodedata
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import SPACE, Merges, Pairs, coded, merge_by_agenda, pattern_of
from .tables import Kernel, with_columns


def _byte_letters() -> list[str]:
    """The letter by which byte-level vocabularies write each byte: printable ones themselves, the others from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


#: Words of more bytes are merged by a heap each.
_LONG = 256


@dataclass(frozen=True)
class Vocabulary:
    """Merge table, as arrays and by pair, the ids of each byte inside and at the end of a word, the proven one-token words, the pre-token pattern and the special strings."""

    pairs: Pairs
    merges: Merges
    inner: np.ndarray
    final: np.ndarray
    pattern: str
    special: tuple[str, ...]
    proven: frozenset[str] = field(default=frozenset())

    def sizes(self, words: list[bytes]) -> np.ndarray:
        """Number of tokens of each word, by merging: short words all together, long ones by a heap each."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        long, short = np.flatnonzero(lengths > _LONG), np.flatnonzero(lengths <= _LONG)
        out = np.empty(len(words), np.int64)
        ids, sizes = self._symbols([words[i] for i in short]), lengths[short]
        out[short] = np.diff(self.pairs.merge(ids, sizes)[0])
        out[long] = [len(merge_by_agenda(self._symbols([words[i]]).tolist(), self.merges)) for i in long]
        return out

    def _symbols(self, words: list[bytes]) -> np.ndarray:
        """The ids of the bytes of words, one after another."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        ids = self.inner[raw]
        ends = np.cumsum(lengths)[lengths > 0] - 1
        ids[ends] = self.final[raw[ends]]
        return ids


def read_vocabulary(path: str) -> Vocabulary:
    """From a tokenizer file with a lower-casing, white-space-dropping BPE with word ends; read and proven on the driver."""
    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    model, letters = data["model"], _byte_letters()
    end, ids = model["end_of_word_suffix"], model["vocab"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    made = np.array([(ids[a], ids[b], i, ids[a + b]) for i, (a, b) in enumerate(merges)], np.int64).T
    inner, final = (np.array([ids[c + tail] for c in letters], np.int32) for tail in ("", end))
    pattern = data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
    special = tuple(t["content"] for t in data["added_tokens"] if t["special"])
    by_pair = {(a, b): (rank, result) for a, b, rank, result in made.T.tolist()}
    unproven = Vocabulary(Pairs(*made), by_pair, inner, final, pattern, special)
    byte_of = {c: i for i, c in enumerate(letters)}
    whole = [bytes(byte_of[c] for c in token[: -len(end)]) for token in ids if token.endswith(end) and token != end and all(c in byte_of for c in token[: -len(end)])]
    proven = {w for w, n in zip(whole, unproven.sizes(whole).tolist(), strict=True) if n == 1}
    texts = frozenset(w.decode() for w in proven if w.decode("utf-8", "ignore").encode() == w)
    return Vocabulary(unproven.pairs, by_pair, inner, final, pattern, special, texts)


def lowered(text: str) -> str:
    """Composed and lower-cased character by character."""
    return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


class TextCounter:
    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.units, self.pieces = vocabulary, re.compile(rf"[^{SPACE}]+").findall, pattern_of(vocabulary.pattern)
        self.special = regex.compile("|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True)))) if vocabulary.special else None

    def _pieces(self, unit: str) -> list[str | None]:
        """Pre-tokens of a run without white space; None stands for a special string."""
        if self.special is None or not self.special.search(unit):
            low = lowered(unit)
            return [low] if low.isalpha() else self.pieces(low)
        out: list[str | None] = []
        at = 0
        for found in self.special.finditer(unit):
            out += [*self.pieces(lowered(unit[at : found.start()])), None]
            at = found.end()
        return out + self.pieces(lowered(unit[at:]))

    def __call__(self, texts: list[str]) -> np.ndarray:
        cut = [self.units(t) for t in texts]
        units, unit_of = coded(list(chain.from_iterable(cut)))
        found = [self._pieces(u) for u in units]
        pieces, piece_of = coded(list(chain.from_iterable(found)))
        one = np.fromiter((p is None or p in self.vocabulary.proven for p in pieces), bool, len(pieces))
        sizes = np.ones(len(pieces), np.int64)
        sizes[~one] = self.vocabulary.sizes([p.encode() for p, known in zip(pieces, one.tolist(), strict=True) if not known])
        return _sums(_sums(sizes[piece_of], found)[unit_of], cut)


def _sums(values: np.ndarray, lists: list) -> np.ndarray:
    """Sums of the values that belong to each list, in order."""
    ends = np.cumsum([len(x) for x in lists], dtype=np.int64)
    total = np.concatenate([[0], np.cumsum(values)])
    return np.diff(total[np.concatenate([[0], ends])])


def count_tokens(docs: DataFrame, vocabulary: Vocabulary, column: str = "text", to: str = "n_tokens", keep: list[str] | None = None) -> DataFrame:
    """`docs`, or its columns `keep`, with the number of tokens of the whole text as long.

    Null and empty texts have none; repeated rows count alike. A column named
    as `to` is replaced; others stay, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def kernel() -> Kernel:
        counter = TextCounter(shared.value)
        return lambda texts: [pa.array(counter(texts.to_pylist()), pa.int64())]

    return with_columns(docs, column, {to: T.LongType()}, kernel, keep)
