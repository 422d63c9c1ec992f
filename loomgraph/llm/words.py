"""Arrow and numpy kernels over the words of texts, one record batch at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: A word is a run of other bytes than these: space, and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(32)


def slices(batch: pa.RecordBatch, column: str | int, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts hold about `limit` bytes, so that temporaries stay bounded."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    block = np.cumsum(sizes, dtype=np.int64) // limit
    starts = np.flatnonzero(np.diff(block, prepend=-1))
    for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def hash_words(words: pa.Array) -> np.ndarray:
    """64-bit hashes; each distinct word is hashed once."""
    coded = words.dictionary_encode()
    digest = xxhash.xxh3_64_intdigest
    distinct = np.fromiter((digest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(coded.dictionary))
    return distinct[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.empty(0, np.uint64)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts, and the offsets at which each text's words start (one more than texts)."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    offsets = lists.offsets.to_numpy()
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(full, dtype=np.int64)])
    return flat.filter(pa.array(full)), before[offsets - offsets[0]]


def mix(values: np.ndarray) -> np.ndarray:
    values = values * _MULTIPLIER
    return values ^ (values >> _SHIFT)


def gram_hashes(words: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """Order-sensitive hashes of the k words from each start."""
    out = np.full(len(starts), k * 0x9E3779B97F4A7C15 % (1 << 64), np.uint64)
    for j in range(k):
        out = mix(out ^ words[starts + j])
    return out


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Each text's sorted distinct k-word shingles as 64-bit hashes, A-Z lower-cased.

    A text of fewer than k words has one shingle, the whole sequence; one without words has none.
    """
    words, offsets = split_words(pc.ascii_lower(texts))
    hashed = hash_words(words)
    counts = np.diff(offsets)
    owner = np.repeat(np.arange(len(counts)), counts)
    starts = np.arange(len(hashed))
    whole = starts[starts + k <= offsets[1:][owner]] if len(owner) else starts
    grams = gram_hashes(hashed, whole, k)
    per = np.maximum(counts - k + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(per)])
    sets = []
    for i, n in enumerate(counts):
        if n >= k:
            own = np.sort(grams[bounds[i] : bounds[i + 1]])
            sets.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif n:
            sets.append(gram_hashes(hashed, offsets[i : i + 1], int(n)))
        else:
            sets.append(np.empty(0, np.uint64))
    return sets
