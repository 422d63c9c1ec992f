"""Pairs of names that are alike, or of which one holds the other, by equi-joins on exact keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import kept_together, wide

#: Below this threshold so many edits are allowed that no key is sure; then all pairs are compared.
LEAST_THRESHOLD = 2

#: A group's pairs are all tried if they are at most so many for each of its names, about as many as a short name has keys.
PAIRS_OF_A_NAME = 32


def edits(length: int, threshold: float) -> int:
    """Edits at most between names whose longer one has `length` letters, if their likeness, rounded to whole percent, is `threshold` or more."""
    return max(0, int(length * (100.5 - threshold) / 100 + 1e-9))


def _shorter(text: str) -> set[str]:
    return {text[:i] + text[i + 1 :] for i in range(len(text))}


def _segments(length: int, most: int) -> list[tuple[int, int]]:
    """(start, size) of so many segments that one of them has one edit at most, of `most` edits in all."""
    n = (most + 2) // 2
    return [(i * length // n, (i + 1) * length // n - i * length // n) for i in range(n)]


def longer_keys(name: str, threshold: float) -> set[str]:
    """Keys of a name as the longer of a pair: its segments, whole and less a letter."""
    n = len(name)
    k = edits(n, threshold)
    if not k:
        return set()
    return {f"{n}/{i}/{x}" for i, (p, q) in enumerate(_segments(n, k)) for x in {name[p : p + q], *_shorter(name[p : p + q])}}


def shorter_keys(name: str, threshold: float) -> set[str]:
    """Keys of a name as the shorter of a pair: for each length of the longer one, what its segments can have become, with places that leave no more than all edits on both sides."""
    m = n = len(name)
    keys = set()
    while n - (k := edits(n, threshold)) <= m:
        for i, (p, q) in enumerate(_segments(n, k) if k else []):
            for more in (-1, 0, 1):
                for by in range(-k, k + 1):
                    a, b = p + by, p + by + q + more
                    if 0 <= a <= b <= m and abs(by) + abs(m - n - by - more) + abs(more) <= k:
                        keys.update(f"{n}/{i}/{x}" for x in ([name[a:b]] if more < 0 else _shorter(name[a:b])))
        n += 1
    return keys


def _begins(name: str) -> set[str]:
    """Key of a name as the one that is held: its first letters, as many as the greatest power of two that it has."""
    size = 1 << (len(name).bit_length() - 1) if name else 0
    return {f"{size}/{name[:size]}"}


def _grams(name: str) -> set[str]:
    """Keys of a name as the one that holds: all its runs of each power of two letters, and the empty one; length times logarithm of the length of them at most."""
    sizes = [0, *(1 << i for i in range(len(name).bit_length()))]
    return {f"{size}/{name[i : i + size]}" for size in sizes for i in range(len(name) - size + 1 if size else 1)}


#: Letters that a profile counts together, in the order in which profiles are tried: each by itself, in six groups, digits and letters.
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_DIGITS = "0123456789"
PROFILES = ((_DIGITS, *_LETTERS), (_DIGITS, *(_LETTERS[i::6] for i in range(6))), (_DIGITS, _LETTERS))
#: So many different profiles of a side are compared at most.
MOST_PROFILES = 2000


def _profile(classes: tuple[str, ...]) -> Column:
    """How many letters of each class a name has, and its length, as text."""
    return F.array_join(F.array(*[(F.length("name") - F.length(F.translate("name", c, ""))).cast("string") for c in classes], F.length("name").cast("string")), ",")


def _may_meet(left: DataFrame, right: DataFrame, meet: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[DataFrame, DataFrame]:
    """The names (name) of both sides less those whose profile can meet no profile of the other side.

    `meet` compares a profile (counts of each class, the last of all other
    letters) with all of the other side. Only profiles go through the driver;
    with too many, coarser ones are taken, and at last all names.
    """
    for classes in PROFILES:
        sides = []
        for df in (left, right):
            rows = df.select(_profile(classes).alias("p")).distinct().limit(MOST_PROFILES + 1).collect()
            counts = np.array([[int(x) for x in r["p"].split(",")] for r in rows]).reshape(len(rows), len(classes) + 1)
            counts[:, -1] -= counts[:, :-1].sum(axis=1)
            sides.append(([r["p"] for r in rows], counts))
        (a, x), (b, y) = sides
        if max(len(a), len(b)) <= MOST_PROFILES:
            good = np.array([meet(row, y) for row in x]).reshape(len(a), len(b))
            of = lambda df, names, some: df.filter(_profile(classes).isin([n for n, s in zip(names, some, strict=True) if s]))  # noqa: B023, E731
            return of(left, a, good.any(axis=1)), of(right, b, good.any(axis=0))
    return left, right


def _close(threshold: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Whether letters too many on a side leave the likeness of names at `threshold`."""

    def meet(one: np.ndarray, others: np.ndarray) -> np.ndarray:
        least = np.maximum(np.maximum(one - others, 0).sum(axis=1), np.maximum(others - one, 0).sum(axis=1))
        return least <= np.array([edits(int(n), threshold) for n in np.maximum(one.sum(), others.sum(axis=1))])

    return meet


def _inside(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Whether one name has all letters of the other."""
    return (one <= others).all(axis=1) | (one >= others).all(axis=1)


def _by_name(names: DataFrame) -> DataFrame:
    """Equal names together, in as many parts as the session has for shuffles: keys are many more than names, so parts are not put together by the size of the names."""
    return names.repartition(int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")), "name")


def _keyed(names: DataFrame, to: str, keys: Callable[[str], set[str]], by: list[str] | None = None) -> DataFrame:
    """(*by, to, key): a row for each key of each name; the columns `by` are strings and are kept."""
    by = by or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, found = [], []

            def cut() -> pa.RecordBatch:
                return pa.record_batch([*batch.select(by).take(pa.array(own, pa.int64())).columns, batch.column("name").take(pa.array(own, pa.int64())), pa.array(found, pa.string())], [*by, "name", "key"])

            for at, name in enumerate(batch.column("name").to_pylist()):
                more = keys(name)
                own += [at] * len(more)
                found += more
                if len(own) > 20_000:
                    yield cut()
                    own, found = [], []
            yield cut()

    keyed = names.select(*by, "name").mapInArrow(run, "".join(f"{c} string, " for c in by) + "name string, key string")
    return wide(keyed.select(*by, F.col("name").alias(to), F.xxhash64("key").alias("key")))


def alike(left: DataFrame, right: DataFrame, threshold: float, rising: str | None = None) -> DataFrame:
    """(left, right): pairs of different names (name) whose edit distance leaves a likeness of `threshold` percent or more, rounded.

    The longer name is cut into segments of which one has one edit at most, so
    that an equal key, a segment whole or less a letter, is found for each pair.
    Names whose letters are like no name's of the other side get no keys. With
    `rising`, only pairs of which the left name has a lesser value in that
    string column than the right one has; others go as soon as they meet.
    """
    longest = F.greatest(F.length("left"), F.length("right"))
    close = (F.col("left") != F.col("right")) & (F.round(100 * (longest - F.levenshtein("left", "right")) / longest) >= threshold)
    low, high = (["low"], ["high"]) if rising else ([], [])
    left, right = left.filter("name is not null"), right.filter("name is not null")
    if rising:
        close = close & (F.col("low") < F.col("high"))
        left, right = left.withColumnRenamed(rising, "low"), right.withColumnRenamed(rising, "high")
    left, right = left.select("name", *low), right.select("name", *high)
    if threshold < LEAST_THRESHOLD:
        return left.distinct().withColumnRenamed("name", "left").crossJoin(right.distinct().withColumnRenamed("name", "right")).filter(close).select("left", "right").distinct()
    left, right = map(_by_name, _may_meet(left, right, _close(threshold)))
    left, right = left.groupBy("name").agg(*[F.min(c).alias(c) for c in low]) if low else left.distinct(), right.groupBy("name").agg(*[F.max(c).alias(c) for c in high]) if high else right.distinct()
    as_longer, as_shorter = lambda x: longer_keys(x, threshold), lambda x: shorter_keys(x, threshold)
    down = _keyed(left, "left", as_longer, low).join(_keyed(right, "right", as_shorter, high), "key").filter(F.length("left") >= F.length("right"))
    up = _keyed(left, "left", as_shorter, low).join(_keyed(right, "right", as_longer, high), "key").filter(F.length("left") < F.length("right"))
    return down.union(up.select(*down.columns)).filter(close).select("left", "right").distinct()


def holding(left: DataFrame, right: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(*by, left, right): pairs of names (*by, name) of which one holds the other, or that are equal, within equal values of the string columns `by`.

    A held name of n letters meets the holder in its first letters, as many as
    the greatest power of two up to n. In a group with so few names that their
    pairs are fewer than such keys, all pairs are tried.
    """
    by = by or []
    left, right = (df.select(*by, "name").filter("name is not null") for df in (left, right))
    if not by:
        return _held(*[_by_name(df).distinct() for df in _may_meet(left, right, _inside)], by).distinct()
    left, right = left.distinct(), right.distinct()
    sizes, others = of_few(left, right, by)
    small = lambda df: df.join(sizes.filter("few").select(*by), by, "left_semi") if others else df
    tried = small(left).withColumnRenamed("name", "left").join(wide(right.withColumnRenamed("name", "right")), by).filter(F.contains("left", "right") | F.contains("right", "left")).select(*by, "left", "right")
    if not others:
        return tried
    large = lambda df: df.join(sizes.filter("not few").select(*by), by, "left_semi")
    return tried.union(_held(large(left), large(right), by).distinct())


def of_few(left: DataFrame, right: DataFrame, by: list[str]) -> tuple[DataFrame, bool]:
    """(*by, few) of the groups of both sides, written: whether the rows of a group make so few pairs that all of them may be tried; and whether any group makes more."""
    size = lambda df, n: df.groupBy(*by).agg(F.count("*").alias(n))
    sizes = kept_together(size(left, "l").join(size(right, "r"), by).select(*by, (F.col("l") * F.col("r") <= PAIRS_OF_A_NAME * (F.col("l") + F.col("r"))).alias("few")), by[0], "sizes")
    return sizes, not sizes.filter("not few").isEmpty()


def _held(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """`holding` of distinct names by their keys; pairs of equal names come twice."""
    down = _keyed(left, "left", _grams, by).join(_keyed(right, "right", _begins, by), [*by, "key"]).filter(F.contains("left", "right"))
    up = _keyed(left, "left", _begins, by).join(_keyed(right, "right", _grams, by), [*by, "key"]).filter(F.contains("right", "left"))
    columns = [*by, "left", "right"]
    return down.select(*columns).union(up.select(*columns))
