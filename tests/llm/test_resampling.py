"""Weights, scores and the draw against a plain version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import resampling


def runs(text, longest, buckets):
    lower = (text or "").encode().lower()  # bytes: A-Z only
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return words, [zlib.crc32(b" ".join(words[i : i + n])) % buckets for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, p):
    cut = [runs(t, p.longest, p.buckets) for _, t in docs]
    own, other = Counter(b for _, f in cut for b in f), Counter(b for t in target for b in runs(t, p.longest, p.buckets)[1])
    s, t = own.total(), other.total()
    gain = {b: math.floor(1000 * math.log((other[b] + 1) * (s + p.buckets) / ((own[b] + 1) * (t + p.buckets)))) for b in own}
    rows = []
    for (d, text), (words, found) in zip(docs, cut, strict=True):
        h = int(hashlib.sha256(f"{p.seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        rows.append([d, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words) >= p.least_words, text])
    enough = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(enough[: p.percent * len(enough) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


@pytest.mark.parametrize("p", [resampling.Params(least_words=5, percent=30), resampling.Params(longest=3, buckets=97, least_words=0, percent=100, seed=5)])
def test_weights_and_draw(spark, p):
    draw = random.Random(p.buckets)
    word = lambda: draw.choice(["Stone", "river", "the", "the", "ÉLAN", "日本", "x1", "letter"]) + str(draw.choice(["", draw.randrange(50)]))
    prose = lambda n: draw.choice([" ", ", ", "\n"]).join(word() for _ in range(n))
    docs = [(i, prose(draw.choice([1, 4, 5, 40]))) for i in range(120)] + [(500, None), (501, ""), (502, "-- !!"), (503, "the " * 60_000)]
    docs += [(900 + i, docs[7][1]) for i in range(60)] + [docs[9]] * 4 + [(None, docs[7][1])]
    target = [prose(30) for _ in range(5)] + [None, ""]
    names = ("bucket", "n", "mark", "rank", "_text", "score", "gain", "copies", "part")
    frame = spark.createDataFrame([(*d, *["x"] * len(names)) for d in docs], f"doc_id long, text string, {', '.join(f'`{n}` string' for n in names)}").repartition(5)
    got = resampling.resample(frame, spark.createDataFrame([(t,) for t in target], "text string"), p)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    rows = [tuple(r) for r in got.collect()]
    want = brute(docs, target, p)
    # rows that tie in score and doc_id are alike but for the rank
    assert sorted((r[:4] for r in rows), key=str) == sorted((r[:4] for r in want), key=str)
    assert sorted(r[4] for r in rows if r[4]) == sorted(r[4] for r in want if r[4])
    assert {r[4]: r[3] for r in rows if r[4]} == {r[4]: r[3] for r in want if r[4]} and {r for r in rows if r[0] is not None and r[0] < 900 and r[4]} >= {r for r in want if r[0] is not None and r[0] < 900 and r[0] != docs[9][0] and r[4]}


def test_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "one two")], "doc_id long, text string"), spark.createDataFrame([], "text string")
    assert resampling.resample(docs.filter("false"), docs.select("text")).count() == 0
    p = resampling.Params(least_words=1, percent=100)
    assert [tuple(r) for r in resampling.resample(docs, none, p).collect()] == brute([(1, "one two")], [], p)


def test_postings_are_counted_by_document(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b")], "doc_id long, text string").coalesce(1)
    lists = resampling.postings(docs, resampling.Params())
    ids = lists.filter("bucket is null").select("block", F.posexplode("doc_ids").alias("at", "doc_id"))
    rows = lists.filter("bucket is not null").select("bucket", "block", F.explode(F.arrays_zip("at", "counts")).alias("x")).select("bucket", "block", "x.*").join(ids, ["block", "at"])
    got = {(r["doc_id"], r["bucket"]): r["counts"] for r in rows.collect()}
    a, b = (zlib.crc32(x) % 10_000 for x in (b"a", b"b"))
    assert got == {(1, a): 2, (1, b): 1, (2, b): 1}
    assert {r["bucket"]: r["n"] for r in lists.filter("bucket is not null").collect()} == {a: 2, b: 2}
