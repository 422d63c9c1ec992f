"""Every operator on clashing column names, nulls, empty and very long texts, repeated rows and empty tables."""

import random

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import bpe, fuzzy, lines, minhash, mixing, quality, token_counts, toxicity, vptree, warc

# Names that operators use inside, or give their results.
CLASHES = ["_text", "__text", "_mark", "mark", "_key", "key", "_removed", "removed", "_times", "times", "_pieces", "pieces", "number", "ids", "n_tokens", "toxicity", "n_hits", "quality_score", "fingerprint", "rank", "band", "bands", "sig", "fp", "component", "part", "a", "b", "size", "start", "line", "h", "g", "w", "label", "draw", "slot", "digest", "payload", "n", "vector", "dim", "shard", "block"]
LONG = " ".join(random.Random(1).choices(["stone", "river", "paper", "letter", "garden"], k=60_000)) + "\n" + "x" * 300_000
ROWS = [(1, "one two three four five six"), (1, "one two three four five six"), (2, None), (3, ""), (None, "no id at all"), (4, LONG), (5, "one two three four five six"), (6, " \n\t")]


def docs(spark, rows=ROWS):
    extra = ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame([(d, t, "en", f"s{(d or 0) % 2}", *["x"] * len(CLASHES)) for d, t in rows], f"doc_id long, text string, lang string, source string, {extra}")


@pytest.fixture(scope="module")
def whole():
    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    vocabulary = token_counts.read_vocabulary(P.path("word_bpe_49k.json"))
    model = np.zeros(1 << 18), 0.5
    return {
        "encode": (lambda d: bpe.encode(d, ranks, P.PATTERN), "ids"),
        "count_tokens": (lambda d: token_counts.count_tokens(d, vocabulary), "n_tokens"),
        "toxicity": (lambda d: toxicity.score(d, toxicity.Lexicon({" ston": 1.0})), "toxicity"),
        "quality": (lambda d: quality.score(d, model), "quality_score"),
        "fingerprint": (fuzzy.fingerprint, "fingerprint"),
    }


@pytest.mark.parametrize("name", ["encode", "count_tokens", "toxicity", "quality", "fingerprint"])
def test_operators_that_add_columns(spark, whole, name):
    run, added = whole[name]
    got = run(docs(spark)).collect()
    assert len(got) == len(ROWS) and sorted(r["doc_id"] or 0 for r in got) == sorted(d or 0 for d, _ in ROWS)
    dropped = {"ids", "n_tokens", "toxicity", "n_hits", "quality_score", "fingerprint"} & {added, *(["n_hits"] if name == "toxicity" else [])}
    assert all(r[c] == "x" for r in got for c in CLASHES if c not in dropped)
    value = lambda r: tuple(r[added]) if isinstance(r[added], list) else r[added]
    assert len({value(r) for r in got if r["text"] == ROWS[0][1]}) == 1 and len({value(r) for r in got if not r["text"]}) == 1
    assert {r["text"] for r in got} == {t for _, t in ROWS}
    assert run(docs(spark, [])).count() == 0


def test_line_dedup(spark):
    got = {r["doc_id"]: r for r in lines.dedup_lines(docs(spark), lines.Params(6)).collect()}
    assert set(got) == {1, 2, 3, None, 4, 6} and got[4]["text"] == LONG and all(r[c] == "x" for r in got.values() for c in CLASHES)
    assert {r["doc_id"]: r["n_removed"] for r in lines.report(docs(spark), lines.Params(6)).collect()} == {1: 0, 2: 0, 3: 0, None: 0, 4: 0, 5: 1, 6: 0}
    assert lines.dedup_lines(docs(spark, [])).count() == 0


def test_mix(spark):
    planned = mixing.plan(docs(spark)).collect()
    assert len(planned) == len(ROWS) and {r["size"] for r in planned if r["doc_id"] == 4} == {60_001}
    got = mixing.mix(docs(spark)).collect()
    assert sum(len(r["text"].split()) for r in got) == sum(r["taken"] for r in planned) and all(r[c] == "x" for r in got for c in CLASHES)
    assert mixing.mix(docs(spark, [])).count() == 0


def test_fingerprints_of_neighbours(spark):
    got = fuzzy.edited_and_next(docs(spark)).collect()
    assert len(got) == len(ROWS) and {r["n_chars"] for r in got if r["doc_id"] == 4} == {len(LONG)}
    assert fuzzy.edited_and_next(docs(spark, [])).count() == 0


def test_near_duplicates(spark):
    got = minhash.near_duplicates(docs(spark)).collect()
    assert len(got) == len(ROWS) and {r["component_id"] for r in got if r["doc_id"] in (1, 5)} == {1}
    kept = minhash.keep_one(docs(spark)).collect()
    assert sorted(r["doc_id"] or 0 for r in kept) == [0, 1, 1, 2, 3, 4, 6] and all(r[c] == "x" for r in kept for c in CLASHES)
    assert minhash.keep_one(docs(spark, [])).count() == 0


def test_neighbours(spark):
    extra = ", ".join(f"`{c}` string" for c in CLASHES)
    top = (1 << 63) - 1
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (None, [1.0, 1.0]), (top, [2.0, 0.0]), (7, [None, 1.0])]
    df = spark.createDataFrame([(i, v, *["x"] * len(CLASHES)) for i, v in rows], f"vec_id long, embedding array<double>, {extra}")
    got = vptree.nearest_neighbours(df, F.col("vec_id") == 1).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(2, 0.0), (top, 1.0)]
    assert vptree.nearest_neighbours(df.filter("false"), F.lit(True)).count() == 0


def test_archives(spark):
    extra = ", ".join(f"`{c}` string" for c in CLASHES if c not in ("payload",))
    rows = [(1, "u", LONG), (1, "u", LONG), (2, None, None), (3, "v", ""), (None, "w", LONG), (4, "u", LONG)]
    df = spark.createDataFrame([(*r, *["x"] * (len(CLASHES) - 1)) for r in rows], f"page_id long, url string, html string, {extra}")
    got = sorted(((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in warc.round_trip(df).collect()), key=str)
    assert got == sorted([(1, "revisit", 4), (1, "revisit", 4), (2, "response", None), (3, "response", None), (0, "response", None), (4, "response", None)], key=str)
    assert warc.round_trip(df.filter("false")).count() == 0
    assert warc.store_uri("s3a://bucket/x") == "s3://bucket/x" and warc.store_uri("file:///tmp/x") == "file:///tmp/x" and warc.store_uri("/tmp/x") == "/tmp/x"
