import base64
import random
import time

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomgraph.llm import bpe, token_counts

WORDS = ["the", "thethat", " ", "  ", "\n", "\n\n", "Élan", "über", "naïve", "日本語", "🙂", "🙂🙂🏽", "don't", "we'll", "x1y2", "12345", "...", "!?", "\t", "a" * 300, "0" * 40, " ", " ", "İstanbul", "ΟΔΟΣ", "<|endoftext|>", "<|startoftext|>", "é", "​", "ﬁ"]


def texts(n, seed):
    draw = random.Random(seed)
    return [None, "", " ", "\n", *("".join(draw.choice(WORDS) + draw.choice(["", " "]) for _ in range(draw.randint(1, 30))) for _ in range(n)), "lo" * 20_000]


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def frame(spark, rows):
    return spark.createDataFrame([(i, t, [i], "n") for i, t in enumerate(rows)], "doc_id long, text string, ids array<long>, n_tokens string")


def test_ids_and_bytes_are_the_library_s(spark, ranks, library):
    rows = texts(150, 1)
    got = bpe.encode(frame(spark, rows), ranks, P.PATTERN).withColumn("raw", bpe.decode(F.col("ids"), ranks)).collect()
    for r in got:
        want = (rows[r["doc_id"]] or "")
        assert r["ids"] == library.encode_ordinary(want)
        assert bytes(r["raw"]) == want.encode()
        assert r["n_tokens"] == "n"


def test_the_fold_gives_the_same_ids(spark, ranks, library):
    rows = [t for t in texts(40, 2) if len(t or "") < 400 and "a" * 300 not in (t or "")]
    got = bpe.encode_native(frame(spark, rows).drop("ids"), ranks, P.PATTERN).collect()
    assert {r["doc_id"]: r["ids"] for r in got} == {i: library.encode_ordinary(t or "") for i, t in enumerate(rows)}


def test_rank_file(ranks):
    first = open(P.path("byte_bpe_50k.tiktoken"), "rb").readline().split()
    assert ranks[base64.b64decode(first[0])] == int(first[1])


def test_counts_are_the_library_s(spark):
    rows = texts(150, 3)
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    vocabulary = token_counts.read_vocabulary(P.path("word_bpe_49k.json"))
    got = token_counts.count_tokens(frame(spark, rows), vocabulary).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(rows)}
    assert all(len(library.encode(w, add_special_tokens=False).ids) == 1 for w in sorted(vocabulary.proven)[::97])


def test_empty_tables(spark, ranks):
    none = frame(spark, [])
    assert bpe.encode(none, ranks, P.PATTERN).count() == 0
    assert token_counts.count_tokens(none, token_counts.read_vocabulary(P.path("word_bpe_49k.json"))).count() == 0


def test_long_words_are_counted_in_seconds():
    draw = random.Random(11)
    word = "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300_000))
    path = P.path("word_bpe_49k.json")
    counter = token_counts.TextCounter(token_counts.read_vocabulary(path))
    began = time.perf_counter()
    got = counter([word, word[:1000], "a " + word[:257]]).tolist()
    assert time.perf_counter() - began < 15  # about 2 on an idle machine
    library = Tokenizer.from_file(path)
    assert got == [len(e.ids) for e in library.encode_batch([word, word[:1000], "a " + word[:257]], add_special_tokens=False)]
