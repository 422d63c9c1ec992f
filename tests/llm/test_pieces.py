"""Encoding and decoding compared with the library, in Arrow batches and text by text."""

import random
import time

import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece

from loomgraph.llm import pieces

PATH = P.path("piece_bpe_32k.model")
BITS = [" ", "  ", "   ", "\n", "\n\n", "\t", "▁", "▁▁", "a", "the", "hello", " " * 7, "x" * 70, "日本語", "🙂", "é", "ﬁ", "<s>", "<0x41>", "</s>", "\0", "\r", "ab" * 40, " " * 40, "Ωß", "�", "　"]


@pytest.fixture(scope="module")
def model():
    return pieces.read_model(PATH)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_ids_and_texts_are_the_library_s(spark, model, library):
    draw = random.Random(3)
    rows = [None, "", " ", *("".join(draw.choice(BITS) for _ in range(draw.randint(1, 25))) for _ in range(400)), *(" " * n for n in range(60)), "ab c" * 20_000]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(rows)], "doc_id long, text string, ids string, _text string").repartition(4)
    coded = pieces.encode(df, model, decoded="decoded")

    def checked(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            want = library.encode(texts, add_eos=True, num_threads=1)
            good = [a == b and d == library.decode(b) for a, b, d in zip(batch.column("ids").to_pylist(), want, batch.column("decoded").to_pylist(), strict=True)]
            yield pa.record_batch([pa.array(good)], ["good"])

    got = coded.toArrow().to_batches()
    good = [x for b in checked(got) for x in b.column("good").to_pylist()]
    assert len(good) == len(rows) and all(good) and {r["_text"] for r in coded.select("_text").collect()} == {"y"}
    assert {r["ids"] for r in coded.filter("text is null").selectExpr("cast(ids as string) ids").collect()} == {"[2]"}


def test_any_ids_decode_as_in_the_library(spark, model, library):
    draw = random.Random(4)
    rows = [[draw.choice([draw.randrange(32000), draw.randrange(259), draw.randrange(130, 259)]) for _ in range(draw.randint(0, 9))] for _ in range(500)]
    df = spark.createDataFrame([(i, x, "kept") for i, x in enumerate(rows)] + [(-1, None, "kept")], "at long, ids array<int>, _ids string")
    got = {r["at"]: (r["decoded"], r["_ids"]) for r in pieces.decode(df, model).collect()}
    assert got == {i: (library.decode(x), "kept") for i, x in enumerate(rows)} | {-1: ("", "kept")}
    assert pieces.decode(df.filter("false"), model).count() == 0 and pieces.encode(df.selectExpr("at", "_ids text").filter("false"), model).count() == 0
    with pytest.raises(ValueError, match="vocabulary"):
        pieces.Decoder(model)([32000])


def test_a_long_run_of_letters_merges_in_seconds(model, library):
    draw = random.Random(5)
    text = "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300_000))
    encoder, began = pieces.Encoder(model), time.perf_counter()
    ids = encoder([text])[1].tolist()
    assert time.perf_counter() - began < 15 and ids == library.encode(text, add_eos=True)


def test_other_kinds_of_models_are_refused(tmp_path):
    (tmp_path / "m.model").write_bytes(b"\x12\x02\x18\x01\x1a\x04\x18\x01\x20\x00")  # a model without merges
    with pytest.raises(ValueError, match="merge-type"):
        pieces.read_model(str(tmp_path / "m.model"))
