import random

import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from loomgraph.llm import bpe


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    draw = random.Random(9)
    words = [f"word{i}" for i in range(500)]
    prose = lambda n: " ".join(draw.choice(words) for _ in range(n))
    passage = prose(60)
    rows = [(i, prose(80) + "\n" + prose(30), "en", f"s{i % 3}") for i in range(60)]
    rows += [(100 + i, prose(40) + "\n" + passage, "en", "s0") for i in range(3)]  # a passage that repeats
    rows += [(200, rows[5][1], "en", "s1"), (201, rows[6][1].replace("word1", "other", 1), "en", "s1")]  # copies
    rows += [(300 + i, "SPAM!! BUY!! " * 40 + str(i), "en", "s2") for i in range(30)]
    rows += [(400, None, "en", None), (401, "", None, "s1")]
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame([(d, t, lang, s, len(t or "")) for d, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(d, int(d < 300), 0) for d, *_ in rows if d % 3], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_each_stage_takes_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = corpus_pipeline.materialize(stage(spark, docs, folder), name)
        seen[name] = docs.toPandas()
        assert name == "encode" or docs.columns == columns
    ids = {n: set(x["doc_id"]) for n, x in seen.items()}
    assert set(range(60)) <= ids["quality_classifier"] and not ids["quality_classifier"] & set(range(300, 330))
    text = seen["line_dedup"].set_index("doc_id")["text"]
    assert len({t.split("\n")[1] for t in text[[100]]}) == 1 and all("\n" not in text[i] for i in (101, 102)) and 200 not in ids["line_dedup"]
    assert set(range(60)) <= ids["line_dedup"] and 201 not in ids["near_dedup"]
    before, after = seen["near_dedup"], seen["mix_sources"]
    size = lambda x: x["text"].fillna("").str.split().str.len().sum()
    assert abs(size(after) - 1.5 * size(before)) <= before["source"].nunique(dropna=False)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = sorted(tuple(library.encode_ordinary(t or "")) for t in after["text"])
    assert sorted(map(tuple, seen["encode"]["ids"])) == want and (seen["encode"]["n_tokens"] == seen["encode"]["ids"].map(len)).all()


def test_run_gives_the_last_stage(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "lang", "source", "ids", "n_tokens", "decoded_sha256"] and got.count() > 0


def test_clashing_columns_repeated_rows_and_empty_tables(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = ["quality_score", "_score", "score", "_key", "key", "_mark", "mark", "times", "pieces", "part", "_part", "removed", "component", "band"]
    clash = docs.union(docs.filter("doc_id = 7")).selectExpr("*", *[f"cast(doc_id as string) as `{n}`" for n in names])
    clash.write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{tmp_path}/a/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/a/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = corpus_pipeline.materialize(stage(spark, docs, f"{tmp_path}/a"), name)
        assert name == "encode" or docs.columns == columns
        assert docs.filter(" or ".join(f"not (`{n}` <=> cast(doc_id as string))" for n in names)).count() == 0
    assert docs.count() > 0
    clash.filter("false").write.parquet(f"{tmp_path}/b/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{tmp_path}/b/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0
