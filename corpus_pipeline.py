"""The corpus pipeline: each stage takes and gives documents and calls one operator of loomgraph.llm.

The last stage gives ids instead of texts. Documents that the mix takes twice
appear as two rows with one doc_id. Columns of documents may have any names but
those that the last stage gives; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import bpe, lines, minhash, mixing, quality
from loomgraph.llm.tables import materialize, table, unused


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from all labelled documents, scores under a half go.

    Null and empty texts have the constant's score and go or stay alike, as
    repeated rows do; a score of a half, as all have without labels, stays.
    """
    score = unused(docs, "score")
    scored = quality.fit_and_score(docs, table(spark, sf_dir, "labels"), F.lit(True), to=score)
    return scored.filter(F.col(score) >= 0.5).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of lines with 50 words or more go, and documents of which nothing is left.

    The first copy is that of the least doc_id. Repeated rows are one document
    and stay or go together; rows without a doc_id, and null and empty texts,
    lose nothing.
    """
    return lines.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the least doc_id; rows that repeat its id stay with it. Null and empty texts are like no other and stay, as do rows without a doc_id."""
    return minhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One and a half times all words, the sources weighing 5, 2 and 1 in turn, none taken more than twice.

    A null source is one of its own. Null and empty texts have no words and are
    left out. Equal rows may swap their shares; else the same rows give the
    same mix.
    """
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, their number, and the digest of the bytes they decode to, instead of text and n_chars; columns of these names are replaced. Repeated rows get the same ids."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    kept = [c for c in docs.columns if c not in ("text", "n_chars")]
    encoded = bpe.encode(docs, ranks, public_tokenizers.PATTERN, keep=kept)
    return encoded.withColumns({"n_tokens": F.size("ids").cast("long"), "decoded_sha256": F.sha2(bpe.decode(F.col("ids"), ranks), 256)})


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

#: SQL can express neither the trained classifier nor the seeded choice of blocks.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`, each one's result written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
