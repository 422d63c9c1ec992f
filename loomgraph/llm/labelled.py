"""Bounded samples of labelled documents for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import whole_text


def fold_of(doc_id: str, folds: int) -> F.Column:
    """crc32 of the id's decimal text, modulo `folds`."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: F.Column, max_rows: int) -> DataFrame:
    """(doc_id, text, label, draw): texts with a 0/1 label where `keep` holds for the doc_id.

    Of more than `max_rows` labelled ids, those with the lowest hashes are
    taken, about `max_rows` in number, so that the ids can be broadcast and no
    text is shuffled. Ids labelled more than once take the larger label; null
    ids and labels are left out.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter(keep & F.col("label").isin(0, 1))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 40))
    share = min(1.0, max_rows / max(1, known.count()))
    ids = known.withColumn("draw", draw).filter(F.col("draw") < int(share * (1 << 40)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return texts.join(F.broadcast(ids), "doc_id").select("doc_id", "text", "label", "draw")
