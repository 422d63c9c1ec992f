"""An index holds the postings that its searches read, and no others."""

import os

import pytest

from loomgraph.operators import textindex
from loomgraph.plans import stored
from loomgraph.sources import property_graph as pg


def test_only_the_postings_asked_for_are_written(spark, tmp_path):
    rows = spark.createDataFrame([("a", "red car"), ("b", "car"), ("c", None)], "id string, name string")
    whole = textindex.TextIndex.build(rows, {"name": "A"}, 4, str(tmp_path / "whole"))
    words = textindex.TextIndex.build(rows, {"name": "A"}, 4, str(tmp_path / "words"), ("words",))
    grams = textindex.TextIndex.build(rows, {"name": "A"}, 4, str(tmp_path / "grams"), ("trigrams",))
    assert [sorted(os.listdir(x.path)) for x in (whole, words, grams)] == [["rows", "trigrams", "words"], ["rows", "words"], ["rows", "trigrams"]]
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) != []
    assert same(words.bm25(spark, "red car"), whole.bm25(spark, "red car"))
    assert same(words.weighted(spark, "car"), whole.weighted(spark, "car"))
    assert same(grams.alike(spark, "red car"), whole.alike(spark, "red car"))
    with pytest.raises(ValueError, match="without trigrams"):
        words.alike(spark, "car")


def test_queries_build_what_they_read(spark, monkeypatch):
    written, kept = [], textindex.TextIndex._write
    monkeypatch.setattr(textindex.TextIndex, "_write", lambda self, postings, term, name: written.append(name) or kept(self, postings, term, name))
    stored.indexed_bm25_search(spark, "/root/testdata/sf0.001")
    nodes = pg.nodes(spark, "/root/testdata/sf0.001")
    stored.indexed_trigram_search(nodes, None)
    stored.indexed_weighted_search(nodes, None)
    assert written == ["words", "trigrams", "words"]


def test_texts_are_dealt_to_all_tasks(spark, monkeypatch):
    dealt, kept = [], textindex.TextIndex._write
    monkeypatch.setattr(textindex.TextIndex, "_write", lambda self, postings, term, name: dealt.append(postings.rdd.getNumPartitions()) or kept(self, postings, term, name))
    textindex.TextIndex.build(spark.range(1000).selectExpr("cast(id as string) as id", "'red car' as name"), {"name": "A"}, 4)
    assert dealt == [4, 4]  # rows of few bytes are not taken together into one task
