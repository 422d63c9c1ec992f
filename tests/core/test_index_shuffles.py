"""A stored index is built without a shuffle of its postings but the one that writes them."""

from loomgraph.operators import textindex


def test_postings_are_not_shuffled_to_be_told_apart(spark, monkeypatch):
    plans, kept = {}, textindex.TextIndex._write

    def write(self, postings, term, name):
        plans[name] = postings._jdf.queryExecution().executedPlan().toString()
        kept(self, postings, term, name)

    monkeypatch.setattr(textindex.TextIndex, "_write", write)
    rows = spark.createDataFrame([("a", "red car", "x/y"), ("a", "red bus", None), ("b", "car", "x/y"), ("b", "car", "x/y"), (None, "car", "z")], "id string, name string, path string")
    index = textindex.TextIndex.build(rows, {"name": "A", "path": "C"}, 4)
    assert all(p.count("Exchange") == 1 and p.rindex("Generate") < p.index("Exchange") for p in plans.values())
    grams = index.postings(spark, "trigrams", ["red", " ca", "  x"]).select("gram", "id", "field", "of").collect()
    assert sorted(map(tuple, grams)) == [("  x", "a", "path", 4), ("  x", "b", "path", 4), (" ca", "a", "name", 8), (" ca", "b", "name", 4), ("red", "a", "name", 8)]
    words = index.postings(spark, "words", ["red", "car"]).select("term", "id", "n", "tf", "weights").collect()
    assert sorted(map(tuple, words)) == [("car", "a", 4, 1, [1.0]), ("car", "b", 3, 2, [1.0, 1.0]), ("red", "a", 2, 1, [1.0]), ("red", "a", 4, 1, [1.0])]
