import random

import numpy as np
from pyspark.sql import functions as F

from loomgraph.llm import quality, toxicity
from loomgraph.llm.labelled import fold_of

DOCS, LABELS = "doc_id long, text string, quality_score string, toxicity int, label string", "doc_id long, quality int, toxic int, text string"


def auc(pairs):
    good, bad = [s for y, s in pairs if y], [s for y, s in pairs if not y]
    return np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])


def made(spark, rows):
    docs = spark.createDataFrame([(d, t, "q", 1, "l") for d, t, _ in rows], DOCS)
    labels = spark.createDataFrame([(d, y, y, "x") for d, _, y in rows if y is not None], LABELS)
    return docs, labels


def corpus(kind):
    draw = random.Random(kind)
    rows = []
    for i in range(300):
        words = [draw.choice(["river", "stone", "paper", "window", "garden", "letter"]) for _ in range(draw.randint(10, 60))]
        y = int(i % 4 == 0)
        if kind == "toxic" and y:
            for _ in range(3):
                words[draw.randrange(len(words))] = draw.choice(["brutard", "skrumbag", "brut4rd", "skrumb@g"])
        if kind == "quality" and not y:
            words = [w.upper() + "!!" if draw.random() < 0.5 else w for w in words]
        rows.append((i, " ".join(words), y))
    return [*rows, (1000, None, None), (1001, "", None), (1002, "ab " * 50_000, None), (None, "text", None)]


def test_quality_separates_held_out_documents(spark):
    docs, labels = made(spark, corpus("quality"))
    got = quality.fit_and_score(docs, labels, fold_of("doc_id", 3) != 1).withColumn("held", fold_of("doc_id", 3) == 1).collect()
    truth = {d: y for d, _, y in corpus("quality")}
    assert len(got) == 304 and all(0 <= r["quality_score"] <= 1 and r["label"] == "l" for r in got)
    assert auc([(truth[r["doc_id"]], r["quality_score"]) for r in got if r["held"] and truth[r["doc_id"]] is not None]) > 0.95


def test_toxicity_separates_held_out_documents_through_substitutions(spark):
    docs, labels = made(spark, corpus("toxic"))
    got = toxicity.fit_and_score(docs, labels, fold_of("doc_id", 5) != 0).withColumn("held", fold_of("doc_id", 5) == 0).collect()
    truth = {d: y for d, _, y in corpus("toxic")}
    assert len(got) == 304 and all(0 <= r["toxicity"] <= 1 for r in got)
    assert auc([(truth[r["doc_id"]], r["toxicity"]) for r in got if r["held"] and truth[r["doc_id"]] is not None]) > 0.95


def test_without_labels_or_documents(spark):
    docs, labels = made(spark, corpus("toxic")[:5])
    none = labels.filter("false")
    assert {r["quality_score"] for r in quality.fit_and_score(docs, none, F.lit(True)).collect()} == {0.5}
    assert all(r["toxicity"] < 0.5 for r in toxicity.fit_and_score(docs, none, F.lit(True)).collect())
    assert quality.fit_and_score(docs.filter("false"), labels, F.lit(True)).count() == 0
    assert toxicity.fit_and_score(docs.filter("false"), labels, F.lit(True)).count() == 0


def test_folding_and_exceptions():
    lexicon = toxicity.Lexicon({" skrum": 2.0}, (" skrum pot",))
    machine = toxicity._automaton(lexicon)
    assert toxicity.fold("SKRUM5") == " skrums" and len(toxicity.hits(toxicity.fold("a ѕkrum here"), machine)) == 1
    assert toxicity.hits(toxicity.fold("a skrum pot"), machine) == []


def test_short_and_long_words_and_many_terms_are_learned(spark):
    draw = random.Random(12)
    rows = []
    for i in range(600):
        words = [draw.choice(["river", "stone", "paper", "is", "to", "abcdefghijkl"]) for _ in range(20)]
        if i % 3 == 0:
            words[3:3] = [draw.choice(["zq", "k9x", "abcdefghijbad", "ve1l"])]
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    docs, labels = made(spark, rows)
    lexicon = toxicity.learn(docs.join(labels.select("doc_id", F.col("toxic").alias("y")), "doc_id").select("text", F.col("y").alias("label")))
    assert {" zq ", " kgx ", " abcdefghijbad "} <= set(lexicon.terms)
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score(docs, lexicon).collect()}
    assert all((got[d] >= 0.5) == bool(y) for d, _, y in rows)
    assert toxicity.hits(toxicity.fold("an zq"), toxicity._automaton(lexicon))[0][:2] == (3, 6) and not toxicity.hits(toxicity.fold("an zqx"), toxicity._automaton(lexicon))
    many = toxicity.Lexicon({f" w{i:05}": 1.0 for i in range(12_000)})
    assert len(toxicity.hits(" w11999 w00000", toxicity._automaton(many))) == 2
