import hashlib
import random

import numpy as np

from loomgraph.llm.fuzzy import Fingerprints, common, edited_and_next, fingerprint, likeness


def prose(draw, n):
    return " ".join("".join(draw.choice("etaoinshr") for _ in range(draw.randint(2, 9))) for _ in range(n))


def test_common_subsequences_are_those_of_brute_force():
    draw = np.random.default_rng(1)
    a, b = draw.integers(0, 5, (30, 64), np.uint8), draw.integers(0, 5, (30, 64), np.uint8)
    for rows in (a, b):
        for i, n in enumerate(draw.integers(0, 65, 30)):
            rows[i, n:] = 64
    for x, y, got in zip(a, b, common(a, b)):
        x, y = x[x < 64], y[y < 64]
        table = np.zeros((len(x) + 1, len(y) + 1), int)
        for i in range(len(x)):
            for j in range(len(y)):
                table[i + 1, j + 1] = table[i, j] + 1 if x[i] == y[j] else max(table[i, j + 1], table[i + 1, j])
        assert got == table[-1, -1]


def test_fingerprints_depend_on_the_text_alone_and_edits_stay_local():
    draw = random.Random(2)
    texts = [prose(draw, n).encode() for n in (0, 1, 3, 50, 500, 5000)] + [b"a" * 9999, "été ".encode() * 90, b"x", b""]
    together = Fingerprints(texts).text()
    assert together == [Fingerprints([t]).text()[0] for t in texts] and together[0] == "1::"
    a = prose(draw, 800)
    b = a[:2000] + "changed here" + a[2000:]
    prints = Fingerprints([a.encode(), b.encode(), prose(draw, 800).encode()])
    pair = lambda i, j: likeness(prints.take(np.array([i])), prints.take(np.array([j])))[0]
    assert pair(0, 0) == 1 and 0.8 < pair(0, 1) < 1 and pair(0, 2) == 0


def test_edited_texts_and_next_documents(spark):
    draw = random.Random(5)
    rows = [(i * 3, prose(draw, draw.randint(0, 200)), "x") for i in range(120)] + [(1, None, "x"), (2, "", "x"), (4, "éé\U0001f642" * 7, "x"), (None, "last", "x"), (7, prose(draw, 9000), "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").repartition(4)
    got = {r["doc_id"]: r for r in edited_and_next(df).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    texts = [t or "" for _, t, _ in order]
    assert len(got) == len(rows)
    for i, (doc, _, _) in enumerate(order):
        t, n = texts[i], texts[(i + 1) % len(texts)]
        k = len(t) // 3
        r = got[doc]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256((t[: len(t) - k] + n[:k]).encode()).hexdigest()
        assert r["fingerprint"] == Fingerprints([t.encode()]).text()[0] and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if len(t) > 400:
            assert r["near_edited"] > 0.4 > r["near_next"]


def test_one_row_equal_texts_and_an_empty_table(spark):
    one = spark.createDataFrame([(5, "alone in here")], "doc_id long, text string")
    assert edited_and_next(one).collect()[0]["near_next"] == 1
    two = spark.createDataFrame([(5, "same text"), (5, "same text")], "doc_id long, text string")
    assert [r["near_next"] for r in edited_and_next(two).collect()] == [1, 1]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert edited_and_next(none).count() == 0 and fingerprint(none).count() == 0
    assert fingerprint(one).first()["fingerprint"] == Fingerprints([b"alone in here"]).text()[0]
