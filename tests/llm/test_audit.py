"""The audit against counting every order by brute force."""

import random
import re
from itertools import permutations

from loomgraph.llm import audit


def brute(docs, labels):
    """Rows of the audit from lists of (doc_id, text, source) and (doc_id, quality, toxic), document by document."""
    least = {}
    for d, t, _ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    out = {}
    for d, t, s in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {f for f, x in zip("ABCDE", (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)), d is not None and d > least[t]), strict=True) if x}
        good, toxic = (any(x[k] == 1 for x in labels if x[0] == d and d is not None) for k in (1, 2))
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for i, f in enumerate(order):
                row = out.setdefault((s or "", order, i + 1), [0] * 6)
                here = f in fails and not gone
                row[1] += here
                row[2] += f in fails and gone
                row[3] += fails == {f}
                row[4] += here and good
                row[5] += here and toxic
                gone = gone or f in fails
                row[0] += not gone
    total = {}
    for (part, order, step), row in out.items():
        total[part, order[step - 1]] = total.get((part, order[step - 1]), 0) + row[1]
    return {key: (*row, total[key[0], key[1][key[2] - 1]]) for key, row in out.items()}


def rows(df):
    return {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in df.collect()}


def test_every_order_of_random_documents(spark):
    draw = random.Random(7)
    word = lambda: draw.choice(["stone", "River", "PAPER", "a", "é", "x#", "50%"]) + str(draw.randrange(draw.choice([3, 400])))
    texts = [None, "", "one", " \n", "A" * 50, "word " * 70_000, *(" ".join(word() for _ in range(draw.choice([3, 199, 200, 260]))) for _ in range(40))]
    docs = [(draw.choice([None, *range(60)]), draw.choice(texts), draw.choice(["s0", "s0", "s1", "", None])) for _ in range(150)]
    docs += [(i, texts[10], "s0") for i in range(100, 150)] + [(7, texts[10], "s0")] * 3
    labels = [(draw.choice([None, *range(60)]), draw.choice([0, 1, None]), draw.choice([0, 1, None])) for _ in range(50)]
    names = [c for c in ("_part", "part", "mask", "_mask", "digest", "_digest", "n", "good", "quality", "copies")]
    frame = spark.createDataFrame([(*d, *["x"] * len(names)) for d in docs], f"doc_id long, text string, source string, {', '.join(f'`{n}` string' for n in names)}")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert rows(audit.audit(frame, known)) == brute(docs, labels)


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([(1, "x", "s")], "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert rows(audit.audit(docs, labels)) == brute([(1, "x", "s")], [])
    assert audit.audit(docs.filter("false"), labels).count() == 0


def test_matrices_sum_to_all_documents():
    m = audit.outcome_matrices()
    assert all(x.shape == (32, 600) for x in m.values())
    steps = m["removed"].reshape(32, 120, 5).sum(2) + m["kept"].reshape(32, 120, 5)[:, :, 4]
    assert (steps == 1).all()
