import random
from collections import defaultdict

import numpy as np
import pytest

from loomgraph.llm.mixing import Params, apportioned, mix, plan, source_quotas

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, times string, key string"


def naive(votes, seats):
    got = [0] * len(votes)
    for _ in range(seats):
        best = max(range(len(votes)), key=lambda i: (votes[i] / (2 * got[i] + 1), -i))
        got[best] += 1
    return got


def targets(sizes, weights, total, most):
    """Shares by weight, stopped at most * size, what is over shared anew until none is above."""
    out, free, left = np.zeros(len(sizes)), np.ones(len(sizes), bool), float(total)
    while free.any():
        level = left / weights[free].sum()
        above = free & (weights * level > most * sizes)
        if not above.any():
            out[free] = weights[free] * level
            break
        out[above] = most * sizes[above]
        left -= out[above].sum()
        free &= ~above
    return out


@pytest.mark.parametrize("seed", range(6))
def test_seats_by_highest_quotients(spark, seed):
    draw = random.Random(seed)
    votes = [draw.choice([0, 1, 7.5, draw.uniform(1, 1000)]) for _ in range(draw.randint(1, 12))]
    if not sum(votes):
        votes[0] = 1
    seats = draw.randint(0, 300)
    got = apportioned(spark.createDataFrame([(i, float(v)) for i, v in enumerate(votes)], "key long, votes double"), seats)
    assert [r["seats"] for r in got.orderBy("key").collect()] == naive(votes, seats)


def quotas(spark, sizes):
    totals = spark.createDataFrame([(s, n, 4) for s, n in sizes], "source string, source_size long, rows long")
    return {r["source"]: r for r in source_quotas(totals, Params()).collect()}


def test_targets_stop_at_the_most_and_share_the_excess(spark):
    got = quotas(spark, [("b", 1000), ("a", 10), (None, 1000)])
    assert [got[s]["target"] for s in ("a", "b", None)] == pytest.approx([20, 2995 * 2 / 3, 2995 / 3]) and got["a"]["full"] and not got["a"]["blocks"]
    assert got["b"]["blocks"] + got[None]["blocks"] == round(2995 / 32) and got["b"]["shards"] == 2
    got = quotas(spark, [("a", 0), ("b", 5)])
    assert (got["a"]["target"], got["b"]["target"]) == (0, 7.5) and not quotas(spark, [])


def test_many_sources(spark):
    draw = random.Random(8)
    sizes = [(chr(0x40 + i) + "𝒳" * (i % 2), draw.choice([0, 1, 7, draw.randint(1, 5000)])) for i in range(400)]
    got, order = quotas(spark, sizes), sorted(sizes)
    want = targets(np.array([n for _, n in order]), np.resize([5.0, 2.0, 1.0], len(order)), 1.5 * sum(n for _, n in order), 2)
    assert [got[s]["target"] for s, _ in order] == pytest.approx(want.tolist())
    free = [i for i, (s, _) in enumerate(order) if not got[s]["full"]]
    votes = [got[order[i][0]]["target"] for i in free]
    assert [got[order[i][0]]["blocks"] for i in free] == naive(votes, round(sum(votes) / 32))


def documents(spark, n=300, seed=4):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        source = None if i % 29 == 0 else f"s{min(draw.randint(0, 9), draw.randint(0, 9))}"
        text = None if i % 31 == 0 else " ".join(f"w{draw.randint(0, 99)}" for _ in range(draw.randint(0, 400)))
        rows.append((i, text, "en", source, len(text or ""), "t", "k"))
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_sources_come_to_their_targets_and_reruns_agree(spark):
    rows, df = documents(spark)
    got = plan(df).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(rows)))
    size = {r[0]: len((r[1] or "").split()) for r in rows}
    taken, target, whole = defaultdict(int), {}, defaultdict(int)
    source = {r[0]: r[3] for r in rows}
    for r in got:
        assert r["size"] == size[r["doc_id"]] and 0 <= r["taken"] <= 2 * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
        whole[source[r["doc_id"]]] += r["size"]
        target[source[r["doc_id"]]] = r["target"]
    order = [*sorted(s for s in target if s is not None), None]
    want = targets(np.array([whole[s] for s in order]), np.resize([5.0, 2.0, 1.0], len(order)), 1.5 * sum(whole.values()), 2)
    for s, t in zip(order, want):
        assert target[s] == pytest.approx(t) and abs(taken[s] - t) <= 0.5
    again = {r["doc_id"]: r["taken"] for r in plan(df.repartition(2)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}


def test_mixed_texts_have_the_words_that_the_plan_takes(spark):
    rows, df = documents(spark, 80)
    planned = {r["doc_id"]: r["taken"] for r in plan(df).collect()}
    words = defaultdict(int)
    for r in mix(df).collect():
        words[r["doc_id"]] += len(r["text"].split())
        assert r["n_chars"] == len(r["text"]) and r["times"] == "t" and r["key"] == "k"
    assert {d: n for d, n in planned.items() if n} == dict(words)


def test_repeated_rows_few_words_and_empty_tables(spark):
    rows = [(1, "a b c", "en", "x", 5, "", ""), (1, "a b c", "en", "x", 5, "", ""), (None, "d", "en", None, 1, "", ""), (3, "", None, "y", None, "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted((r["doc_id"] or 0, r["size"]) for r in plan(df).collect()) == [(0, 1), (1, 3), (1, 3), (3, 0)]
    assert sorted(len(r["text"].split()) for r in mix(df).filter("source is null").collect()) == [1, 1]
    assert sum(len(r["text"].split()) for r in mix(df).filter("source = 'x'").collect()) == 9
    none = spark.createDataFrame([], SCHEMA)
    assert plan(none).count() == 0 and mix(none).count() == 0
