import random
from itertools import combinations

import pytest

from loomgraph.llm.minhash import Params, keep_one, near_duplicates

SCHEMA = "doc_id long, text string, sig string, component_id int"


def shingles(text, k):
    words = [w.lower() for w in (text or "").split()]
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def brute(rows, k, percent):
    sets, parent = {d: shingles(t, k) for d, t in rows}, {d: d for d, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in sets}


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "s", 1) for d, t in rows], SCHEMA).repartition(4)


def corpus(seed):
    """Copies, near copies of growing distance from each other, and documents that share passages, in groups of all sizes."""
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    fresh = lambda n: [draw.choice(words) for _ in range(n)]
    rows, d = [], 0
    for size in (1, 2, 3, 60):
        base = fresh(120)
        for _ in range(size):
            text = list(base)
            for _ in range(draw.randint(0, 5)):
                text[draw.randrange(len(text))] = f"n{draw.random()}"
            rows.append((d, " ".join(text)))
            d += 1
    passage = fresh(60)
    for _ in range(40):
        rows.append((d, " ".join(passage + fresh(draw.randint(5, 60)))))
        d += 1
    for t in (None, "", " \t", "one", "ONE", "two words", "a b c d e", "A b C d e f"):
        rows.append((d, t))
        d += 1
    rows.append((d, rows[3][1].upper()))
    return rows


@pytest.mark.parametrize("part", [2, 256])
@pytest.mark.parametrize("small", [32, 2])
def test_components_are_those_of_brute_force(spark, small, part):
    rows = corpus(small)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(frame(spark, rows), Params(shingle=4, small=small, part=part)).collect()}
    want = brute(rows, 4, 80)
    assert got == {d: (n, c, c == d) for d, (n, c) in want.items()}


def test_one_of_each_group_stays_with_its_columns(spark):
    text = " ".join(f"t{i}" for i in range(50))
    rows = [(3, text), (1, text), (1, text), (2, "something else"), (None, text), (7, None)]
    got = keep_one(frame(spark, rows)).collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in got) == [-1, 1, 1, 2, 7]
    assert {(r["sig"], r["component_id"]) for r in got} == {("s", 1)}


def test_empty_table(spark):
    assert near_duplicates(frame(spark, [])).count() == 0
