import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm.vptree import Nearest, Params, Tree, nearest_neighbours


def brute(ids, points, queries, k):
    out = {}
    for i in queries:
        far = np.sqrt(((points - points[i]) ** 2).sum(1))
        order = np.lexsort((ids, far))
        out[int(ids[i])] = [(int(ids[j]), float(far[j])) for j in order if ids[j] != ids[i]][:k]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")


def test_exact_search_gives_what_brute_force_gives(spark):
    draw = np.random.default_rng(1)
    points = np.concatenate([draw.normal(size=(300, 8)), np.repeat(draw.normal(size=(1, 8)), 60, 0)])  # with a group of equal vectors
    ids = np.arange(len(points))
    df = frame(spark, [(int(i), p.tolist(), "x") for i, p in zip(ids, points)]).repartition(3)
    got = nearest_neighbours(df, F.col("vec_id") % 20 == 0, Params(shard_rows=64, block_rows=4, leaf_rows=8, per_cell=1)).collect()
    want = brute(ids, points, range(0, len(ids), 20), 10)
    found = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert found.keys() == want.keys()
    for q in want:
        assert [v for v, _ in found[q]] == [v for v, _ in want[q]]
        assert np.allclose([s for _, s in found[q]], [s for _, s in want[q]])


def test_a_larger_factor_prunes_more_and_keeps_recall():
    draw = np.random.default_rng(2)
    points = draw.normal(size=(2000, 6))
    ids = np.arange(2000)
    tree = Tree.build(ids, points, 32, 1)
    exact, loose = (Nearest(ids[::50], points[::50], 10, f) for f in (1.0, 1.2))
    exact.search(tree)
    loose.search(tree)
    hits = sum(len(set(a) & set(b)) for a, b in zip(exact.near.tolist(), loose.near.tolist()))
    assert hits / exact.near.size >= 0.9


def test_unusable_vectors_take_no_part_and_few_candidates_are_all_given(spark):
    rows = [(0, [1.0, 0.0], "a"), (1, [0.0, 1.0], "a"), (2, None, "a"), (3, [0.0, 0.0], "a"), (4, [float("nan"), 1.0], "a"), (5, [float("inf"), 1.0], "a"), (6, [], "a"), (100, [1.0, 1.0], "a"), (100, [1.0, 1.0], "b"), (None, [1.0, 2.0], "a"), (7, [1.0, 2.0, 3.0], "a")]
    got = nearest_neighbours(frame(spark, rows), F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(0, 1, 100), (0, 2, 1), (100, 1, 0), (100, 2, 1)]
    assert got[0]["score"] == pytest.approx(1.0)


def test_empty_table(spark):
    assert nearest_neighbours(frame(spark, []), F.col("vec_id") % 100 == 0).count() == 0
