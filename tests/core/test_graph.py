"""Operators on small hand-made graphs, against literal results and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import components, graphs, impact, traverse

EDGE = "id string, source string, target string, type string, confidence double"


def edges(spark, pairs, kind="depends_on"):
    return spark.createDataFrame([(f"{a}>{b}", a, b, kind, 80.0) for a, b in pairs], EDGE)


def nodes(spark, ids, repo="r"):
    return spark.createDataFrame([(i, "terraform_resource", repo) for i in ids], "id string, type string, repo_id string")


TREE = [("root", "a1"), ("root", "b1"), ("a1", "a2"), ("a1", "b2"), ("b1", "c2"), ("a2", "a3")]
NAMES = ["root", "a1", "b1", "a2", "b2", "c2", "a3"]


def closure(pairs):
    reach = {}
    for a in {x for p in pairs for x in p}:
        seen, todo = set(), [a]
        while todo:
            for s, t in pairs:
                if s == todo[0] and t not in seen:
                    seen.add(t)
                    todo.append(t)
            todo.pop(0)
        reach[a] = seen
    return reach


def test_blast_radius_of_a_tree(spark):
    found = impact.blast_radius(nodes(spark, NAMES), edges(spark, TREE), traverse.only(spark, "root"))
    assert {r["node"]: r["depth"] for r in found.collect()} == {"a1": 1, "b1": 1, "a2": 2, "b2": 2, "c2": 2, "a3": 3}
    row = impact.blast_summary(found).first()
    assert row["score"] == pytest.approx(45.9) and row["risk"] == "low" and (row["direct"], row["indirect"]) == (2, 4)


def test_traversal_stops_at_its_depth_and_keeps_cycles_out(spark):
    loop = edges(spark, [("sg1", "sg2"), ("sg2", "sg1"), ("sg2", "x")])
    assert {(r["node"], r["depth"]) for r in traverse.reachable(loop, "sg1").collect()} == {("sg2", 1), ("x", 2)}
    assert traverse.reachable(edges(spark, TREE), "root", 1).count() == 2
    assert {r["node"] for r in traverse.reachable(edges(spark, TREE), "a3", 10, "upstream").collect()} == {"a2", "a1", "root"}


def test_cycles_once_for_each_rotation_or_once(spark):
    loop = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "c"), ("c", "d")])
    assert sorted("".join(r["path"]) for r in traverse.cycles(loop).collect()) == ["abca", "bcab", "cabc", "ccc"]
    assert sorted("".join(r["path"]) for r in traverse.cycles(loop, canonical=True).collect()) == ["abca", "ccc"]


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_graphs(spark, seed):
    draw = random.Random(seed)
    pairs = list({(f"n{draw.randint(0, 24)}", f"n{draw.randint(0, 24)}") for _ in range(28)})
    reach = closure(pairs)
    want = {a: min(b for b in {*r, a} if a in reach[b]) for a, r in reach.items() if a in r}
    df = edges(spark, pairs)
    assert {r["node"]: r["scc"] for r in components.strongly_connected(df).collect()} == want
    both = closure([*pairs, *((b, a) for a, b in pairs)])
    assert {r["node"]: r["component"] for r in components.connected_components(df).collect()} == {a: min({*r, a}) for a, r in both.items()}


def test_paths(spark):
    df = edges(spark, [("a", "b"), ("b", "d"), ("a", "c"), ("c", "d"), ("a", "d"), ("d", "a")])
    assert [r["path"] for r in traverse.simple_paths(df, "a", "d").collect()] == [["a", "d"], ["a", "b", "d"], ["a", "c", "d"]]
    assert traverse.shortest_path(df, "b", "c").first()["path"] == ["b", "d", "a", "c"]
    assert traverse.shortest_path(df, "a", "a").first()["length"] == 0
    assert traverse.shortest_path(edges(spark, TREE), "a3", "root").count() == 0


def test_topological_levels(spark):
    got = {r["id"]: r["level"] for r in traverse.topological_levels(nodes(spark, [*NAMES, "alone"]), edges(spark, TREE)).collect()}
    assert got == {"root": 0, "a1": 1, "b1": 1, "a2": 2, "b2": 2, "c2": 2, "a3": 3, "alone": 0}
    loop = traverse.topological_levels(nodes(spark, "abc"), edges(spark, [("a", "b"), ("b", "a"), ("b", "c")]))
    assert {r["id"]: r["level"] for r in loop.collect()} == {"a": None, "b": None, "c": None}


def test_issues_and_merges(spark):
    df = edges(spark, [("a", "b"), ("b", "b"), ("x", "a"), ("a", "y")])
    got = {(r["code"], r["element"]) for r in graphs.issues(nodes(spark, "abc"), df).collect()}
    assert got == {("DANGLING_SOURCE", "x>a"), ("DANGLING_TARGET", "a>y"), ("SELF_LOOP", "b>b"), ("ORPHAN_NODE", "c"), ("CYCLE_DETECTED", "b")}
    two = nodes(spark, "ab", "one").withColumn("graph", F.lit(1)).union(nodes(spark, "bc", "two").withColumn("graph", F.lit(2)))
    assert {(r["id"], r["repo_id"]) for r in graphs.merged(two).collect()} == {("a", "one"), ("b", "one"), ("c", "two")}
    assert {(r["id"], r["repo_id"]) for r in graphs.merged(two, "last").collect()} == {("a", "one"), ("b", "two"), ("c", "two")}
    assert graphs.built(nodes(spark, "ab"), df.union(df)).count() == 2
