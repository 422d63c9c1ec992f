"""Articulation points and blocks, searches for many roots, and stored graphs, against plain versions on random graphs."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import cuts, impact, traverse
from loomgraph.sources import tables

EDGE = "id string, source string, target string, type string, confidence double"


def frame(spark, pairs):
    return spark.createDataFrame([(f"{a}>{b}/{i}", a, b, "depends_on", 50.0) for i, (a, b) in enumerate(pairs)], EDGE)


def parts(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        if a in root and b in root:
            root[find(a)] = find(b)
    return len({find(n) for n in nodes})


def test_articulation_points_of_random_graphs(spark):
    draw = random.Random(6)
    pairs, want = [("star", f"ray{i:03}") for i in range(300)] + [(f"path{i:03}", f"path{i + 1:03}") for i in range(60)] + [("self", "self"), ("x1", "x2"), ("x2", "x1")], {"star", *(f"path{i:03}" for i in range(1, 60))}
    for g in range(60):
        n = draw.randint(2, 12)
        ids = [f"g{g:02}n{i:02}" for i in range(n)]
        own = [(draw.choice(ids), draw.choice(ids)) for _ in range(draw.randint(1, 2 * n))]
        pairs += own
        seen = {x for a, b in own for x in (a, b)}
        links = [(a, b) for a, b in own if a != b]
        whole = parts(seen, links)
        want |= {v for v in seen if parts(seen - {v}, [e for e in links if v not in e]) > whole - (0 if any(v in e for e in links) else 1)}
    got = [r["node"] for r in cuts.articulation_points(frame(spark, pairs)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert cuts.articulation_points(frame(spark, pairs).filter("false")).count() == 0


def plain_search(pairs, root, most):
    depth, frontier = {root: 0}, [root]
    for d in range(1, most + 1):
        frontier = sorted({b for a, b in pairs if a in frontier and b not in depth})
        depth |= dict.fromkeys(frontier, d)
    return depth


@pytest.mark.parametrize("stored", [False, True])
def test_impact_of_many_roots(spark, stored):
    draw = random.Random(9)
    ids = [f"n{i:03}" for i in range(200)]
    pairs = [(draw.choice(ids), draw.choice(ids[:150])) for _ in range(240)]
    roots = draw.sample(ids, 70)  # more than one word of bits
    nodes = spark.createDataFrame([(i, f"t{int(i[1:]) % 3}", "r") for i in ids if i != "n007"], "id string, type string, repo_id string")
    graph = traverse.Registered(nodes, frame(spark, pairs)) if stored else frame(spark, pairs)
    found, types, depths, row = impact.impact_of_many(nodes, graph, spark.createDataFrame([(r, i) for i, r in enumerate([*roots, "absent"])], "node string, at int"), 4)
    direct, through, by_type, by_depth = set(), set(), {}, {}
    for r in roots:
        if r == "n007":
            continue
        for node, d in plain_search(pairs, r, 4).items():
            if d and node != "n007":
                if d == 1:
                    direct.add(node)
                elif node not in direct:
                    through.add(node)
                by_type[f"t{int(node[1:]) % 3}"] = by_type.get(f"t{int(node[1:]) % 3}", 0) + 1
                by_depth[d] = by_depth.get(d, 0) + 1
    assert {(r["node"], r["kind"]) for r in found.collect()} == {(n, "direct") for n in direct} | {(n, "transitive") for n in through}
    assert {r["type"]: r["n"] for r in types.collect()} == by_type and {r["depth"]: r["n"] for r in depths.collect()} == by_depth
    assert tuple(row.first()) == (len(direct), len(through), len(direct) + len(through), "critical")
    if stored:
        graph.drop()


def test_a_stored_graph_is_searched_without_shuffling_its_moves(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("a", "d"), ("x", "a")]
    nodes = spark.createDataFrame([(i, "t", "r") for i in "abcdx"], "id string, type string, repo_id string")
    graph = traverse.Registered(nodes, frame(spark, pairs), 4)
    search = lambda g, **more: {(r["node"], r["depth"]) for r in traverse.bfs(g, traverse.only(spark, "a"), 5, **more).select("node", "depth").collect()}
    assert search(graph) == search(frame(spark, pairs)) == {("a", 0), ("b", 1), ("d", 1), ("c", 2)}
    assert search(graph, direction="upstream") == {("a", 0), ("x", 1)} and search(graph, direction="both") == search(frame(spark, pairs), direction="both")
    assert len(impact.blast_radius(nodes, graph, traverse.only(spark, "a")).collect()) == 3
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = nodes.select(nodes["id"].alias("here")).join(graph.moves(), "here")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "SelectedBucketsCount: 4 out of 4" in plan  # only the small side moves
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    graph.drop()
    assert not [t for t in spark.catalog.listTables() if t.name in graph.names]


def test_rows_are_numbered_over_ranges(spark):
    df = spark.range(1000).selectExpr("id * 7919 % 1000 as x").repartition(7)
    got = tables.numbered(df, [F.col("x")], "n").collect()
    assert len(got) == 1000 and all(r["x"] == r["n"] for r in got)


def test_a_cluster_without_a_shared_folder_is_refused(monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.fresh_path(Session(), "x")
