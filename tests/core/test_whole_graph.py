"""Queries over all nodes and edges, against brute force on small graphs."""

import random

from loomgraph.operators import components
from loomgraph.plans import registry

EDGE = "id string, source string, target string, type string, confidence double"


def whole(spark, name, monkeypatch, ids, pairs):
    """The rows of a registered query over a graph with edges (source, target, type)."""
    monkeypatch.setattr(registry.pg, "nodes", lambda *_: spark.createDataFrame([(i, "t", "r") for i in ids], "id string, type string, repo_id string"))
    monkeypatch.setattr(registry.pg, "edges", lambda *_: spark.createDataFrame([(f"{a}>{b}", a, b, kind, 50.0) for a, b, kind in pairs], EDGE))
    return registry.QUERIES[name](spark, "").collect()


def test_components_of_all_nodes_and_edges(spark, monkeypatch):
    draw = random.Random(4)
    ids = [f"n{i}" for i in range(30)]
    pairs = [(draw.choice(ids[:24]), draw.choice(ids[:24]), draw.choice(["FEEDS_INTO", "references", "depends_on"])) for _ in range(16)]
    root = {i: i for i in ids}
    for a, b, _ in pairs:
        low, high = sorted((root[a], root[b]))
        root = {i: low if r == high else r for i, r in root.items()}
    assert {r["node"]: r["component"] for r in whole(spark, "components_of_all", monkeypatch, ids, pairs)} == root
    assert root["n29"] == "n29" and components.connected_components(spark.createDataFrame([], EDGE), nodes=spark.createDataFrame([("x",)], "id string")).collect() == [("x", "x")]


#: orders > part > supplier > nation > region > customer > nation > region:1 <> customer, as in the tables, and a node behind the cycle.
CHAIN = [("o", "p", "module_call"), ("p", "s", "FEEDS_INTO"), ("s", "n", "depends_on"), ("n", "r", "references"), ("r", "c", "selector_match"), ("r1", "c1", "selector_match"), ("c1", "r1", "creates"), ("c", "r1", "depends_on"), ("c1", "behind", "OPERATES_ON")]
IDS = ["o", "p", "s", "n", "r", "c", "r1", "c1", "behind", "alone"]


def test_levels_and_depth_over_all_edges(spark, monkeypatch):
    levels = {r["id"]: r["level"] for r in whole(spark, "topological_levels_of_all", monkeypatch, IDS, CHAIN)}
    assert levels == {"o": 0, "p": 1, "s": 2, "n": 3, "r": 4, "c": 5, "r1": None, "c1": None, "behind": None, "alone": 0}
    assert whole(spark, "longest_depth_of_all", monkeypatch, IDS, CHAIN) == [(6,)]


def test_cycles_over_all_edge_types_and_lengths(spark, monkeypatch):
    ring = [(f"q{i}", f"q{(i + 1) % 7}", "creates") for i in range(7)]
    assert {r["node"]: r["scc"] for r in whole(spark, "strong_components", monkeypatch, IDS, CHAIN + ring)} == {"r1": "c1", "c1": "c1"} | {f"q{i}": "q0" for i in range(7)}
    assert {(r["source"], r["target"]) for r in whole(spark, "cycle_edges", monkeypatch, IDS, CHAIN + ring)} == {("r1", "c1"), ("c1", "r1")} | {(a, b) for a, b, _ in ring}
    assert sorted(r["length"] for r in whole(spark, "cycles", monkeypatch, IDS, CHAIN + ring)) == [2] * 2 + [7] * 7
