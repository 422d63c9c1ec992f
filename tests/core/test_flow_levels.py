"""Flows grow level by level: no level shuffles the moves, and none is grown from nodes that lead nowhere."""

from loomgraph.operators import flows
from loomgraph.sources.tables import Levels


def test_levels_read_the_moves_as_they_lie(spark, monkeypatch):
    plans, kept = [], Levels.add

    def add(self, df, depth):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(self, df, depth)

    monkeypatch.setattr(Levels, "add", add)
    nodes = spark.createDataFrame([("o", "terraform_output"), ("r", "helm_release"), ("d", "k8s_deployment"), ("e", "k8s_pod"), ("q", "terraform_output")], "id string, type string")
    pairs = [("o", "r", 90.0), ("o", "r", 80.0), ("r", "d", 70.0), ("o", "e", 60.0), ("r", "e", 50.0), ("r", "o", 40.0)]
    edges = spark.createDataFrame([(f"{a}{b}{c}", a, b, "FEEDS_INTO", c) for a, b, c in pairs], "id string, source string, target string, type string, confidence double")
    tables = spark.catalog.listTables()
    found = flows.end_to_end_flows(nodes, edges)
    assert sorted((r["source"], r["target"], r["path"], r["confidence"]) for r in found.collect()) == [("o", "d", ["o", "r", "d"], 75.0), ("o", "e", ["o", "e"], 60.0), ("o", "r", ["o", "r"], 80.0)]
    assert len(plans) == 3  # d and e lead nowhere, and o was there, so that no third level is tried
    assert all(p.count("Exchange hashpartitioning(node") == 1 and "hashpartitioning(here" not in p for p in plans[1:])
    assert spark.catalog.listTables() == tables
