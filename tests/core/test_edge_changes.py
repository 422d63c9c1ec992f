"""Edge differences by numbers of keys are those by keys, and each edge is shuffled on once for both snapshots."""

import random

from loomgraph.operators import diff

NODE = "id string, type string, name string, file_path string, namespace string"
EDGE = "source string, target string, type string, confidence double"


def test_changes_are_those_of_the_keys(spark):
    rng = random.Random(3)
    ids = [f"n{i}" for i in range(40)]

    def snapshot(renamed):
        nodes = [(i, "t", f"name{int(i[1:]) % 30}{renamed if int(i[1:]) % 9 == 0 else ''}", "A/b", None) for i in ids if rng.random() < 0.9]
        pool = [*ids, None, "gone"]
        return spark.createDataFrame(nodes, NODE), spark.createDataFrame([(rng.choice(pool), rng.choice(pool), rng.choice(["x", "y", None]), rng.choice([1.0, 2.0, None])) for _ in range(900)], EDGE)

    base, target = snapshot(""), snapshot("new")
    want = diff.edge_diff(diff.edge_keys(*base), diff.edge_keys(*target), changes=True)
    found, names = diff.edge_changes(base, target)
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(diff.named_changes(found, names)) == rows(want)
    assert {r["change"] for r in found.collect()} == {"added", "removed", "modified", "unchanged"}


def test_edges_go_on_as_numbers_and_once(spark):
    nodes = spark.createDataFrame([(f"n{i}", "t", f"a name {i}", "A/b", None) for i in range(9)], NODE)
    edges = spark.createDataFrame([(f"n{i}", f"n{j}", "x", 1.0) for i in range(9) for j in range(9)], EDGE)
    found, _ = diff.edge_changes((nodes, edges), (nodes, edges))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "key#" not in plan and sum("REPARTITION" in x for x in plan.splitlines()) == 1
    assert found.count() == 81 and found.filter("change = 'unchanged'").count() == 81
