"""Levels over moves in buckets: no level shuffles the moves, and none of them is left behind."""

from loomgraph.operators import components, traverse


def test_levels_put_moves_in_buckets_once(spark, monkeypatch):
    plans, kept = [], components.Levels.add

    def add(self, df, depth):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(self, df, depth)

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(components.Levels, "add", add)
    try:
        pairs = [(f"a{i}", f"b{i % 7}") for i in range(50)] + [(f"b{i}", "c") for i in range(7)] + [("x", "y"), ("y", "x"), ("y", "z"), ("c", "gone"), ("c", "d"), ("c", "d")]
        ids = sorted({n for p in pairs for n in p if n != "gone"} | {"alone"})
        nodes, edges = spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(pairs, "source string, target string")
        levels = {r["id"]: r["level"] for r in traverse.topological_levels(nodes, edges).collect()}
        assert traverse.longest_depth(nodes, edges).collect() == [(4,)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert levels == {i: {"a": 0, "b": 1, "c": 2, "d": 3}.get(i[0]) for i in ids if i != "alone"} | {"alone": 0}
    assert sum("SelectedBucketsCount" in p for p in plans) >= 4  # the moves come from buckets
    assert not [t for t in spark.catalog.listTables() if "loomgraph_moves" in t.name]


def test_longest_depth_without_levels(spark):
    nodes, loop = spark.createDataFrame([("x",), ("y",)], "id string"), spark.createDataFrame([("x", "y"), ("y", "x")], "source string, target string")
    assert traverse.longest_depth(nodes, loop).collect() == [(0,)]
    assert traverse.longest_depth(nodes, loop.filter("false")).collect() == [(1,)]
    assert traverse.longest_depth(nodes.filter("false"), loop).collect() == [(0,)]
