"""Joins whose sides grow with the input are shuffled, not sent through the driver."""

from pyspark.sql import functions as F

from loomgraph.operators import likeness, rollup, workflows

STEP = "workflow string, job string, ordinal int, position int, step string, text string, uses string, artifact string, path string, env map<string,string>"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_frames_of_workflows_are_not_broadcast(spark):
    steps = spark.createDataFrame([("w", "j", 1, 1, None, "terraform output x", None, None, None, None), ("w", "j", 1, 2, None, "helm upgrade a b", None, None, None, None)], STEP)
    every = workflows.frames(steps, spark.createDataFrame([("w", "j", ["i"])], "workflow string, job string, needs array<string>"))
    for df in every:
        for other in every:
            assert "BroadcastHashJoin" not in plan(df.select("workflow", "job").join(other.select("workflow", "job").distinct(), ["workflow", "job"]))


def test_keys_of_names_are_not_broadcast(spark):
    names = spark.range(1000, 1002).select(F.col("id").cast("string").alias("name"))
    assert "BroadcastHashJoin" not in plan(likeness.holding(names, names))
    assert "BroadcastHashJoin" not in plan(likeness.alike(names, names, 70))


def test_blocks_of_nodes_are_not_broadcast(spark):
    text = F.col("id").cast("string")
    nodes = spark.range(2).select(text.alias("repo_id"), text.alias("id"), text.alias("type"), text.alias("name"), text.alias("namespace"), F.lit("{}").alias("metadata"))
    assert "BroadcastHashJoin" not in plan(rollup.matches(nodes, rollup.name_matcher()))
