"""What tasks keep to tell values apart doesn't grow with the input: their number does."""

from pyspark.sql import functions as F

from loomgraph.operators import stats
from loomgraph.sources import property_graph as pg
from loomgraph.sources.tables import dealt

EDGE = "source string, target string, confidence double"


def test_parts_follow_the_files(spark, tmp_path):
    spark.range(0, 1 << 20, 1, 1).select(F.xxhash64("id").alias("k")).write.parquet(f"{tmp_path}/k")  # 8 MB
    df = spark.read.parquet(f"{tmp_path}/k")
    assert 8 <= dealt(df, "k", mb=1).rdd.getNumPartitions() <= 10
    assert dealt(df.limit(10), "k").rdd.getNumPartitions() == dealt(spark.range(3), "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_ends_are_counted_in_dealt_parts(spark):
    edges = spark.createDataFrame([("a", "b", 95.0), ("a", "c", 80.0), ("b", "c", 10.0), (None, "c", None), ("d", None, 70.0)], EDGE)
    found = stats.edge_stats(edges)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "REPARTITION_BY_NUM" in plan
    assert [tuple(r) for r in found.collect()] == [(5, 3, 2, 63.75, 1, 2, 1)]
    assert [tuple(r) for r in stats.edge_stats(edges.limit(0)).collect()] == [(0, 0, 0, None, 0, 0, 0)]
    as_before = edges.agg(F.count("*"), F.count_distinct("source"), F.count_distinct("target"), F.round(F.avg("confidence"), 2), *stats.banded(edges, 90, 70))
    assert found.collect() == as_before.collect()


def test_pairs_of_order_lines_are_told_apart_in_dealt_parts(spark):
    plan = pg.edges(spark, "/root/testdata/sf0.001").filter("type = 'module_call'")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan
