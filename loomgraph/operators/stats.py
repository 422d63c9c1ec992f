"""Counts, distributions and summaries of nodes, edges, evidence, matches and flows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.graph import TOOLS, tool_of
from ..sources.tables import checkpointed, dealt, numbered


def counts_by(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def confidence_distribution(edges: DataFrame) -> DataFrame:
    """One row: edges of each confidence level."""
    c = F.col("confidence")
    bands = {"certain": c >= 95, "high": (c >= 80) & (c < 95), "medium": (c >= 60) & (c < 80), "low": (c >= 40) & (c < 60), "uncertain": c < 40}
    return edges.agg(*[F.count_if(b).alias(n) for n, b in bands.items()])


def banded(df: DataFrame, high: float = 80, medium: float = 50) -> list[Column]:
    c = F.col("confidence")
    return [F.count_if(c >= high).alias("high"), F.count_if((c >= medium) & (c < high)).alias("medium"), F.count_if(c < medium).alias("low")]


def confidence_by(df: DataFrame, key: str) -> DataFrame:
    """(key, n, average to two places, least, most)."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 2).alias("average"), F.min("confidence").alias("least"), F.max("confidence").alias("most"))


def edge_stats(edges: DataFrame, high: float = 90, medium: float = 70) -> DataFrame:
    """One row: edges, distinct ends, average confidence and bands.

    Counted by end in parts that follow the input's size, so that no task keeps
    more ends the more edges there are; the sums are those of the sources.
    """
    end = lambda side, rated: F.struct(F.lit(side).alias("side"), F.col(side).alias("node"), rated.cast("double").alias("confidence"))
    ends = edges.select(F.explode(F.array(end("source", F.col("confidence")), end("target", F.lit(None)))).alias("end")).select("end.*")
    ends = dealt(ends, "side", "node")
    by = ends.groupBy("side", "node").agg(F.count("*").alias("n"), F.count("confidence").alias("rated"), F.sum("confidence").alias("total"), *banded(ends, high, medium))
    of = lambda side, column: F.when(F.col("side") == side, F.col(column))
    whole = lambda column: F.coalesce(F.sum(column), F.lit(0))
    average = F.round(F.sum("total") / F.nullif(F.sum("rated"), F.lit(0)), 2)
    return by.agg(F.coalesce(F.sum(of("source", "n")), F.lit(0)).alias("edges"), F.count(of("source", "node")).alias("sources"), F.count(of("target", "node")).alias("targets"), average.alias("average"), *[whole(c).alias(c) for c in ("high", "medium", "low")])


def fan(edges: DataFrame, side: str, threshold: int = 5) -> DataFrame:
    """(node, n): nodes with at least `threshold` edges on that side."""
    return edges.groupBy(F.col(side).alias("node")).agg(F.count("*").alias("n")).filter(F.col("n") >= threshold)


def degrees(edges: DataFrame) -> DataFrame:
    """(node, n_out, n_in) of nodes on edges."""
    ends = edges.select(F.col("source").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("target", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, edges per node, largest degrees, orphans and density."""
    by = nodes.select("id").join(degrees(edges).withColumnRenamed("node", "id"), "id", "left")
    out, into = F.coalesce("n_out", F.lit(0)), F.coalesce("n_in", F.lit(0))
    row = by.agg(F.count("*").alias("nodes"), F.sum(out).alias("edges"), F.max(out).alias("max_out"), F.max(into).alias("max_in"), F.count_if((out == 0) & (into == 0)).alias("orphans"), F.avg(F.when(out > 0, out)).alias("avg_degree"))
    n = F.col("nodes").cast("double")
    return row.select("nodes", "edges", F.round(F.col("edges") / n, 6).alias("edges_per_node"), "max_out", "max_in", "orphans", F.round("avg_degree", 6).alias("avg_degree"), F.round(F.when(n < 2, 0.0).otherwise(F.col("edges") / (n * (n - 1))), 12).alias("density"))


def tool_counts(nodes: DataFrame) -> DataFrame:
    """(tool, n) of all tools, zero for those without nodes."""
    spark = nodes.sparkSession
    return spark.createDataFrame([(t,) for t in TOOLS], "tool string").join(counts_by(nodes.select(tool_of(F.col("type")).alias("tool")), "tool"), "tool", "left").select("tool", F.coalesce("n", F.lit(0)).alias("n"))


def tool_pairs(nodes: DataFrame, edges: DataFrame, limit: int | None = 10) -> DataFrame:
    """(source_tool, target_tool, n, average): edges between different tools, the most frequent pairs."""
    kind = lambda end: nodes.select(F.col("id").alias(end), tool_of(F.col("type")).alias(f"{end}_tool"))
    crossing = edges.join(kind("source"), "source").join(kind("target"), "target").filter("source_tool <> target_tool")
    pairs = crossing.groupBy("source_tool", "target_tool").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("average"))
    return pairs.orderBy(F.desc("n"), "source_tool", "target_tool").limit(limit) if limit else pairs


def nodes_of_tools(nodes: DataFrame, tools: list[str]) -> DataFrame:
    """The nodes of these tools, with a column tool."""
    return nodes.withColumn("tool", tool_of(F.col("type"))).filter(F.col("tool").isin(tools))


def cross_tool_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, edges between different tools, their share of all to six places, and their average confidence."""
    kind = lambda end: nodes.select(F.col("id").alias(end), tool_of(F.col("type")).alias(f"{end}_tool"))
    crossing = F.col("source_tool") != F.col("target_tool")
    row = edges.join(kind("source"), "source").join(kind("target"), "target").agg(F.count("*").alias("edges"), F.count_if(crossing).alias("crossing"), F.round(F.avg(F.when(crossing, F.col("confidence"))), 4).alias("average"))
    whole = nodes.agg(F.count("*").alias("nodes")).withColumn("_one", F.lit(1))
    share = F.round(F.col("crossing") / F.nullif(F.col("edges"), F.lit(0)), 6).alias("share")
    return row.withColumn("_one", F.lit(1)).join(whole, "_one").select("nodes", "edges", "crossing", share, "average")


def percentiles_by(df: DataFrame, column: str, keys: list[str], points: tuple[int, ...] = (50, 75, 90, 95, 99)) -> DataFrame:
    """(keys, least, most, average, deviation, p50, ...): nearest-rank percentiles of each group of the values that aren't null.

    Exact: all values are sorted by ranges and numbered, and of each group the
    rows at its ranks are picked by their numbers, so that no group's values
    meet in one buffer.
    """
    own = df.filter(F.col(column).isNotNull()).select(*keys, F.col(column).alias("_x"))
    placed = checkpointed(numbered(own, [F.col(k) for k in keys] + [F.col("_x")], "_i"), "ordered")
    sums = placed.groupBy(*keys).agg(F.min("_x").alias("least"), F.max("_x").alias("most"), F.round(F.avg("_x"), 6).alias("average"), F.round(F.stddev_pop("_x"), 6).alias("deviation"), F.min("_i").alias("_start"), F.count("*").alias("_n"))
    ranks = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), (F.col("_start") + F.greatest(F.ceil(F.lit(p) * F.col("_n") / 100), F.lit(1)) - 1).alias("_i")) for p in points]))
    at = sums.select(*keys, ranks.alias("r")).select("r.p", "r._i").join(placed, "_i")
    named = at.groupBy(*keys).agg(*[F.max(F.when(F.col("p") == p, F.col("_x"))).alias(f"p{p}") for p in points])
    same = lambda a, b: reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys], F.lit(True))
    return sums.join(named, same(sums, named)).select(*[sums[k] for k in keys], "least", "most", "average", "deviation", *[f"p{p}" for p in points])


def percentiles(df: DataFrame, column: str, points: tuple[int, ...] = (50, 75, 90, 95, 99)) -> DataFrame:
    """One row: least, most, average, population deviation and nearest-rank percentiles, zero without rows."""
    found = percentiles_by(df.withColumn("_all", F.lit(1)), column, ["_all"], points)
    return df.sparkSession.range(1).select(F.lit(1).alias("_all")).join(found, "_all", "left").drop("_all").na.fill(0)


def share_by(df: DataFrame, key: str) -> DataFrame:
    """(key, n, percent): rows of each key, and their share of all to two places."""
    whole = df.agg(F.count("*").alias("_all")).withColumn("_one", F.lit(1))
    by = counts_by(df, key).withColumn("_one", F.lit(1)).join(F.broadcast(whole), "_one")  # one row
    return by.select(key, "n", F.round(100 * F.col("n") / F.col("_all"), 2).alias("percent"))


def linking_stats(edges: DataFrame) -> DataFrame:
    """(operation, edges, jobs, targets, average, high, medium, low) of edges (source, target, operation_type, confidence) from jobs to what they operate on; the row without an operation is of all edges."""
    by = edges.withColumn("operation", F.coalesce("operation_type", F.lit("unknown"))).rollup("operation")
    return by.agg(F.count("*").alias("edges"), F.count_distinct("source").alias("jobs"), F.count_distinct("target").alias("targets"), F.round(F.avg("confidence"), 2).alias("average"), *banded(edges))


def graph_metadata(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, key, n): nodes and edges by type, and nodes of each source file."""
    named = lambda df, what, key: df.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "key", "n")
    return named(nodes, "nodes", "type").union(named(edges, "edges", "type")).union(named(nodes.filter("file_path is not null"), "files", "file_path"))


def rollup_type_counts(nodes: DataFrame, grouped: DataFrame, merged: DataFrame) -> DataFrame:
    """(type, n): merged nodes, and nodes that nothing matched."""
    alone = nodes.join(grouped.select("repo_id", "id"), ["repo_id", "id"], "left_anti")
    return merged.select("type").union(alone.select("type")).groupBy("type").agg(F.count("*").alias("n"))
