"""Building, checking and merging graphs of nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import strongly_connected


def built(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges both of whose ends are nodes, each (source, target, type) once: the one of the least id."""
    ids = nodes.select("id")
    whole = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    first = Window.partitionBy("source", "target", "type").orderBy("id")
    return whole.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n").select(*edges.columns)


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id) of nodes on no edge."""
    ends = edges.select(F.col("source").alias("id")).union(edges.select("target"))
    return nodes.select("id").join(ends.distinct(), "id", "left_anti")


def issues(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(code, element): dangling ends, self-loops, orphan nodes and nodes on cycles."""
    ids = nodes.select("id")
    lost = lambda side: edges.join(ids.withColumnRenamed("id", side), side, "left_anti")
    parts = [
        lost("source").select(F.lit("DANGLING_SOURCE").alias("code"), F.col("id").alias("element")),
        lost("target").select(F.lit("DANGLING_TARGET"), "id"),
        edges.filter("source = target").select(F.lit("SELF_LOOP"), "id"),
        orphans(nodes, edges).select(F.lit("ORPHAN_NODE"), "id"),
        strongly_connected(edges).select(F.lit("CYCLE_DETECTED"), "node"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def merged(graphs: DataFrame, keep: str = "first") -> DataFrame:
    """Nodes of several graphs (column `graph` gives their order), each id once: the first's or the last's; `error` fails on repeats."""
    if keep == "error":
        one = Window.partitionBy("id")
        return graphs.withColumn("_n", F.count("*").over(one)).withColumn("id", F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("repeated node "), F.col("id")))).otherwise(F.col("id"))).drop("_n")
    order = F.col("graph").asc() if keep == "first" else F.col("graph").desc()
    return graphs.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(order))).filter("_n = 1").drop("_n")


def removed(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without the nodes `gone` (id) and their edges."""
    drop = lambda df, side: df.join(gone.select(F.col("id").alias(side)), side, "left_anti")
    return drop(nodes, "id"), drop(drop(edges, "source"), "target").select(*edges.columns)
