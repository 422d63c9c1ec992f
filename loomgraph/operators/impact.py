"""Blast radius, and what crosses repositories and tools."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.graph import TOOLS, impact_score, risk_level, tool_of
from .traverse import Registered, bfs, bfs_of_many, only


def blast_radius(nodes: DataFrame, edges: DataFrame | Registered, seeds: DataFrame, max_depth: int = 5, types: list[str] | None = None, direction: str = "downstream") -> DataFrame:
    """(node, type, repo_id, depth, edge_type, cross_repo, score, path) of what the seeds (node) reach.

    A node's score is the weight of the edge that found it, decayed by the
    depth it came from, so that direct hits don't decay. A node counts as
    cross-repository if the one before it on its path is of another repository.
    """
    kinds = nodes.select(F.col("id").alias("node"), "type", "repo_id")
    found = bfs(edges, seeds, max_depth, direction, types, paths=True).filter("depth > 0").join(kinds, "node")
    found = found.join(nodes.select(F.col("id").alias("parent"), F.col("repo_id").alias("parent_repo")), "parent")
    return found.select("node", "type", "repo_id", "depth", "edge_type", (F.col("repo_id") != F.col("parent_repo")).alias("cross_repo"), impact_score(F.col("depth") - 1, F.col("edge_type")).alias("score"), "path", "parent_repo")


def blast_summary(found: DataFrame) -> DataFrame:
    """One row of a blast radius: direct and indirect nodes, nodes and (pair of repositories, edge type) groups that cross, score and risk."""
    groups = F.count_distinct(F.when(F.col("cross_repo"), F.struct("parent_repo", "repo_id", "edge_type")))
    row = found.agg(F.count_if(F.col("depth") == 1).alias("direct"), F.count_if(F.col("depth") > 1).alias("indirect"), F.count_if("cross_repo").alias("cross_nodes"), groups.alias("cross_groups"), F.round(F.sum("score"), 6).alias("score"))
    return row.withColumn("score", F.coalesce("score", F.lit(0.0))).withColumn("risk", risk_level(F.col("direct"), F.col("indirect"), F.col("cross_groups")))


# Least number of nodes hit of each level of risk.
MANY_RISKS = {"critical": 50, "high": 20, "medium": 5}


def impact_of_many(nodes: DataFrame, edges: DataFrame | Registered, roots: DataFrame, max_depth: int = 10) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What changes of the nodes `roots` (node, at: numbers from 0) hit downstream.

    Four frames: (node, kind) with a row for a node that a root hits directly
    and one for a node that a root hits through others before any hits it
    directly; (type, n) and (depth, n), hits of each root counted each; one row
    (direct, transitive, total, risk) of the first. Roots that aren't nodes and
    nodes that aren't known count for nothing.
    """
    known = nodes.select(F.col("id").alias("node"), "type")
    hits = bfs_of_many(edges, roots.join(known.select("node"), "node", "left_semi"), max_depth).filter("depth > 0").join(known, "node")
    lowest = F.col("word") * 63 + F.round(F.log2(F.col("bits").bitwiseAND(-F.col("bits")).cast("double"))).cast("int")
    by = hits.groupBy("node").agg(F.min(F.when(F.col("depth") == 1, lowest)).alias("direct"), F.min(F.when(F.col("depth") > 1, lowest)).alias("through"))
    kinds = F.array_compact(F.array(F.when(F.col("direct").isNotNull(), "direct"), F.when(F.col("through").isNotNull() & (F.col("direct").isNull() | (F.col("through") < F.col("direct"))), "transitive")))
    found = by.select("node", F.explode(kinds).alias("kind"))
    count = F.sum(F.bit_count("bits")).alias("n")
    row = found.agg(F.count_if(F.col("kind") == "direct").alias("direct"), F.count_if(F.col("kind") == "transitive").alias("transitive"), F.count("*").alias("total"))
    risk = F.lit("low")
    for level, least in reversed(MANY_RISKS.items()):
        risk = F.when(F.col("total") >= least, level).otherwise(risk)
    return found, hits.groupBy("type").agg(count), hits.groupBy("depth").agg(count), row.withColumn("risk", risk)


def tool_blast(nodes: DataFrame, edges: DataFrame, node: str, max_depth: int = 5, min_confidence: float = 50, with_ci: bool = True) -> DataFrame:
    """(tool, direct, transitive) of what is within reach of `node` in either direction over edges of some confidence."""
    kinds = nodes.select(F.col("id").alias("node"), tool_of(F.col("type")).alias("tool"))
    seeds = nodes.filter(F.col("id") == node).select(F.col("id").alias("node"))
    found = bfs(edges, seeds, max_depth, "both", None, min_confidence).filter("depth > 0").join(kinds, "node")
    found = found if with_ci else found.filter("tool <> 'ci'")
    return found.groupBy("tool").agg(F.count_if(F.col("depth") == 1).alias("direct"), F.count_if(F.col("depth") > 1).alias("transitive"))


def critical_paths(nodes: DataFrame, edges: DataFrame, node: str, per_tool: int = 3, max_nodes: int = 5, most: int = 10) -> DataFrame:
    """(tool, node, path): shortest ways of `max_nodes` nodes at most from `node` down to its first `per_tool` direct neighbours of each other tool, `most` in all, in the order of tools and ids."""
    kinds = nodes.select(F.col("id").alias("node"), tool_of(F.col("type")).alias("tool"))
    own = kinds.filter(F.col("node") == node).select(F.col("tool").alias("own"), F.lit(1).alias("_one"))
    direct = bfs(edges, only(edges.sparkSession, node), 1, "both").filter("depth = 1").join(kinds, "node").withColumn("_one", F.lit(1)).join(own, "_one").filter("tool <> own")
    first = Window.partitionBy("tool").orderBy("node")
    chosen = direct.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= per_tool).select("node", "tool")
    ways = bfs(edges, only(edges.sparkSession, node), max_nodes - 1, paths=True).select("node", "path").join(chosen, "node")
    return ways.select("tool", "node", "path").orderBy(F.array_position(F.array(*map(F.lit, TOOLS)), F.col("tool")), "node").limit(most)


def impact_summary(by_tool: DataFrame) -> DataFrame:
    """One row (summary): a sentence of the counts of each tool, in the order of their names."""
    piece = F.concat_ws(" ", (F.col("direct") + F.col("transitive")).cast("string"), F.col("tool"), F.concat(F.lit("("), F.col("direct").cast("string"), F.lit(" direct)")))
    return by_tool.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tool", piece.alias("p")))), lambda x: x["p"]), ", ").alias("summary"))
