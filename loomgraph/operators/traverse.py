"""Traversals: breadth-first search, paths, cycles, topological order, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import Levels, bucketed, checkpointed, discard, wide
from .components import cycle_edges, peeled, strongly_connected


def steps(edges: DataFrame, direction: str = "downstream", types: list[str] | None = None, min_confidence: float | None = None) -> DataFrame:
    """(here, there, edge_id, type, confidence): the moves that a traversal may make."""
    if types:
        edges = edges.filter(F.col("type").isin(types))
    if min_confidence is not None:
        edges = edges.filter(F.col("confidence") >= min_confidence)
    move = lambda a, b: edges.select(F.col(a).alias("here"), F.col(b).alias("there"), F.col("id").alias("edge_id"), "type", "confidence")
    match direction:
        case "downstream":
            return move("source", "target")
        case "upstream":
            return move("target", "source")
        case "both":
            return move("source", "target").union(move("target", "source"))
    raise ValueError(f"unknown direction {direction!r}")


class Registered:
    """A graph stored for many searches: nodes (id, type, repo_id), and its moves forward and back, each in buckets by where they start, so that no search derives or shuffles them.

    The tables stay in the shared folder until `drop`.
    """

    def __init__(self, nodes: DataFrame, edges: DataFrame, buckets: int | None = None):
        self.sparkSession = edges.sparkSession
        self.nodes, self.nodes_name = bucketed(nodes.select("id", "type", "repo_id"), "id", "nodes", buckets)
        sides = {side: bucketed(steps(edges, side), "here", side, buckets) for side in ("downstream", "upstream")}
        self.tables = {side: df for side, (df, _) in sides.items()}
        self.names = [self.nodes_name, *(name for _, name in sides.values())]

    def moves(self, direction: str = "downstream", types: list[str] | None = None, min_confidence: float | None = None) -> DataFrame:
        """As `steps` gives them."""
        found = self.tables["downstream"].union(self.tables["upstream"]) if direction == "both" else self.tables[direction]
        if types:
            found = found.filter(F.col("type").isin(types))
        return found if min_confidence is None else found.filter(F.col("confidence") >= min_confidence)

    def drop(self) -> None:
        """Forget the tables and delete their files."""
        discard(self.nodes, *self.tables.values())
        for name in self.names:
            self.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")


def bfs(edges: DataFrame | Registered, seeds: DataFrame, max_depth: int = 10, direction: str = "downstream", types: list[str] | None = None, min_confidence: float | None = None, paths: bool = False, until: str | None = None) -> DataFrame:
    """(node, depth) of the seeds (node) and all that they reach in `max_depth` moves, each at its least depth; with `paths` also (parent, edge_id, edge_type, path).

    Of several ways of one length the one whose path is first in order counts.
    The moves are written once, so that no level derives them again, or are
    those of a registered graph; a level is
    a join of the last level with them, less what was visited, and is written
    to one table of all levels. The search ends after the level that holds the
    node `until`.
    """
    spark = edges.sparkSession
    stored = isinstance(edges, Registered)
    moves = edges.moves(direction, types, min_confidence) if stored else steps(edges, direction, types, min_confidence)
    moves = moves.drop("confidence") if paths else moves.select("here", "there")
    if not stored:
        moves = checkpointed(moves, "moves")
    levels = Levels(spark, "visited")
    none = F.lit(None).cast("string")
    first = seeds.select("node").distinct()
    extra = [none.alias("parent"), none.alias("edge_id"), none.alias("edge_type"), F.array("node").alias("path")] if paths else []
    frontier = levels.add(first.select("node", *extra), 0)
    for depth in range(1, max_depth + 1):
        reached = frontier.drop("parent", "edge_id", "edge_type").join(moves, F.col("node") == F.col("here"))
        if paths:
            best = reached.groupBy("there").agg(F.min(F.struct("path", "edge_id", F.col("here").alias("parent"), "type")).alias("b"))
            new = best.select(F.col("there").alias("node"), "b.parent", "b.edge_id", F.col("b.type").alias("edge_type"), F.concat("b.path", F.array("there")).alias("path"))
        else:
            new = reached.select(F.col("there").alias("node")).distinct()
        frontier = levels.add(new.join(levels.all().select("node"), "node", "left_anti"), depth)
        if frontier.isEmpty() or (until is not None and not frontier.filter(F.col("node") == until).isEmpty()):
            break
    if not stored:
        discard(moves)
    return levels.all()


def bfs_of_many(edges: DataFrame | Registered, roots: DataFrame, max_depth: int = 10, direction: str = "downstream", types: list[str] | None = None) -> DataFrame:
    """(node, word, bits, depth): all roots (node, at) searched at once. Bit b of a row says that the root numbered 63 * word + b comes to the node in `depth` moves and no fewer; roots reach themselves at 0.

    A level carries the set of roots of each node as bits and merges them by
    bit_or, so that nodes that many roots reach stay one row for 63 roots.
    """
    spark = edges.sparkSession
    stored = isinstance(edges, Registered)
    moves = (edges.moves(direction, types) if stored else steps(edges, direction, types)).select("here", "there")
    if not stored:
        moves = checkpointed(moves.distinct(), "moves")
    levels = Levels(spark, "roots")
    first = roots.select("node", F.floor(F.col("at") / 63).cast("int").alias("word"), F.expr("shiftleft(1L, cast(pmod(at, 63) as int))").alias("bits"))
    frontier = levels.add(first.groupBy("node", "word").agg(F.bit_or("bits").alias("bits")), 0)
    for depth in range(1, max_depth + 1):
        reached = frontier.select(F.col("node").alias("here"), "word", "bits").join(moves, "here").groupBy(F.col("there").alias("node"), "word").agg(F.bit_or("bits").alias("bits"))
        seen = levels.all().groupBy("node", "word").agg(F.bit_or("bits").alias("seen"))
        new = reached.join(seen, ["node", "word"], "left").withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("seen", F.lit(0).cast("long")))))
        frontier = levels.add(new.filter("bits <> 0").select("node", "word", "bits"), depth)
        if frontier.isEmpty():
            break
    if not stored:
        discard(moves)
    return levels.all()


def only(spark, *ids: str) -> DataFrame:
    """The given ids as a frame (node)."""
    return spark.createDataFrame([(i,) for i in ids], "node string")


def reachable(edges: DataFrame, node: str, max_depth: int = 10, direction: str = "downstream", types: list[str] | None = None) -> DataFrame:
    """(node, depth) of what `node` reaches, without itself."""
    return bfs(edges, only(edges.sparkSession, node), max_depth, direction, types).filter("depth > 0").select("node", "depth")


def neighbourhood(edges: DataFrame, node: str, hops: int, types: list[str] | None = None) -> DataFrame:
    """(node, depth) within `hops` moves in either direction, with the node itself."""
    return bfs(edges, only(edges.sparkSession, node), hops, "both", types).select("node", "depth")


def unreachable(nodes: DataFrame, edges: DataFrame, start: str, max_depth: int = 100) -> DataFrame:
    seen = bfs(edges, only(edges.sparkSession, start), max_depth).select(F.col("node").alias("id"))
    return nodes.join(seen, "id", "left_anti").select("id")


def shortest_path(edges: DataFrame, source: str, target: str, max_depth: int = 20) -> DataFrame:
    """(path, length): one row, or none; of equal lengths the first path in order. A node reaches itself in no moves."""
    found = bfs(edges, only(edges.sparkSession, source), max_depth, paths=True, until=target)
    return found.filter(F.col("node") == target).select("path", F.col("depth").alias("length"))


def simple_paths(edges: DataFrame, source: str, target: str, max_depth: int = 10, max_paths: int = 100) -> DataFrame:
    """(path, length): the `max_paths` shortest simple paths of 1 to `max_depth` moves, ties in the order of their nodes. Parallel edges count once.

    Only nodes that reach the target in the moves that are left are entered.
    """
    spark = edges.sparkSession
    left = bfs(edges, only(spark, target), max_depth, "upstream").select(F.col("node").alias("target"), F.col("depth").alias("left"))
    moves = checkpointed(edges.select("source", "target").distinct().join(left, "target"), "moves")
    frontier = only(spark, source).select("node", F.array("node").alias("path"))
    found = None
    for depth in range(1, max_depth + 1):
        grown = frontier.join(moves, frontier["node"] == moves["source"]).filter((F.col("left") <= max_depth - depth) & ~F.array_contains("path", F.col("target")))
        grown = checkpointed(grown.select(F.col("target").alias("node"), F.concat("path", F.array("target")).alias("path")), "paths")
        hit = grown.filter(F.col("node") == target).select("path", F.lit(depth).alias("length"))
        found = hit if found is None else found.union(hit)
        frontier = grown.filter(F.col("node") != target)
        if frontier.isEmpty() or found.limit(max_paths).count() >= max_paths:  # lengths only rise
            break
    return found.orderBy("length", "path").limit(max_paths)


def cycles(edges: DataFrame, max_length: int = 20, max_cycles: int = 50, canonical: bool = False) -> DataFrame:
    """(path, length): the shortest cycles, first node repeated at the end; one row for each rotation, or only that which starts at the least node.

    Paths are grown inside strong components alone. A self-loop is [a, a, a].
    """
    inside = checkpointed(cycle_edges(edges.select("source", "target").distinct(), strongly_connected(edges)).select("source", "target"), "cyclic")
    loops = inside.filter("source = target").select(F.array("source", "source", "source").alias("path"), F.lit(1).alias("length"))
    moves = inside.filter("source <> target")
    frontier, found = moves.select(F.array("source", "target").alias("path")), loops
    if canonical:
        frontier = frontier.filter(F.col("path")[0] < F.col("path")[1])
    for length in range(2, max_length + 1):
        grown = checkpointed(frontier.join(moves, F.element_at("path", -1) == moves["source"]).select("path", "target"), "walks")
        found = found.union(grown.filter(F.col("target") == F.col("path")[0]).select(F.concat("path", F.array("target")).alias("path"), F.lit(length).alias("length")))
        new = grown.filter(~F.array_contains("path", F.col("target")))
        if canonical:
            new = new.filter(F.col("target") > F.col("path")[0])
        frontier = new.select(F.concat("path", F.array("target")).alias("path"))
        if frontier.isEmpty() or found.limit(max_cycles).count() >= max_cycles:  # lengths only rise
            break
    return found.orderBy("length", "path").limit(max_cycles)


def _ordered(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The nodes (id), those that moves between them lead to (id), and the levels (id, level) of those on moves but not on or behind a cycle."""
    every = checkpointed(nodes.select("id").distinct(), "nodes")
    side = lambda end: wide(every.select(F.col("id").alias(end)))
    moves = edges.select("source", "target").join(side("target"), "target", "left_semi").join(side("source"), "source", "left_semi")
    moves, name = bucketed(moves.select("source", "target").distinct(), "source", "moves")  # dealt out by source already
    into = checkpointed(moves.select(F.col("target").alias("id")).distinct(), "into")
    placed = peeled(moves, stored=True).select(F.col("node").alias("id"), F.col("depth").alias("level"))
    discard(moves)
    edges.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    return every, into, placed


def topological_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, level): the longest way from a node without edges in, level null for nodes on or behind a cycle. Edges of other nodes don't count."""
    every, into, placed = _ordered(nodes, edges)
    found = every.join(placed, "id", "left").join(into.withColumn("into", F.lit(True)), "id", "left")
    return found.select("id", F.coalesce("level", F.when(F.col("into").isNull(), 0)).alias("level"))


def longest_depth(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(max_depth): nodes on the longest path of the part without cycles; 0 without nodes."""
    every, into, placed = _ordered(nodes, edges)
    first = every.join(into, "id", "left_anti").limit(1).select(F.lit(0).alias("level"))
    return placed.select("level").union(first).agg(F.coalesce(F.max("level") + 1, F.lit(0)).alias("max_depth"))


def walk_rows(edges: DataFrame, seeds: DataFrame, max_depth: int, direction: str = "downstream", types: list[str] | None = None) -> DataFrame:
    """(source, target, edge_id, depth) of every move of every walk of 1 to `max_depth` moves, one row for each way to come there."""
    moves = steps(edges, direction, types).drop("type", "confidence")
    frontier, found = seeds.select(F.col("node").alias("at")), None
    for depth in range(1, max_depth + 1):
        level = checkpointed(frontier.join(moves, F.col("at") == F.col("here")).select("here", "there", "edge_id"), "walk")
        if level.isEmpty():
            break
        row = level.select(F.col("here").alias("source"), F.col("there").alias("target"), "edge_id", F.lit(depth).alias("depth"))
        found = row if found is None else found.union(row)
        frontier = level.select(F.col("there").alias("at"))
    return found if found is not None else moves.select(F.col("here").alias("source"), F.col("there").alias("target"), "edge_id", F.lit(0).alias("depth")).limit(0)


def impact(edges: DataFrame, node: str, max_depth: int = 10) -> DataFrame:
    """(node, kind, depth): who depends on `node` directly, and transitively with the depth of the longest walk of up to `max_depth` moves. Direct ones are never transitive."""
    moves = steps(edges, "upstream").filter(F.col("there") != node).select("here", "there").distinct()
    frontier = only(edges.sparkSession, node)
    levels = None
    for depth in range(1, max_depth + 1):
        frontier = checkpointed(frontier.join(moves, F.col("node") == F.col("here")).select(F.col("there").alias("node")).distinct(), "level")
        if frontier.isEmpty():
            break
        level = frontier.withColumn("depth", F.lit(depth))
        levels = level if levels is None else levels.union(level)
    if levels is None:
        return frontier.select("node", F.lit("").alias("kind"), F.lit(0).alias("depth")).limit(0)
    by = levels.groupBy("node").agg(F.max("depth").alias("most"), F.min("depth").alias("least"))
    direct = F.col("least") == 1
    return by.select("node", F.when(direct, "direct").otherwise("transitive").alias("kind"), F.when(direct, 1).otherwise(F.col("most")).alias("depth"))


def subgraph(nodes: DataFrame, edges: DataFrame, ids: list[str] | None = None, types: list[str] | None = None, hops: int = 0) -> tuple[DataFrame, DataFrame]:
    """The nodes of the ids and types, with their neighbourhood of `hops`, and the edges between them."""
    chosen = nodes.filter(F.col("id").isin(ids or []) | F.col("type").isin(types or [])).select(F.col("id").alias("node"))
    if hops:
        chosen = bfs(edges, chosen, hops, "both").select("node")
    chosen = checkpointed(chosen.distinct(), "chosen")
    kept = nodes.join(chosen.withColumnRenamed("node", "id"), "id", "left_semi")
    inner = edges.join(chosen.withColumnRenamed("node", "source"), "source", "left_semi").join(chosen.withColumnRenamed("node", "target"), "target", "left_semi")
    return kept, inner


def adjacency(edges: DataFrame, direction: str = "downstream") -> DataFrame:
    """(node, next): sorted (there, edge_id) of each node with moves."""
    return steps(edges, direction).groupBy(F.col("here").alias("node")).agg(F.sort_array(F.collect_list(F.struct("there", "edge_id"))).alias("next"))
