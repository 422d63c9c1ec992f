"""Connected components and strongly connected components by iterated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import Levels, bucketed, checkpointed, discard, numbered, wide


#: Numbers of nodes take so many bits; those above hold how long the number of their edges is.
_BITS = 57


def numbers(links: DataFrame) -> DataFrame:
    """(name, i): the ends of links (u, v), numbered in their order, so that loops shuffle and compare numbers."""
    names = checkpointed(links.select(F.col("u").alias("name")).union(links.select("v")).distinct(), "names")
    found = checkpointed(numbered(names, [F.col("name")], "i"), "numbers")
    discard(names)
    return found


def by_number(links: DataFrame, of: DataFrame) -> DataFrame:
    """Links (u, v) between names as links between their numbers, u < v."""
    side = lambda end: wide(of.select(F.col("name").alias(end), F.col("i").alias(f"_{end}")))
    return links.join(side("u"), "u").join(side("v"), "v").select(F.col("_u").alias("u"), F.col("_v").alias("v"))


def _ends(hooks: DataFrame) -> DataFrame:
    """(node, root) of (node, up): where the pointers end, by doubling them. Only nodes that don't point at a root yet are moved."""
    now = hooks.select("node", "up", F.lit(True).alias("open"))
    while True:
        above = now.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("open").alias("more"))
        moved = now.filter("open").join(above, "up", "left").select("node", F.coalesce("next", "up").alias("up"), F.coalesce("more", F.lit(False)).alias("open"))
        was, now = now, checkpointed(now.filter("not open").union(moved), "pointers")
        if was.inputFiles() != hooks.inputFiles():
            discard(was)
        if now.filter("open").isEmpty():
            return now.select("node", F.col("up").alias("root"))


def contracted(links: DataFrame, forest: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(node, component) of stored links (u, v) between numbers, u < v and each once; with `forest` also (u, v), so many of them that they join the same nodes without a cycle.

    In a round every node takes hold of its neighbour with the most edges (by
    how long that number is, then the greater node), if that has more than
    itself. No cycle can come of that, at least a quarter of the nodes go, and hubs
    take all that is around them in one round. Links between what is joined
    are left, each pair once.
    """
    rest, maps, trees = links.select("u", "v", *([F.col("u").alias("eu"), F.col("v").alias("ev")] if forest else [])), [], None
    rank = lambda n: F.shiftleft(F.length(F.bin(n)).cast("long"), _BITS) + F.col("u")
    while not rest.isEmpty():
        both = rest.select("u", "v").union(rest.select("v", "u"))
        ranks = both.groupBy("u").agg(F.count("*").alias("n")).select(F.col("u").alias("v"), rank("n").alias("rank"))
        best = both.join(ranks, "v").groupBy("u").agg(F.count("*").alias("n"), F.max("rank").alias("best")).filter(rank("n") < F.col("best"))
        hooks = checkpointed(best.select(F.col("u").alias("node"), F.col("best").bitwiseAND(F.lit((1 << _BITS) - 1)).alias("up")), "hooks")
        if forest:
            held = hooks.select(F.least("node", "up").alias("u"), F.greatest("node", "up").alias("v"))
            held = held if trees is None else checkpointed(held.join(rest, ["u", "v"]).select(F.col("eu").alias("u"), F.col("ev").alias("v")), "held")
            trees = held if trees is None else trees.union(held)
        maps.append(_ends(hooks))
        side = lambda end: maps[-1].select(F.col("node").alias(end), F.col("root").alias(f"r{end}"))
        ends = rest.join(side("u"), "u", "left").join(side("v"), "v", "left").withColumns({"a": F.coalesce("ru", "u"), "b": F.coalesce("rv", "v")}).filter("a <> b")
        ends = ends.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), *(["eu", "ev"] if forest else []))
        between = ends.groupBy("u", "v").agg(F.min("eu").alias("eu"), F.min_by("ev", "eu").alias("ev")) if forest else ends.distinct()
        before, rest = rest, checkpointed(between, "rest")
        if len(maps) > 1:
            discard(before)
        if not forest:
            discard(hooks)
    if not maps:
        return links.select(F.col("u").alias("node"), F.col("v").alias("component")), links.select("u", "v") if forest else None
    found = maps.pop()
    while maps:
        found = maps.pop().join(found.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root")).union(found)
    found = checkpointed(found, "labels")
    least = checkpointed(found.groupBy("root").agg(F.min("node").alias("least")).select("root", F.least("root", "least").alias("component")), "least")
    return found.join(least, "root").select("node", "component").union(least.select(F.col("root").alias("node"), "component")), trees


def connected_components(edges: DataFrame, source: str = "source", target: str = "target", nodes: DataFrame | None = None) -> DataFrame:
    """(node, component): the least id that is reachable over edges in either direction, for nodes with an edge, and for those of `nodes` (id), each alone if it has none.

    The nodes are numbered in their order, and the numbers' components named
    again. Loops count as edges of a node to itself; nulls are ignored.
    """
    loops = edges.filter(F.col(source) == F.col(target)).select(F.col(source).alias("node")).distinct()
    links = checkpointed(edges.filter(F.col(source) != F.col(target)).select(F.least(source, target).alias("u"), F.greatest(source, target).alias("v")).distinct(), "edges")
    of = numbers(links)
    own = checkpointed(by_number(links, of), "edges")
    labels = contracted(own)[0]
    labels = checkpointed(labels, "labels")
    least = checkpointed(of.join(labels.filter("node = component").select(F.col("node").alias("i")), "i", "left_semi").select(F.col("i").alias("component"), F.col("name").alias("least")), "least")
    named = wide(of.select(F.col("i").alias("node"), "name")).join(labels, "node").join(least, "component").select(F.col("name").alias("node"), F.col("least").alias("component"))
    discard(links, own)
    alone = loops if nodes is None else loops.union(nodes.select(F.col("id").alias("node"))).distinct()
    alone = alone.join(of.select(F.col("name").alias("node")), "node", "left_anti")
    return named.union(alone.select("node", F.col("node").alias("component")))


def _spread(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels (node, label) lowered along edges (source, target) until none changes; only labels that changed are sent on."""
    labels = checkpointed(labels, "labels")
    changed = labels
    while True:
        sent = edges.join(changed, edges["source"] == changed["node"]).select(F.col("target").alias("node"), "label")
        after = checkpointed(labels.union(sent).groupBy("node").agg(F.min("label").alias("label")), "labels")
        changed = checkpointed(after.join(labels, ["node", "label"], "left_anti"), "changed")
        discard(labels)
        labels = after
        if changed.isEmpty():
            return labels


def peeled(moves: DataFrame, stored: bool = False) -> DataFrame:
    """(node, depth) of the nodes of acyclic beginnings: those of `moves` (source, target), distinct, without a move in are of depth 0, each other one is one behind the last of those before it. Nodes on or behind a cycle are left out.

    A level only touches the moves out of the level before: it writes how many
    moves into a node they are, and a node is done when all that it has are. The
    moves are put in buckets by where they start, unless they are `stored` so
    already, and no level shuffles them.
    """
    spark = moves.sparkSession
    if not stored:
        moves, name = bucketed(moves.select("source", "target"), "source", "moves")
    indegree = checkpointed(moves.groupBy(F.col("target").alias("node")).agg(F.count("*").alias("of")), "indegree")
    counted, placed = Levels(spark, "counted"), Levels(spark, "placed")
    first = moves.select(F.col("source").alias("node")).distinct().join(indegree, "node", "left_anti").select("node")
    frontier, depth = placed.add(first, 0), 0
    while not frontier.isEmpty():
        hit = counted.add(moves.join(frontier.select(F.col("node").alias("source")), "source").groupBy(F.col("target").alias("node")).agg(F.count("*").alias("n")), depth)
        seen = counted.all().join(hit.select("node"), "node", "left_semi").groupBy("node").agg(F.sum("n").alias("n"))
        depth += 1
        frontier = placed.add(seen.join(indegree, "node").filter("n = of").select("node"), depth)
    discard(indegree)
    if not stored:
        discard(moves)
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return placed.all()


def trimmed(edges: DataFrame) -> DataFrame:
    """The distinct edges (source, target) on or between cycles: those that are left without the nodes that no cycle leads to, and then without those that lead to none.

    Rounds that drop every node without an edge in or out come first, while
    each leaves half of the edges at most: together they cost as much as two
    over all edges, and few are left to be counted level by level.
    """
    rest = checkpointed(edges.select("source", "target").distinct(), "rest")
    had, left = 0, rest.count()
    while left and (not had or 2 * left <= had):
        into, out = rest.select(F.col("target").alias("source")).distinct(), rest.select(F.col("source").alias("target")).distinct()
        before, rest = rest, checkpointed(rest.join(into, "source", "left_semi").join(out, "target", "left_semi").select("source", "target"), "rest")
        discard(before)
        had, left = left, rest.count()
    if not left:
        return rest
    for a, b in (("source", "target"), ("target", "source")):
        gone = peeled(rest.select(F.col(a).alias("source"), F.col(b).alias("target"))).select(F.col("node").alias(a))
        before, rest = rest, checkpointed(rest.join(gone, a, "left_anti").select("source", "target"), "rest")
        discard(before)
    return rest


def strongly_connected(edges: DataFrame) -> DataFrame:
    """(node, scc): the least id of the strong component, for nodes in a component of several nodes or with a self-loop.

    Colours are the least id that reaches a node; the nodes that reach the
    colour's own node back within the colour are its component. What is left
    goes round again, trimmed.
    """
    rest, found = trimmed(edges), None
    while not rest.isEmpty():
        own = rest.select(F.col("source").alias("node")).union(rest.select("target")).distinct()
        colour = _spread(rest, own.select("node", F.col("node").alias("label")))
        a, b = colour.select(F.col("node").alias("source"), F.col("label").alias("ca")), colour.select(F.col("node").alias("target"), F.col("label").alias("cb"))
        within = checkpointed(rest.join(a, "source").join(b, "target").filter("ca = cb").select("source", "target", F.col("ca").alias("colour")), "within")
        back = within.select(F.col("target").alias("source"), F.col("source").alias("target"))
        reach = _spread(back, within.filter("source = colour or target = colour").select(F.col("colour").alias("node"), F.col("colour").alias("label")).distinct())
        part = checkpointed(reach.join(colour.withColumnRenamed("label", "colour"), "node").filter("label = colour").select("node", F.col("colour").alias("scc")), "scc")
        # a colour's own node alone is a component only with a loop
        loops = rest.filter("source = target").select(F.col("source").alias("node"))
        counts = part.groupBy("scc").agg(F.count("*").alias("n"))
        part_kept = part.join(counts, "scc").join(loops.withColumn("loop", F.lit(True)), "node", "left").filter("n > 1 or loop").select("node", "scc")
        found = part_kept if found is None else found.union(part_kept)
        rest = rest.join(part.select(F.col("node").alias("source")), "source", "left_anti").join(part.select(F.col("node").alias("target")), "target", "left_anti")
        rest = trimmed(rest)
    return found if found is not None else edges.select(F.col("source").alias("node"), F.col("source").alias("scc")).limit(0)


def cycle_edges(edges: DataFrame, components: DataFrame) -> DataFrame:
    """The edges whose ends lie in one strong component."""
    a, b = components.select(F.col("node").alias("source"), "scc"), components.select(F.col("node").alias("target"), F.col("scc").alias("other"))
    return edges.join(a, "source").join(b, "target").filter("scc = other").drop("other")
