"""Configurations merged along their include chains, with a trace of which file gave what."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import checkpointed, discard

#: Kinds of blocks that merge key by key; of other kinds a file's first block replaces that of older files.
KEYED = ("locals", "inputs")


def ancestors(files: DataFrame) -> DataFrame:
    """(path, ancestor, place) of files (path, includes: paths in order): all files that a file includes, over any number of includes, and a place that sorts them oldest first.

    The order is that of a search that visits the includes in their order, each
    file once, and puts a file behind its own includes. A file's way is the
    least in order of the positions along it; ways are improved until none
    changes. Includes that lead back to the file itself don't count; missing
    files are ancestors without includes.
    """
    moves = checkpointed(files.select(F.col("path").alias("at"), F.posexplode("includes").alias("i", "next")).filter("next is not null").groupBy("at", "next").agg(F.min("i").alias("i")), "includes")
    ways = checkpointed(moves.filter("at <> next").select(F.col("at").alias("path"), F.col("next").alias("ancestor"), F.array("i").alias("way")), "ways")
    changed = ways
    while not changed.isEmpty():
        grown = changed.join(moves, changed["ancestor"] == moves["at"]).filter("path <> next").select("path", F.col("next").alias("ancestor"), F.concat("way", F.array("i")).alias("way"))
        after = checkpointed(ways.union(grown).groupBy("path", "ancestor").agg(F.min("way").alias("way")), "ways")
        changed = checkpointed(after.join(ways, ["path", "ancestor", "way"], "left_anti"), "changed")
        discard(ways)
        ways = after
    discard(moves)
    return ways.select("path", "ancestor", F.concat("way", F.array(F.lit(2**31 - 1))).alias("place"))


def merged(files: DataFrame, blocks: DataFrame) -> DataFrame:
    """(path, kind, key, value, origin): the configuration of each file from blocks (path, position, kind, key, value) of itself and all that it includes.

    locals and inputs merge key by key, later files over older ones and later
    blocks over earlier ones in a file; of other kinds (their key is null) the
    first block of the last file that has one counts. origin is the file that
    gave the value. Files without blocks, and null keys of locals and inputs,
    give nothing.
    """
    own = files.select("path", F.col("path").alias("origin"), F.array(F.lit(2**31 - 1), F.lit(1)).alias("place"))
    chain = ancestors(files).select("path", F.col("ancestor").alias("origin"), "place").union(own)
    rows = chain.join(blocks.withColumnRenamed("path", "origin"), "origin")
    keyed = F.col("kind").isin(*KEYED)
    order = F.struct("place", F.when(keyed, F.col("position")).otherwise(-F.col("position")).alias("position"))
    best = rows.filter(~keyed | F.col("key").isNotNull()).groupBy("path", "kind", F.when(keyed, F.col("key")).alias("key")).agg(F.max_by(F.struct("value", "origin"), order).alias("b"))
    return best.select("path", "kind", "key", "b.value", "b.origin")


def collected(files: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(path, dependency, origin, n): all dependencies (path, position, dependency) of each file and of those that it includes, numbered in the order of the merge."""
    own = files.select("path", F.col("path").alias("origin"), F.array(F.lit(2**31 - 1), F.lit(1)).alias("place"))
    chain = ancestors(files).select("path", F.col("ancestor").alias("origin"), "place").union(own)
    rows = chain.join(dependencies.withColumnRenamed("path", "origin"), "origin")
    listed = rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("place", "position", "origin", "dependency"))).alias("d"))  # a file's own chain
    return listed.select("path", F.posexplode("d").alias("n", "x")).select("path", "x.dependency", "x.origin", "n")
