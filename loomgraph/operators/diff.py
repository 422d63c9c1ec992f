"""Differences of two snapshots of a graph."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.graph import change_score, identity_key, impact_level
from ..sources.tables import checkpointed, discard, wide

# Attributes that a comparison leaves out, of nodes matched by identity and of records compared as they are.
IGNORED = {
    "nodes": ("id", "metadata.uid", "metadata.resourceVersion", "metadata.generation", "metadata.creationTimestamp", "status", "location.lineStart", "location.lineEnd", "location.columnStart", "location.columnEnd"),
    "records": ("location", "updatedAt", "createdAt", "id"),
}


def indexed(nodes: DataFrame, lower_path: bool = True, columns: tuple[str, ...] = ()) -> DataFrame:
    """Nodes with their identity key; of several with one key the one of the greatest id. With `columns` only these."""
    key = identity_key(F.col("type"), F.col("name"), F.col("file_path"), F.col("namespace"), lower_path)
    last = nodes.groupBy(key.alias("key")).agg(F.max_by(F.struct(*(columns or nodes.columns)), "id").alias("x"))
    return last.select("x.*", "key")


def _plain(value: object) -> object:
    """Whole numbers without a fraction, so that 1 and 1.0 are one value."""
    if isinstance(value, float) and value.is_integer():
        return int(value)
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, list) else value


def _is_json(text: str) -> bool:
    try:
        json.loads(text)
    except (ValueError, RecursionError):
        return False
    return True


def _ignored(path: str, ignore: tuple[str, ...]) -> bool:
    """Whether a path of the metadata, by itself or as a path of the node, is one of those left out or lies in one."""
    return any(full == name or full.startswith(f"{name}.") for name in ignore for full in (path, f"metadata.{path}"))


def _leaves(metadata: str | None, ignore: tuple[str, ...] = IGNORED["nodes"]) -> dict[str, str]:
    if metadata is None:
        return {}
    try:
        top = json.loads(metadata)
        if not isinstance(top, dict):
            return {"": metadata}
        out: dict[str, str] = {}
        todo = list(top.items())
        while todo:
            path, value = todo.pop()
            if _ignored(path, ignore):
                continue
            if isinstance(value, dict) and value:
                todo += [(f"{path}.{k}", v) for k, v in sorted(value.items())]
                continue
            text = value if isinstance(value, str) and not _is_json(value) else json.dumps(_plain(value), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
            out[path] = ",".join(sorted([out[path], text])) if path in out else text
        return out
    except (ValueError, RecursionError):
        return {"": metadata}


def leaves(metadata: Column, ignore: str = "nodes") -> Column:
    """Leaf path -> value of a JSON object, however deep; arrays and empty objects are leaves. Left out are the paths of IGNORED[ignore].

    Values are JSON with sorted keys, but strings stand as they are unless they
    read as JSON themselves. A null has no leaves; text that is no JSON object
    is one leaf without a path.
    """
    names = IGNORED[ignore]
    return F.udf(lambda text: _leaves(text, names), "map<string,string>", useArrow=True)(metadata)


_CHANGES = "struct<added:array<string>,removed:array<string>,modified:array<string>>"


def changes_of(base: Column, target: Column, ignore: str = "nodes") -> Column:
    """(added, removed, modified): sorted leaf paths by which two JSON texts differ; equal texts are not parsed."""
    names = IGNORED[ignore]

    def compared(a: str | None, b: str | None) -> tuple[list[str], list[str], list[str]]:
        if a == b:
            return [], [], []
        x, y = _leaves(a, names), _leaves(b, names)
        return sorted(y.keys() - x.keys()), sorted(x.keys() - y.keys()), sorted(k for k in x.keys() & y.keys() if x[k] != y[k])

    differ = ~base.eqNullSafe(target)
    return F.udf(compared, _CHANGES, useArrow=True)(F.when(differ, base), F.when(differ, target))


def node_diff(base: DataFrame, target: DataFrame, lower_path: bool = True, ignore: str = "nodes") -> DataFrame:
    """(key, type, change, changes): added, removed, modified and unchanged nodes by identity.

    Nodes meet first; metadata go to Python, and are parsed, only where both
    sides have them and their texts differ.
    """
    side = lambda df, s: indexed(df, lower_path, ("type", "metadata")).select("key", F.col("type").alias(f"type_{s}"), F.col("metadata").alias(f"m_{s}"), F.lit(True).alias(f"in_{s}"))
    both = side(base, "a").join(side(target, "b"), "key", "full_outer")
    shared = F.col("in_a") & F.col("in_b")
    both = both.withColumn("changes", F.when(shared, changes_of(F.when(shared, F.col("m_a")), F.when(shared, F.col("m_b")), ignore)))
    some = F.size("changes.added") + F.size("changes.removed") + F.size("changes.modified") > 0
    change = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(some, "modified").otherwise("unchanged")
    return both.select("key", F.coalesce("type_a", "type_b").alias("type"), change.alias("change"), "changes")


def value_overrides(base: DataFrame, overrides: DataFrame) -> DataFrame:
    """(key, source, path, base_value, value): leaf paths of overriding values (key, source, metadata) that the base values (key, metadata) of their key lack, with a null base value, or hold otherwise. No path is left out; values are as `leaves` shows them."""
    everything = F.udf(lambda text: _leaves(text, ()), "map<string,string>", useArrow=True)
    own = base.select("key", F.explode(everything("metadata")).alias("path", "base_value"))
    new = overrides.select("key", "source", F.explode(everything("metadata")).alias("path", "value"))
    return new.join(own, ["key", "path"], "left").filter(F.col("base_value").isNull() | (F.col("base_value") != F.col("value"))).select("key", "source", "path", "base_value", "value")


def appended(diffs: list[DataFrame]) -> DataFrame:
    """The changes of diffs that follow one another, one behind the other: what one adds and a later one removes stays in as both. Each has its number (at)."""
    found = [d.withColumn("at", F.lit(i)) for i, d in enumerate(diffs)]
    return reduce(DataFrame.unionByName, found)


def edge_keys(nodes: DataFrame, edges: DataFrame, lower_path: bool = True) -> DataFrame:
    """(source_key, type, target_key, label, reason): edges by the identities of their ends; reason says which end is missing."""
    keys = nodes.select("id", identity_key(F.col("type"), F.col("name"), F.col("file_path"), F.col("namespace"), lower_path).alias("key"))
    end = lambda s: keys.select(F.col("id").alias(s), F.col("key").alias(f"{s}_key"))
    both = edges.join(end("source"), "source", "left").join(end("target"), "target", "left")
    a, b = F.col("source_key").isNull(), F.col("target_key").isNull()
    return both.select("source_key", "type", "target_key", "confidence", F.when(a & b, "missing_both").when(a, "missing_source").when(b, "missing_target").alias("reason"))


def edge_diff(base: DataFrame, target: DataFrame, changes: bool = False) -> DataFrame:
    """(source_key, type, target_key, change) of resolved edges (from `edge_keys`); with `changes`, edges whose confidence differs are modified."""
    one = lambda df, s: df.filter("reason is null").groupBy("source_key", "type", "target_key").agg(F.max("confidence").alias(s))
    both = one(base, "a").join(one(target, "b"), ["source_key", "type", "target_key"], "full_outer")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.lit(changes) & (F.col("a") != F.col("b")), "modified").otherwise("unchanged")
    return both.select("source_key", "type", "target_key", change.alias("change"))


def edge_changes(base: tuple[DataFrame, DataFrame], target: tuple[DataFrame, DataFrame], lower_path: bool = True) -> tuple[DataFrame, DataFrame]:
    """(source, type, target, change) of the edges of two snapshots (nodes, edges), as `edge_diff` with `changes` has them, by the numbers of their ends' keys; and (k, key), the numbers.

    Long keys are numbered and not shuffled with the edges. Edges of both
    snapshots between the same ids become one row where they are dealt out by
    their sources, so that what goes on from there is each edge once.
    """
    key = identity_key(F.col("type"), F.col("name"), F.col("file_path"), F.col("namespace"), lower_path).alias("key")
    own = base[0].select("id", key, F.lit(1).cast("byte").alias("at")).union(target[0].select("id", key, F.lit(2).cast("byte")))
    own = checkpointed(own.groupBy("key", "id").agg(F.bit_or("at").alias("at")), "keys")
    names = checkpointed(own.select("key").distinct().select(F.monotonically_increasing_id().alias("k"), "key"), "names")
    ids = checkpointed(own.join(wide(names), "key").select("id", "k", "at"), "ids")
    discard(own)

    # `at` is 1 for an edge of the base, 2 of the target, 3 of both; as in a join, no type is equal to none
    one = lambda df, at: df.select("source", "target", "type", "confidence", F.lit(at).cast("byte").alias("at"))
    rows = one(base[1], 1).union(one(target[1], 2)).repartition("source")
    apart = F.when(F.col("type").isNull(), F.col("at")).alias("apart")
    of = lambda at: F.max(F.when(F.col("at") == at, F.col("confidence")))
    rows = rows.groupBy("source", "target", "type", apart).agg(of(1).alias("a"), of(2).alias("b"), F.bit_or("at").alias("at")).drop("apart")
    for end, to in (("source", "s"), ("target", "t")):
        known = wide(ids.select(F.col("id").alias(end), F.col("k").alias(to), F.col("at").alias("of")))
        at = F.col("at").bitwiseAND(F.col("of"))
        rows = rows.join(known, end).filter(at > 0).withColumn("at", at).drop(end, "of")
    has = lambda n: F.col("at").bitwiseAND(F.lit(n).cast("byte")) > 0
    rows = rows.groupBy("s", "type", "t", apart).agg(F.max(F.when(has(1), F.col("a"))).alias("a"), F.max(F.when(has(2), F.col("b"))).alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "modified").otherwise("unchanged")
    return rows.select(F.col("s").alias("source"), "type", F.col("t").alias("target"), change.alias("change")), names


def named_changes(found: DataFrame, names: DataFrame) -> DataFrame:
    """(source_key, type, target_key, change) of rows of `edge_changes`."""
    for end in ("source", "target"):
        found = wide(found).join(wide(names.select(F.col("k").alias(end), F.col("key").alias(f"{end}_key"))), end)
    return found.select("source_key", "type", "target_key", "change")


def resolution(keys: DataFrame) -> DataFrame:
    """One row: resolved and unresolved edges, and the share of resolved ones."""
    row = keys.agg(F.count_if(F.col("reason").isNull()).alias("resolved"), F.count("reason").alias("unresolved"))
    return row.withColumn("rate", F.round(F.col("resolved") / F.nullif(F.col("resolved") + F.col("unresolved"), F.lit(0)), 6))


def by_type(diff: DataFrame) -> DataFrame:
    """(type, added, removed, modified)."""
    return diff.groupBy("type").agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "modified")])


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: counts of changes, their share, impact level and change score."""
    kinds = ("added", "removed", "modified")
    count = lambda df, s: df.agg(*[F.count_if(F.col("change") == c).alias(f"{s}_{c}") for c in kinds], F.count_if(F.col("change") != "added").alias(f"{s}_base")).withColumn("_one", F.lit(1))
    row = count(nodes, "nodes").join(count(edges, "edges"), "_one").drop("_one")
    total = sum((F.col(f"{s}_{c}") for s in ("nodes", "edges") for c in kinds), F.lit(0))
    elements = F.col("nodes_base") + F.col("edges_base")
    gone = F.col("nodes_removed") + F.col("edges_removed")
    score = change_score(*[F.col(f"{s}_{c}") for s in ("nodes", "edges") for c in kinds])
    return row.withColumns({"changes": total, "ratio": F.round(total / F.nullif(elements, F.lit(0)), 6), "impact": impact_level(total, gone, elements), "score": score})


def affected_files(base: DataFrame, target: DataFrame, diff: DataFrame) -> DataFrame:
    """(file_path) of all nodes that changed."""
    changed = diff.filter("change <> 'unchanged'").select("key")
    return indexed(base).select("key", "file_path").union(indexed(target).select("key", "file_path")).join(changed, "key", "left_semi").select("file_path").distinct()


def applied(nodes: DataFrame, diff: DataFrame) -> DataFrame:
    """`nodes` without those that the diff removes."""
    key = identity_key(F.col("type"), F.col("name"), F.col("file_path"), F.col("namespace"))
    gone = diff.filter("change = 'removed'").select("key")
    return nodes.withColumn("key", key).join(gone, "key", "left_anti").drop("key")
