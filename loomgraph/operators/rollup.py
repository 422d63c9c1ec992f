"""Matching nodes of different repositories, and merging the graphs of what matches."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.external import arn_confidence, arn_parts, arn_regex
from ..sources.tables import checkpointed, known, once, wide
from .components import connected_components
from .likeness import alike

DEFAULT_LEAST = 80


@dataclass(frozen=True)
class Matcher:
    """`key` drops nodes where it is null; `confidence` compares two nodes of one block, a struct a and a struct b. Nodes meet where `block` (the key by default) is equal, and where their keys are alike by `alike` percent. `same` says that all nodes of a block match, for certain (100) if they are equal in that column (kind, type, or key), else by 95."""

    strategy: str
    key: Column
    confidence: Callable[[Column, Column], Column]
    least: float = 0
    block: Column | None = None
    alike: float | None = None
    same: str | None = None


def _meta(path: str, metadata: Column | str = "metadata") -> Column:
    """The value at a path, parsed only where the text holds the last name of the path, or an escape that might spell it."""
    found, text = F.get_json_object(metadata, f"$.{path}"), F.col(metadata) if isinstance(metadata, str) else metadata
    if not re.fullmatch(r"\w+(\.\w+)*", path, re.ASCII):
        return found
    return F.when(F.contains(text, F.lit(path.rsplit(".", 1)[-1])) | F.contains(text, F.lit("\\")), found)


def arn_of_metadata() -> Column:
    """The ARN of a resource or data node: its own, that of its attributes, those of the usual fields, else the first field by name that is one. Other nodes have none."""

    def found(m: Column) -> Column:
        named = [F.when(_meta(p, m).startswith("arn:"), _meta(p, m)) for p in ("resource_arn", "target_arn", "function_arn", "bucket_arn")]
        fields = F.array_sort(F.map_entries(F.map_filter(F.from_json(m, "map<string,string>"), lambda _, v: v.rlike(r"^arn:[\w-]+:[\w-]+:[\w-]*:\d*:.+$"))))
        return F.coalesce(_meta("arn", m), _meta("attributes.arn", m), *named, F.try_element_at(fields, F.lit(1))["value"])

    return F.when(F.col("type").isin("terraform_resource", "terraform_data"), once("metadata", found))


def arn_matcher(least: float = 0, pattern: str | None = None, partial: bool = False, region: bool = False, account: bool = False) -> Matcher:
    """Equal service and resource: 100 with equal partitions, else 67; with `region` or `account` these are parts of the share as well. Nodes meet by service and the resource's type and id.

    With a pattern, in which * stands for any text, only ARNs that match it
    count; with `partial` also those of its service.
    """

    def good(key: Column) -> Column:
        if pattern is None:
            return key.startswith("arn:")
        service = pattern.split(":")[2] if pattern.count(":") >= 2 else "*"
        p = arn_parts(key)
        near = F.lit(partial) & p.isNotNull() & (F.lit(service == "*") | (p["service"] == service))
        return key.startswith("arn:") & (F.rlike(key, arn_regex(F.lit(pattern))) | near)

    key = once(arn_of_metadata(), lambda k: F.when(good(k), k))
    block = once(arn_of_metadata(), lambda k: once(arn_parts(k), lambda p: F.concat_ws("|", p["service"], F.coalesce(p["resource_type"], F.lit("")), p["resource_id"])))
    return Matcher("arn", key, lambda a, b: arn_confidence(a["key"], b["key"], region, account), least, block)


def resource_id_matcher(path: str = "id", least: float = 0, extract: str | None = None) -> Matcher:
    """Equal ids in lower case, without placeholders; 100 for one resource type, else 95.

    The id is at `path` of the metadata, or of its attributes, or else the
    first of the usual places. `extract` is a pattern whose first group, or
    whole match without one, is the id; nodes that it doesn't match drop out.
    """
    found = once("metadata", lambda m: F.coalesce(*[_meta(p, m) for p in (path, f"attributes.{path}", "id", "name", "unique_id", "resource_id", f"{path}_id")]))
    if extract is not None:
        found = F.regexp_extract(found, extract, 1 if re.compile(extract).groups else 0)
    sure = lambda k: (k != "") & ~k.rlike(r"^(\$\{|<|unknown|null$|computed)")
    key = once(F.lower(F.trim(found)), lambda k: F.when(sure(k), k))
    return Matcher("resource_id", key, lambda a, b: F.when(a["kind"].eqNullSafe(b["kind"]), 100.0).otherwise(95.0), least, same="kind")


def name_matcher(least: float = 0, namespaced: bool = False, threshold: float | None = None, block: Column | None = None) -> Matcher:
    """Equal names in lower case: 100 for one node type, else 95. With a threshold also names alike by so many percent, among all or those of one block."""
    name = F.lower("name")
    key = F.when(F.length(name) > 0, F.concat_ws("/", F.col("namespace"), name) if namespaced else name)
    longest = lambda a, b: F.greatest(F.length(a["key"]), F.length(b["key"]))
    fuzzy = lambda a, b: F.round(100 * (longest(a, b) - F.levenshtein(a["key"], b["key"])) / longest(a, b))
    same = lambda a, b: F.when(a["type"] == b["type"], 100.0).otherwise(95.0)
    if threshold is None:
        return Matcher("name", key, same, least, same="type")
    score = lambda a, b: F.when(a["key"] == b["key"], same(a, b)).when(fuzzy(a, b) >= threshold, fuzzy(a, b)).otherwise(0.0)
    if block is not None:
        return Matcher("name", key, score, least, block)
    return Matcher("name", key, score, least, alike=max(threshold, least or DEFAULT_LEAST))


@dataclass(frozen=True)
class Tag:
    """A tag that counts: with a value only that value, with a pattern only values that it finds."""

    key: str
    value: str | None = None
    pattern: str | None = None


def tag_entries(tags: list[str | Tag], mode: str = "all", metadata: Column | str = "metadata") -> Column:
    """The sorted entries key=value of the tags that count; null without any, and in mode "all" unless every tag counts."""
    asked = [Tag(t) if isinstance(t, str) else t for t in tags]

    def entry(t: Tag, m: Column) -> Column:
        good = lambda v: v.isNotNull() if t.value is None and t.pattern is None else v == t.value if t.value is not None else v.rlike(t.pattern)
        return once(F.coalesce(_meta(f"tags.{t.key}", m), _meta(f"attributes.tags.{t.key}", m)), lambda v: F.when(good(v), F.concat(F.lit(f"{t.key}="), v)))

    found = once(metadata, lambda m: F.array_sort(F.array_compact(F.array(*[entry(t, m) for t in asked]))))
    return once(found, lambda x: F.when(F.size(x) >= (len(asked) if mode == "all" else 1), x))


def tag_matcher(tags: list[str | Tag], least: float = 0) -> Matcher:
    """All the tags with equal values: 100. For shares of tags see `tag_matches`."""
    key = F.array_join(tag_entries(tags), "|")
    return Matcher("tag", key, lambda a, b: F.when(a["key"] == b["key"], 100.0).otherwise(0.0), least, same="key")


def tag_matches(nodes: DataFrame, tags: list[str | Tag], least: float = 0, mode: str = "all") -> DataFrame:
    """(source_repo, source, target_repo, target, strategy, confidence): pairs of resources of different repositories by the share of their entries that are equal, among all tags of both; 5 more, up to 100, for one kind of resource. A least confidence of zero counts as 80.

    A set-overlap join: of n entries so many must be shared that a pair of them
    meets in the n - shared + 1 rarest ones; only these are joined, and a pair
    counts where its first common one is.
    """
    threshold = least or DEFAULT_LEAST
    share = max(0.0, threshold - 5) / 100
    entries = once("metadata", lambda m: F.struct("repo_id", "id", _meta("resourceType", m).alias("kind"), tag_entries(tags, mode, m).alias("own")))
    own = checkpointed(known(nodes.filter("type = 'terraform_resource'"), entries, lambda x: x["own"].isNotNull()), "entries")  # read for the entries and for how frequent they are
    each = own.select("repo_id", "id", "kind", "own", F.explode("own").alias("entry"))
    frequent = own.select(F.explode("own").alias("entry")).groupBy("entry").agg(F.count("*").alias("of"))
    ranked = each.join(frequent, "entry").groupBy("repo_id", "id", "kind", "own").agg(F.array_sort(F.collect_list(F.struct("of", "entry"))).alias("r"))  # as many entries as tags
    kept = F.size("own") - F.greatest(F.ceil(F.size("own") * F.lit(share) - 1e-9), F.lit(1)) + 1
    first = F.transform(F.slice("r", F.lit(1), kept.cast("int")), lambda x: x["entry"])
    sides = ranked.select("repo_id", "id", "kind", "own", first.alias("first"))
    keyed = checkpointed(sides.select(F.struct("repo_id", "id", "kind", "own", "first").alias("x"), F.explode("first").alias("entry")), "tags")
    met = keyed.select(F.col("x").alias("a"), "entry").join(keyed.select(F.col("x").alias("b"), "entry"), "entry").filter("a.repo_id < b.repo_id and entry = array_intersect(a.first, b.first)[0]")
    key_of = lambda x: F.transform(x, lambda e: F.substring_index(e, "=", 1))
    shared, total = F.size(F.array_intersect("a.own", "b.own")), F.size(F.array_union(key_of(F.col("a.own")), key_of(F.col("b.own"))))
    base = shared / total * 100
    sure = F.when(F.col("a.kind").eqNullSafe(F.col("b.kind")), F.least(F.lit(100.0), base + 5)).otherwise(F.round(base))
    found = met.withColumn("confidence", sure).filter(F.col("confidence") >= threshold)
    return found.select(F.col("a.repo_id").alias("source_repo"), F.col("a.id").alias("source"), F.col("b.repo_id").alias("target_repo"), F.col("b.id").alias("target"), F.lit("tag").alias("strategy"), "confidence")


def _keyed(nodes: DataFrame, matcher: Matcher) -> DataFrame:
    """(x, block): what a matcher compares of each node that it takes."""
    x = F.struct("repo_id", "id", "type", _meta("resourceType").alias("kind"), matcher.key.alias("key")).alias("x")
    if matcher.block is None:
        return known(nodes, F.struct(x), lambda r: r["x"]["key"].isNotNull()).select("x", F.col("x.key").alias("block"))
    return known(nodes, F.struct(x, matcher.block.alias("block")), lambda r: r["x"]["key"].isNotNull() & r["block"].isNotNull())


def links(nodes: DataFrame, matchers: list[Matcher]) -> DataFrame:
    """(source_repo, source, target_repo, target, strategy, confidence): enough pairs to join what `all_matches` joins, and the best match of each group among them.

    Where all nodes of a block match, each is tied to the least one of the
    block, if the block has several repositories, so that a frequent name or
    tag gives as many rows as it has nodes. Other matchers give their matches.
    """
    found = None
    for matcher in matchers:
        if matcher.same is None or max(matcher.least, DEFAULT_LEAST) > 95:
            own = matches(nodes, matcher)
        else:
            x = _keyed(nodes, matcher)
            by_value = x.groupBy("block", F.col(f"x.{matcher.same}").alias("value")).agg(F.min(F.struct("x.repo_id", "x.id")).alias("hub"), F.min("x.repo_id").alias("low"), F.max("x.repo_id").alias("high"))
            certain = (F.col("low") != F.col("high")) & (F.col("value").isNotNull() | F.lit(matcher.same == "kind"))
            hubs = by_value.groupBy("block").agg(F.min("hub").alias("hub"), F.min("low").alias("low"), F.max("high").alias("high"), F.bool_or(certain).alias("certain")).filter("low <> high")
            met = x.join(hubs, "block").filter(F.struct("x.repo_id", "x.id") != F.col("hub"))
            own = met.select(F.col("hub.repo_id").alias("source_repo"), F.col("hub.id").alias("source"), F.col("x.repo_id").alias("target_repo"), F.col("x.id").alias("target"), F.lit(matcher.strategy).alias("strategy"), F.when(F.col("certain"), 100.0).otherwise(95.0).alias("confidence"))
        found = own if found is None else found.union(own)
    return found


def matches(nodes: DataFrame, matcher: Matcher) -> DataFrame:
    """(source_repo, source, target_repo, target, strategy, confidence): pairs of nodes of different repositories that meet in a block or by likeness, from the lesser repository to the greater.

    A least confidence of zero counts as 80.
    """
    own = wide(_keyed(nodes, matcher))
    met = own.select("block", F.col("x").alias("a")).join(own.select("block", F.col("x").alias("b")), "block").filter("a.repo_id < b.repo_id").select("a", "b")
    if matcher.alike is not None:
        names = own.select(F.col("x.key").alias("name"), "x.repo_id").distinct()
        near = wide(checkpointed(alike(names, names, matcher.alike, rising="repo_id"), "alike"))
        side = lambda end, s: own.select(F.col("x.key").alias(end), F.col("x").alias(s))
        met = met.union(near.join(side("left", "a"), "left").join(side("right", "b"), "right").filter("a.repo_id < b.repo_id").select("a", "b"))
    scored = met.withColumn("confidence", matcher.confidence(F.col("a"), F.col("b"))).filter(F.col("confidence") >= (matcher.least or DEFAULT_LEAST))
    return scored.select(F.col("a.repo_id").alias("source_repo"), F.col("a.id").alias("source"), F.col("b.repo_id").alias("target_repo"), F.col("b.id").alias("target"), F.lit(matcher.strategy).alias("strategy"), "confidence")


def all_matches(nodes: DataFrame, matchers: list[Matcher]) -> DataFrame:
    """Each pair of nodes once, by its best match; on ties the matcher that comes first."""
    found = None
    for order, matcher in enumerate(matchers):
        own = matches(nodes, matcher).withColumn("order", F.lit(order))
        found = own if found is None else found.union(own)
    best = F.max_by(F.struct("strategy", "confidence"), F.struct("confidence", -F.col("order")))
    return found.groupBy("source_repo", "source", "target_repo", "target").agg(best.alias("b")).select("source_repo", "source", "target_repo", "target", "b.*")


def _end(repo: str, node: str) -> Column:
    return F.concat(repo, F.lit("/"), node)


def groups(found: DataFrame) -> DataFrame:
    """(repo_id, id, group, confidence, strategy): nodes that matches join, with the best match of their group."""
    links = checkpointed(found.select(_end("source_repo", "source").alias("source"), _end("target_repo", "target").alias("target"), "strategy", "confidence"), "links")  # read for edges, loops and the best match
    parts = checkpointed(connected_components(links), "groups")
    best = links.join(parts.withColumnRenamed("node", "source"), "source").groupBy("component").agg(F.max("confidence").alias("confidence"), F.max_by("strategy", F.struct("confidence", "strategy")).alias("strategy"))
    cut = F.instr("node", "/")
    return parts.join(best, "component").select(F.expr("substring(node, 1, instr(node, '/') - 1)").alias("repo_id"), F.col("node").substr(cut + 1, F.length("node")).alias("id"), F.col("component").alias("group"), "confidence", "strategy")


def merged_nodes(nodes: DataFrame, grouped: DataFrame) -> DataFrame:
    """(id, name, type, source_ids, source_repos, strategy, confidence): a node for each group; its name the most frequent one, on ties the first in the order of (repo, id); its type the first's; its id a hash of the members."""
    own = nodes.join(grouped, ["repo_id", "id"])
    at = F.struct("repo_id", "id")
    names = own.groupBy("group", "name").agg(F.count("*").alias("n"), F.min(at).alias("at"))
    most = names.groupBy("group").agg(F.max("n").alias("most"))
    names = names.join(most, "group").filter("n = most").groupBy("group").agg(F.min_by("name", "at").alias("name"))
    members = own.groupBy("group").agg(F.min_by("type", at).alias("type"), F.array_sort(F.collect_list(_end("repo_id", "id"))).alias("source_ids"), F.array_sort(F.collect_set("repo_id")).alias("source_repos"), F.first("strategy").alias("strategy"), F.first("confidence").alias("confidence"))
    return members.join(names, "group").select(F.substring(F.sha2(F.array_join("source_ids", "|"), 256), 1, 32).alias("id"), "name", "type", "source_ids", "source_repos", "strategy", "confidence")


def metadata_values(nodes: DataFrame, grouped: DataFrame) -> DataFrame:
    """(group, key, at, value, text, kind): each member's top-level metadata; text as it shows, kind array, object or other. Metadata that is no JSON object has none."""
    own = nodes.join(grouped, ["repo_id", "id"]).select("group", F.struct("repo_id", "id").alias("at"), F.explode(F.from_json("metadata", "map<string,variant>")).alias("key", "value"))
    schema = F.schema_of_variant("value")
    kind = F.when(schema.startswith("ARRAY"), "array").when(schema.startswith("OBJECT"), "object").otherwise("other")
    return own.select("group", "key", "at", "value", F.col("value").cast("string").alias("text"), kind.alias("kind"))


def merged_metadata(nodes: DataFrame, grouped: DataFrame, resolution: str = "first") -> DataFrame:
    """(group, key, value): top-level metadata of each group: equal values stay, others by `resolution`.

    first and last take that member's, in the order of (repo, id). merge goes by
    the first value: of an array all distinct items of the arrays, in order; of
    an object the fields of the objects, later ones over earlier, sorted by
    name; of anything else the first. error fails. Arrays and objects show as
    JSON, text as it stands.
    """
    own = metadata_values(nodes, grouped)
    values = own.groupBy("group", "key")
    match resolution:
        case "first":
            return values.agg(F.min_by("text", "at").alias("value"))
        case "last":
            return values.agg(F.max_by("text", "at").alias("value"))
        case "merge":
            own = checkpointed(own.withColumn("json", F.to_json("value")).drop("value"), "metadata")
            first = own.groupBy("group", "key").agg(F.min_by(F.struct("text", "kind"), "at").alias("f"), (F.min(F.struct("kind", "json")) != F.max(F.struct("kind", "json"))).alias("differ"))
            plain = first.filter(~F.col("differ") | (F.col("f.kind") == "other")).select("group", "key", F.col("f.text").alias("value"))
            open_ = own.join(first.filter("differ").select("group", "key", F.col("f.kind").alias("kind")), ["group", "key", "kind"])
            items = open_.filter("kind = 'array'").select("group", "key", "at", F.posexplode(F.transform(F.from_json("json", "array<variant>"), lambda v: F.to_json(v))).alias("i", "item"))
            items = items.groupBy("group", "key", "item").agg(F.min(F.struct("at", "i")).alias("first"))
            arrays = items.groupBy("group", "key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "item"))), lambda x: x["item"]), ",").alias("v"))
            fields = open_.filter("kind = 'object'").select("group", "key", "at", F.explode(F.from_json("json", "map<string,variant>")).alias("name", "x")).withColumn("x", F.to_json("x"))
            fields = fields.groupBy("group", "key", "name").agg(F.max_by("x", "at").alias("x"))
            quoted = F.expr("substring(to_json(array(name)), 2, length(to_json(array(name))) - 2)")
            objects = fields.groupBy("group", "key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", F.concat(quoted, F.lit(":"), "x").alias("f")))), lambda y: y["f"]), ",").alias("v"))
            whole = lambda kind, found, a, z: first.filter(F.col("differ") & (F.col("f.kind") == kind)).select("group", "key").join(found, ["group", "key"], "left").select("group", "key", F.concat(F.lit(a), F.coalesce("v", F.lit("")), F.lit(z)))
            return plain.union(whole("array", arrays, "[", "]")).union(whole("object", objects, "{", "}"))
        case "error":
            one = values.agg(F.min("text").alias("value"), F.max("text").alias("other"))
            return one.select("group", "key", F.when(F.col("value") == F.col("other"), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("conflict in "), F.col("key")))).alias("value"))
    raise ValueError(f"unknown resolution {resolution!r}")


def remapped_edges(edges: DataFrame, grouped: DataFrame, merged: DataFrame) -> DataFrame:
    """(source, target, type, cross_repo): edges (repo_id, source, target, type) between merged nodes, or the repository's own where nothing matched; no loops, each once.

    An edge crosses repositories if one of its ends was merged over several.
    """
    named = merged.select("id", F.explode("source_ids").alias("member"), (F.size("source_repos") > 1).alias("many"))
    end = lambda side: named.select(F.col("member").alias(f"m_{side}"), F.col("id").alias(f"n_{side}"), F.col("many").alias(f"x_{side}"))
    out = edges.withColumns({"m_source": _end("repo_id", "source"), "m_target": _end("repo_id", "target")}).join(end("source"), "m_source", "left").join(end("target"), "m_target", "left")
    a, b = F.coalesce("n_source", "m_source"), F.coalesce("n_target", "m_target")
    out = out.select(a.alias("source"), b.alias("target"), "type", (F.coalesce("x_source", F.lit(False)) | F.coalesce("x_target", F.lit(False))).alias("cross_repo")).filter("source <> target")
    return out.groupBy("source", "target", "type").agg(F.bool_or("cross_repo").alias("cross_repo"))
