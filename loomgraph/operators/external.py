"""Index of external objects that nodes refer to."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.external import arn_regex, arns, normal_arn, provider_of, reference_hash, resource_ids
from ..sources.tables import checkpointed, wide


def references(nodes: DataFrame) -> DataFrame:
    """(scan_id, tenant_id, repo_id, node_id, type, external_id, normalized_id, reference_hash, provider): ARNs and cloud resource ids in the metadata of nodes."""
    text = F.col("metadata")
    arn = F.transform(F.array_distinct(arns(text)), lambda x: F.struct(F.lit("arn").alias("type"), x.alias("external_id")))
    own = F.transform(resource_ids(text), lambda x: F.struct(F.lit("resource_id").alias("type"), x.alias("external_id")))
    found = nodes.select("scan_id", "tenant_id", "repo_id", F.col("id").alias("node_id"), F.explode(F.concat(arn, own)).alias("x")).select("*", "x.*").drop("x")
    norm = F.when(F.col("type") == "arn", normal_arn(F.col("external_id"))).otherwise(F.lower(F.trim("external_id")))
    provider = F.when(F.col("type") == "arn", "aws").otherwise(provider_of(F.col("external_id")))
    return found.withColumns({"normalized_id": norm, "reference_hash": reference_hash(F.col("type"), F.col("external_id")), "provider": provider})


def kubernetes_references(nodes: DataFrame, column: str = "spec") -> DataFrame:
    """(node_id, kind, name): config maps, secrets, claims and service accounts that a pod spec (JSON) names, in the environment, volumes (also projected ones) and pull secrets."""
    ref = "struct<name:string>"
    env = f"envFrom:array<struct<configMapRef:{ref},secretRef:{ref}>>,env:array<struct<valueFrom:struct<configMapKeyRef:{ref},secretKeyRef:{ref}>>>"
    volume = f"configMap:{ref},secret:struct<secretName:string>,persistentVolumeClaim:struct<claimName:string>,projected:struct<sources:array<struct<configMap:{ref},secret:{ref}>>>"
    spec = f"struct<serviceAccountName:string,imagePullSecrets:array<{ref}>,containers:array<struct<{env}>>,volumes:array<struct<{volume}>>>"
    x = nodes.select(F.col("id").alias("node_id"), F.from_json(column, spec).alias("s"))
    named = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("name")))
    empty = F.array().cast("array<struct<kind:string,name:string>>")
    inner = lambda lists: F.flatten(F.filter(lists, lambda x: x.isNotNull()))
    at = lambda rows, *path: F.transform(rows, lambda e: reduce(lambda x, field: x[field], path, e))
    whole, keys = inner(F.col("s.containers.envFrom")), inner(F.col("s.containers.env"))
    projected = inner(F.col("s.volumes.projected.sources"))
    lists = [
        named("configmap", at(whole, "configMapRef", "name")),
        named("secret", at(whole, "secretRef", "name")),
        named("configmap", at(keys, "valueFrom", "configMapKeyRef", "name")),
        named("secret", at(keys, "valueFrom", "secretKeyRef", "name")),
        named("configmap", F.col("s.volumes.configMap.name")),
        named("secret", F.col("s.volumes.secret.secretName")),
        named("pvc", F.col("s.volumes.persistentVolumeClaim.claimName")),
        named("configmap", at(projected, "configMap", "name")),
        named("secret", at(projected, "secret", "name")),
        named("secret", F.col("s.imagePullSecrets.name")),
        named("serviceaccount", F.array("s.serviceAccountName")),
    ]
    return x.select("node_id", F.explode(F.array_distinct(F.concat(*[F.coalesce(v, empty) for v in lists]))).alias("r")).select("node_id", "r.*").filter("name is not null")


def ingress_references(nodes: DataFrame, column: str = "spec") -> DataFrame:
    """(node_id, kind, name): the secrets and services that an ingress (JSON with tls and rules) names."""
    x = nodes.select(F.col("id").alias("node_id"), F.from_json(column, "struct<tls:array<struct<secretName:string>>,rules:array<struct<paths:array<struct<serviceName:string>>>>>").alias("s"))
    secrets = x.select("node_id", F.lit("Secret").alias("kind"), F.explode("s.tls.secretName").alias("name"))
    services = x.select("node_id", F.explode("s.rules.paths").alias("p")).select("node_id", F.lit("Service").alias("kind"), F.explode("p.serviceName").alias("name"))
    return secrets.union(services).filter("length(name) > 0").distinct()


def role_references(nodes: DataFrame, column: str = "spec") -> DataFrame:
    """(node_id, kind, name): the role of a role binding (JSON with roleRef and subjects), and its service accounts as namespace/name, the namespace default if there is none."""
    x = nodes.select(F.col("id").alias("node_id"), F.from_json(column, "struct<roleRef:struct<kind:string,name:string>,subjects:array<struct<kind:string,name:string,namespace:string>>>").alias("s"))
    role = x.select("node_id", F.when(F.col("s.roleRef.kind") == "ClusterRole", "ClusterRole").otherwise("Role").alias("kind"), F.col("s.roleRef.name").alias("name"))
    subjects = x.select("node_id", F.explode("s.subjects").alias("t")).filter("t.kind = 'ServiceAccount'")
    accounts = subjects.select("node_id", F.lit("ServiceAccount"), F.concat_ws("/", F.coalesce(F.nullif("t.namespace", F.lit("")), F.lit("default")), "t.name"))
    return role.union(accounts).filter("name is not null").distinct()


def inverted(refs: DataFrame) -> DataFrame:
    """`refs` by term: the id in lower case and the normalised id."""
    return refs.withColumn("term", F.explode(F.array_distinct(F.array(F.lower("external_id"), "normalized_id"))))


def find(refs: DataFrame, external_id: str, types: list[str] | None = None, repos: list[str] | None = None) -> DataFrame:
    """Entries of an id or normalised id; a trailing * finds all that begin so."""
    id_, norm = F.col("external_id"), F.col("normalized_id")
    if external_id.endswith("*"):
        begin = external_id[:-1]
        hit: Column = id_.startswith(begin) | norm.startswith(begin.lower())
    else:
        hit = (id_ == external_id) | (norm == external_id.lower())
    found = refs.filter(hit)
    found = found.filter(F.col("type").isin(types)) if types else found
    return found.filter(F.col("repo_id").isin(repos)) if repos else found


# Letters at most of a literal at an end, and of one inside, that a key holds.
END, INSIDE = 32, 16


def _anchors(resource: str, open_: bool) -> list[tuple[int, int, int, str]]:
    """(prefix, suffix, inside, key) of a pattern's resource, one of which every resource that it matches has: its whole text without *, its literal ends, and its longest literal inside, by their lengths. With `open_` the beginning doesn't count."""
    if "*" not in resource and not open_:
        return [(-1, -1, 0, f"whole/{resource}")]
    first, *inner = resource.split("*")
    last = inner.pop() if inner else first
    first = "" if open_ else first[:END]
    last, longest = last[-END:], "" if open_ else max(inner, key=len, default="")[:INSIDE]
    ends = [(len(first), len(last), 0, f"ends{len(first)},{len(last)}/{first}*{last}")]
    return ends + [(0, 0, len(longest), f"inside{len(longest)}/{longest}")] * bool(longest)


def _keys(resource: str, prefix: int, suffix: int, inside: int) -> set[str]:
    """Keys by which a resource meets patterns whose literals have these lengths: one for a whole text or ends, its runs of that length for a literal inside."""
    if prefix < 0:
        return {f"whole/{resource}"}
    if inside:
        return {f"inside{inside}/{resource[i : i + inside]}" for i in range(len(resource) - inside + 1)}
    return {f"ends{prefix},{suffix}/{resource[:prefix]}*{resource[len(resource) - suffix :]}"} if max(prefix, suffix) <= len(resource) else set()


def _split(arn: str) -> list[str]:
    """Partition, service, region, account and resource of an ARN or pattern; empty for other texts."""
    parts = arn.split(":", 5)
    return parts[1:] if len(parts) == 6 and parts[0] == "arn" else []


def wildcard_matches(patterns: DataFrame, arns: DataFrame) -> DataFrame:
    """(pattern, arn): distinct ARN patterns (pattern) and the distinct ARNs (arn) that they match; * stands for any text. Texts that aren't of six parts match nothing.

    Patterns have a mask that says which of partition, service, region and
    account hold no *, and anchors in the resource: the whole, both literal
    ends, the longest literal inside. A pattern takes that of its anchors which
    the fewest ARNs have, so that one letter before a * doesn't meet them all.
    An ARN takes a key for each mask and lengths of literals that patterns
    have, and pairs meet by equal keys. A * in a part may reach over the parts
    behind it; such patterns, with a * in a part that isn't * alone, drop those
    parts from the mask and all but the end from the anchor.
    """

    def keys_of_patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("pattern").to_pylist():
                parts = _split(text)
                if not parts:
                    continue
                mask = "".join("." if "*" in p else "x" for p in parts[:4])
                if "*" in "".join(parts[:4]):  # it may swallow colons: what is before it stays sure, and the end of the text
                    first = next(i for i, p in enumerate(parts[:4]) if "*" in p)
                    mask = mask[:first] + "." * (4 - first)
                sure = "|".join(p for p, m in zip(parts, mask) if m == "x")
                rows += [(text, mask, prefix, suffix, inside, f"{sure}|{key}") for prefix, suffix, inside, key in _anchors(parts[4], "." in mask)]
            yield pa.record_batch([pa.array([r[i] for r in rows], pa.int32() if 1 < i < 5 else pa.string()) for i in range(6)], ["pattern", "mask", "prefix", "suffix", "inside", "key"])

    schema = "pattern string, mask string, prefix int, suffix int, inside int, key string"
    keyed = wide(checkpointed(patterns.select("pattern").filter("pattern is not null").distinct().mapInArrow(keys_of_patterns, schema), "patterns"))
    shapes = [tuple(r) for r in keyed.select("mask", "prefix", "suffix", "inside").distinct().collect()]  # masks, lengths of ends up to END, or one up to INSIDE

    def keys_of_arns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, keys = [], []
            for text in batch.column("arn").to_pylist():
                parts = _split(text)
                for mask, *lengths in shapes if parts else ():
                    sure = "|".join(p for p, m in zip(parts, mask) if m == "x")
                    found = _keys(parts[4], *lengths)
                    own += [text] * len(found)
                    keys += [f"{sure}|{key}" for key in found]
            yield pa.record_batch([pa.array(own, pa.string()), pa.array(keys, pa.string())], ["arn", "key"])

    own = wide(checkpointed(arns.select("arn").filter("arn is not null").distinct().mapInArrow(keys_of_arns, "arn string, key string").join(keyed.select("key").distinct(), "key", "left_semi"), "arns"))
    often = own.groupBy("key").agg(F.count("*").alias("n"))
    rarest = keyed.join(often, "key", "left").groupBy("pattern").agg(F.min_by("key", F.struct(F.coalesce("n", F.lit(0)), "key")).alias("key"))
    return own.join(rarest, "key").filter(F.rlike("arn", arn_regex(F.col("pattern")))).select("pattern", "arn").distinct()


def merged_index(old: DataFrame, new: DataFrame) -> DataFrame:
    """`old` with the entries of `new`, which replace those of the same node and scan."""
    fresh = new.select("node_id", "scan_id").distinct()
    return old.join(fresh, ["node_id", "scan_id"], "left_anti").unionByName(new)


def shared_objects(refs: DataFrame) -> DataFrame:
    """(normalized_id, nodes, repos) of objects that several repositories refer to."""
    return refs.groupBy("normalized_id").agg(F.count_distinct("repo_id", "node_id").alias("nodes"), F.count_distinct("repo_id").alias("repos")).filter("repos > 1")


def index_stats(refs: DataFrame) -> DataFrame:
    """One row: entries, distinct objects and nodes."""
    return refs.agg(F.count("*").alias("entries"), F.count_distinct("normalized_id").alias("objects"), F.count_distinct("node_id").alias("nodes"))


def top_objects(refs: DataFrame, n: int = 10) -> DataFrame:
    """(normalized_id, n): the `n` objects with most entries, ties by id."""
    return refs.groupBy("normalized_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "normalized_id").limit(n)
