"""Column functions on node and edge types, confidences, risks and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Impact weight of each edge type; other types weigh 5. An impact decays by DECAY for each move.
EDGE_WEIGHTS = {
    "depends_on": 10, "references": 8, "creates": 9, "destroys": 10, "module_call": 9, "module_source": 7, "module_provider": 6, "input_variable": 5, "output_value": 5, "local_reference": 4, "provider_config": 7,
    "provider_alias": 6, "data_source": 6, "data_reference": 5, "selector_match": 8, "namespace_member": 4, "volume_mount": 7, "service_target": 8, "ingress_backend": 8, "rbac_binding": 6, "configmap_ref": 5, "secret_ref": 7,
}
OTHER_WEIGHT, DECAY = 5, 0.7
# The tool of a node type by its beginning; others count as terraform.
TOOL_PREFIXES = {"terraform_": "terraform", "tg_": "terraform", "helm_": "helm", "k8s_": "kubernetes", "ci_": "ci", "argocd_": "argocd"}
TOOLS = ("terraform", "helm", "kubernetes", "ci", "argocd")
# Edge types along which data flows, and the node types at which flows begin.
FLOW_EDGES = ("FEEDS_INTO", "references", "output_value", "input_variable", "module_source", "configmap_ref", "secret_ref")
FLOW_SOURCES = ("terraform_output", "terraform_resource", "tg_config")
# Least confidence of each level.
LEVELS = {"certain": 95, "high": 80, "medium": 60, "low": 40}


def lookup(values: dict[str, float], key: Column, other: float) -> Column:
    pairs = [F.lit(x) for k, v in values.items() for x in (k, float(v))]
    return F.coalesce(F.create_map(*pairs)[key], F.lit(float(other)))


def edge_weight(edge_type: Column) -> Column:
    return lookup(EDGE_WEIGHTS, edge_type, OTHER_WEIGHT)


def impact_score(depth: Column, edge_type: Column) -> Column:
    """Weight of the edge, decayed by the depth of its source."""
    return edge_weight(edge_type) * F.pow(F.lit(DECAY), depth)


def tool_of(node_type: Column) -> Column:
    chain = F.lit("terraform")
    for prefix, tool in reversed(TOOL_PREFIXES.items()):
        chain = F.when(node_type.startswith(prefix), tool).otherwise(chain)
    return chain


def confidence_level(score: Column) -> Column:
    chain = F.lit("uncertain")
    for level, least in sorted(LEVELS.items(), key=lambda x: x[1]):
        chain = F.when(score >= least, level).otherwise(chain)
    return chain


def risk_level(direct: Column, indirect: Column, cross: Column) -> Column:
    weighted = 2 * direct + indirect + 5 * cross
    return F.when(weighted < 10, "low").when(weighted < 30, "medium").when((weighted < 100) & (cross < 5), "high").otherwise("critical")


def impact_level(changes: Column, removals: Column, elements: Column) -> Column:
    """Of a diff: by the share of changed elements, and by the share of removals among changes."""
    ratio, removed = changes / F.nullif(elements, F.lit(0)), removals / F.greatest(changes, F.lit(1))
    level = F.when((ratio > 0.5) | (removed > 0.3), "critical").when((ratio > 0.25) | (removed > 0.15), "high").when((ratio > 0.1) | (removed > 0.05), "medium").otherwise("low")
    return F.when(elements == 0, "low").otherwise(level)


def change_score(nodes_added: Column, nodes_removed: Column, nodes_modified: Column, edges_added: Column, edges_removed: Column, edges_modified: Column) -> Column:
    raw = nodes_added + 2 * nodes_removed + 0.5 * nodes_modified + 0.5 * edges_added + edges_removed + 0.25 * edges_modified
    return F.least(F.lit(100.0), F.round(20 * F.log10(raw + 1)))


def flow_id(source: Column, target: Column) -> Column:
    return F.concat(F.lit("flow-"), F.substring(F.sha2(F.concat(F.lit("flow:"), source, F.lit(":"), target), 256), 1, 16))


def feeds_into_id(source: Column, target: Column) -> Column:
    return F.concat(F.lit("feeds-into-"), F.substring(F.sha2(F.concat(F.lit("FEEDS_INTO:"), source, F.lit(":"), target), 256), 1, 16))


def normal_path(path: Column) -> Column:
    """Forward slashes, no leading ./ and no trailing slash, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^\./", ""), "/$", ""))


def identity_key(node_type: Column, name: Column, path: Column, namespace: Column, lower_path: bool = True) -> Column:
    """type::name::path[::namespace], the key by which snapshots are matched."""
    if not lower_path:
        return F.concat_ws(":", node_type, name, path)
    return F.concat_ws("::", node_type, name, normal_path(path), F.nullif(namespace, F.lit("")))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over the characters of an ASCII text, as eight hex digits."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    h = F.aggregate(codes, F.lit(2166136261).cast("long"), lambda a, c: F.pmod(a.bitwiseXOR(c) * 16777619, F.lit(1 << 32)))
    return F.lower(F.lpad(F.hex(h), 8, "0"))


def path_segments(path: Column) -> Column:
    return F.filter(F.split(normal_path(path), "/"), lambda s: s != "")


def path_similarity(a: Column, b: Column) -> Column:
    """100 times the common leading segments over the larger number of segments, rounded."""
    one, two = path_segments(a), path_segments(b)
    same = F.zip_with(one, two, lambda x, y: F.coalesce(x == y, F.lit(False)))
    state = F.aggregate(same, F.struct(F.lit(True).alias("on"), F.lit(0).alias("n")), lambda s, x: F.struct((s["on"] & x).alias("on"), (s["n"] + (s["on"] & x).cast("int")).alias("n")))
    return F.when(normal_path(a) == normal_path(b), F.lit(100.0)).otherwise(F.round(100 * state["n"] / F.greatest(F.size(one), F.size(two))))


def directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def paths_related(a: Column, b: Column) -> Column:
    a, b = normal_path(a), normal_path(b)
    under = lambda x, y: x.startswith(F.concat(y, F.lit("/")))
    da, db = directory(a), directory(b)
    return (a == b) | under(a, b) | under(b, a) | (da == db) | under(da, db) | under(db, da)


def name_similarity(a: Column, b: Column) -> Column:
    """Without - _ and white space: 100 if equal, 80 if one holds the other, else by edit distance."""
    bare = lambda x: F.regexp_replace(F.lower(x), r"[-_\s]", "")
    a, b = bare(a), bare(b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, 100.0).when(a.contains(b) | b.contains(a), 80.0).otherwise(F.round(100 * (longest - F.levenshtein(a, b)) / longest))


def version_constraints(text: Column) -> Column:
    """[(op, version)] of a comma list; no operator means =."""
    parts = F.transform(F.split(text, ","), lambda p: F.trim(p))
    return F.transform(parts, lambda p: F.struct(F.coalesce(F.nullif(F.regexp_extract(p, r"^(~>|>=|<=|!=|=|>|<)", 1), F.lit("")), F.lit("=")).alias("op"), F.trim(F.regexp_replace(p, r"^(~>|>=|<=|!=|=|>|<)", "")).alias("version")))


def module_source_kind(source: Column) -> Column:
    """local, github, git, s3, gcs, registry or unknown, the first that fits."""
    return (
        F.when(source.rlike(r"^\.{1,2}(/|$)"), "local")
        .when(source.rlike(r"^(github\.com/|git@github\.com:)"), "github")
        .when(source.rlike(r"^(git::|git@)|\.git(\?|$)"), "git")
        .when(source.rlike(r"^s3::"), "s3")
        .when(source.rlike(r"^gcs::"), "gcs")
        .when(source.rlike(r"^([a-z0-9.-]+\.[a-z]+/)?[A-Za-z0-9_-]+/[A-Za-z0-9_-]+/[A-Za-z0-9_-]+$"), "registry")
        .otherwise("unknown")
    )


def expressions(text: Column) -> Column:
    """The bodies of ${{ ... }} expressions."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\$\{\{\s*(.*?)\s*\}\}"), F.lit(1)), lambda x: F.trim(x))


def template_values(text: Column) -> Column:
    """Distinct paths after .Values in templates, in order of first use."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\.Values\.([A-Za-z0-9_.]*[A-Za-z0-9_])"), F.lit(1)))


def infrastructure_command(line: Column) -> Column:
    """terraform <command>, helm <command> or null, from a shell line."""
    tool = lambda name, words: F.regexp_extract(line, rf"(?:^|[\s;&|])({name})\s+(?:-\S+\s+)*({words})\b", 2)
    found = [(n, tool(n, w)) for n, w in (("terraform", "init|plan|apply|destroy|output|validate|import"), ("helm", "install|upgrade|template|lint|uninstall|rollback"))]
    return F.coalesce(*[F.when(c != "", F.concat(F.lit(f"{n} "), c)) for n, c in found])
