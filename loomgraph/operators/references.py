"""References of configurations as rows: addresses resolved in an index, modules, dependencies, evidence of edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.graph import lookup
from ..sources.tables import wide

# The kind of a reference by its first word, and the edge type and confidence of each kind.
KINDS = {"var": "variable", "local": "local", "module": "module_output", "data": "data_source", "count": "count", "each": "for_each_key", "self": "whole", "path": "whole"}
CONFIDENCES = {"variable": 95, "local": 95, "module_output": 95, "data_source": 95, "attribute": 90, "whole": 85, "index": 80, "splat": 80}
EDGE_TYPES = {"module_output": "output_value", "data_source": "data_reference", "variable": "input_variable", "local": "local_reference", "provider": "provider_alias"}
# Words that refer to no node of their own.
CONTEXT = ("count", "each", "self", "path")
# Data sources whose type names the resources that they look up.
LOOKED_UP = ("aws_ami", "aws_vpc", "aws_subnet", "aws_security_group", "aws_iam_role", "aws_s3_bucket")
GRAM = 8


def edge_type_of(kind: Column) -> Column:
    """The edge type of a kind of reference; references for all others."""
    return F.coalesce(F.create_map(*[F.lit(x) for pair in EDGE_TYPES.items() for x in pair])[kind], F.lit("references"))


def resolved(refs: DataFrame, index: DataFrame) -> DataFrame:
    """(origin, ref, kind, edge_type, confidence, target, resolved, code) of references (origin, ref), looked up in an index (address, node).

    The address of `var.x`, `local.x` and `module.m` is their first two words,
    of `data.T.N` three, of a resource two. Variables and locals resolve to
    their address if the index lacks them. A reference to its own origin is
    CIRCULAR, an address that the index lacks NOT_FOUND, a single word UNKNOWN.
    """
    parts = F.split(F.regexp_replace("ref", r"\[[^\]]*\]", ""), r"\.")
    head, kinds = parts[0], F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    size = F.when(head == "data", 3).otherwise(2)
    own = F.when(F.contains("ref", F.lit("[*]")), "splat").when(F.contains("ref", F.lit("[")), "index").when(F.size(parts) == 2, "whole").otherwise("attribute")
    rows = refs.select("origin", "ref", head.alias("head"), F.size(parts).alias("n"), F.coalesce(kinds[head], own).alias("kind"), F.array_join(F.slice(parts, F.lit(1), size), ".").alias("address"), size.alias("size"))
    found = rows.join(index.select("address", F.col("node").alias("known")), "address", "left")
    free = F.col("head").isin(*CONTEXT)
    code = F.when(free, None).when(F.col("n") < F.col("size"), "UNKNOWN").when(F.col("address") == F.col("origin"), "CIRCULAR").when(F.col("known").isNull() & ~F.col("head").isin("var", "local"), "NOT_FOUND")
    target = F.when(free | code.isNotNull(), None).otherwise(F.coalesce("known", "address"))
    return found.select("origin", "ref", "kind", edge_type_of(F.col("kind")).alias("edge_type"), lookup(CONFIDENCES, F.col("kind"), 70).alias("confidence"), target.alias("target"), code.isNull().alias("resolved"), code.alias("code"))


def module_targets(sources: DataFrame, modules: DataFrame) -> DataFrame:
    """(config, source, target, synthetic) of module sources (config, directory, source): a local path is looked up among modules (path, node) as it stands and from its directory; all else is a node made of the source."""
    local = F.col("source").rlike(r"^(\.{0,2}/|[^:@]+$)") & ~F.col("source").rlike(r"^(git|s3|gcs|tfr|https?)(::|:)")
    steps = lambda path: F.split(F.regexp_replace(path, r"^\./", ""), "/")
    whole = F.aggregate(steps(F.concat_ws("/", "directory", "source")), F.array().cast("array<string>"), lambda a, s: F.when(s.isin("", "."), a).when((s == "..") & (F.size(a) > 0), F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(F.concat(a, F.array(s))))
    rows = sources.select("config", "source", local.alias("local"), F.array_join(whole, "/").alias("path"))
    own = modules.groupBy("path").agg(F.min("node").alias("node"))
    direct, relative = own.select(F.col("path").alias("source"), F.col("node").alias("a")), own.select("path", F.col("node").alias("b"))
    found = rows.join(direct, "source", "left").join(relative, "path", "left")
    target = F.when(F.col("local"), F.coalesce("a", "b"))
    return found.select("config", "source", F.coalesce(target, F.concat(F.lit("module:"), F.col("source"))).alias("target"), target.isNull().alias("synthetic"))


def hinted_edges(hints: DataFrame, configs: DataFrame, least: float = 0, keep_unresolved: bool = False) -> DataFrame:
    """(source, target, type, confidence) of hints (source, kind, path, confidences) to configurations (path, id); unresolved ones are left out or go to `unresolved:path`. The mean of a hint's confidences is to reach `least`."""
    mean = F.aggregate("confidences", F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size("confidences"), F.lit(0))
    found = hints.join(configs.select("path", F.col("id").alias("known")), "path", "left").withColumn("confidence", mean).filter(F.col("confidence") >= least)
    target = F.coalesce("known", F.concat(F.lit("unresolved:"), F.col("path"))) if keep_unresolved else F.col("known")
    return found.select("source", target.alias("target"), F.concat(F.lit("tg_"), F.col("kind")).alias("type"), F.round("confidence", 6).alias("confidence")).filter("target is not null")


def data_dependencies(data: DataFrame, resources: DataFrame) -> DataFrame:
    """(data, resource): data sources (id, kind) and all resources (id, kind) of the type that they look up."""
    looked_up = data.filter(F.col("kind").isin(*LOOKED_UP)).select(F.col("id").alias("data"), "kind")
    return looked_up.join(resources.select(F.col("id").alias("resource"), "kind"), "kind").select("data", "resource")


def evidence_of_edges(edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """(edge, evidence): evidence (id, edge_id, source, target, description) that names an edge (id, source, target, expression), or its ends, or whose description holds its expression.

    A description meets expressions by runs of letters: expressions of eight
    letters or more by that run of eight which the fewest descriptions have (a
    beginning may be common to all), each shorter length by its own.
    """
    edges, evidence = wide(edges), wide(evidence)
    out = edges.select(F.col("id").alias("edge"), F.col("id").alias("edge_id")).join(evidence.select(F.col("id").alias("evidence"), "edge_id"), "edge_id").select("edge", "evidence")
    out = out.union(edges.select(F.col("id").alias("edge"), "source", "target").join(evidence.select(F.col("id").alias("evidence"), "source", "target"), ["source", "target"]).select("edge", "evidence"))
    said = edges.filter(F.length("expression") > 0).select("expression").distinct().select("expression", F.least(F.length("expression"), F.lit(GRAM)).alias("k"))
    lengths = said.select("k").distinct()  # eight rows at most
    texts = evidence.filter("description is not null").select("description").distinct().join(F.broadcast(lengths), F.length("description") >= F.col("k"))
    runs = lambda text: F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - F.col("k") + 1), lambda i: F.substr(text, i, F.col("k"))))).alias("gram")
    grams = wide(texts.select("description", "k", runs(F.col("description"))))
    often = grams.groupBy("k", "gram").agg(F.count("*").alias("n"))
    rarest = wide(said.select("expression", "k", runs(F.col("expression")))).join(often, ["k", "gram"], "left").groupBy("expression", "k").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    holds = grams.join(rarest, ["k", "gram"]).filter(F.contains("description", "expression")).select("description", "expression").distinct()
    by_text = edges.select(F.col("id").alias("edge"), "expression").join(holds, "expression").join(evidence.select(F.col("id").alias("evidence"), "description"), "description").select("edge", "evidence")
    return out.union(by_text).distinct()
