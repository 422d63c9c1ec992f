"""Data flows from end to end, links between jobs and infrastructure, their scores and sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.graph import FLOW_EDGES, FLOW_SOURCES, confidence_level, directory, flow_id, lookup, name_similarity, normal_path, path_segments, path_similarity, paths_related, tool_of
from ..sources.tables import Levels, bucketed, checkpointed, discard, wide
from .likeness import alike, holding
from .traverse import steps

# Base score of each flow pattern, weight of each kind of evidence.
PATTERN_SCORES = {"direct_output": 90, "output_to_env": 80, "output_to_file": 75, "output_to_secret": 85, "job_chain": 70, "artifact_transfer": 65, "matrix_propagation": 60, "inferred": 40}
EVIDENCE_WEIGHTS = {"explicit_reference": 1.0, "expression_match": 0.9, "env_variable": 0.8, "artifact_path": 0.7, "job_dependency": 0.8, "naming_convention": 0.5, "step_proximity": 0.4, "semantic_match": 0.6, "file_path_match": 0.6}
TRANSFORMS = ("jq ", "yq ", "envsubst", "sed ", "awk ")
DESTINATIONS = ("helm", "kubernetes", "argocd")


def end_to_end_flows(nodes: DataFrame, edges: DataFrame, sources: DataFrame | None = None, max_nodes: int = 10) -> DataFrame:
    """(flow_id, source, target, path, confidence, pipeline, tools) of paths over data-flow edges from source nodes to deployed ones.

    Of each pair of ends the shortest path counts, ties by node ids; a path of
    up to `max_nodes` nodes is grown by one more. A search goes on behind the
    destinations that it comes to, and enters a node once for each source.
    Confidence is the mean of the edges; the last CI node on the path is the
    flow's pipeline.
    """
    spark = edges.sparkSession
    roots = sources if sources is not None else nodes.filter(F.col("type").isin(*FLOW_SOURCES)).select(F.col("id").alias("node"))
    own = checkpointed(steps(edges, "downstream", list(FLOW_EDGES)).select("here", "there", "confidence"), "own")
    going = own.select(F.col("here").alias("there"), F.lit(True).alias("goes")).distinct()
    kinds = wide(nodes.select(F.col("id").alias("there"), tool_of(F.col("type")).alias("tool"))).join(wide(going), "there", "left")
    moves, name = bucketed(own.join(kinds, "there").select("here", "there", "confidence", "tool", F.coalesce("goes", F.lit(False)).alias("goes")), "here", "moves")  # dealt out by where they start, so no level shuffles them
    first = nodes.select(F.col("id").alias("node"), tool_of(F.col("type")).alias("tool"))
    placed = Levels(spark, "flows")
    frontier = placed.add(roots.join(first, "node").select(F.col("node").alias("source"), "node", F.array("node").alias("path"), F.array("tool").alias("tools"), F.lit(0.0).alias("total"), F.lit(True).alias("goes")), 0)
    for depth in range(1, max_nodes + 1):
        ahead = wide(frontier.filter("goes").drop("goes"))
        grown = ahead.join(moves, ahead["node"] == moves["here"]).select("source", "there", "path", "tools", "tool", "total", "confidence", "goes")
        dealt = grown.repartition("source", "there")  # few ways meet, so that to sort them before they are dealt out gains nothing
        best = dealt.groupBy("source", "there").agg(F.min(F.struct("path", "tools", "tool", "total", "confidence", "goes")).alias("b"))
        new = best.select("source", F.col("there").alias("node"), F.concat("b.path", F.array("there")).alias("path"), F.concat("b.tools", F.array("b.tool")).alias("tools"), (F.col("b.total") + F.col("b.confidence")).alias("total"), "b.goes")
        frontier = placed.add(new.join(wide(placed.all().select("source", "node")), ["source", "node"], "left_anti"), depth)
        if frontier.filter("goes").isEmpty():
            break
    discard(own, moves)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    found = placed.all().filter("depth > 0").filter(F.element_at("tools", -1).isin(*DESTINATIONS))
    pipeline = F.filter(F.zip_with("path", "tools", lambda p, t: F.when(t == "ci", p)), lambda x: x.isNotNull())
    return found.select(flow_id(F.col("source"), F.col("node")).alias("flow_id"), "source", F.col("node").alias("target"), "path", F.round(F.col("total") / F.col("depth"), 6).alias("confidence"), F.try_element_at(pipeline, F.lit(-1)).alias("pipeline"), F.array_distinct("tools").alias("tools"), F.element_at("tools", -1).alias("end"))


def described(flows: DataFrame) -> DataFrame:
    """Flows with an arrow text."""
    return flows.withColumn("text", F.array_join("path", " -> "))


def filtered_flows(flows: DataFrame, least: float | None = None, source_tool: str | None = None, destination_tool: str | None = None, orchestrated: bool = False, limit: int | None = None) -> DataFrame:
    """Flows of `end_to_end_flows` that meet the conditions; with a limit the most confident ones, ties by flow_id."""
    if least is not None:
        flows = flows.filter(F.col("confidence") >= least)
    if source_tool:
        flows = flows.filter(F.col("tools")[0] == source_tool)
    if destination_tool:
        flows = flows.filter((F.col("end") if "end" in flows.columns else F.element_at("tools", -1)) == destination_tool)  # tools are distinct, so the last one may have come earlier
    if orchestrated:
        flows = flows.filter("pipeline is not null")
    return flows.orderBy(F.desc("confidence"), "flow_id").limit(limit) if limit else flows


def flow_levels(flows: DataFrame) -> DataFrame:
    """(level, flows): flows of each confidence level that any has."""
    return flows.groupBy(confidence_level(F.col("confidence")).alias("level")).agg(F.count("*").alias("flows"))


def flow_statistics(flows: DataFrame) -> DataFrame:
    """One row: flows, average confidence, bands at 80 and 50, flows with a pipeline, average edges."""
    c = F.col("confidence")
    return flows.agg(F.count("*").alias("flows"), F.round(F.avg(c), 6).alias("average"), F.count_if(c >= 80).alias("high"), F.count_if((c >= 50) & (c < 80)).alias("medium"), F.count_if(c < 50).alias("low"), F.count("pipeline").alias("orchestrated"), F.round(F.avg(F.size("path") - 1), 6).alias("edges"))


def flows_by_pipeline(flows: DataFrame) -> DataFrame:
    """(pipeline, flows, sources, targets), flows without a pipeline in a row of their own."""
    return flows.groupBy("pipeline").agg(F.count("*").alias("flows"), F.count_distinct("source").alias("sources"), F.count_distinct("target").alias("targets"))


def merged_flows(flows: DataFrame) -> DataFrame:
    """One row for each (source, target): largest confidence, the metadata of the strongest, earliest first detection, all evidence once."""
    best = F.max_by("metadata", F.struct("confidence", "metadata"))
    return flows.groupBy("source", "target").agg(F.max("confidence").alias("confidence"), best.alias("metadata"), F.min("first_detected").alias("first_detected"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence"))


def flow_score(pattern: Column, evidence: Column) -> Column:
    """(base, evidence, bonus, penalty, total, level) of a flow from its pattern and evidence array<struct<type,strength,snippet,description>>."""
    weight = lambda e: lookup(EVIDENCE_WEIGHTS, e["type"], 0.5)
    total = lambda f: F.aggregate(evidence, F.lit(0.0), lambda a, e: a + f(e))
    has = lambda *types: F.exists(evidence, lambda e: e["type"].isin(*types))
    says = lambda e, text: F.coalesce(e["snippet"].contains(text), F.lit(False)) | F.coalesce(e["description"].contains(text), F.lit(False))
    some = F.size(evidence) > 0
    base = lookup(PATTERN_SCORES, pattern, 40)
    strength = F.when(some, F.round(0.3 * total(lambda e: e["strength"] * weight(e)) / total(weight))).otherwise(0.0)
    number = lambda c, n: c.cast("double") * n
    needs = F.exists(evidence, lambda e: F.coalesce(e["snippet"].rlike(r"needs[.:]"), F.lit(False)) | F.coalesce(e["description"].contains("explicit reference"), F.lit(False)))
    explicit = has("explicit_reference")
    bonus = F.least(F.lit(20.0), number(explicit, 10) + number(has("job_dependency"), 5) + number(has("naming_convention"), 3) + number(needs & ~explicit, 5))
    weak = has("semantic_match", "step_proximity", "naming_convention") & ~has("explicit_reference", "expression_match", "job_dependency")
    changes = lambda text: F.exists(evidence, lambda e: says(e, text))
    changed = sum((number(changes(t), 3) for t in TRANSFORMS), F.lit(0.0))
    faint = F.size(F.filter(evidence, lambda e: e["strength"] < 50)) > F.size(evidence) / 2
    penalty = F.least(F.lit(25.0), number(weak, 5) + changed + number(pattern == "inferred", 5) + number(faint, 5))
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(base + strength + bonus - penalty)))
    return F.struct(base.alias("base"), strength.alias("evidence"), bonus.alias("bonus"), penalty.alias("penalty"), score.alias("total"), confidence_level(score).alias("level"))


def _bare(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"[-_\s]", "")


def _path_pairs(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """(path, file_path): pairs of distinct paths, all that are alike by 50 or more or related among them."""
    above = lambda d: F.concat(F.array(d), F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))), lambda i: F.substr(d, i, F.lit(1)) == "/"), lambda i: F.substr(d, F.lit(1), i - 1)))

    def keyed(df: DataFrame, path: str, up: str, down: str) -> DataFrame:
        """`up` keys are a path's directories, `down` keys itself and its directory; one side's up meet the other's down."""
        whole, segments = normal_path(F.col(path)), path_segments(F.col(path))
        n = F.size(segments)
        begins = F.transform(F.sequence(F.greatest(F.ceil(n * 0.495), F.lit(1)).cast("int"), F.greatest(n, F.lit(1))), lambda i: F.concat(F.lit("begin:"), F.array_join(F.slice(segments, F.lit(1), i), "/")))
        ups = F.transform(above(directory(whole)), lambda x: F.concat(F.lit(up), x))
        downs = F.transform(F.array(whole, directory(whole)), lambda x: F.concat(F.lit(down), x))
        return df.filter(F.col(path).isNotNull()).select(path, F.explode(F.array_distinct(F.concat(F.array(F.concat(F.lit("whole:"), whole)), begins, ups, downs))).alias("key"))

    met = wide(keyed(jobs, "path", "a:", "b:")).join(keyed(files, "file_path", "b:", "a:"), "key")
    return met.select("path", "file_path").distinct()


def job_links(jobs: DataFrame, nodes: DataFrame, least: float = 50, most: int = 5) -> DataFrame:
    """(job, node, score): for each job (job, path, name) its `most` best nodes (id, file_path, name).

    Paths alike by 80 or more score as alike as they are, by 50 or more less a
    tenth, related directories 60, else names 0.7 of their likeness. Pairs are
    found among distinct paths (common beginnings and directories) and among
    distinct names (alike, or one holds the other). Of the nodes of one path
    and name only the `most` first can be in a job's best.
    """
    alike_paths = path_similarity(F.col("path"), F.col("file_path"))
    by_path = F.when(alike_paths >= 80, alike_paths).when(alike_paths >= 50, alike_paths * 0.9).when(paths_related(F.col("path"), F.col("file_path")), 60.0)
    best = lambda df, by, order: df.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("n") <= most).drop("n")
    order = [F.desc("score"), "node"]
    jobs, ends = wide(jobs), wide(nodes.select(F.col("id").alias("node"), "file_path", F.col("name").alias("node_name")))
    paths = _path_pairs(jobs.select("path").distinct(), nodes.select("file_path").distinct()).withColumn("score", F.round(by_path, 4)).filter(F.col("score") >= least)
    near = best(paths.join(best(ends.select("node", "file_path"), ["file_path"], ["node"]), "file_path").select("path", "node", "score"), ["path"], order)
    found = jobs.select("job", "path").join(near, "path").select("job", "node", "score")

    bare = lambda df, name: df.select(_bare(F.col(name)).alias("name")).distinct()
    left, right = bare(jobs, "name"), bare(nodes, "name")
    names = checkpointed(holding(left, right).union(alike(left, right, least / 0.7)).distinct(), "names")
    kinds = jobs.select("path", "name").distinct().withColumn("left", _bare(F.col("name")))
    ends = best(ends, ["file_path", "node_name"], ["node"]).withColumn("right", _bare(F.col("node_name")))
    score = F.round(0.7 * name_similarity(F.col("name"), F.col("node_name")), 4)
    named = kinds.join(names, "left").join(ends, "right").filter(by_path.isNull()).withColumn("score", score).filter(F.col("score") >= least)
    named = best(named.select("path", "name", "node", "score"), ["path", "name"], order).select(F.col("path").alias("p"), F.col("name").alias("m"), "node", "score")
    found = found.union(jobs.join(named, F.col("path").eqNullSafe(F.col("p")) & (F.col("name") == F.col("m"))).select("job", "node", "score"))
    return best(found, ["job"], order)


def helm_links(operations: DataFrame, nodes: DataFrame, least: float = 50, most: int = 5) -> DataFrame:
    """(job, position, node, score): for each Helm operation (job, position, path, name, working_dir, command, namespace) its `most` best nodes (id, file_path, name, release, chart, chart_path, namespace), ties by id.

    95 for the release that the command names, 85 for a chart whose name holds
    the command's or is held by it, 75 for the namespace, the likeness of the
    working directory and the chart's path if it is 80 or more; a pair of the
    best of these. Without any, 55 for related directories, else 0.7 of the
    likeness of names of 60 or more. Of the nodes of one value, only the `most`
    first can be among an operation's best, so no value makes more pairs.
    """
    best = lambda df, by, order: df.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("n") <= most).drop("n")
    said = lambda pattern: F.nullif(_bare(F.regexp_extract("command", pattern, 1)), F.lit(""))
    release = F.coalesce(said(r"(?i)(?:install|upgrade)\s+(\S+)"), said(r"(?i)uninstall\s+(\S+)"))
    ops = operations.select("job", "position", "path", "name", "working_dir", release.alias("release"), said(r"(?i)(?:install|upgrade)\s+\S+\s+(\S+)").alias("chart"), F.nullif(_bare(F.col("namespace")), F.lit("")).alias("namespace"))
    ops = wide(checkpointed(ops, "operations"))
    ends = wide(nodes.select(F.col("id").alias("node"), "file_path", F.col("name").alias("node_name"), _bare(F.col("release")).alias("release"), _bare(F.col("chart")).alias("chart"), "chart_path", _bare(F.col("namespace")).alias("namespace")))
    key = ["job", "position"]
    shown = lambda df, score: df.select(*key, "node", score.cast("double").alias("score"))
    first = lambda column: best(ends.select(column, "node").filter(F.length(column) > 0), [column], ["node"])
    found = shown(ops.join(first("release"), "release"), F.lit(95)).union(shown(ops.join(first("namespace"), "namespace"), F.lit(75)))
    charts = holding(ops.select(F.col("chart").alias("name")), first("chart").select(F.col("chart").alias("name")))
    near = best(charts.join(first("chart").withColumnRenamed("chart", "right"), "right").select("left", "node"), ["left"], ["node"])
    found = found.union(shown(ops.join(near, ops["chart"] == near["left"]), F.lit(85)))
    dirs = ops.select(F.col("working_dir").alias("path")).distinct()
    paths = _path_pairs(dirs, ends.select(F.col("chart_path").alias("file_path")).distinct()).withColumn("score", path_similarity(F.col("path"), F.col("file_path"))).filter("score >= 80")
    placed = best(paths.join(first("chart_path").withColumnRenamed("chart_path", "file_path"), "file_path").select("path", "node", "score"), ["path"], [F.desc("score"), "node"])
    found = found.union(shown(ops.join(placed, ops["working_dir"] == placed["path"]), F.col("score")))
    beside = paths_related(directory(normal_path(F.col("path"))), directory(normal_path(F.col("file_path"))))
    related = _path_pairs(ops.select("path").distinct(), ends.select("file_path").distinct()).filter(beside)
    related = best(related.join(first("file_path"), "file_path").select("path", "node"), ["path"], ["node"])
    found = found.union(shown(ops.join(related, "path"), F.lit(55)))
    bare = lambda df, name: df.select(_bare(F.col(name)).alias("name")).distinct()
    left, right = bare(ops, "name"), bare(ends, "node_name")
    names = checkpointed(holding(left, right).union(alike(left, right, 60)).distinct(), "names")
    kinds = ops.select("path", "name").distinct().withColumn("left", _bare(F.col("name")))
    owners = best(ends.select("node", "file_path", "node_name"), ["file_path", "node_name"], ["node"]).withColumn("right", _bare(F.col("node_name")))
    likeness = name_similarity(F.col("name"), F.col("node_name"))
    named = kinds.join(names, "left").join(owners, "right").filter(~F.coalesce(beside, F.lit(False))).withColumn("score", likeness).filter("score >= 60").withColumn("score", F.round(F.col("score") * 0.7))
    named = best(named.select("path", "name", "node", "score"), ["path", "name"], [F.desc("score"), "node"]).select(F.col("path").alias("p"), F.col("name").alias("m"), "node", "score")
    found = found.union(shown(ops.join(named, F.col("path").eqNullSafe(F.col("p")) & (F.col("name") == F.col("m"))), F.col("score")))
    found = found.repartition(*key)  # an operation's rows together, once for their sum and for the best of them
    return best(found.groupBy(*key, "node").agg(F.round(F.max("score")).alias("score")).filter(F.col("score") >= least), key, [F.desc("score"), "node"])


def direct_needs(jobs: DataFrame) -> DataFrame:
    """(job, needs): distinct union of the arrays `needs` and `dependencies` of each job, in order, not closed over."""
    empty = F.array().cast("array<string>")
    return jobs.select("job", F.array_distinct(F.concat(F.coalesce("needs", empty), F.coalesce("dependencies", empty))).alias("needs"))


def stage_order(stages: DataFrame, pipeline: str = "pipeline", order: str = "position") -> DataFrame:
    """(pipeline, source, target): each stage before the next of its pipeline."""
    following = F.lead("stage").over(Window.partitionBy(pipeline).orderBy(order))
    return stages.select(pipeline, F.col("stage").alias("source"), following.alias("target")).filter("target is not null")
