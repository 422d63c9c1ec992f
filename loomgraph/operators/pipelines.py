"""CI pipelines as rows: triggers, jobs, statistics, and the links that needs, outputs, files and artifacts make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import field

# Kinds of triggers by the name a workflow gives them; other names are manual.
TRIGGERS = {
    "github_actions": {"push": "push", "pull_request": "pull_request", "pull_request_target": "pull_request", "schedule": "schedule", "workflow_dispatch": "workflow_dispatch", "repository_dispatch": "api"},
    "gitlab_ci": {"push": "push", "pushes": "push", "merge_requests": "pull_request", "merge_request_events": "pull_request", "schedules": "schedule", "web": "manual", "trigger": "manual", "api": "api", "triggers": "api", "tags": "tag"},
}
_TYPED = "array<struct<type:string>>"


def counted_map(df: DataFrame, key: Column, name: str) -> DataFrame:
    """One row: a map of how often each value that isn't null occurs, in the order of the values."""
    by = df.select(key.alias("k")).filter("k is not null").groupBy("k").agg(F.count("*").alias("n"))
    return by.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(name))


def _beside(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Frames of one row each, as one row."""
    out = first.withColumn("_one", F.lit(1))
    for other in others:
        out = out.join(other.withColumn("_one", F.lit(1)), "_one")
    return out.drop("_one")


def config_stats(configs: DataFrame) -> DataFrame:
    """One row of configurations (metadata): how many, with remote state, with a source, sums of dependencies, includes and inputs, and backends."""
    number = lambda path: F.coalesce(F.sum(field("metadata", path, "long")), F.lit(0))
    backend = field("metadata", "remoteStateBackend")
    row = configs.agg(
        F.count("*").alias("configs"),
        F.count_if(F.coalesce(field("metadata", "hasRemoteState", "boolean"), F.lit(False))).alias("with_remote_state"),
        F.count(field("metadata", "terraformSource")).alias("with_source"),
        number("dependencyCount").alias("dependencies"),
        number("includeCount").alias("includes"),
        number("inputCount").alias("inputs"),
        F.count_distinct(backend).alias("backends"),
    )
    return _beside(row, counted_map(configs, backend, "by_backend"))


def with_counts(df: DataFrame, *columns: str) -> DataFrame:
    """`df` with a column n_<column> for each of `columns`: how many rows have the row's value, zero for null. Counts are made before they are joined."""
    for c in columns:
        by = df.groupBy(F.col(c).alias("_k")).agg(F.count("*").alias(f"n_{c}"))
        df = df.join(by, df[c] == by["_k"], "left").drop("_k").withColumn(f"n_{c}", F.coalesce(f"n_{c}", F.lit(0)))
    return df


def flow_stats(edges: DataFrame) -> DataFrame:
    """One row of data flows (source, target, confidence, flow_mechanism, pipeline_type): how many, average, bands at 80 and 50, distinct ends and their ratio, and flows by mechanism and pipeline type."""
    c = F.col("confidence")
    ends = F.count_distinct("source"), F.count_distinct("target")
    row = edges.agg(F.count("*").alias("flows"), F.round(F.coalesce(F.avg(c), F.lit(0.0)), 2).alias("average"), F.count_if(c >= 80).alias("high"), F.count_if((c >= 50) & (c < 80)).alias("medium"), F.count_if(c < 50).alias("low"), ends[0].alias("sources"), ends[1].alias("targets"))
    row = row.withColumn("ratio", F.coalesce(F.round(F.col("sources") / F.nullif(F.col("targets"), F.lit(0)), 2), F.lit(0.0)))
    return _beside(row, counted_map(edges, F.coalesce("flow_mechanism", F.lit("unknown")), "by_mechanism"), counted_map(edges, F.coalesce("pipeline_type", F.lit("unknown")), "by_pipeline_type"))


def pipeline_stats(pipelines: DataFrame, jobs: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: pipelines and jobs (id, metadata), those with Terraform, Helm, dependencies and infrastructure that they operate on, jobs a pipeline, and maps by pipeline type, trigger type and operation type (of edges)."""
    yes = lambda path: F.coalesce(field("metadata", path, "boolean"), F.lit(False))
    one = pipelines.agg(F.count("*").alias("pipelines"), F.count_if(yes("hasTerraformJobs")).alias("with_terraform"), F.count_if(yes("hasHelmJobs")).alias("with_helm"), F.round(F.coalesce(F.avg(field("metadata", "jobCount", "int")), F.lit(0.0)), 2).alias("jobs_per_pipeline"))
    operating = edges.filter("type = 'OPERATES_ON'")
    owned = jobs.join(operating.select(F.col("source").alias("id"), F.lit(True).alias("_on")).distinct(), "id", "left")
    needs = F.size(F.from_json(field("metadata", "dependsOn"), "array<string>")) > 0
    two = owned.agg(F.count("*").alias("jobs"), F.count_if(needs).alias("with_needs"), F.count("_on").alias("operating"))
    kinds = pipelines.select(F.explode(F.from_json(field("metadata", "triggers"), _TYPED)).alias("t"))
    return _beside(one, two, counted_map(pipelines, field("metadata", "pipelineType"), "by_pipeline_type"), counted_map(kinds, F.col("t.type"), "by_trigger"), counted_map(operating, F.col("operation_type"), "by_operation"))


def execution_summary(matches: DataFrame, merged: DataFrame) -> DataFrame:
    """One row of a rollup: matches, matches by strategy, merged nodes, and their average confidence."""
    return _beside(matches.agg(F.count("*").alias("matches")), counted_map(matches, F.col("strategy"), "by_strategy"), merged.agg(F.count("*").alias("merged"), F.round(F.avg("confidence"), 2).alias("average")))


def pipelines_by_trigger(pipelines: DataFrame, kind: str) -> DataFrame:
    """The pipelines that a trigger of this kind starts."""
    return pipelines.filter(F.exists(F.coalesce(F.from_json(field("metadata", "triggers"), _TYPED), F.array().cast(_TYPED)), lambda t: t["type"] == kind))


def jobs_of(jobs: DataFrame, pipeline: str) -> DataFrame:
    """(id, name, stage, has_terraform, has_helm) of a pipeline's jobs, in the order of their stages (test without one) and names."""
    operations = F.coalesce(F.from_json(field("metadata", "operations"), _TYPED), F.array().cast(_TYPED))
    has = lambda tool: F.exists(operations, lambda o: o["type"] == tool)
    own = jobs.filter(field("metadata", "pipelineId") == pipeline)
    return own.select("id", "name", field("metadata", "stage").alias("stage"), has("terraform").alias("has_terraform"), has("helm").alias("has_helm")).orderBy(F.coalesce("stage", F.lit("test")), "name")


def triggers(workflows: DataFrame, system: str = "github_actions") -> DataFrame:
    """(pipeline, type, branches, paths, tags) of workflows (pipeline, on): `on` is JSON, a name, a list of names, or an object of names with their filters."""
    on = F.col("on")
    names = F.when(on.startswith("["), F.from_json(on, "array<string>")).when(on.startswith("{"), F.json_object_keys(on)).otherwise(F.array(F.trim(F.regexp_replace(on, '"', ""))))
    rows = workflows.filter(on.isNotNull()).select("pipeline", on.alias("on"), F.explode(names).alias("name"))
    detail = F.from_json("on", "map<string,struct<branches:array<string>,paths:array<string>,tags:array<string>>>")[F.col("name")]
    known = F.create_map(*[F.lit(x) for pair in TRIGGERS[system].items() for x in pair])
    kind = F.coalesce(known[F.lower("name")], F.lit("manual"))
    return rows.select("pipeline", kind.alias("type"), F.when(on.startswith("{"), detail).alias("d")).select("pipeline", "type", "d.branches", "d.paths", "d.tags")


def job_id(pipeline: Column, job: Column) -> Column:
    """The id of a job's node: jobs of different pipelines may have one name."""
    return F.concat(pipeline, F.lit("/"), job)


def pipeline_graph(jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type) and edges (source, target, type, confidence) of jobs (pipeline, job, needs): a pipeline contains its jobs, and from each job that another one of its pipeline needs goes an edge to that one."""
    own = jobs.select("pipeline", "job", job_id(F.col("pipeline"), F.col("job")).alias("id"), "needs")
    nodes = own.select(F.col("pipeline").alias("id"), F.lit("ci_pipeline").alias("type")).distinct().union(own.select("id", F.lit("ci_job")).distinct())
    contains = own.select(F.col("pipeline").alias("source"), F.col("id").alias("target"), F.lit("PIPELINE_CONTAINS").alias("type")).distinct()
    wanted = own.select("pipeline", F.col("id").alias("target"), F.explode("needs").alias("job")).distinct()
    needs = wanted.join(own.select("pipeline", "job", F.col("id").alias("source")).distinct(), ["pipeline", "job"]).select("source", "target", F.lit("JOB_DEPENDS_ON").alias("type"))
    return nodes, contains.union(needs).withColumn("confidence", F.lit(100.0))


def job_edges(jobs: DataFrame) -> DataFrame:
    """(pipeline, source, target, type) of jobs (pipeline, job, needs, dependencies, extends): each array gives edges of its kind inside the pipeline, in the order needs, dependencies, extends; a pair is kept once, as the first."""
    empty = F.array().cast("array<string>")
    kinds = ("needs", "dependencies", "extends")
    rows = None
    for order, kind in enumerate(kinds):
        own = jobs.select("pipeline", F.col("job").alias("source"), F.explode(F.coalesce(F.col(kind), empty)).alias("target"), F.lit(kind).alias("type"), F.lit(order).alias("order"))
        rows = own if rows is None else rows.union(own)
    return rows.groupBy("pipeline", "source", "target").agg(F.min_by("type", "order").alias("type"))
