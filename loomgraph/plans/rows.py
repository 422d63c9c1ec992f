"""Queries over rows of pipelines, references and debt, and such as compare the operators' own results, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import external as fx
from ..operators import debt, external, flows, impact, pipelines, references, rollup, stats, tables
from ..sources import property_graph as pg
from .registry import ARN_SQL, TOOL_SQL, plain, query


def listed(name: str) -> Column:
    """A map as text: key=value, in order."""
    return F.array_join(F.transform(F.map_entries(name), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias(name)


def rows(name: str, sql: str):
    """Register a query over (spark, sf_dir) whose SQL follows the common table expressions of rows as well."""
    return plain(name, f", {pg.ROWS_SQL} {sql}")


def counted_sql(table: str, key: str) -> str:
    return f"(SELECT coalesce(string_agg(k || '=' || n, ',' ORDER BY k), '') FROM (SELECT {key} AS k, count(*) AS n FROM {table} GROUP BY 1) WHERE k IS NOT NULL)"


# ---- pipelines


@rows("pipelines_by_trigger", "SELECT id FROM pipelines WHERE metadata LIKE '%\"type\":\"schedule\"%'")
def pipelines_by_trigger(spark, sf_dir):
    return pipelines.pipelines_by_trigger(pg.pipelines(spark, sf_dir), "schedule").select("id")


@rows("pipeline_jobs", "SELECT id, name, metadata->>'stage' AS stage, metadata LIKE '%\"type\":\"terraform\"%' AS has_terraform, metadata LIKE '%\"type\":\"helm\"%' AS has_helm FROM jobs WHERE pipeline = 'pipeline:7'")
def pipeline_jobs(spark, sf_dir):
    return pipelines.jobs_of(pg.jobs(spark, sf_dir), "pipeline:7")


@rows("pipeline_stats", f"""SELECT (SELECT count(*) FROM pipelines) AS pipelines, (SELECT count(*) FROM pipelines WHERE metadata->>'hasTerraformJobs' = 'true') AS with_terraform, (SELECT count(*) FROM pipelines WHERE metadata->>'hasHelmJobs' = 'true') AS with_helm,
  (SELECT round(avg((metadata->>'jobCount')::INTEGER), 2) FROM pipelines) AS jobs_per_pipeline, (SELECT count(*) FROM jobs) AS jobs, (SELECT count(*) FROM jobs WHERE len(needs) > 0) AS with_needs, (SELECT count(*) FROM jobs WHERE id IN (SELECT source FROM edges WHERE type = 'OPERATES_ON')) AS operating,
  {counted_sql('pipelines', "metadata->>'pipelineType'")} AS by_pipeline_type, {counted_sql("(SELECT unnest(regexp_extract_all(metadata, '[{]\"type\":\"([a-z]+)\"', 1)) AS t FROM pipelines)", 't')} AS by_trigger,
  {counted_sql("(SELECT CASE WHEN confidence >= 70 THEN 'apply' ELSE 'plan' END AS o FROM edges WHERE type = 'OPERATES_ON')", 'o')} AS by_operation""")
def pipeline_stats(spark, sf_dir):
    edges = pg.edges(spark, sf_dir).filter("type = 'OPERATES_ON'").withColumn("operation_type", F.when(F.col("confidence") >= 70, "apply").otherwise("plan"))
    row = pipelines.pipeline_stats(pg.pipelines(spark, sf_dir), pg.jobs(spark, sf_dir), edges)
    maps = ("by_pipeline_type", "by_trigger", "by_operation")
    return row.select(*[c for c in row.columns if c not in maps], *map(listed, maps))


@query("config_stats", f"""SELECT count(*) AS configs, 0::BIGINT AS with_remote_state, 0::BIGINT AS with_source, coalesce(sum((metadata->>'dependencyCount')::INTEGER), 0)::BIGINT AS dependencies, 0::BIGINT AS includes, 0::BIGINT AS inputs, count(DISTINCT metadata->>'remoteStateBackend') AS backends, {counted_sql('nodes', "metadata->>'remoteStateBackend'")} AS by_backend FROM nodes""")
def config_stats(nodes, edges):
    row = pipelines.config_stats(nodes)
    return row.select(*[c for c in row.columns if c != "by_backend"], listed("by_backend"))


FLOW_ROWS = "f AS (SELECT *, CASE WHEN confidence >= 90 THEN 'direct' WHEN confidence >= 50 THEN 'artifact' END AS flow_mechanism, CASE WHEN implicit THEN 'gitlab_ci' ELSE 'github_actions' END AS pipeline_type FROM edges WHERE type = 'FEEDS_INTO')"


def _flows(edges):
    mechanism = F.when(F.col("confidence") >= 90, "direct").when(F.col("confidence") >= 50, "artifact")
    return edges.filter("type = 'FEEDS_INTO'").withColumns({"flow_mechanism": mechanism, "pipeline_type": F.when(F.col("implicit"), "gitlab_ci").otherwise("github_actions")})


@query("flow_stats", f""", {FLOW_ROWS} SELECT count(*) AS flows, round(avg(confidence), 2) AS average, count_if(confidence >= 80) AS high, count_if(confidence >= 50 AND confidence < 80) AS medium, count_if(confidence < 50) AS low, count(DISTINCT source) AS sources, count(DISTINCT target) AS targets,
  round(count(DISTINCT source) / count(DISTINCT target), 2) AS ratio, {counted_sql('f', "coalesce(flow_mechanism, 'unknown')")} AS by_mechanism, {counted_sql('f', 'pipeline_type')} AS by_pipeline_type FROM f""")
def flow_stats(nodes, edges):
    row = pipelines.flow_stats(_flows(edges))
    maps = ("by_mechanism", "by_pipeline_type")
    return row.select(*[c for c in row.columns if c not in maps], *map(listed, maps))


@query("flows_with_counts", f", {FLOW_ROWS} SELECT id, (SELECT count(*) FROM f g WHERE g.flow_mechanism = f.flow_mechanism) AS n_flow_mechanism, (SELECT count(*) FROM f g WHERE g.pipeline_type = f.pipeline_type) AS n_pipeline_type FROM f")
def flows_with_counts(nodes, edges):
    return pipelines.with_counts(_flows(edges), "flow_mechanism", "pipeline_type").select("id", "n_flow_mechanism", "n_pipeline_type")


@query("execution_summary", f", {ARN_SQL} SELECT count(*) AS matches, 'arn=' || count(*) AS by_strategy, count(*) AS merged, 100.0 AS average FROM m")
def execution_summary(nodes, edges):
    found = rollup.all_matches(nodes, [rollup.arn_matcher()])
    row = pipelines.execution_summary(found, rollup.merged_nodes(nodes, rollup.groups(found)))
    return row.select("matches", listed("by_strategy"), "merged", "average")


@plain("workflow_triggers", """, w AS (SELECT 'pipeline:' || c_custkey AS pipeline, c_custkey % 3 AS k, c_custkey % 5 AS b FROM customer)
  SELECT pipeline, 'push' AS type, NULL::VARCHAR AS branches FROM w WHERE k = 0 UNION ALL SELECT pipeline, unnest(['push', 'pull_request', 'manual']), NULL FROM w WHERE k = 1 UNION ALL SELECT pipeline, 'pull_request', 'main,b' || b FROM w WHERE k = 2 UNION ALL SELECT pipeline, 'schedule', NULL FROM w WHERE k = 2""")
def workflow_triggers(spark, sf_dir):
    k = F.col("c_custkey")
    on = F.when(k % 3 == 0, "push").when(k % 3 == 1, '["push","pull_request_target","label"]').otherwise(F.concat(F.lit('{"pull_request":{"branches":["main","b'), (k % 5).cast("string"), F.lit('"]},"schedule":null}')))
    found = pipelines.triggers(pg.table(spark, sf_dir, "customer").select(F.concat(F.lit("pipeline:"), k.cast("string")).alias("pipeline"), on.alias("on")))
    return found.select("pipeline", "type", F.array_join("branches", ",").alias("branches"))


@rows("pipeline_edges", "SELECT pipeline AS source, pipeline || '/' || name AS target, 'PIPELINE_CONTAINS' AS type FROM jobs UNION ALL SELECT b.pipeline || '/' || b.name, a.pipeline || '/' || a.name, 'JOB_DEPENDS_ON' FROM jobs a JOIN jobs b ON list_contains(a.needs, b.name) AND a.pipeline = b.pipeline")
def pipeline_edges(spark, sf_dir):
    return pipelines.pipeline_graph(pg.jobs(spark, sf_dir).select("pipeline", F.col("name").alias("job"), "needs"))[1].select("source", "target", "type")


@rows("job_edges", "SELECT pipeline, name AS source, unnest(needs) AS target, 'needs' AS type FROM jobs UNION ALL SELECT pipeline, name, pipeline, 'extends' FROM jobs")
def job_edges(spark, sf_dir):
    own = pg.jobs(spark, sf_dir)
    return pipelines.job_edges(own.select("pipeline", F.col("name").alias("job"), "needs", F.col("needs").alias("dependencies"), F.array("pipeline").alias("extends")))


# ---- references


@plain("resolved_references", """, r AS (SELECT 'nation:' || n_nationkey AS origin, unnest(['var.r' || n_regionkey, 'module.r' || n_regionkey || '.out', 'data.aws_vpc.r' || (n_regionkey + 2) || '.id', 'count.index', 'aws_vpc.r' || n_regionkey || '[0].id']) AS ref, n_regionkey AS k FROM nation)
  SELECT origin, ref, CASE split_part(ref, '.', 1) WHEN 'var' THEN 'input_variable' WHEN 'module' THEN 'output_value' WHEN 'data' THEN 'data_reference' ELSE 'references' END AS edge_type, CASE split_part(ref, '.', 1) WHEN 'count' THEN 70.0 WHEN 'aws_vpc' THEN 80.0 ELSE 95.0 END AS confidence,
    CASE WHEN ref LIKE 'var%' THEN 'var.r' || k WHEN ref LIKE 'module%' AND k < 3 THEN 'node-' || k WHEN ref LIKE 'data%' AND k + 2 < 4 THEN 'data-' || (k + 2) END AS target, CASE WHEN ref LIKE 'module%' AND k >= 3 THEN 'NOT_FOUND' WHEN ref LIKE 'data%' AND k + 2 >= 4 THEN 'NOT_FOUND' WHEN ref LIKE 'aws%' THEN 'NOT_FOUND' END AS code FROM r""")
def resolved_references(spark, sf_dir):
    k = F.col("n_regionkey")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    refs = pg.table(spark, sf_dir, "nation").select(text("nation:", F.col("n_nationkey")).alias("origin"), F.explode(F.array(text("var.r", k), text("module.r", k, ".out"), text("data.aws_vpc.r", k + 2, ".id"), F.lit("count.index"), text("aws_vpc.r", k, "[0].id"))).alias("ref"))
    region = pg.table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"))
    index = region.filter("k < 3").select(text("module.r", F.col("k")).alias("address"), text("node-", F.col("k")).alias("node")).union(region.filter("k < 4").select(text("data.aws_vpc.r", F.col("k")), text("data-", F.col("k"))))
    return references.resolved(refs, index).select("origin", "ref", "edge_type", "confidence", "target", "code")


@plain("module_targets", """, m AS (SELECT s_suppkey AS k, 'conf-' || s_suppkey AS config, CASE s_suppkey % 3 WHEN 0 THEN '../m' || (s_suppkey % 10) WHEN 1 THEN 'live/m' || (s_suppkey % 10) ELSE 'git::ssh://host/m' || s_suppkey || '.git' END AS source FROM supplier)
  SELECT config, source, CASE WHEN k % 3 < 2 AND k % 10 < 5 THEN 'mod-' || (k % 10) ELSE 'module:' || source END AS target, NOT (k % 3 < 2 AND k % 10 < 5) AS synthetic FROM m""")
def module_targets(spark, sf_dir):
    k = F.col("s_suppkey")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    source = F.when(k % 3 == 0, text("../m", k % 10)).when(k % 3 == 1, text("live/m", k % 10)).otherwise(text("git::ssh://host/m", k, ".git"))
    sources = pg.table(spark, sf_dir, "supplier").select(text("conf-", k).alias("config"), F.lit("live/app").alias("directory"), source.alias("source"))
    modules = spark.range(5).select(text("live/m", F.col("id")).alias("path"), text("mod-", F.col("id")).alias("node"))
    return references.module_targets(sources, modules)


@query("hinted_edges", "SELECT id AS source, CASE WHEN EXISTS (SELECT 1 FROM nodes t WHERE t.id = replace(n.id, 'customer', 'supplier')) THEN replace(id, 'customer', 'supplier') ELSE 'unresolved:' || replace(id, 'customer', 'supplier') END AS target, 'tg_include' AS type, (90.0 + line_start % 20) / 2 AS confidence FROM nodes n WHERE id LIKE 'customer:%' AND (90.0 + line_start % 20) / 2 >= 50")
def hinted_edges(nodes, edges):
    hints = nodes.filter("id like 'customer:%'").select(F.col("id").alias("source"), F.lit("include").alias("kind"), F.regexp_replace("id", "customer", "supplier").alias("path"), F.array(F.lit(90.0), (F.col("line_start") % 20).cast("double")).alias("confidences"))
    return references.hinted_edges(hints, nodes.select(F.col("id").alias("path"), "id"), 50, True)


@query("data_dependencies", "SELECT d.id AS data, r.id AS resource FROM nodes d JOIN nodes r ON r.type = 'terraform_module' WHERE d.type = 'terraform_output' AND d.line_start % 2 = 0")
def data_dependencies(nodes, edges):
    data = nodes.filter("type = 'terraform_output'").select("id", F.when(F.col("line_start") % 2 == 0, "aws_vpc").otherwise("aws_eip").alias("kind"))
    return references.data_dependencies(data, nodes.filter("type = 'terraform_module'").select("id", F.lit("aws_vpc").alias("kind")))


@query("evidence_of_edges", """, v AS (SELECT id, CASE WHEN id LIKE '%0' THEN id END AS edge_id, source, target, 'calls ' || id || ' here' AS description FROM edges WHERE type = 'depends_on')
  SELECT e.id AS edge, v.id AS evidence FROM edges e JOIN v ON e.id = v.edge_id UNION SELECT e.id, v.id FROM edges e JOIN v ON e.source = v.source AND e.target = v.target UNION SELECT e.id, v.id FROM edges e JOIN v ON contains(v.description, e.source) WHERE e.type = 'depends_on'""")
def evidence_of_edges(nodes, edges):
    some = edges.filter("type = 'depends_on'")
    evidence = some.select("id", F.when(F.col("id").endswith("0"), F.col("id")).alias("edge_id"), "source", "target", F.concat(F.lit("calls "), "id", F.lit(" here")).alias("description"))
    return references.evidence_of_edges(edges.withColumn("expression", F.when(F.col("type") == "depends_on", F.col("source"))), evidence)


@query("constructed_arns", "SELECT id, CASE WHEN line_start % 3 = 0 THEN 'arn:aws:s3:::' || name WHEN line_start % 3 = 1 THEN 'arn:aws:iam::*:role/' || name ELSE 'arn:aws:lambda:eu-west-1:*:function:' || name END AS arn FROM nodes WHERE type = 'terraform_resource'")
def constructed_arns(nodes, edges):
    kind = F.when(F.col("line_start") % 3 == 0, "aws_s3_bucket").when(F.col("line_start") % 3 == 1, "aws_iam_role").otherwise("aws_lambda_function")
    return nodes.filter("type = 'terraform_resource'").select("id", fx.arn_of(kind, F.col("name"), F.lit("eu-west-1"), F.lit(None).cast("string")).alias("arn"))


@query("ingress_references", "SELECT id AS node_id, unnest(['Secret', 'Service', 'Service']) AS kind, unnest(['tls-' || namespace, 'svc-' || line_start, 'web']) AS name FROM nodes WHERE type = 'k8s_deployment'")
def ingress_references(nodes, edges):
    spec = F.concat(F.lit('{"tls":[{"secretName":"tls-'), "namespace", F.lit('"},{}],"rules":[{"paths":[{"serviceName":"svc-'), F.col("line_start").cast("string"), F.lit('"}]},{"paths":[{"serviceName":"web"}]},{}]}'))
    return external.ingress_references(nodes.filter("type = 'k8s_deployment'").withColumn("spec", spec))


@query("role_references", "SELECT id AS node_id, CASE WHEN line_start % 2 = 0 THEN 'ClusterRole' ELSE 'Role' END AS kind, 'r' || line_start AS name FROM nodes WHERE type = 'k8s_deployment' UNION ALL SELECT id, 'ServiceAccount', unnest([namespace || '/a', 'default/b']) FROM nodes WHERE type = 'k8s_deployment'")
def role_references(nodes, edges):
    kind = F.when(F.col("line_start") % 2 == 0, "ClusterRole").otherwise("Role")
    spec = F.concat(F.lit('{"roleRef":{"kind":"'), kind, F.lit('","name":"r'), F.col("line_start").cast("string"), F.lit('"},"subjects":[{"kind":"ServiceAccount","name":"a","namespace":"'), "namespace", F.lit('"},{"kind":"ServiceAccount","name":"b"},{"kind":"User","name":"u"}]}'))
    return external.role_references(nodes.filter("type = 'k8s_deployment'").withColumn("spec", spec))


@query("arn_matches_across_partitions", f", {ARN_SQL} SELECT source, target, 67.0::DOUBLE AS confidence FROM m")
def arn_matches_across_partitions(nodes, edges):
    moved = F.when(F.col("repo_id") == "repo-1", F.regexp_replace("metadata", "arn:aws:", "arn:aws-cn:")).otherwise(F.col("metadata"))
    return rollup.matches(nodes.withColumn("metadata", moved), rollup.arn_matcher(60)).select("source", "target", "confidence")


@query("resource_id_matches", "SELECT a.id AS source, b.id AS target, CASE WHEN a.metadata->>'resourceType' = b.metadata->>'resourceType' THEN 100.0 ELSE 95.0 END::DOUBLE AS confidence FROM nodes a JOIN nodes b ON a.type = 'terraform_resource' AND b.type = a.type AND a.repo_id < b.repo_id AND regexp_extract(a.metadata, 'bucket-([0-9]+)', 1) = regexp_extract(b.metadata, 'bucket-([0-9]+)', 1)")
def resource_id_matches(nodes, edges):
    named = nodes.withColumn("metadata", F.regexp_replace("metadata", '"arn":', '"unique_id":'))
    return rollup.matches(named, rollup.resource_id_matcher("bucket", extract=r"bucket-(\d+)")).select("source", "target", "confidence")


@query("critical_paths", f""", t AS (SELECT id, {TOOL_SQL.format('type')} AS tool FROM nodes), d AS (SELECT target AS node FROM edges WHERE source = 'orders:3' UNION SELECT source FROM edges WHERE target = 'orders:3'),
  c AS (SELECT node, tool FROM d JOIN t ON t.id = d.node WHERE tool <> 'ci' QUALIFY row_number() OVER (PARTITION BY tool ORDER BY node) <= 3), b AS (SELECT 'orders:3' AS node, ['orders:3'] AS path UNION SELECT e.target, list_append(b.path, e.target) FROM b JOIN edges e ON e.source = b.node WHERE len(b.path) < 5 AND NOT list_contains(b.path, e.target))
  SELECT c.tool, c.node, array_to_string(path, '>') AS path FROM c JOIN (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY node ORDER BY len(path), path) = 1) w USING (node)""")
def critical_paths(nodes, edges):
    return impact.critical_paths(nodes, edges, "orders:3").select("tool", "node", F.array_join("path", ">").alias("path"))


# ---- debt


@rows("debt_summary", "SELECT count_if(status IN ('open', 'in-progress')) AS items, round(coalesce(sum(hours) FILTER (status IN ('open', 'in-progress')), 0), 6)::DOUBLE AS hours, count_if(created_at >= TIMESTAMP '2024-02-01') AS added, count_if(resolved_at >= TIMESTAMP '2024-02-01') AS resolved, count_if(created_at >= TIMESTAMP '2024-02-01') - count_if(resolved_at >= TIMESTAMP '2024-02-01') AS net FROM debt")
def debt_summary(spark, sf_dir):
    return debt.summary(pg.debt(spark, sf_dir), "2024-03-02")


@rows("debt_by_category", "SELECT category, count(*) AS items, round(coalesce(sum(hours) FILTER (status IN ('open', 'in-progress')), 0), 6)::DOUBLE AS hours FROM debt GROUP BY category")
def debt_by_category(spark, sf_dir):
    return debt.totals_by(pg.debt(spark, sf_dir), "category")


@rows("debt_files", "SELECT file_path, count(*) AS items, round(coalesce(sum(hours) FILTER (status IN ('open', 'in-progress')), 0), 6)::DOUBLE AS hours FROM debt GROUP BY file_path ORDER BY hours DESC, file_path LIMIT 10")
def debt_files(spark, sf_dir):
    return debt.top_files(pg.debt(spark, sf_dir))


WEIGHT_SQL = "CASE priority WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END"


@rows("debt_priorities", f"SELECT id, round(10 * {WEIGHT_SQL} * CASE category WHEN 'security-debt' THEN 1.5 WHEN 'design-debt' THEN 1.2 ELSE 1.0 END::DOUBLE / greatest(1, hours), 6) AS score FROM debt WHERE status IN ('open', 'in-progress') ORDER BY score DESC, id LIMIT 20")
def debt_priorities(spark, sf_dir):
    return debt.prioritized(pg.debt(spark, sf_dir))


@rows("quick_wins", f"SELECT id, priority, hours::DOUBLE AS hours FROM debt WHERE status IN ('open', 'in-progress') AND hours <= 2 AND priority IN ('critical', 'high') ORDER BY {WEIGHT_SQL} DESC, hours, id LIMIT 10")
def quick_wins(spark, sf_dir):
    return debt.quick_wins(pg.debt(spark, sf_dir))


# ---- filters that have no query elsewhere


@query("upsert_counts", "SELECT count_if(type = 'terraform_module') AS inserted, count_if(type = 'ci_job') AS updated FROM nodes")
def upsert_counts(nodes, edges):
    new = nodes.filter("type = 'ci_job'").select("id").union(nodes.filter("type = 'terraform_module'").select(F.concat("id", F.lit("x"))))
    return tables.upsert_counts(nodes.select("id"), new.union(new), ["id"])


@query("upsert_repeated_keys", "SELECT id, CASE WHEN type = 'terraform_output' THEN 'b' ELSE name END AS name FROM nodes")
def upsert_repeated_keys(nodes, edges):
    own = nodes.select("id", "name")
    new = nodes.filter("type = 'terraform_output'").select("id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("name"))
    return tables.upsert(own, new, ["id"])


@query("removed_nodes", "SELECT id FROM nodes WHERE NOT coalesce(namespace = 'ns-3', false)")
def removed_nodes(nodes, edges):
    return tables.without(nodes, F.col("namespace") == "ns-3").select("id")


@query("inserted_nodes", "SELECT id || 'n' AS id FROM nodes WHERE type = 'terraform_output'")
def inserted_nodes(nodes, edges):
    own = nodes.filter("type = 'terraform_output'").select("id")
    new = own.union(own.select(F.concat("id", F.lit("n")))).union(own.select(F.concat("id", F.lit("n"))))
    return tables.insert_missing(own, new, ["id"])


@query("unnested_rows", "SELECT id, unnest([1, 2]) AS n FROM nodes WHERE type = 'terraform_module'")
def unnested_rows(nodes, edges):
    own = nodes.filter("type = 'terraform_module'").select(F.array("id", "id").alias("id"), F.array(F.lit(1), F.lit(2)).alias("n"))
    return tables.unnest_rows(own, "id", "n")


@query("rows_of_json", "SELECT id, 1::BIGINT AS n FROM nodes WHERE type = 'terraform_module'")
def rows_of_json(nodes, edges):
    own = nodes.filter("type = 'terraform_module'").select(F.concat(F.lit('[{"id":"'), "id", F.lit('","n":1}]')).alias("j"))
    return tables.rows_of_json(own, "j", "id string, n long")


@query("owned_edges", "SELECT id FROM edges WHERE scan_id = 'scan-0' AND type = 'references'")
def owned_edges(nodes, edges):
    return tables.child_rows(edges.filter("type = 'references'"), nodes.select("scan_id", "tenant_id").distinct(), "scan_id", "scan_id", "tenant-0").select("id")


@query("tool_nodes", f"SELECT id, {TOOL_SQL.format('type')} AS tool FROM nodes WHERE {TOOL_SQL.format('type')} IN ('helm', 'kubernetes')")
def tool_nodes(nodes, edges):
    return stats.nodes_of_tools(nodes, ["helm", "kubernetes"]).select("id", "tool")


@query("cross_tool_summary", f", t AS (SELECT id, {TOOL_SQL.format('type')} AS tool FROM nodes), e AS (SELECT s.tool <> d.tool AS crossing, confidence FROM edges JOIN t s ON s.id = source JOIN t d ON d.id = target) SELECT (SELECT count(*) FROM nodes) AS nodes, count(*) AS edges, count_if(crossing) AS crossing, round(count_if(crossing) / count(*), 6) AS share, round(avg(confidence) FILTER (crossing), 4) AS average FROM e")
def cross_tool_summary(nodes, edges):
    return stats.cross_tool_summary(nodes, edges)


@query("flows_by_pipeline", "SELECT NULL::VARCHAR AS pipeline, count(*) AS flows, count(DISTINCT source) AS sources, count(DISTINCT target) AS targets FROM edges WHERE type = 'FEEDS_INTO'")
def flows_by_pipeline(nodes, edges):
    return flows.flows_by_pipeline(edges.filter("type = 'FEEDS_INTO'").select(F.lit(None).cast("string").alias("pipeline"), "source", "target"))


@query("merged_flows", "SELECT source, target, max(confidence) AS confidence, min(implicit::INT) AS first_detected, count(DISTINCT implicit) AS evidence FROM edges WHERE type IN ('depends_on', 'references') GROUP BY source, target")
def merged_flows(nodes, edges):
    own = edges.filter(F.col("type").isin("depends_on", "references")).select("source", "target", "confidence", "metadata", F.col("implicit").cast("int").alias("first_detected"), F.array(F.col("implicit").cast("string")).alias("evidence"))
    return flows.merged_flows(own.union(own)).select("source", "target", "confidence", "first_detected", F.size("evidence").cast("long").alias("evidence"))

