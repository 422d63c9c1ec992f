"""Queries for lookups, counts and filters of merged nodes, references, flows and steps, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import graph as fg
from ..operators import diff, external, flows, rollup, scoring, search, stats, tables
from ..sources import property_graph as pg
from ..sources.tables import table
from .registry import ARN_SQL, DIFF_SQL, FLOWS_SQL, LEVEL_SQL, TOOL_SQL, plain, query
from .rows import rows

# ---- kinds and fields


@query("nodes_of_kinds", "SELECT id FROM nodes WHERE type IN ('terraform_resource', 'helm_chart', 'k8s_deployment') AND type NOT IN ('helm_chart')")
def nodes_of_kinds(nodes, edges):
    return tables.of_kinds(nodes, ["terraform_resource", "helm_chart", "k8s_deployment"], ["helm_chart"]).select("id")


@query("edges_of_kinds", "SELECT id FROM edges WHERE type NOT IN ('module_call', 'FEEDS_INTO')")
def edges_of_kinds(nodes, edges):
    return tables.of_kinds(edges, exclude=["module_call", "FEEDS_INTO"]).select("id")


@query("nodes_at_field", "SELECT id FROM nodes WHERE metadata->>'segment' = 'BUILDING'")
def nodes_at_field(nodes, edges):
    return nodes.filter(tables.field("metadata", "segment") == "BUILDING").select("id")


@query("counts_of_kinds", "SELECT type, count(*) AS n FROM nodes WHERE type IN ('terraform_module', 'terraform_output', 'helm_chart') GROUP BY type")
def counts_of_kinds(nodes, edges):
    return stats.counts_by(tables.of_kinds(nodes, ["terraform_module", "terraform_output", "helm_chart"]), "type")


@query("graph_metadata", "SELECT 'nodes' AS what, type AS key, count(*) AS n FROM nodes GROUP BY type UNION ALL SELECT 'edges', type, count(*) FROM edges GROUP BY type UNION ALL SELECT 'files', file_path, count(*) FROM nodes GROUP BY file_path")
def graph_metadata(nodes, edges):
    return stats.graph_metadata(nodes, edges)


OPERATES_SQL = ", o AS (SELECT *, CASE WHEN confidence >= 70 THEN 'apply' ELSE 'plan' END AS operation FROM edges WHERE type = 'OPERATES_ON')"


def _operating(edges: DataFrame) -> DataFrame:
    return edges.filter("type = 'OPERATES_ON'").withColumn("operation_type", F.when(F.col("confidence") >= 70, "apply").otherwise("plan"))


@query("edges_by_operation", f"{OPERATES_SQL} SELECT id FROM o WHERE operation = 'apply'")
def edges_by_operation(nodes, edges):
    return tables.where(_operating(edges), equal={"operation_type": "apply"}).select("id")


@query("linking_stats", f"{OPERATES_SQL} SELECT operation, count(*) AS edges, count(DISTINCT source) AS jobs, count(DISTINCT target) AS targets, round(avg(confidence), 2) AS average, count_if(confidence >= 80) AS high, count_if(confidence >= 50 AND confidence < 80) AS medium, count_if(confidence < 50) AS low FROM o GROUP BY ROLLUP (operation)")
def linking_stats(nodes, edges):
    return stats.linking_stats(_operating(edges))


# ---- matches and merged nodes


MERGED_SQL = f", {ARN_SQL}, g AS (SELECT sha256('repo-0/' || source || '|repo-1/' || target)[:32] AS id, source, target, 100.0::DOUBLE AS confidence, 'terraform_resource' AS type FROM m)"


def _merged(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    grouped = rollup.groups(rollup.links(nodes, [rollup.arn_matcher()]))
    return grouped, rollup.merged_nodes(nodes, grouped)


@query("matches_of_node", f", {ARN_SQL} SELECT source, target, 'arn' AS strategy FROM m WHERE source = 'part:5' OR target = 'part:5'")
def matches_of_node(nodes, edges):
    return rollup.all_matches(nodes, [rollup.arn_matcher()]).filter("source = 'part:5' or target = 'part:5'").select("source", "target", "strategy")


@query("merged_of_node", f"{MERGED_SQL} SELECT id, type FROM g WHERE source = 'part:4'")
def merged_of_node(nodes, edges):
    return _merged(nodes)[1].filter(F.array_contains("source_ids", "repo-0/part:4")).select("id", "type")


@query("merged_filter", f"{MERGED_SQL} SELECT id FROM g WHERE confidence >= 90")
def merged_filter(nodes, edges):
    found = tables.where(_merged(nodes)[1], equal={"strategy": "arn"}, among={"type": ["terraform_resource", "helm_chart"]}, least={"confidence": 90})
    return found.filter(F.array_contains("source_repos", "repo-1")).select("id")


@query("ids_of_merged", f"{MERGED_SQL} SELECT 'repo-0/' || source AS original, id FROM g UNION ALL SELECT 'repo-1/' || target, id FROM g")
def ids_of_merged(nodes, edges):
    return _merged(nodes)[1].select(F.explode("source_ids").alias("original"), "id")


@query("merged_by_type", f"{MERGED_SQL} SELECT type, count(*) AS n FROM g GROUP BY type")
def merged_by_type(nodes, edges):
    return stats.counts_by(_merged(nodes)[1], "type")


@query("merged_bands", f"{MERGED_SQL} SELECT count_if(confidence >= 80) AS high, count_if(confidence >= 50 AND confidence < 80) AS medium, count_if(confidence < 50) AS low FROM g")
def merged_bands(nodes, edges):
    own = _merged(nodes)[1]
    return own.agg(*stats.banded(own))


@query("rollup_type_counts", f", {ARN_SQL} SELECT type, count(*) AS n FROM nodes WHERE id NOT IN (SELECT target FROM m) GROUP BY type")
def rollup_type_counts(nodes, edges):
    return stats.rollup_type_counts(nodes, *_merged(nodes))


@query("rollup_edge_counts", f""", {ARN_SQL}, x AS (SELECT 'repo-0/' || source AS k, source AS g FROM m UNION ALL SELECT 'repo-1/' || target, source FROM m),
e AS (SELECT DISTINCT e.type, coalesce(a.g, n.repo_id || '/' || e.source) AS s, coalesce(b.g, n.repo_id || '/' || e.target) AS t FROM edges e JOIN nodes n ON n.id = e.source LEFT JOIN x a ON a.k = n.repo_id || '/' || e.source LEFT JOIN x b ON b.k = n.repo_id || '/' || e.target)
SELECT type, count(*) AS n FROM e WHERE s <> t GROUP BY type""")
def rollup_edge_counts(nodes, edges):
    owned = edges.join(nodes.select(F.col("id").alias("source"), "repo_id"), "source")
    return stats.counts_by(rollup.remapped_edges(owned.select("repo_id", "source", "target", "type"), *_merged(nodes)), "type")


@plain("applied_diff", f"{DIFF_SQL} SELECT id FROM nodes WHERE concat_ws('::', type, name, lower(file_path), nullif(namespace, '')) NOT IN (SELECT key FROM nd WHERE change = 'removed')")
def applied_diff(spark, sf_dir):
    base, _, target, _ = pg.snapshots(spark, sf_dir)
    return diff.applied(base, diff.node_diff(base, target)).select("id")


# ---- references


@query("references_of_node", "SELECT 'arn' AS type, metadata->>'arn' AS external_id FROM nodes WHERE id = 'part:9'")
def references_of_node(nodes, edges):
    return external.references(nodes).filter("node_id = 'part:9'").select("type", "external_id")


@query("references_by_type", "SELECT 'arn' AS type, count(*) AS n FROM nodes WHERE metadata->>'arn' IS NOT NULL")
def references_by_type(nodes, edges):
    return stats.counts_by(external.references(nodes), "type")


@query("reference_count", "SELECT count(*) AS n FROM nodes WHERE metadata->>'arn' IS NOT NULL AND repo_id = 'repo-1'")
def reference_count(nodes, edges):
    return tables.where(external.references(nodes), equal={"repo_id": "repo-1", "provider": "aws"}).agg(F.count("*").alias("n"))


@plain("pod_references", """, r AS (SELECT 'pod:' || c_custkey AS node_id, c_custkey AS k FROM customer) SELECT node_id, 'serviceaccount' AS kind, 'sa-' || (k % 5) AS name FROM r UNION ALL SELECT node_id, 'secret', 'pull' FROM r UNION ALL SELECT node_id, 'configmap', 'cm-' || (k % 7) FROM r
UNION ALL SELECT node_id, 'secret', 'se-' || (k % 3) FROM r UNION ALL SELECT node_id, 'configmap', 'key' FROM r UNION ALL SELECT node_id, 'pvc', 'pvc-' || k FROM r UNION ALL SELECT node_id, 'secret', 'token' FROM r""")
def pod_references(spark, sf_dir):
    k = F.col("c_custkey")
    spec = F.format_string('{"serviceAccountName":"sa-%d","imagePullSecrets":[{"name":"pull"}],"containers":[{"envFrom":[{"configMapRef":{"name":"cm-%d"}},{"secretRef":{"name":"se-%d"}}],"env":[{"name":"A","valueFrom":{"configMapKeyRef":{"name":"key"}}}]},{"name":"bare"}],"volumes":[{"persistentVolumeClaim":{"claimName":"pvc-%d"}},{"projected":{"sources":[{"secret":{"name":"token"}}]}}]}', k % 5, k % 7, k % 3, k)
    return external.kubernetes_references(table(spark, sf_dir, "customer").select(F.concat(F.lit("pod:"), k.cast("string")).alias("id"), spec.alias("spec")))


# ---- flows


CHAINS_SQL = f""", {pg.CHAINED_SQL}, t AS (SELECT id, {TOOL_SQL.format('type')} AS tool FROM nodes), m AS (SELECT source, target, confidence, tool FROM chained JOIN t ON t.id = target WHERE chained.type IN ('FEEDS_INTO', 'references', 'output_value', 'secret_ref', 'configmap_ref')),
f AS (SELECT [id] AS path, ['terraform'] AS tools, 0.0::DOUBLE AS total FROM nodes WHERE type IN ('terraform_output', 'terraform_resource') UNION ALL SELECT list_append(path, target), list_append(tools, tool), total + confidence FROM f JOIN m ON m.source = path[-1] WHERE len(path) <= 10 AND NOT list_contains(path, target)),
g AS (SELECT * FROM f WHERE tools[-1] IN ('helm', 'kubernetes', 'argocd') QUALIFY row_number() OVER (PARTITION BY path[1], path[-1] ORDER BY len(path), path) = 1)"""


@plain("tool_chains", f"{CHAINS_SQL} SELECT path[1] AS source, path[-1] AS target, array_to_string(path, '>') AS path, round(total / (len(path) - 1), 6) AS confidence, list_filter(path, lambda x, i: tools[i] = 'ci')[-1] AS pipeline, array_to_string(list_filter(tools, lambda x, i: list_position(tools, x) = i), ',') AS tools FROM g")
def tool_chains(spark, sf_dir):
    found = flows.end_to_end_flows(pg.nodes(spark, sf_dir), pg.chained_edges(spark, sf_dir))
    return found.select("source", "target", F.array_join("path", ">").alias("path"), "confidence", "pipeline", F.array_join("tools", ",").alias("tools"))


@plain("tool_chain_statistics", f"{CHAINS_SQL} SELECT count(*) AS flows, round(avg(round(total / (len(path) - 1), 6)), 6) AS average, count_if(round(total / (len(path) - 1), 6) >= 80) AS high, count_if(round(total / (len(path) - 1), 6) >= 50 AND round(total / (len(path) - 1), 6) < 80) AS medium, count_if(round(total / (len(path) - 1), 6) < 50) AS low, count_if(list_contains(tools, 'ci')) AS orchestrated, round(avg(len(path) - 1), 6) AS edges FROM g")
def tool_chain_statistics(spark, sf_dir):
    return flows.flow_statistics(flows.end_to_end_flows(pg.nodes(spark, sf_dir), pg.chained_edges(spark, sf_dir)))


@query("described_flows", f"{FLOWS_SQL} SELECT flow_id, source || ' -> ' || target AS text, 'terraform,helm' AS tools FROM g")
def described_flows(nodes, edges):
    return flows.described(flows.end_to_end_flows(nodes, edges)).select("flow_id", "text", F.array_join("tools", ",").alias("tools"))


@query("flow_filter", f"{FLOWS_SQL} SELECT flow_id, confidence FROM g WHERE confidence >= 80 ORDER BY confidence DESC, flow_id LIMIT 25")
def flow_filter(nodes, edges):
    return flows.filtered_flows(flows.end_to_end_flows(nodes, edges), 80, "terraform", "helm", limit=25).select("flow_id", "confidence")


@query("flow_levels", f"{FLOWS_SQL} SELECT {LEVEL_SQL.format('confidence')} AS level, count(*) AS flows FROM g GROUP BY 1")
def flow_levels(nodes, edges):
    return flows.flow_levels(flows.end_to_end_flows(nodes, edges))


# ---- scores and search

RULES = [
    scoring.Rule("declared", ("module_source", "explicit_reference"), 30, 1.2, (("confidence", "gt", 60), ("category", "equals", "explicit"))),
    scoring.Rule("named", ("naming_convention",), 10, 0.8, (("category", "matches", "^s"), ("id", "contains", "7"))),
    scoring.Rule("any", ("interpolation",), 5, 1, (("edge_id", "exists", None), ("confidence", "lt", 30))),
    scoring.Rule("never", ("interpolation",), 5, 1, (("missing.path", "exists", None),)),
]


@plain("rule_results", """, h AS (SELECT edge_id, 'declared' AS rule, 36.0 AS part FROM evidence WHERE type IN ('module_source', 'explicit_reference') AND confidence > 60 AND category = 'explicit' UNION ALL SELECT edge_id, 'named', 8.0 FROM evidence WHERE type = 'naming_convention' AND category LIKE 's%' AND id LIKE '%7%'
UNION ALL SELECT edge_id, 'any', 5.0 FROM evidence WHERE type = 'interpolation' AND confidence < 30) SELECT edge_id, rule, count(*) AS matched, round(sum(part)::DOUBLE, 6) AS contribution FROM h GROUP BY ALL""")
def rule_results(spark, sf_dir):
    return scoring.rule_results(pg.evidence(spark, sf_dir), RULES)


TERMS_SQL = "list_filter(string_split_regex(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


@query("weighted_search", f""", d AS (SELECT id, {TERMS_SQL.format('name')} AS a, {TERMS_SQL.format('file_path')} AS c FROM nodes), q AS (SELECT unnest(['small', 'part']) AS word),
h AS (SELECT id, len(list_filter(a, lambda x: x = word)) AS na, len(list_filter(c, lambda x: x = word)) AS nc FROM d, q), s AS (SELECT id, min(na + nc) AS least, sum((SELECT coalesce(sum(CASE WHEN i <= na THEN 1.0 ELSE 0.2 END::DOUBLE / (i * i)), 0) FROM range(1, 40) t(i) WHERE i <= na + nc)) AS total FROM h GROUP BY id)
SELECT id, round(total / 1.64493406685 / 2, 6) AS rank FROM s WHERE least > 0 ORDER BY rank DESC, id LIMIT 50""")
def weighted_search(nodes, edges):
    return search.weighted_search(nodes, "Part, small")


# ---- texts


@rows("step_commands", "SELECT step, CASE WHEN text LIKE 'terraform%' THEN 'terraform output' ELSE 'helm upgrade' END AS command FROM steps")
def step_commands(spark, sf_dir):
    return pg.steps(spark, sf_dir).select("step", fg.infrastructure_command(F.col("text")).alias("command"))


@rows("step_expressions", "SELECT step, trim(regexp_extract(text, '[$][{][{](.*)[}][}]', 1)) AS expression FROM steps WHERE text LIKE '%${{%'")
def step_expressions(spark, sf_dir):
    return pg.steps(spark, sf_dir).select("step", F.explode(fg.expressions(F.col("text"))).alias("expression"))


SOURCES = ("./modules/x", "github.com/org/m", "git::https://host/x.git", "s3::https://b/x.zip", "gcs::https://b/x", "org/name/aws", "what?")


@plain("module_sources", "SELECT p_partkey, ['local', 'github', 'git', 's3', 'gcs', 'registry', 'unknown'][p_partkey % 7 + 1] AS kind FROM part")
def module_sources(spark, sf_dir):
    source = F.element_at(F.array(*map(F.lit, SOURCES)), (F.col("p_partkey") % len(SOURCES) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", fg.module_source_kind(source).alias("kind"))


@plain("version_lists", "SELECT p_partkey, '>=1.' || (p_partkey % 5) || ';~>2.0;=3' AS constraints FROM part")
def version_lists(spark, sf_dir):
    text = F.concat(F.lit(">= 1."), (F.col("p_partkey") % 5).cast("string"), F.lit(", ~>2.0 , 3"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(fg.version_constraints(text), lambda x: F.concat(x["op"], x["version"])), ";").alias("constraints"))


@plain("values_of_templates", "SELECT p_partkey, 'a' || (p_partkey % 5) || '.b,c' AS paths FROM part")
def values_of_templates(spark, sf_dir):
    text = F.format_string("{{ .Values.a%d.b }} {{ .Values.c | quote }} {{ .Values.a%d.b }}", F.col("p_partkey") % 5, F.col("p_partkey") % 5)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(fg.template_values(text), ",").alias("paths"))


# ---- links of Helm operations, overriding values, diffs in a row


@query("helm_links", """, op AS (SELECT 'orders:' || o_orderkey AS job, 0 AS position, 'supplier' || (o_custkey % 200) AS release, 'c' || (o_orderkey % 9) AS chart, 'ns' || (o_orderkey % 40) AS ns, 'charts/n' || (o_orderkey % 30) AS dir FROM orders),
  nd AS (SELECT id AS node, 'supplier' || split_part(id, ':', 2) AS release, 'mychartc' || (split_part(id, ':', 2)::BIGINT % 12) AS chart, replace(namespace, '-', '') AS ns, regexp_replace(file_path, '/[^/]*$', '') AS dir FROM nodes WHERE type = 'helm_chart'),
  x AS (SELECT job, position, node, greatest(CASE WHEN op.dir = nd.dir THEN 100.0 ELSE 0 END, CASE WHEN op.release = nd.release THEN 95.0 ELSE 0 END, CASE WHEN contains(nd.chart, op.chart) THEN 85.0 ELSE 0 END, CASE WHEN op.ns = nd.ns THEN 75.0 ELSE 0 END)::DOUBLE AS score FROM op JOIN nd ON op.dir = nd.dir OR op.release = nd.release OR contains(nd.chart, op.chart) OR op.ns = nd.ns)
  SELECT job, position, node, score FROM x QUALIFY row_number() OVER (PARTITION BY job ORDER BY score DESC, node) <= 5""")
def helm_links(nodes, edges):
    k = F.regexp_extract("id", r":(\d+)$", 1).try_cast("long")
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    customer = edges.filter("type = 'OPERATES_ON'").select(F.col("source").alias("id"), F.regexp_extract("target", r":(\d+)$", 1).cast("long").alias("c"))
    jobs = nodes.filter("type = 'ci_job'").join(customer, "id")
    command = text("helm upgrade --x supplier-", F.col("c") % 200, " c", k % 9)
    operations = jobs.select(F.col("id").alias("job"), F.lit(0).alias("position"), F.col("file_path").alias("path"), "name", text("charts/n", k % 30).alias("working_dir"), F.regexp_replace(command, "--x ", "").alias("command"), text("ns-", k % 40).alias("namespace"))
    charts = nodes.filter("type = 'helm_chart'").select("id", "file_path", "name", text("supplier_", k).alias("release"), text("my-chart-c", k % 12).alias("chart"), F.regexp_replace("file_path", "/[^/]*$", "").alias("chart_path"), "namespace")
    return flows.helm_links(operations, charts)


@plain("value_overrides", """, b AS (SELECT n.id AS key, substring(t.fullkey, 3) AS path, t.atom->>'$' AS v FROM nodes n, json_tree(n.metadata) t WHERE t.type <> 'OBJECT'), c AS (SELECT n.id AS key, substring(t.fullkey, 3) AS path, t.atom->>'$' AS v FROM target_nodes n, json_tree(n.metadata) t WHERE t.type <> 'OBJECT')
  SELECT c.key, 'target' AS source, c.path, b.v AS base_value, c.v AS value FROM c LEFT JOIN b ON b.key = c.key AND b.path = c.path WHERE b.v IS NULL OR b.v <> c.v""")
def value_overrides(spark, sf_dir):
    base, _, target, _ = pg.snapshots(spark, sf_dir)
    found = diff.value_overrides(base.select(F.col("id").alias("key"), "metadata"), target.select(F.col("id").alias("key"), F.lit("target").alias("source"), "metadata"))
    return found.select("key", "source", "path", "base_value", "value")


@plain("appended_diffs", f"{DIFF_SQL} SELECT i AS at, CASE WHEN i = 1 AND change = 'added' THEN 'removed' WHEN i = 1 AND change = 'removed' THEN 'added' ELSE change END AS change, count(*) AS n FROM nd, range(2) r(i) WHERE change <> 'unchanged' GROUP BY ALL".replace("AS at,", 'AS "at",'))
def appended_diffs(spark, sf_dir):
    """There and back again: what is added first and then removed counts as both."""
    base, _, target, _ = pg.snapshots(spark, sf_dir)
    found = diff.appended([diff.node_diff(base, target), diff.node_diff(target, base)]).filter("change <> 'unchanged'")
    return found.groupBy(F.col("at").cast("long").alias("at"), "change").agg(F.count("*").alias("n"))
