"""The queries of the graph engine over the driver tables, and DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import external as fx
from ..functions import graph as fg
from ..operators import components, diff, external, flows, graphs, impact, rollup, scoring, search, stats, tables, timeseries, traverse
from ..sources import property_graph as pg
from ..sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

SEED = "part:7"
TERRAFORM_EDGES = ["depends_on", "references"]


def query(name: str, sql: str | None = None):
    """Register a query over (nodes, edges); `sql` follows the graph's common table expressions."""

    def add(f: Callable[[DataFrame, DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(pg.nodes(spark, sf_dir), pg.edges(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = f"WITH RECURSIVE {pg.GRAPH_SQL} {sql}"
        return f

    return add


def plain(name: str, sql: str | None = None):
    """Register a query over (spark, sf_dir)."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = f"WITH RECURSIVE {pg.GRAPH_SQL} {sql}"
        return f

    return add


# ---- filters, lookups, pages


@query("node_filter", "SELECT id, name FROM nodes WHERE type IN ('terraform_resource', 'helm_chart') AND file_path ILIKE '%brand#1%' AND name ILIKE '%a%'")
def node_filter(nodes, edges):
    return tables.where(nodes, among={"type": ["terraform_resource", "helm_chart"]}, like={"file_path": "brand#1", "name": "a"}).select("id", "name")


@query("node_page", "SELECT id, file_path, line_start, (SELECT count(*) FROM nodes) AS total_count FROM nodes ORDER BY file_path, line_start, id LIMIT 50 OFFSET 100")
def node_page(nodes, edges):
    return tables.page(nodes.select("id", "file_path", "line_start"), [F.col("file_path"), F.col("line_start"), F.col("id")], 3, 50)


@query("edge_filter", "SELECT id, confidence FROM edges WHERE type IN ('depends_on', 'FEEDS_INTO') AND implicit AND confidence BETWEEN 60 AND 80")
def edge_filter(nodes, edges):
    return tables.where(edges, equal={"implicit": True}, among={"type": ["depends_on", "FEEDS_INTO"]}, least={"confidence": 60}, most={"confidence": 80}).select("id", "confidence")


@plain("evidence_filter", "SELECT id, confidence FROM evidence WHERE category IN ('explicit', 'semantic') AND confidence >= 90")
def evidence_filter(spark, sf_dir):
    return tables.where(pg.evidence(spark, sf_dir), among={"category": ["explicit", "semantic"]}, least={"confidence": 90}).select("id", "confidence")


@query("json_fields", """SELECT id, CASE WHEN id LIKE 'supplier:%' THEN metadata->>'remoteStateBackend' END AS backend, coalesce(TRY_CAST(metadata->>'dependencyCount' AS INTEGER), 0) AS dependencies
FROM nodes WHERE metadata->>'remoteStateBackend' = 's3' OR TRY_CAST(metadata->>'dependencyCount' AS INTEGER) >= 5""")
def json_fields(nodes, edges):
    backend, n = tables.field("metadata", "remoteStateBackend"), tables.field("metadata", "dependencyCount", "int")
    return nodes.filter((backend == "s3") | (n >= 5)).select("id", backend.alias("backend"), F.coalesce(n, F.lit(0)).alias("dependencies"))


@query("edges_of_node", "SELECT id, 'out' AS side FROM edges WHERE source = 'nation:3' UNION ALL SELECT id, 'in' FROM edges WHERE target = 'nation:3'")
def edges_of_node(nodes, edges):
    return edges.filter("source = 'nation:3'").select("id", F.lit("out").alias("side")).union(edges.filter("target = 'nation:3'").select("id", F.lit("in")))


@plain("scan_filter", "SELECT id, status FROM scans WHERE status = 'failed' AND started_at >= TIMESTAMP '2024-01-05' AND started_at <= TIMESTAMP '2024-01-20'")
def scan_filter(spark, sf_dir):
    at = lambda t: F.lit(t).cast("timestamp")
    return tables.where(pg.scans(spark, sf_dir), among={"status": ["failed"]}, least={"started_at": at("2024-01-05")}, most={"started_at": at("2024-01-20")}).select("id", "status")


@plain("latest_scan", "SELECT repository_id, id FROM scans QUALIFY row_number() OVER (PARTITION BY repository_id ORDER BY started_at DESC, id DESC) = 1")
def latest_scan(spark, sf_dir):
    return tables.latest(pg.scans(spark, sf_dir), ["repository_id"], [F.desc("started_at"), F.desc("id")]).select("repository_id", "id")


@query("tenant_rows", "SELECT count(*) AS mine, 0::BIGINT AS others FROM nodes WHERE tenant_id = 'tenant-0'")
def tenant_rows(nodes, edges):
    mine = tables.tenant_rows(nodes, "tenant-0").agg(F.count("*").alias("mine"))
    return mine.crossJoin(tables.tenant_rows(nodes, "tenant-1").agg(F.count("*").alias("others")))  # two single rows


@query("upsert_nodes", "SELECT id, CASE WHEN type = 'ci_job' THEN 'renamed' ELSE name END AS name FROM nodes UNION ALL SELECT id || 'x', name FROM nodes WHERE type = 'region' OR type = 'terraform_module'")
def upsert_nodes(nodes, edges):
    own = nodes.select("id", "name")
    new = nodes.filter("type = 'ci_job'").select("id", F.lit("renamed").alias("name")).union(nodes.filter("type = 'terraform_module'").select(F.concat("id", F.lit("x")), "name"))
    return tables.upsert(own, new, ["id"])


@query("update_confidence", "SELECT id, CASE WHEN type = 'references' THEN 99.0 ELSE confidence END AS confidence FROM edges WHERE type IN ('references', 'depends_on')")
def update_confidence(nodes, edges):
    some = edges.filter(F.col("type").isin("references", "depends_on")).select("id", "confidence")
    return tables.update_values(some, edges.filter("type = 'references'").select("id", F.lit(99.0).alias("confidence")), "id", "confidence")


# ---- joins


@query("edge_ends", "SELECT e.id, s.name AS source_name, t.name AS target_name, (e.metadata->>'step')::INTEGER AS step FROM edges e JOIN nodes s ON s.id = e.source JOIN nodes t ON t.id = e.target WHERE e.type IN ('depends_on', 'references')")
def edge_ends(nodes, edges):
    end = lambda side: nodes.select(F.col("id").alias(side), F.col("name").alias(f"{side}_name"))
    return edges.filter(F.col("type").isin(*TERRAFORM_EDGES)).join(end("source"), "source").join(end("target"), "target").select("id", "source_name", "target_name", tables.field("metadata", "step", "int").alias("step"))


@query("infrastructure_of_jobs", "SELECT e.source AS job, t.id AS node, e.confidence FROM edges e JOIN nodes t ON t.id = e.target WHERE e.type = 'OPERATES_ON' AND e.confidence >= 90")
def infrastructure_of_jobs(nodes, edges):
    return edges.filter("type = 'OPERATES_ON' and confidence >= 90").join(nodes.select(F.col("id").alias("target")), "target").select(F.col("source").alias("job"), F.col("target").alias("node"), "confidence")


@query("jobs_without_parts", "SELECT id FROM nodes n WHERE type = 'ci_job' AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.source = n.id AND e.type = 'module_call')")
def jobs_without_parts(nodes, edges):
    calls = edges.filter("type = 'module_call'").select(F.col("source").alias("id"))
    return nodes.filter("type = 'ci_job'").join(calls, "id", "left_anti").select("id")


@query("jobs_that_operate", "SELECT id FROM nodes n WHERE type = 'ci_job' AND EXISTS (SELECT 1 FROM edges e WHERE e.source = n.id AND e.type = 'OPERATES_ON' AND e.confidence >= 80)")
def jobs_that_operate(nodes, edges):
    return nodes.filter("type = 'ci_job'").join(edges.filter("type = 'OPERATES_ON' and confidence >= 80").select(F.col("source").alias("id")), "id", "left_semi").select("id")


# ---- aggregates


@query("nodes_by_type", "SELECT type, count(*) AS n FROM nodes GROUP BY type")
def nodes_by_type(nodes, edges):
    return stats.counts_by(nodes, "type")


@query("edges_by_type", "SELECT type, count(*) AS n FROM edges GROUP BY type")
def edges_by_type(nodes, edges):
    return stats.counts_by(edges, "type")


@query("confidence_distribution", "SELECT count_if(confidence >= 95) AS certain, count_if(confidence >= 80 AND confidence < 95) AS high, count_if(confidence >= 60 AND confidence < 80) AS medium, count_if(confidence >= 40 AND confidence < 60) AS low, count_if(confidence < 40) AS uncertain FROM edges")
def confidence_distribution(nodes, edges):
    return stats.confidence_distribution(edges)


@plain("evidence_by_type", "SELECT type, count(*) AS n, round(avg(confidence), 2) AS average, min(confidence) AS least, max(confidence) AS most FROM evidence GROUP BY type")
def evidence_by_type(spark, sf_dir):
    return stats.confidence_by(pg.evidence(spark, sf_dir), "type")


@plain("evidence_by_category", "SELECT category, count(*) AS n, round(avg(confidence), 2) AS average, min(confidence) AS least, max(confidence) AS most FROM evidence GROUP BY category")
def evidence_by_category(spark, sf_dir):
    return stats.confidence_by(pg.evidence(spark, sf_dir), "category")


@query("edge_stats", "SELECT count(*) AS edges, count(DISTINCT source) AS sources, count(DISTINCT target) AS targets, round(avg(confidence), 2) AS average, count_if(confidence >= 90) AS high, count_if(confidence >= 70 AND confidence < 90) AS medium, count_if(confidence < 70) AS low FROM edges")
def edge_stats(nodes, edges):
    return stats.edge_stats(edges)


@query("high_fan_out", "SELECT source AS node, count(*) AS n FROM edges GROUP BY source HAVING count(*) >= 7")
def high_fan_out(nodes, edges):
    return stats.fan(edges, "source", 7)


@query("high_fan_in", "SELECT target AS node, count(*) AS n FROM edges GROUP BY target HAVING count(*) >= 30")
def high_fan_in(nodes, edges):
    return stats.fan(edges, "target", 30)


@query("graph_stats", """, d AS (SELECT n.id, (SELECT count(*) FROM edges e WHERE e.source = n.id) AS o, (SELECT count(*) FROM edges e WHERE e.target = n.id) AS i FROM nodes n)
SELECT count(*) AS nodes, sum(o)::BIGINT AS edges, round(sum(o)::DOUBLE / count(*), 6) AS edges_per_node, max(o) AS max_out, max(i) AS max_in, count_if(o = 0 AND i = 0) AS orphans, round(avg(o) FILTER (o > 0), 6) AS avg_degree, round(sum(o)::DOUBLE / (count(*)::DOUBLE * (count(*) - 1)), 12) AS density FROM d""")
def graph_stats(nodes, edges):
    return stats.graph_stats(nodes, edges)


TOOL_SQL = "CASE WHEN {0} LIKE 'helm\\_%' ESCAPE '\\' THEN 'helm' WHEN {0} LIKE 'k8s\\_%' ESCAPE '\\' THEN 'kubernetes' WHEN {0} LIKE 'ci\\_%' ESCAPE '\\' THEN 'ci' WHEN {0} LIKE 'argocd\\_%' ESCAPE '\\' THEN 'argocd' ELSE 'terraform' END"


@query("tool_counts", f"SELECT t.tool, count(n.id) AS n FROM (VALUES ('terraform'), ('helm'), ('kubernetes'), ('ci'), ('argocd')) t(tool) LEFT JOIN (SELECT id, {TOOL_SQL.format('type')} AS tool FROM nodes) n USING (tool) GROUP BY t.tool")
def tool_counts(nodes, edges):
    return stats.tool_counts(nodes)


@query("tool_pairs", f", t AS (SELECT id, {TOOL_SQL.format('type')} AS tool FROM nodes) SELECT s.tool AS source_tool, d.tool AS target_tool, count(*) AS n, round(avg(confidence), 4) AS average FROM edges e JOIN t s ON s.id = e.source JOIN t d ON d.id = e.target WHERE s.tool <> d.tool GROUP BY ALL ORDER BY n DESC, 1, 2 LIMIT 10")
def tool_pairs(nodes, edges):
    return stats.tool_pairs(nodes, edges)


@plain("scan_percentiles", """, s AS (SELECT node_count::DOUBLE AS x FROM scans), r AS (SELECT x, row_number() OVER (ORDER BY x) AS i, count(*) OVER () AS n FROM s)
SELECT min(x) AS least, max(x) AS most, round(avg(x), 6) AS average, round(stddev_pop(x), 6) AS deviation, max(x) FILTER (i = ceil(0.5 * n)) AS p50, max(x) FILTER (i = ceil(0.75 * n)) AS p75, max(x) FILTER (i = ceil(0.9 * n)) AS p90, max(x) FILTER (i = ceil(0.95 * n)) AS p95, max(x) FILTER (i = ceil(0.99 * n)) AS p99 FROM r""")
def scan_percentiles(spark, sf_dir):
    return stats.percentiles(pg.scans(spark, sf_dir).select(F.col("node_count").cast("double").alias("x")), "x")


@query("orphan_nodes", "SELECT id FROM nodes WHERE id NOT IN (SELECT source FROM edges UNION SELECT target FROM edges)")
def orphan_nodes(nodes, edges):
    return graphs.orphans(nodes, edges)


@query("adjacency", "SELECT source AS node, count(*) AS n, string_agg(target, '>' ORDER BY target, id) AS targets FROM edges GROUP BY source")
def adjacency(nodes, edges):
    return traverse.adjacency(edges).select("node", F.size("next").cast("long").alias("n"), F.array_join("next.there", ">").alias("targets"))


# ---- traversal

REACH_SQL = "b AS (SELECT {seed} AS node, 0 AS depth UNION SELECT e.{there}, b.depth + 1 FROM b JOIN edges e ON e.{here} = b.node WHERE b.depth < {depth})"


@query("downstream", f", {REACH_SQL.format(seed=repr(SEED), here='source', there='target', depth=5)} SELECT node, min(depth) AS depth FROM b WHERE node <> '{SEED}' GROUP BY node")
def downstream(nodes, edges):
    return traverse.reachable(edges, SEED, 5)


@query("upstream", f", {REACH_SQL.format(seed=repr('supplier:3'), here='target', there='source', depth=2)} SELECT node, min(depth) AS depth FROM b WHERE node <> 'supplier:3' GROUP BY node")
def upstream(nodes, edges):
    return traverse.reachable(edges, "supplier:3", 2, "upstream")


@query("neighbourhood", ", u AS (SELECT source, target FROM edges UNION ALL SELECT target, source FROM edges), b AS (SELECT 'orders:1' AS node, 0 AS depth UNION SELECT u.target, b.depth + 1 FROM b JOIN u ON u.source = b.node WHERE b.depth < 2) SELECT node, min(depth) AS depth FROM b GROUP BY node")
def neighbourhood(nodes, edges):
    return traverse.neighbourhood(edges, "orders:1", 2)


@query("unreachable_nodes", f", {REACH_SQL.format(seed=repr('orders:1'), here='source', there='target', depth=8)} SELECT id FROM nodes WHERE id NOT IN (SELECT node FROM b)")
def unreachable_nodes(nodes, edges):
    return traverse.unreachable(nodes, edges, "orders:1", 8)


@query("shortest_path", ", b AS (SELECT 'orders:1' AS node, ['orders:1'] AS path UNION SELECT e.target, list_append(b.path, e.target) FROM b JOIN edges e ON e.source = b.node WHERE len(b.path) < 6 AND NOT list_contains(b.path, e.target)) SELECT array_to_string(path, '>') AS path, len(path)::INTEGER - 1 AS length FROM b WHERE node LIKE 'region:%' AND node = 'region:2' ORDER BY len(path), path LIMIT 1")
def shortest_path(nodes, edges):
    return traverse.shortest_path(edges, "orders:1", "region:2").select(F.array_join("path", ">").alias("path"), "length")


@query("simple_paths", ", b AS (SELECT 'orders:2' AS node, ['orders:2'] AS path UNION SELECT e.target, list_append(b.path, e.target) FROM b JOIN edges e ON e.source = b.node WHERE len(b.path) < 6 AND NOT list_contains(b.path, e.target)) SELECT array_to_string(path, '>') AS path, len(path)::INTEGER - 1 AS length FROM b WHERE node = 'region:1' ORDER BY len(path), path LIMIT 100")
def simple_paths(nodes, edges):
    return traverse.simple_paths(edges, "orders:2", "region:1", 5).select(F.array_join("path", ">").alias("path"), "length")


CORE_SQL = "c AS (SELECT source, target FROM edges WHERE type IN ('depends_on', 'references', 'selector_match'))"


@query("cycles", f", {CORE_SQL}, w AS (SELECT [source, target] AS path FROM c UNION ALL SELECT list_append(path, target) FROM w JOIN c ON c.source = path[-1] WHERE len(path) < 6 AND path[-1] <> path[1] AND (target = path[1] OR NOT list_contains(path, target))) SELECT array_to_string(path, '>') AS path, len(path)::INTEGER - 1 AS length FROM w WHERE path[1] = path[-1] ORDER BY length, w.path LIMIT 50")
def cycles(nodes, edges):
    return traverse.cycles(edges).select(F.array_join("path", ">").alias("path"), "length")


@query("strong_components", f", {CORE_SQL}, r AS (SELECT source AS a, target AS b FROM c UNION SELECT r.a, c.target FROM r JOIN c ON c.source = r.b) SELECT x.a AS node, min(x.b) AS scc FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a")
def strong_components(nodes, edges):
    return components.strongly_connected(edges)


@query("connected_components", ", f AS (SELECT source, target FROM edges WHERE type = 'FEEDS_INTO' AND confidence >= 98), u AS (SELECT source AS a, target AS b FROM f UNION SELECT target, source FROM f), r AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON u.a = r.b) SELECT a AS node, min(least(a, b)) AS component FROM r GROUP BY a")
def connected_components(nodes, edges):
    return components.connected_components(edges.filter("type = 'FEEDS_INTO' and confidence >= 98"))


@query("components_of_all")
def components_of_all(nodes, edges):
    """Of all nodes and edges; `connected_components` is a part that its SQL can close over."""
    return components.connected_components(edges, nodes=nodes)


@query("topological_levels", ", t AS (SELECT source, target FROM edges WHERE type IN ('OPERATES_ON', 'module_call', 'FEEDS_INTO')), b AS (SELECT id, 0 AS level FROM nodes WHERE id NOT IN (SELECT target FROM t) UNION SELECT t.target, b.level + 1 FROM b JOIN t ON t.source = b.id) SELECT id, max(level) AS level FROM b GROUP BY id")
def topological_levels(nodes, edges):
    return traverse.topological_levels(nodes, edges.filter(F.col("type").isin("OPERATES_ON", "module_call", "FEEDS_INTO")))


@query("longest_depth", ", t AS (SELECT source, target FROM edges WHERE type IN ('OPERATES_ON', 'module_call', 'FEEDS_INTO')), b AS (SELECT id, 0 AS level FROM nodes WHERE id NOT IN (SELECT target FROM t) UNION SELECT t.target, b.level + 1 FROM b JOIN t ON t.source = b.id) SELECT max(level) + 1 AS max_depth FROM b")
def longest_depth(nodes, edges):
    return traverse.longest_depth(nodes, edges.filter(F.col("type").isin("OPERATES_ON", "module_call", "FEEDS_INTO")))


@query("topological_levels_of_all")
def topological_levels_of_all(nodes, edges):
    """Over all edges; `topological_levels` is the part without cycles, on which its SQL ends."""
    return traverse.topological_levels(nodes, edges)


@query("longest_depth_of_all")
def longest_depth_of_all(nodes, edges):
    """Over all edges; `longest_depth` is the part without cycles, on which its SQL ends."""
    return traverse.longest_depth(nodes, edges)


@query("walks", ", b AS (SELECT source, target, id AS edge_id, 1 AS depth FROM edges WHERE source = 'part:1' UNION ALL SELECT e.source, e.target, e.id, b.depth + 1 FROM b JOIN edges e ON e.source = b.target WHERE b.depth < 6) SELECT * FROM b")
def walks(nodes, edges):
    return traverse.walk_rows(edges, traverse.only(edges.sparkSession, "part:1"), 6)


@query("impact_analysis", ", b AS (SELECT source AS node, 1 AS depth FROM edges WHERE target = 'supplier:5' AND source <> 'supplier:5' UNION SELECT e.source, b.depth + 1 FROM b JOIN edges e ON e.target = b.node WHERE b.depth < 4 AND e.source <> 'supplier:5') SELECT node, CASE WHEN min(depth) = 1 THEN 'direct' ELSE 'transitive' END AS kind, CASE WHEN min(depth) = 1 THEN 1 ELSE max(depth) END AS depth FROM b GROUP BY node")
def impact_analysis(nodes, edges):
    return traverse.impact(edges, "supplier:5", 4)


@query("subgraph_edges", ", k AS (SELECT source, target FROM edges WHERE source IN ('nation:3', 'region:1') UNION SELECT target, source FROM edges WHERE target IN ('nation:3', 'region:1')), s AS (SELECT 'nation:3' AS id UNION SELECT 'region:1' UNION SELECT target FROM k) SELECT id FROM edges WHERE source IN (SELECT id FROM s) AND target IN (SELECT id FROM s)")
def subgraph_edges(nodes, edges):
    return traverse.subgraph(nodes, edges, ["nation:3", "region:1"], hops=1)[1].select("id")


@query("graph_issues", f", {CORE_SQL}, r AS (SELECT source AS a, target AS b FROM c UNION SELECT r.a, c.target FROM r JOIN c ON c.source = r.b) SELECT 'CYCLE_DETECTED' AS code, a AS element FROM r WHERE a = b UNION ALL SELECT 'DANGLING_SOURCE', id FROM edges WHERE source NOT IN (SELECT id FROM nodes) UNION ALL SELECT 'ORPHAN_NODE', id FROM nodes WHERE id NOT IN (SELECT source FROM edges UNION SELECT target FROM edges)")
def graph_issues(nodes, edges):
    return graphs.issues(nodes, edges)


# ---- impact


WEIGHT_SQL = "CASE type WHEN 'depends_on' THEN 10 WHEN 'references' THEN 8 WHEN 'module_call' THEN 9 WHEN 'selector_match' THEN 8 ELSE 5 END"


@query("blast_radius", f""", b AS (SELECT 'orders:3' AS node, ['orders:3'] AS path, NULL::VARCHAR AS type, 0 AS depth
  UNION SELECT e.target, list_append(b.path, e.target), e.type, b.depth + 1 FROM b JOIN edges e ON e.source = b.node WHERE b.depth < 4 AND NOT list_contains(b.path, e.target)),
f AS (SELECT * FROM b WHERE depth > 0 QUALIFY row_number() OVER (PARTITION BY node ORDER BY depth, path, type) = 1)
SELECT node, depth, f.type AS edge_type, (n.repo_id <> p.repo_id) AS cross_repo, round({WEIGHT_SQL.replace('type', 'f.type', 1)} * pow(0.7, depth - 1), 6) AS score FROM f JOIN nodes n ON n.id = f.node JOIN nodes p ON p.id = f.path[-2]""")
def blast_radius(nodes, edges):
    return impact.blast_radius(nodes, edges, traverse.only(edges.sparkSession, "orders:3"), 4).select("node", "depth", "edge_type", "cross_repo", F.round("score", 6).alias("score"))


BLAST_ROWS = f"""b AS (SELECT 'orders:3' AS node, ['orders:3'] AS path, NULL::VARCHAR AS type, 0 AS depth
  UNION SELECT e.target, list_append(b.path, e.target), e.type, b.depth + 1 FROM b JOIN edges e ON e.source = b.node WHERE b.depth < 4 AND NOT list_contains(b.path, e.target)),
f AS (SELECT * FROM b WHERE depth > 0 QUALIFY row_number() OVER (PARTITION BY node ORDER BY depth, path, type) = 1),
j AS (SELECT depth, f.type, n.repo_id AS own, p.repo_id AS before, {WEIGHT_SQL.replace('type', 'f.type', 1)} * pow(0.7, depth - 1) AS score FROM f JOIN nodes n ON n.id = f.node JOIN nodes p ON p.id = f.path[-2]),
s AS (SELECT count_if(depth = 1) AS direct, count_if(depth > 1) AS indirect, count_if(own <> before) AS cross_nodes, count(DISTINCT (before, own, type)) FILTER (own <> before) AS cross_groups, coalesce(round(sum(score), 6), 0) AS score FROM j)"""


@query("blast_summary", f", {BLAST_ROWS} SELECT *, CASE WHEN 2 * direct + indirect + 5 * cross_groups < 10 THEN 'low' WHEN 2 * direct + indirect + 5 * cross_groups < 30 THEN 'medium' WHEN 2 * direct + indirect + 5 * cross_groups < 100 AND cross_groups < 5 THEN 'high' ELSE 'critical' END AS risk FROM s")
def blast_summary(nodes, edges):
    return impact.blast_summary(impact.blast_radius(nodes, edges, traverse.only(edges.sparkSession, "orders:3"), 4))


TOOL_REACH = "u AS (SELECT source, target FROM edges WHERE confidence >= 60 UNION ALL SELECT target, source FROM edges WHERE confidence >= 60), b AS (SELECT 'nation:4' AS node, 0 AS depth UNION SELECT u.target, b.depth + 1 FROM b JOIN u ON u.source = b.node WHERE b.depth < 2), m AS (SELECT node, min(depth) AS depth FROM b GROUP BY node HAVING min(depth) > 0)"


@query("tool_blast", f", u AS (SELECT source, target FROM edges WHERE confidence >= 60 UNION ALL SELECT target, source FROM edges WHERE confidence >= 60), b AS (SELECT 'nation:4' AS node, 0 AS depth UNION SELECT u.target, b.depth + 1 FROM b JOIN u ON u.source = b.node WHERE b.depth < 2), m AS (SELECT node, min(depth) AS depth FROM b GROUP BY node HAVING min(depth) > 0) SELECT {TOOL_SQL.format('n.type')} AS tool, count_if(depth = 1) AS direct, count_if(depth > 1) AS transitive FROM m JOIN nodes n ON n.id = m.node GROUP BY 1")
def tool_blast(nodes, edges):
    return impact.tool_blast(nodes, edges, "nation:4", 2, 60)


# ---- flows


FLOWS_SQL = f""", t AS (SELECT id, {TOOL_SQL.format('type')} AS tool FROM nodes), m AS (SELECT source, target, confidence, tool FROM edges JOIN t ON t.id = target WHERE type IN ('FEEDS_INTO', 'references')),
f AS (SELECT [id] AS path, 0.0::DOUBLE AS total, 'terraform' AS last FROM nodes WHERE type IN ('terraform_output', 'terraform_resource') UNION ALL SELECT list_append(path, target), total + confidence, tool FROM f JOIN m ON m.source = path[-1] WHERE len(path) <= 10 AND NOT list_contains(path, target)),
g AS (SELECT path[1] AS source, path[-1] AS target, round(total / (len(path) - 1), 6) AS confidence, 'flow-' || sha256('flow:' || path[1] || ':' || path[-1])[:16] AS flow_id FROM f WHERE last IN ('helm', 'kubernetes', 'argocd'))"""


@query("end_to_end_flows", f"{FLOWS_SQL} SELECT * FROM g")
def end_to_end_flows(nodes, edges):
    return flows.end_to_end_flows(nodes, edges).select("flow_id", "source", "target", "confidence")


@query("flow_statistics", f"{FLOWS_SQL} SELECT count(*) AS flows, round(avg(confidence), 6) AS average, count_if(confidence >= 80) AS high, count_if(confidence >= 50 AND confidence < 80) AS medium, count_if(confidence < 50) AS low, 0::BIGINT AS orchestrated, 1.0 AS edges FROM g")
def flow_statistics(nodes, edges):
    return flows.flow_statistics(flows.end_to_end_flows(nodes, edges))


NORMAL_SQL = "lower(regexp_replace(regexp_replace(replace({0}, '\\', '/'), '^[.]/', ''), '/$', ''))"
UNDER_SQL = "({0} = {1} OR starts_with({0}, {1} || '/') OR starts_with({1}, {0} || '/'))"
JOB_LINKS_SQL = f""", j AS (SELECT id AS job, file_path AS path, name, regexp_replace(lower(name), '[-_[:space:]]', '', 'g') AS bare FROM nodes WHERE type = 'ci_job'),
n AS (SELECT id AS node, file_path, name, regexp_replace(lower(name), '[-_[:space:]]', '', 'g') AS bare FROM nodes WHERE NOT starts_with(type, 'ci_')),
p AS (SELECT path, file_path, {NORMAL_SQL.format('path')} AS a, {NORMAL_SQL.format('file_path')} AS b FROM (SELECT DISTINCT path FROM j), (SELECT DISTINCT file_path FROM n)),
q AS (SELECT *, list_filter(string_split(a, '/'), lambda x: x <> '') AS sa, list_filter(string_split(b, '/'), lambda x: x <> '') AS sb, regexp_replace(a, '/?[^/]*$', '') AS da, regexp_replace(b, '/?[^/]*$', '') AS db FROM p),
r AS (SELECT *, CASE WHEN a = b THEN 100.0 ELSE round(100.0 * len(list_filter(range(1, least(len(sa), len(sb)) + 1), lambda i: sa[1:i] = sb[1:i])) / greatest(len(sa), len(sb))) END AS alike FROM q),
t AS (SELECT path, file_path, CASE WHEN alike >= 80 THEN alike WHEN alike >= 50 THEN alike * 0.9 WHEN {UNDER_SQL.format('a', 'b')} OR {UNDER_SQL.format('da', 'db')} THEN 60.0 END AS by_path FROM r),
x AS (SELECT job, node, t.by_path FROM j JOIN t USING (path) JOIN n USING (file_path) WHERE t.by_path >= 50
  UNION ALL SELECT job, node, 0.7 * CASE WHEN j.bare = n.bare THEN 100.0 WHEN contains(j.bare, n.bare) OR contains(n.bare, j.bare) THEN 80.0 ELSE round(100.0 * (greatest(len(j.bare), len(n.bare)) - levenshtein(j.bare, n.bare)) / greatest(len(j.bare), len(n.bare))) END FROM j JOIN t USING (path) JOIN n USING (file_path) WHERE t.by_path IS NULL)
SELECT job, node, round(by_path, 4)::DOUBLE AS score FROM x WHERE round(by_path, 4) >= 50 QUALIFY row_number() OVER (PARTITION BY job ORDER BY round(by_path, 4) DESC, node) <= 5"""


@query("job_links", JOB_LINKS_SQL)
def job_links(nodes, edges):
    jobs = nodes.filter("type = 'ci_job'").select(F.col("id").alias("job"), F.col("file_path").alias("path"), "name")
    return flows.job_links(jobs, nodes.filter(fg.tool_of(F.col("type")) != "ci"))


# ---- scores


SCORES_SQL = """, s AS (SELECT edge_id, count(*) AS n, avg(confidence * CASE category WHEN 'explicit' THEN 1.0 WHEN 'structural' THEN 0.8 WHEN 'heuristic' THEN 0.6 ELSE 0.9 END) AS base, count_if(category = 'explicit') AS ex, bool_and(category = 'heuristic') AS h, avg(confidence) AS a, count(DISTINCT category) AS c, count(DISTINCT type) AS t,
  sum(CASE type WHEN 'depends_on_directive' THEN 48.0 WHEN 'explicit_reference' THEN 35.0 WHEN 'module_source' THEN 30.0 WHEN 'interpolation' THEN 25.0 WHEN 'function_call' THEN 20.0 WHEN 'label_matching' THEN 25.0 WHEN 'naming_convention' THEN 8.0 ELSE 3.5 END)::DOUBLE AS r FROM evidence GROUP BY edge_id),
x AS (SELECT *, least(1.5, 1 + 0.1 * (SELECT coalesce(sum(pow(0.85, i)), 0) FROM range(1, n) v(i))) AS m, least(20, 10 * ex) AS b, CASE WHEN NOT h THEN 0 WHEN a < 50 THEN 15 ELSE 5 END AS p, 5 * ((c >= 2)::INT + (c >= 3)::INT + (t >= 3)::INT + (t >= 5)::INT) AS q FROM s),
y AS (SELECT *, round(greatest(0, least(100, base * m + b - p + q + 0.1 * r)), 9) AS score FROM x)"""
LEVEL_SQL = "CASE WHEN {0} >= 95 THEN 'certain' WHEN {0} >= 80 THEN 'high' WHEN {0} >= 60 THEN 'medium' WHEN {0} >= 40 THEN 'low' ELSE 'uncertain' END"


@plain("edge_scores", f"{SCORES_SQL} SELECT edge_id, round(base, 6) AS base, round(m, 6) AS multiplier, b AS bonus, p AS penalty, q AS pattern, round(r, 6) AS rules, round(score) AS value, {LEVEL_SQL.format('score')} AS level FROM y")
def edge_scores(spark, sf_dir):
    return scoring.edge_scores(pg.evidence(spark, sf_dir))


@plain("scored_edges", f"{SCORES_SQL} SELECT id, coalesce(round(score), confidence) AS confidence, coalesce(round(score), confidence) < 80 AS implicit FROM edges LEFT JOIN y ON y.edge_id = edges.id")
def scored_edges(spark, sf_dir):
    return scoring.scored_edges(pg.edges(spark, sf_dir), scoring.edge_scores(pg.evidence(spark, sf_dir))).select("id", "confidence", "implicit")


@plain("collected_evidence", "SELECT edge_id, count(*) AS n, round(avg(confidence), 6) AS average, arg_max(id, (confidence, id)) AS strongest FROM evidence GROUP BY edge_id")
def collected_evidence(spark, sf_dir):
    return scoring.collected(pg.evidence(spark, sf_dir))


# ---- repositories matched and merged

ARN_SQL = "p AS (SELECT id, repo_id, metadata->>'arn' AS arn, type FROM nodes WHERE metadata->>'arn' IS NOT NULL), m AS (SELECT a.id AS source, b.id AS target FROM p a JOIN p b ON a.arn = b.arn AND a.repo_id < b.repo_id)"


@query("arn_matches", f", {ARN_SQL} SELECT source, target, 100.0::DOUBLE AS confidence FROM m")
def arn_matches(nodes, edges):
    return rollup.matches(nodes, rollup.arn_matcher()).select("source", "target", "confidence")


@query("name_matches", "SELECT a.id AS source, b.id AS target, CASE WHEN a.type = b.type THEN 100.0 ELSE 95.0 END::DOUBLE AS confidence FROM nodes a JOIN nodes b ON lower(a.name) = lower(b.name) AND a.repo_id < b.repo_id")
def name_matches(nodes, edges):
    return rollup.matches(nodes, rollup.name_matcher()).select("source", "target", "confidence")


@query("fuzzy_name_matches", "SELECT a.id AS source, b.id AS target, CASE WHEN a.name = b.name THEN 100.0 ELSE round(100.0 * (greatest(len(a.name), len(b.name)) - levenshtein(lower(a.name), lower(b.name))) / greatest(len(a.name), len(b.name))) END::DOUBLE AS confidence FROM nodes a JOIN nodes b ON a.repo_id < b.repo_id AND a.type = 'helm_chart' AND b.type = 'helm_chart' AND substring(a.name, 1, 3) = substring(b.name, 1, 3) WHERE round(100.0 * (greatest(len(a.name), len(b.name)) - levenshtein(lower(a.name), lower(b.name))) / greatest(len(a.name), len(b.name))) >= 90")
def fuzzy_name_matches(nodes, edges):
    return rollup.matches(nodes.filter("type = 'helm_chart'"), rollup.name_matcher(90, threshold=90)).select("source", "target", "confidence")


@query("fuzzy_name_matches_of_all")
def fuzzy_name_matches_of_all(nodes, edges):
    """Of all node types; `fuzzy_name_matches` is the part that its SQL can check."""
    return rollup.matches(nodes, rollup.name_matcher(90, threshold=90)).select("source", "target", "confidence")


@query("tag_matches", """, t AS (SELECT id, repo_id, metadata->>'resourceType' AS kind, split_part(id, ':', 2)::BIGINT AS k FROM nodes WHERE type = 'terraform_resource'), g AS (SELECT *, k // 2 AS owner, k // 3 AS cost, CASE WHEN k % 4 = 3 THEN 'old' ELSE 'new' END AS state FROM t),
  c AS (SELECT a.id AS source, b.id AS target, a.kind = b.kind AS same, ((a.owner = b.owner)::INT + (a.cost = b.cost)::INT + (a.state = b.state)::INT) AS n FROM g a JOIN g b ON a.repo_id < b.repo_id AND (a.owner = b.owner OR a.cost = b.cost))
  SELECT source, target, CASE WHEN same THEN least(100.0, n / 3 * 100 + 5) ELSE round(n / 3 * 100) END::DOUBLE AS confidence FROM c WHERE CASE WHEN same THEN least(100.0, n / 3 * 100 + 5) ELSE round(n / 3 * 100) END >= 60""")
def tag_matches(nodes, edges):
    k = F.regexp_extract("id", r":(\d+)$", 1).try_cast("long")
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    tags = text('"tags":{"Owner":"', F.floor(k / 2), '","Cost":"', F.floor(k / 3), '","State":"', F.when(k % 4 == 3, "old").otherwise("new"), '"')
    own = nodes.filter("type = 'terraform_resource'").withColumn("metadata", F.regexp_replace("metadata", F.lit(r'"tags":\{"Environment":"[a-z]+"'), tags))
    return rollup.tag_matches(own, ["Owner", "Cost", "State"], 60).select("source", "target", "confidence")


@query("merged_nodes", f", {ARN_SQL}, g AS (SELECT source, target FROM m) SELECT sha256('repo-0/' || source || '|repo-1/' || target)[:32] AS id, 2 AS members, (SELECT name FROM nodes WHERE id = source) AS name FROM g")
def merged_nodes(nodes, edges):
    grouped = rollup.groups(rollup.all_matches(nodes, [rollup.arn_matcher()]))
    return rollup.merged_nodes(nodes, grouped).select("id", F.size("source_ids").alias("members"), "name")


PAIRS_SQL = "g AS (SELECT 'repo-0/' || source AS grp, source, target FROM m), o AS (SELECT grp, 0 AS i, source AS id FROM g UNION ALL SELECT grp, 1, target FROM g)"


LISTED = "CASE WHEN json_type({0}) = 'ARRAY' THEN 'array' WHEN json_type({0}) = 'OBJECT' THEN 'object' ELSE 'other' END"


@query("merged_metadata", f""", {ARN_SQL}, {PAIRS_SQL},
  n2 AS (SELECT id, json_merge_patch(metadata, '{{"zones":["z' || (line_start % 3) || '","z' || (line_start % 2) || '"],"owner":{{"k' || (line_start % 2) || '":' || line_start || ',"all":' || (line_start % 5) || '}}}}') AS metadata FROM nodes WHERE type = 'terraform_resource'),
  v AS (SELECT grp, i, key, json_extract(metadata, '$."' || key || '"') AS j, metadata->>('$."' || key || '"') AS value FROM (SELECT grp, i, metadata, unnest(json_keys(metadata)) AS key FROM o JOIN n2 USING (id))),
  k AS (SELECT grp, key, arg_min(value, i) AS first, arg_min(j, i) AS fj, arg_max(j, i) AS lj, count(DISTINCT j::VARCHAR) AS n FROM v GROUP BY grp, key)
  SELECT grp AS "group", key, CASE WHEN {LISTED.format('fj')} = 'object' THEN merged WHEN n = 1 OR {LISTED.format('fj')} = 'other' THEN first ELSE to_json(list_distinct_in_order)::VARCHAR END AS value FROM (
    SELECT k.*, list_filter(z, lambda x, i: list_position(z, x) = i) AS list_distinct_in_order, '{{' || list_aggregate(list_sort(list_transform(json_keys(bo), lambda q: '"' || q || '":' || json_extract(bo, '$.' || q)::VARCHAR)), 'string_agg', ',') || '}}' AS merged FROM (
      SELECT k.*, CASE WHEN {LISTED.format('fj')} = 'array' THEN list_concat(from_json(fj, '["VARCHAR"]'), from_json(lj, '["VARCHAR"]')) END AS z, CASE WHEN {LISTED.format('fj')} = 'object' THEN json_merge_patch(fj, lj) END AS bo FROM k) k)""")
def merged_metadata(nodes, edges):
    n = F.col("line_start")
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    more = text(',"zones":["z', n % 3, '","z', n % 2, '"],"owner":{"k', n % 2, '":', n, ',"all":', n % 5, "}}")
    own = nodes.filter("type = 'terraform_resource'").withColumn("metadata", F.concat(F.expr("substring(metadata, 1, length(metadata) - 1)"), more))
    return rollup.merged_metadata(own, rollup.groups(rollup.all_matches(nodes, [rollup.arn_matcher()])), "merge")


MERGED_EDGES_SQL = f""", {ARN_SQL}, w AS (SELECT source, target FROM m UNION SELECT a.id, b.id FROM nodes a JOIN nodes b ON lower(a.name) = lower(b.name) AND a.repo_id < b.repo_id), u AS (SELECT source AS a, target AS b FROM w UNION ALL SELECT target, source FROM w),
h AS (SELECT a, b FROM u UNION SELECT h.a, u.b FROM h JOIN u ON u.a = h.b), k AS (SELECT a AS id, min(b) AS root FROM h GROUP BY a), z AS (SELECT DISTINCT k.root, e.repo_id || '/' || e.id AS member, e.repo_id FROM k JOIN nodes e ON e.id = k.id),
c AS (SELECT root, sha256(string_agg(member, '|' ORDER BY member))[:32] AS merged, count(DISTINCT repo_id) > 1 AS many FROM z GROUP BY root), l AS (SELECT member, merged, many FROM z JOIN c USING (root)),
e AS (SELECT s.repo_id || '/' || edges.source AS a, s.repo_id || '/' || edges.target AS b, edges.type FROM edges JOIN nodes s ON s.id = edges.source), r AS (SELECT coalesce(x.merged, a) AS source, coalesce(y.merged, b) AS target, type, coalesce(x.many, false) OR coalesce(y.many, false) AS cross_repo FROM e LEFT JOIN l x ON x.member = a LEFT JOIN l y ON y.member = b)
SELECT source, target, type, bool_or(cross_repo) AS cross_repo FROM r WHERE source <> target GROUP BY source, target, type"""


@query("merged_edges", MERGED_EDGES_SQL)
def merged_edges(nodes, edges):
    grouped = rollup.groups(rollup.links(nodes, [rollup.arn_matcher(), rollup.name_matcher()]))
    owned = edges.join(nodes.select(F.col("id").alias("source"), "repo_id"), "source")
    return rollup.remapped_edges(owned.select("repo_id", "source", "target", "type"), grouped, rollup.merged_nodes(nodes, grouped))


# ---- snapshots compared

DIFF_SQL = """, k AS (SELECT concat_ws('::', type, name, lower(file_path), nullif(namespace, '')) AS key, type, metadata, id FROM nodes QUALIFY row_number() OVER (PARTITION BY key ORDER BY id DESC) = 1),
l AS (SELECT concat_ws('::', type, name, lower(file_path), nullif(namespace, '')) AS key, type, metadata, id FROM target_nodes QUALIFY row_number() OVER (PARTITION BY key ORDER BY id DESC) = 1),
nd AS (SELECT coalesce(k.key, l.key) AS key, coalesce(k.type, l.type) AS type, CASE WHEN k.key IS NULL THEN 'added' WHEN l.key IS NULL THEN 'removed' WHEN k.metadata <> l.metadata THEN 'modified' ELSE 'unchanged' END AS change FROM k FULL JOIN l ON k.key = l.key)"""


LEAVES_SQL = f"""{DIFF_SQL}, jk AS (SELECT k.key, substring(t.fullkey, 3) AS path, t.atom AS value FROM k, json_tree(k.metadata) t WHERE t.type <> 'OBJECT'), jl AS (SELECT l.key, substring(t.fullkey, 3) AS path, t.atom AS value FROM l, json_tree(l.metadata) t WHERE t.type <> 'OBJECT'),
df AS (SELECT coalesce(jk.key, jl.key) AS key, coalesce(jk.path, jl.path) AS path, CASE WHEN jk.key IS NULL THEN 'added' WHEN jl.key IS NULL THEN 'removed' WHEN jk.value <> jl.value THEN 'modified' END AS what FROM jk FULL JOIN jl ON jk.key = jl.key AND jk.path = jl.path),
ch AS (SELECT key, coalesce(string_agg(path, ',' ORDER BY path) FILTER (what = 'added'), '') AS added, coalesce(string_agg(path, ',' ORDER BY path) FILTER (what = 'removed'), '') AS removed, coalesce(string_agg(path, ',' ORDER BY path) FILTER (what = 'modified'), '') AS modified FROM df GROUP BY key)"""


@plain("node_diff", f"{LEAVES_SQL} SELECT key, type, change, CASE WHEN change = 'modified' THEN added END AS added, CASE WHEN change = 'modified' THEN removed END AS removed, CASE WHEN change = 'modified' THEN modified END AS modified FROM nd LEFT JOIN ch USING (key) WHERE change <> 'unchanged'")
def node_diff(spark, sf_dir):
    base, _, target, _ = pg.snapshots(spark, sf_dir)
    found = diff.node_diff(base, target).filter("change <> 'unchanged'")
    return found.select("key", "type", "change", *[F.array_join(f"changes.{c}", ",").alias(c) for c in ("added", "removed", "modified")])


@plain("node_changes_by_type", f"{DIFF_SQL} SELECT type, count_if(change = 'added') AS added, count_if(change = 'removed') AS removed, count_if(change = 'modified') AS modified FROM nd GROUP BY type")
def node_changes_by_type(spark, sf_dir):
    base, _, target, _ = pg.snapshots(spark, sf_dir)
    return diff.by_type(diff.node_diff(base, target))


KEY_SQL = "concat_ws('::', type, name, lower(file_path), nullif(namespace, ''))"
EDGE_DIFF_SQL = f"""{DIFF_SQL}, bk AS (SELECT id, {KEY_SQL} AS key FROM nodes), tk AS (SELECT id, {KEY_SQL} AS key FROM target_nodes),
be AS (SELECT s.key AS source_key, e.type, t.key AS target_key, max(confidence) AS a FROM edges e JOIN bk s ON s.id = e.source JOIN bk t ON t.id = e.target GROUP BY ALL), te AS (SELECT s.key AS source_key, e.type, t.key AS target_key, max(confidence) AS b FROM target_edges e JOIN tk s ON s.id = e.source JOIN tk t ON t.id = e.target GROUP BY ALL),
ed AS (SELECT source_key, type, target_key, CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'removed' WHEN a <> b THEN 'modified' ELSE 'unchanged' END AS change FROM be FULL JOIN te USING (source_key, type, target_key)),
n1 AS (SELECT count_if(change = 'added') AS nodes_added, count_if(change = 'removed') AS nodes_removed, count_if(change = 'modified') AS nodes_modified, count_if(change <> 'added') AS nodes_base FROM nd), e1 AS (SELECT count_if(change = 'added') AS edges_added, count_if(change = 'removed') AS edges_removed, count_if(change = 'modified') AS edges_modified, count_if(change <> 'added') AS edges_base FROM ed),
s1 AS (SELECT *, nodes_added + nodes_removed + nodes_modified + edges_added + edges_removed + edges_modified AS changes, nodes_base + edges_base AS elements, nodes_removed + edges_removed AS gone FROM n1, e1)"""


@plain("diff_summary", f"""{EDGE_DIFF_SQL} SELECT * EXCLUDE (elements, gone), round(changes / elements, 6) AS ratio, CASE WHEN changes / elements > 0.5 OR gone / greatest(changes, 1) > 0.3 THEN 'critical' WHEN changes / elements > 0.25 OR gone / greatest(changes, 1) > 0.15 THEN 'high' WHEN changes / elements > 0.1 OR gone / greatest(changes, 1) > 0.05 THEN 'medium' ELSE 'low' END AS impact,
  least(100, round(20 * log10(nodes_added + 2 * nodes_removed + 0.5 * nodes_modified + 0.5 * edges_added + edges_removed + 0.25 * edges_modified + 1)))::DOUBLE AS score FROM s1""")
def diff_summary(spark, sf_dir):
    base, base_edges, target, target_edges = pg.snapshots(spark, sf_dir)
    found, _ = diff.edge_changes((base, base_edges), (target, target_edges))
    return diff.summary(diff.node_diff(base, target), found)


@plain("edge_diff", f"{EDGE_DIFF_SQL} SELECT * FROM ed WHERE change <> 'unchanged'")
def edge_diff(spark, sf_dir):
    base, base_edges, target, target_edges = pg.snapshots(spark, sf_dir)
    found, names = diff.edge_changes((base, base_edges), (target, target_edges))
    return diff.named_changes(found.filter("change <> 'unchanged'"), names)


@plain("edge_changes_by_type", f"{EDGE_DIFF_SQL} SELECT type, count_if(change = 'added') AS added, count_if(change = 'removed') AS removed, count_if(change = 'modified') AS modified FROM ed GROUP BY type")
def edge_changes_by_type(spark, sf_dir):
    base, base_edges, target, target_edges = pg.snapshots(spark, sf_dir)
    found, _ = diff.edge_changes((base, base_edges), (target, target_edges))
    return diff.by_type(found)


@plain("affected_files", f"{DIFF_SQL} SELECT DISTINCT file_path FROM (SELECT id, file_path FROM nodes UNION ALL SELECT id, file_path FROM target_nodes) f JOIN (SELECT k.id FROM k JOIN nd USING (key) WHERE change <> 'unchanged' UNION SELECT l.id FROM l JOIN nd USING (key) WHERE change <> 'unchanged') c USING (id)")
def affected_files(spark, sf_dir):
    base, _, target, _ = pg.snapshots(spark, sf_dir)
    return diff.affected_files(base, target, diff.node_diff(base, target))


# ---- external objects


@query("external_references", "SELECT id AS node_id, metadata->>'arn' AS external_id, lower(metadata->>'arn') AS normalized_id, sha256('arn:' || lower(metadata->>'arn')) AS reference_hash FROM nodes WHERE metadata->>'arn' IS NOT NULL")
def external_references(nodes, edges):
    return external.references(nodes).select("node_id", "external_id", "normalized_id", "reference_hash")


@query("external_lookup", "SELECT id AS node_id FROM nodes WHERE metadata->>'arn' LIKE 'arn:aws:s3:::bucket-1%'")
def external_lookup(nodes, edges):
    return external.find(external.references(nodes), "arn:aws:s3:::bucket-1*").select("node_id")


@query("shared_objects", "SELECT lower(metadata->>'arn') AS normalized_id, count(*) AS nodes, count(DISTINCT repo_id) AS repos FROM nodes WHERE metadata->>'arn' IS NOT NULL GROUP BY 1 HAVING count(DISTINCT repo_id) > 1")
def shared_objects(nodes, edges):
    return external.shared_objects(external.references(nodes))


@query("external_stats", "SELECT count(*) AS entries, count(DISTINCT metadata->>'arn') AS objects, count(DISTINCT id) AS nodes FROM nodes WHERE metadata->>'arn' IS NOT NULL")
def external_stats(nodes, edges):
    return external.index_stats(external.references(nodes))


# ---- time, text


@plain("daily_scans", "SELECT repository_id, count(*) AS scans, count_if(status = 'completed') AS completed, count_if(status = 'failed') AS failed, round(avg(node_count))::BIGINT AS nodes, round(avg(edge_count))::BIGINT AS edges, strftime(time_bucket(INTERVAL 1 DAY, started_at), '%Y-%m-%d') AS day FROM scans GROUP BY repository_id, day")
def daily_scans(spark, sf_dir):
    return timeseries.rolled(pg.scans(spark, sf_dir), "1 day", "repository_id").select("repository_id", "scans", "completed", "failed", "nodes", "edges", F.date_format("bucket", "yyyy-MM-dd").alias("day"))


@plain("hourly_scans", "SELECT count(*) AS scans, count_if(status = 'completed') AS completed, count_if(status = 'failed') AS failed, strftime(time_bucket(INTERVAL 1 HOUR, started_at), '%Y-%m-%d %H') AS hour FROM scans GROUP BY hour")
def hourly_scans(spark, sf_dir):
    return timeseries.rolled(pg.scans(spark, sf_dir), "1 hour").select("scans", "completed", "failed", F.date_format("bucket", "yyyy-MM-dd HH").alias("hour"))


@plain("scan_trends", "SELECT count(*) AS scans, round(100.0 * count_if(status = 'completed') / count(*), 2) AS success_rate, strftime(time_bucket(INTERVAL 1 DAY, started_at), '%Y-%m-%d') AS day FROM scans GROUP BY day")
def scan_trends(spark, sf_dir):
    return timeseries.trends(pg.scans(spark, sf_dir)).select("scans", "success_rate", F.date_format("bucket", "yyyy-MM-dd").alias("day"))


@plain("scan_history", "SELECT id, status, node_count, edge_count, (id % 600)::BIGINT AS seconds FROM scans WHERE repository_id = 3 AND started_at >= TIMESTAMP '2024-01-03' AND started_at <= TIMESTAMP '2024-01-25'")
def scan_history(spark, sf_dir):
    return timeseries.history(pg.scans(spark, sf_dir), 3, "2024-01-03", "2024-01-25")


TRIGRAM_SQL = "list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, len(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"


@query("trigram_search", f", s AS (SELECT id, name, {TRIGRAM_SQL.format('name')} AS a, {TRIGRAM_SQL.format('file_path')} AS p, {TRIGRAM_SQL.format(repr('Customer 00012'))} AS q FROM nodes), z AS (SELECT id, name, round(greatest(len(list_intersect(a, q)) / len(list_distinct(a || q)), len(list_intersect(p, q)) / len(list_distinct(p || q))), 6) AS similarity FROM s) SELECT * FROM z WHERE similarity >= 0.3 ORDER BY similarity DESC, id LIMIT 50")
def trigram_search(nodes, edges):
    return search.fuzzy_search(nodes, "Customer 00012")


@query("contains_search", "SELECT id FROM nodes WHERE name ILIKE '%00012%' OR file_path ILIKE '%00012%'")
def contains_search(nodes, edges):
    return search.contains_search(nodes, "00012").select("id")


@plain("bm25_search", """, d AS (SELECT p_partkey, list_filter(string_split_regex(lower(p_name), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS t FROM part), a AS (SELECT count(*) AS docs, avg(len(t)) AS mean FROM d),
h AS (SELECT p_partkey, len(t) AS n, term, count(*) AS tf FROM (SELECT p_partkey, t, unnest(t) AS term FROM d) WHERE term IN ('steel', 'small', 'brass') GROUP BY ALL), s AS (SELECT term, count(*) AS df FROM h GROUP BY term)
SELECT p_partkey, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 6) AS score FROM h JOIN s USING (term), a GROUP BY p_partkey""")
def bm25_search(spark, sf_dir):
    return search.bm25(table(spark, sf_dir, "part"), "steel small brass", "p_partkey", "p_name")


# ---- column functions


@query("identity_keys", "SELECT id, concat_ws('::', type, name, lower(file_path), nullif(namespace, '')) AS key, 'flow-' || sha256('flow:' || id || ':' || type)[:16] AS flow FROM nodes")
def identity_keys(nodes, edges):
    return nodes.select("id", fg.identity_key(F.col("type"), F.col("name"), F.col("file_path"), F.col("namespace")).alias("key"), fg.flow_id(F.col("id"), F.col("type")).alias("flow"))


@query("confidence_levels", "SELECT id, CASE WHEN confidence >= 95 THEN 'certain' WHEN confidence >= 80 THEN 'high' WHEN confidence >= 60 THEN 'medium' WHEN confidence >= 40 THEN 'low' ELSE 'uncertain' END AS level FROM edges")
def confidence_levels(nodes, edges):
    return edges.select("id", fg.confidence_level(F.col("confidence")).alias("level"))


@query("arn_parts", "SELECT id, 'aws' AS partition, 's3' AS service, split_part(metadata->>'arn', ':', 6) AS resource FROM nodes WHERE metadata->>'arn' IS NOT NULL")
def arn_parts(nodes, edges):
    parts = fx.arn_parts(F.get_json_object("metadata", "$.arn"))
    return nodes.select("id", parts.alias("p")).filter("p is not null").select("id", "p.partition", "p.service", "p.resource")


# ---- more of matches, pipelines and walks


@query("matches_by_strategy", f", {ARN_SQL}, x AS (SELECT 'arn' AS strategy, 100.0 AS c, source, target FROM m) SELECT strategy, count(*) AS n, round(avg(c), 2) AS average, min(c)::DOUBLE AS least, max(c)::DOUBLE AS most FROM x GROUP BY strategy")
def matches_by_strategy(nodes, edges):
    return stats.confidence_by(rollup.all_matches(nodes, [rollup.arn_matcher()]), "strategy")


@query("cross_repo_matches", f", {ARN_SQL} SELECT 'repo-0' AS source_repo, 'repo-1' AS target_repo, count(*) AS n FROM m")
def cross_repo_matches(nodes, edges):
    return stats.counts_by(rollup.matches(nodes, rollup.arn_matcher()), "source_repo", "target_repo")


@query("merged_by_repo", f", {ARN_SQL}, r AS (SELECT unnest(['repo-0', 'repo-1']) AS repo_id FROM m) SELECT repo_id, count(*) AS n FROM r GROUP BY repo_id")
def merged_by_repo(nodes, edges):
    merged = rollup.merged_nodes(nodes, rollup.groups(rollup.all_matches(nodes, [rollup.arn_matcher()])))
    return stats.counts_by(merged.select(F.explode("source_repos").alias("repo_id")), "repo_id")


@plain("share_by_status", "SELECT status, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM scans), 2) AS percent FROM scans GROUP BY status")
def share_by_status(spark, sf_dir):
    return stats.share_by(pg.scans(spark, sf_dir), "status")


@query("top_objects", "SELECT lower(metadata->>'arn') AS normalized_id, count(*) AS n FROM nodes WHERE metadata->>'arn' IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
def top_objects(nodes, edges):
    return external.top_objects(external.references(nodes))


@query("hierarchy", ", r AS (SELECT id FROM nodes WHERE type IN ('terraform_module', 'terraform_output') AND id NOT IN (SELECT source FROM edges WHERE type = 'references')), b AS (SELECT e.target AS source, e.source AS target, e.id AS edge_id, 1 AS depth FROM edges e JOIN r ON e.target = r.id WHERE e.type IN ('references', 'depends_on') UNION ALL SELECT e.target, e.source, e.id, b.depth + 1 FROM b JOIN edges e ON e.target = b.target WHERE e.type IN ('references', 'depends_on') AND b.depth < 10) SELECT * FROM b")
def hierarchy(nodes, edges):
    own = nodes.filter(F.col("type").isin("terraform_module", "terraform_output")).select(F.col("id").alias("source"))
    roots = own.join(edges.filter("type = 'references'").select("source"), "source", "left_anti").select(F.col("source").alias("node"))
    return traverse.walk_rows(edges, roots, 10, "upstream", ["references", "depends_on"])


@query("data_flow_chain", ", d AS (SELECT source, target, id AS edge_id FROM edges WHERE type IN ('FEEDS_INTO', 'depends_on', 'references')), b AS (SELECT source, target, edge_id, 1 AS depth FROM d WHERE source = 'part:9' UNION ALL SELECT d.source, d.target, d.edge_id, b.depth + 1 FROM b JOIN d ON d.source = b.target WHERE b.depth < 5) SELECT * FROM b")
def data_flow_chain(nodes, edges):
    return traverse.walk_rows(edges, traverse.only(edges.sparkSession, "part:9"), 5, "downstream", ["FEEDS_INTO", "depends_on", "references"])


@query("cycle_edges", f", {CORE_SQL}, r AS (SELECT source AS a, target AS b FROM c UNION SELECT r.a, c.target FROM r JOIN c ON c.source = r.b) SELECT DISTINCT c.source, c.target FROM c JOIN r ON r.a = c.target AND r.b = c.source")
def cycle_edges(nodes, edges):
    return components.cycle_edges(edges, components.strongly_connected(edges)).select("source", "target").distinct()


@query("stage_order", ", s AS (SELECT DISTINCT file_path AS pipeline, metadata->>'stage' AS stage FROM nodes WHERE type = 'ci_job'), o AS (SELECT pipeline, stage AS source, lead(stage) OVER (PARTITION BY pipeline ORDER BY stage) AS target FROM s) SELECT * FROM o WHERE target IS NOT NULL")
def stage_order(nodes, edges):
    stages = nodes.filter("type = 'ci_job'").select(F.col("file_path").alias("pipeline"), tables.field("metadata", "stage").alias("stage")).distinct()
    return flows.stage_order(stages.withColumn("position", F.col("stage")))


@plain("edge_resolution", "SELECT count_if(s AND t) AS resolved, count_if(NOT (s AND t)) AS unresolved, round(count_if(s AND t)::DOUBLE / count(*), 6) AS rate FROM (SELECT source IN (SELECT id FROM target_nodes) AS s, target IN (SELECT id FROM target_nodes) AS t FROM edges)")
def edge_resolution(spark, sf_dir):
    _, base_edges, target, _ = pg.snapshots(spark, sf_dir)
    return diff.resolution(diff.edge_keys(target, base_edges))


@query("impact_text", f", {TOOL_REACH}, t AS (SELECT {TOOL_SQL.format('n.type')} AS tool, count(*) AS n, count_if(depth = 1) AS direct FROM m JOIN nodes n ON n.id = m.node GROUP BY 1) SELECT string_agg(n || ' ' || tool || ' (' || direct || ' direct)', ', ' ORDER BY tool) AS summary FROM t")
def impact_text(nodes, edges):
    return impact.impact_summary(impact.tool_blast(nodes, edges, "nation:4", 2, 60))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blast radius of one node: (node, type, depth, score)."""
    found = impact.blast_radius(pg.nodes(spark, sf_dir), pg.edges(spark, sf_dir), traverse.only(spark, "orders:3"))
    return found.select("node", "type", "depth", "score")
