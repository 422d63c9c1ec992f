"""The property graph of the driver tables: nodes, edges, evidence, scans, two repositories and two snapshots."""

from __future__ import annotations

from functools import lru_cache, reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import dealt, table

SCAN, TENANT = "scan-0", "tenant-0"

EVIDENCE_TYPES = ("depends_on_directive", "explicit_reference", "module_source", "interpolation", "function_call", "label_matching", "naming_convention", "resource_proximity")
CATEGORIES = ("explicit", "syntax", "semantic", "structural", "heuristic")


def _key(kind: str, column: str) -> F.Column:
    return F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))


def _text(*parts: str | F.Column) -> F.Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@lru_cache(maxsize=4)
def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scan_id, tenant_id, repo_id, id, type, name, namespace, file_path, line_start, metadata). The frame, not its rows, is kept for a session and folder, with the files that were there."""

    def made(name: str, kind: str, key: str, node_type: str, label: F.Column, namespace: F.Column, path: F.Column, line: F.Column, metadata: F.Column) -> DataFrame:
        df = table(spark, sf_dir, name)
        return df.select(
            F.lit(SCAN).alias("scan_id"),
            F.lit(TENANT).alias("tenant_id"),
            _text("repo-", F.col(key) % 2).alias("repo_id"),
            _key(kind, key).alias("id"),
            F.lit(node_type).alias("type"),
            label.alias("name"),
            namespace.cast("string").alias("namespace"),
            path.alias("file_path"),
            line.cast("int").alias("line_start"),
            metadata.alias("metadata"),
        )

    c, none = F.col, F.lit(None)
    parts = [
        made("region", "region", "r_regionkey", "terraform_module", c("r_name"), none, _text("modules/r", c("r_regionkey"), "/main.tf"), F.lit(1), F.lit("{}")),
        made("nation", "nation", "n_nationkey", "terraform_output", c("n_name"), none, _text("modules/r", c("n_regionkey"), "/outputs.tf"), c("n_nationkey") + 1, F.lit("{}")),
        made("customer", "customer", "c_custkey", "k8s_deployment", c("c_name"), _text("ns-", c("c_nationkey")), _text("clusters/n", c("c_nationkey"), "/deploy.yaml"), c("c_custkey") % 500, _text('{"segment":"', c("c_mktsegment"), '","dependencyCount":', c("c_custkey") % 7, "}")),
        made("supplier", "supplier", "s_suppkey", "helm_chart", c("s_name"), _text("ns-", c("s_nationkey")), _text("charts/n", c("s_nationkey"), "/Chart.yaml"), c("s_suppkey") % 50, _text('{"remoteStateBackend":"', F.when(c("s_suppkey") % 2 == 0, "s3").otherwise("gcs"), '","isEncrypted":', F.when(c("s_suppkey") % 3 == 0, "true").otherwise("false"), "}")),
        made("part", "part", "p_partkey", "terraform_resource", c("p_name"), none, _text("infra/", F.lower("p_brand"), "/part.tf"), c("p_size"), _text('{"arn":"arn:aws:s3:::bucket-', F.floor(c("p_partkey") / 2), '","resourceType":"', c("p_type"), '","size":', c("p_size"), ',"tags":{"Environment":"', F.when(c("p_partkey") % 4 < 2, "production").otherwise("staging"), '","Project":"p', c("p_partkey") % 100, '"}}')),
        made("orders", "orders", "o_orderkey", "ci_job", _text("job-", c("o_orderkey")), none, _text(".ci/", c("o_orderstatus"), "/pipeline.yml"), c("o_orderkey") % 1000, _text('{"stage":"', c("o_orderpriority"), '"}')),
    ]
    return reduce(DataFrame.unionByName, parts)


@lru_cache(maxsize=4)
def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scan_id, tenant_id, id, source, target, type, confidence 0..100, implicit, metadata). Kept as `nodes` is."""
    lines = table(spark, sf_dir, "lineitem")

    def made(df: DataFrame, source: F.Column, target: F.Column, kind: str, key: F.Column) -> DataFrame:
        return df.select(
            F.lit(SCAN).alias("scan_id"),
            F.lit(TENANT).alias("tenant_id"),
            F.concat(F.lit(f"{kind}:"), source, F.lit(">"), target).alias("id"),
            source.alias("source"),
            target.alias("target"),
            F.lit(kind).alias("type"),
            (F.lit(40) + key % 61).cast("double").alias("confidence"),
            (key % 3 == 0).alias("implicit"),
            _text('{"step":', key % 5, "}").alias("metadata"),
        )

    pairs = lambda *keys: dealt(lines.select(*keys), *keys).distinct()
    c = F.col
    parts = [
        made(table(spark, sf_dir, "nation"), _key("nation", "n_nationkey"), _key("region", "n_regionkey"), "references", c("n_nationkey").cast("long")),
        made(table(spark, sf_dir, "customer"), _key("customer", "c_custkey"), _key("nation", "c_nationkey"), "depends_on", c("c_custkey")),
        made(table(spark, sf_dir, "supplier"), _key("supplier", "s_suppkey"), _key("nation", "s_nationkey"), "depends_on", c("s_suppkey")),
        made(table(spark, sf_dir, "orders"), _key("orders", "o_orderkey"), _key("customer", "o_custkey"), "OPERATES_ON", c("o_orderkey")),
        made(pairs("l_partkey", "l_suppkey"), _key("part", "l_partkey"), _key("supplier", "l_suppkey"), "FEEDS_INTO", c("l_partkey") + c("l_suppkey")),
        made(pairs("l_orderkey", "l_partkey"), _key("orders", "l_orderkey"), _key("part", "l_partkey"), "module_call", c("l_orderkey") + c("l_partkey")),
        made(table(spark, sf_dir, "region"), _key("region", "r_regionkey"), _text("customer:", c("r_regionkey") + 1), "selector_match", c("r_regionkey").cast("long")),
    ]
    return reduce(DataFrame.unionByName, parts)


def _pick(values: tuple[str, ...], index: F.Column) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, edge_id, type, category, confidence): a row of evidence for each order line, on its module_call edge."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(
        _text(F.col("l_orderkey"), "-", F.col("l_linenumber")).alias("id"),
        F.concat(F.lit("module_call:"), _key("orders", "l_orderkey"), F.lit(">"), _key("part", "l_partkey")).alias("edge_id"),
        _pick(EVIDENCE_TYPES, F.col("l_linenumber") % len(EVIDENCE_TYPES)).alias("type"),
        _pick(CATEGORIES, F.col("l_suppkey") % len(CATEGORIES)).alias("category"),
        (F.col("l_quantity") * 2).alias("confidence"),
    )


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, tenant_id, repository_id, status, started_at, completed_at, node_count, edge_count) from events; times are UTC."""
    e = table(spark, sf_dir, "events")
    started = F.to_timestamp("ts")
    return e.select(
        F.col("event_id").alias("id"),
        F.lit(TENANT).alias("tenant_id"),
        F.col("user_id").alias("repository_id"),
        F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"),
        started.alias("started_at"),
        (started + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("event_id") % 600).cast("decimal(18,6)"))).alias("completed_at"),
        (F.col("event_id") % 97).alias("node_count"),
        (F.col("event_id") % 193).alias("edge_count"),
    )


def repositories(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The nodes of either of the two repositories."""
    every = nodes(spark, sf_dir)
    return every.filter("repo_id = 'repo-0'"), every.filter("repo_id = 'repo-1'")


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Nodes and edges of a base and of a target snapshot: in the target some parts are gone, some changed, some new."""
    n, e = nodes(spark, sf_dir), edges(spark, sf_dir)
    key = F.regexp_extract("id", r":(\d+)$", 1).cast("long")
    part = F.col("type") == "terraform_resource"
    target = n.filter(~(part & (key % 7 == 0))).withColumn("metadata", F.when(part & (key % 11 == 0), F.regexp_replace("metadata", '"size":', '"depth":')).otherwise(F.col("metadata")))
    new = n.filter(part & (key % 13 == 0)).withColumns({"id": F.concat("id", F.lit("n")), "name": F.concat("name", F.lit(" new"))})
    gone = lambda side: F.col(side).startswith("part:") & (F.regexp_extract(side, r":(\d+)$", 1).try_cast("long") % 7 == 0)
    kept = e.filter(~F.coalesce(gone("source"), F.lit(False)) & ~F.coalesce(gone("target"), F.lit(False)))
    return n, e, target.unionByName(new), kept.withColumn("confidence", F.when(F.col("confidence") == 100, 99.0).otherwise(F.col("confidence")))


#: The same frames as common table expressions of DuckDB, without the word WITH.
GRAPH_SQL = """
nodes AS (
  SELECT 'scan-0' AS scan_id, 'tenant-0' AS tenant_id, 'repo-' || (k % 2) AS repo_id, kind || ':' || k AS id, * EXCLUDE (kind) FROM (
    SELECT 'region' AS kind, r_regionkey::BIGINT AS k, 'terraform_module' AS type, r_name AS name, NULL::VARCHAR AS namespace, 'modules/r' || r_regionkey || '/main.tf' AS file_path, 1 AS line_start, '{}' AS metadata FROM region
    UNION ALL SELECT 'nation', n_nationkey, 'terraform_output', n_name, NULL, 'modules/r' || n_regionkey || '/outputs.tf', n_nationkey + 1, '{}' FROM nation
    UNION ALL SELECT 'customer', c_custkey, 'k8s_deployment', c_name, 'ns-' || c_nationkey, 'clusters/n' || c_nationkey || '/deploy.yaml', c_custkey % 500, '{"segment":"' || c_mktsegment || '","dependencyCount":' || (c_custkey % 7) || '}' FROM customer
    UNION ALL SELECT 'supplier', s_suppkey, 'helm_chart', s_name, 'ns-' || s_nationkey, 'charts/n' || s_nationkey || '/Chart.yaml', s_suppkey % 50, '{"remoteStateBackend":"' || CASE WHEN s_suppkey % 2 = 0 THEN 's3' ELSE 'gcs' END || '","isEncrypted":' || CASE WHEN s_suppkey % 3 = 0 THEN 'true' ELSE 'false' END || '}' FROM supplier
    UNION ALL SELECT 'part', p_partkey, 'terraform_resource', p_name, NULL, 'infra/' || lower(p_brand) || '/part.tf', p_size, '{"arn":"arn:aws:s3:::bucket-' || (p_partkey // 2) || '","resourceType":"' || p_type || '","size":' || p_size || ',"tags":{"Environment":"' || CASE WHEN p_partkey % 4 < 2 THEN 'production' ELSE 'staging' END || '","Project":"p' || (p_partkey % 100) || '"}}' FROM part
    UNION ALL SELECT 'orders', o_orderkey, 'ci_job', 'job-' || o_orderkey, NULL, '.ci/' || o_orderstatus || '/pipeline.yml', o_orderkey % 1000, '{"stage":"' || o_orderpriority || '"}' FROM orders)),
edges AS (
  SELECT 'scan-0' AS scan_id, 'tenant-0' AS tenant_id, type || ':' || source || '>' || target AS id, source, target, type, (40 + k % 61)::DOUBLE AS confidence, k % 3 = 0 AS implicit, '{"step":' || (k % 5) || '}' AS metadata FROM (
    SELECT 'nation:' || n_nationkey AS source, 'region:' || n_regionkey AS target, 'references' AS type, n_nationkey::BIGINT AS k FROM nation
    UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'depends_on', c_custkey FROM customer
    UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'depends_on', s_suppkey FROM supplier
    UNION ALL SELECT 'orders:' || o_orderkey, 'customer:' || o_custkey, 'OPERATES_ON', o_orderkey FROM orders
    UNION ALL SELECT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'FEEDS_INTO', l_partkey + l_suppkey FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
    UNION ALL SELECT 'orders:' || l_orderkey, 'part:' || l_partkey, 'module_call', l_orderkey + l_partkey FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)
    UNION ALL SELECT 'region:' || r_regionkey, 'customer:' || (r_regionkey + 1), 'selector_match', r_regionkey FROM region)),
evidence AS (
  SELECT l_orderkey || '-' || l_linenumber AS id, 'module_call:orders:' || l_orderkey || '>part:' || l_partkey AS edge_id,
    ['depends_on_directive', 'explicit_reference', 'module_source', 'interpolation', 'function_call', 'label_matching', 'naming_convention', 'resource_proximity'][l_linenumber % 8 + 1] AS type,
    ['explicit', 'syntax', 'semantic', 'structural', 'heuristic'][l_suppkey % 5 + 1] AS category, l_quantity * 2 AS confidence FROM lineitem),
scans AS (
  SELECT event_id AS id, 'tenant-0' AS tenant_id, user_id AS repository_id, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status,
    ts AS started_at, ts + to_seconds(event_id % 600) AS completed_at, event_id % 97 AS node_count, event_id % 193 AS edge_count FROM events),
target_nodes AS (
  SELECT id, type, name, namespace, file_path, CASE WHEN type = 'terraform_resource' AND k % 11 = 0 THEN replace(metadata, '"size":', '"depth":') ELSE metadata END AS metadata FROM nodes WHERE NOT (type = 'terraform_resource' AND k % 7 = 0)
  UNION ALL SELECT id || 'n', type, name || ' new', namespace, file_path, metadata FROM nodes WHERE type = 'terraform_resource' AND k % 13 = 0),
target_edges AS (
  SELECT * REPLACE (CASE WHEN confidence = 100 THEN 99.0 ELSE confidence END AS confidence) FROM edges WHERE NOT (source LIKE 'part:%' AND split_part(source, ':', 2)::BIGINT % 7 = 0) AND NOT (target LIKE 'part:%' AND split_part(target, ':', 2)::BIGINT % 7 = 0))
"""


def pipelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, metadata): a pipeline for each customer."""
    k, yes = F.col("c_custkey"), lambda c: F.when(c, "true").otherwise("false")
    triggers = F.when(k % 3 == 0, '[{"type":"push"}]').when(k % 3 == 1, '[{"type":"push"},{"type":"schedule"}]').otherwise("[]")
    kind = F.when(k % 2 == 0, "github_actions").otherwise("gitlab_ci")
    return table(spark, sf_dir, "customer").select(_key("pipeline", "c_custkey").alias("id"), _text('{"pipelineType":"', kind, '","hasTerraformJobs":', yes(k % 3 == 0), ',"hasHelmJobs":', yes(k % 4 == 0), ',"jobCount":', k % 7, ',"triggers":', triggers, "}").alias("metadata"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, pipeline, name, needs, metadata): a job for each order, of its customer's pipeline."""
    k = F.col("o_orderkey")
    needs = F.when(k % 3 == 0, F.array(_text("job-", k - 1))).otherwise(F.array().cast("array<string>"))
    stage = F.when(k % 4 == 0, "").otherwise(_text(',"stage":"', F.col("o_orderpriority"), '"'))
    operations = F.when(k % 3 == 0, '[{"type":"terraform"}]').when(k % 3 == 1, '[{"type":"helm"},{"type":"terraform"}]').otherwise("[]")
    metadata = _text('{"pipelineId":"pipeline:', F.col("o_custkey"), '"', stage, ',"dependsOn":', F.to_json(needs), ',"operations":', operations, "}")
    return table(spark, sf_dir, "orders").select(_key("orders", "o_orderkey").alias("id"), _key("pipeline", "o_custkey").alias("pipeline"), _text("job-", k).alias("name"), needs.alias("needs"), metadata.alias("metadata"))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(step, job, text): a shell line for each order line."""
    n, part = F.col("l_linenumber"), F.col("l_partkey")
    text = (
        F.when(n % 4 == 0, _text("terraform output -json > out", part, ".json"))
        .when(n % 4 == 1, _text("helm upgrade app ./chart -f out", part, ".json"))
        .when(n % 4 == 2, _text("helm upgrade app ./chart --set x=$(terraform output v", part, ") ${{ needs.job-", F.col("l_orderkey"), ".outputs.v", part % 3, " }}"))
        .otherwise(_text("terraform output v", part))
    )
    return table(spark, sf_dir, "lineitem").select(_text(F.col("l_orderkey"), "-", n).alias("step"), _text("job-", F.col("l_orderkey")).alias("job"), text.alias("text"))


def workflow_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(workflow, job, ordinal, needs, env, outputs): a job for each order, of its customer's workflow; jobs of different workflows have the same names."""
    o, yes = F.col("ordinal"), F.lit(None).cast("map<string,string>")
    rows = table(spark, sf_dir, "orders").select(_key("pipeline", "o_custkey").alias("workflow"), "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("ordinal"))
    needs = F.when(o % 3 != 1, F.array(_text("j", o - 1))).otherwise(F.array().cast("array<string>"))
    env = F.when(o % 2 == 0, F.create_map(F.lit("E0"), _text("${{ needs.j", o - 1, ".outputs.o1 }}"), F.lit("E1"), F.lit("plain"))).otherwise(yes)
    outputs = F.when(o % 4 == 1, F.create_map(F.lit("o1"), F.lit("from terraform"), F.lit("o2"), F.lit("fixed"))).otherwise(yes)
    return rows.select("workflow", "o_orderkey", _text("j", o).alias("job"), "ordinal", needs.alias("needs"), env.alias("env"), outputs.alias("outputs"))


def workflow_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(workflow, job, ordinal, position, step, text, uses, artifact, path, env): a step for each order line, in the order's job."""
    n, v, w, o = F.col("position"), F.col("l_partkey") % 4, F.col("l_suppkey") % 3, F.col("ordinal")
    kind = (n + o) % 7
    text = (
        F.when(kind == 0, _text("export V", v, "=$(terraform output -raw o", v, ")"))
        .when(kind == 1, F.when(v == 3, "terraform output -json > my-values.json").otherwise(_text("terraform output -json > out", v, ".json")))
        .when(kind == 2, _text("helm upgrade app ./chart --set a.x=$V", v, " --set b.y=$(terraform output -raw o", w, ") --set e.f=$W", w))
        .when(kind == 3, _text('echo "V', v, "=$(terraform output o", w, ')" >> $GITHUB_ENV'))
        .when(kind == 6, _text("helm install app ./chart -f values/", F.when(v == 3, "terraform.yaml").otherwise(_text("out", v, ".json")), " --set c.z=${{ needs.j", o - 1, ".outputs.o", w, " }} --set d.e=${{ steps.s", v, ".outputs.o", v, " }} -f <(jq '{k", w, ": .x}' out", w, ".json)"))
    )
    uses = F.when(kind == 4, "actions/upload-artifact@v3").when(kind == 5, "actions/download-artifact@v3")
    artifact = F.when(kind == 4, _text("tf-art", v)).when(kind == 5, _text("TF-art", w))
    path = F.when(kind == 4, _text("out", v, ".json")).when((kind == 5) & (v % 2 == 1), _text("out", w, ".json"))
    env = F.when(kind == 0, F.create_map(_text("W", v), F.lit("${{ needs.j1.outputs.o1 }}")))
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    lines = table(spark, sf_dir, "lineitem").withColumn("position", place).withColumnRenamed("l_orderkey", "o_orderkey").join(workflow_jobs(spark, sf_dir).select("workflow", "o_orderkey", "job", "ordinal"), "o_orderkey")
    return lines.select("workflow", "job", "ordinal", "position", F.when(n % 3 != 0, _text("s", n)).alias("step"), text.alias("text"), uses.alias("uses"), artifact.alias("artifact"), path.alias("path"), env.alias("env"))


def debt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, category, priority, status, hours, file_path, created_at, resolved_at): an item of technical debt for each part."""
    k = F.col("p_partkey")
    names = {"category": ("code-smell", "design-debt", "test-debt", "documentation-debt", "dependency-debt", "security-debt"), "priority": ("critical", "high", "medium", "low"), "status": ("open", "in-progress", "resolved", "wont-fix", "deferred")}
    day = lambda n: (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(n.cast("int"))).cast("timestamp_ntz")
    chosen = [_pick(values, k % len(values)).alias(name) for name, values in names.items()]
    return table(spark, sf_dir, "part").select(k.alias("id"), *chosen, (F.col("p_size") % 9 / 2).alias("hours"), _text("src/f", k % 50, ".tf").alias("file_path"), day(k % 60).alias("created_at"), F.when(k % 5 == 2, day(k % 60 + 9)).alias("resolved_at"))


#: These as common table expressions that may follow GRAPH_SQL.
ROWS_SQL = """
pipelines AS (
  SELECT 'pipeline:' || c_custkey AS id, '{"pipelineType":"' || CASE WHEN c_custkey % 2 = 0 THEN 'github_actions' ELSE 'gitlab_ci' END || '","hasTerraformJobs":' || CASE WHEN c_custkey % 3 = 0 THEN 'true' ELSE 'false' END || ',"hasHelmJobs":' || CASE WHEN c_custkey % 4 = 0 THEN 'true' ELSE 'false' END || ',"jobCount":' || (c_custkey % 7) || ',"triggers":' || CASE c_custkey % 3 WHEN 0 THEN '[{"type":"push"}]' WHEN 1 THEN '[{"type":"push"},{"type":"schedule"}]' ELSE '[]' END || '}' AS metadata FROM customer),
jobs AS (
  SELECT 'orders:' || o_orderkey AS id, 'pipeline:' || o_custkey AS pipeline, 'job-' || o_orderkey AS name, CASE WHEN o_orderkey % 3 = 0 THEN ['job-' || (o_orderkey - 1)] ELSE [] END AS needs,
    '{"pipelineId":"pipeline:' || o_custkey || '"' || CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE ',"stage":"' || o_orderpriority || '"' END || ',"dependsOn":' || CASE WHEN o_orderkey % 3 = 0 THEN '["job-' || (o_orderkey - 1) || '"]' ELSE '[]' END || ',"operations":' || CASE o_orderkey % 3 WHEN 0 THEN '[{"type":"terraform"}]' WHEN 1 THEN '[{"type":"helm"},{"type":"terraform"}]' ELSE '[]' END || '}' AS metadata FROM orders),
steps AS (
  SELECT l_orderkey || '-' || l_linenumber AS step, 'job-' || l_orderkey AS job, CASE l_linenumber % 4 WHEN 0 THEN 'terraform output -json > out' || l_partkey || '.json' WHEN 1 THEN 'helm upgrade app ./chart -f out' || l_partkey || '.json' WHEN 2 THEN 'helm upgrade app ./chart --set x=$(terraform output v' || l_partkey || ') ${{ needs.job-' || l_orderkey || '.outputs.v' || (l_partkey % 3) || ' }}' ELSE 'terraform output v' || l_partkey END AS text FROM lineitem),
debt AS (
  SELECT p_partkey AS id, ['code-smell', 'design-debt', 'test-debt', 'documentation-debt', 'dependency-debt', 'security-debt'][p_partkey % 6 + 1] AS category, ['critical', 'high', 'medium', 'low'][p_partkey % 4 + 1] AS priority, ['open', 'in-progress', 'resolved', 'wont-fix', 'deferred'][p_partkey % 5 + 1] AS status,
    (p_size % 9) / 2.0 AS hours, 'src/f' || (p_partkey % 50) || '.tf' AS file_path, TIMESTAMP '2024-01-01' + to_days((p_partkey % 60)::INTEGER) AS created_at, CASE WHEN p_partkey % 5 = 2 THEN TIMESTAMP '2024-01-01' + to_days((p_partkey % 60 + 9)::INTEGER) END AS resolved_at FROM part)
"""


#: Jobs and steps of workflows, which may follow GRAPH_SQL.
WORKFLOWS_SQL = """
ci_jobs AS (
  SELECT *, 'j' || ordinal AS job, CASE WHEN ordinal % 3 <> 1 THEN ['j' || (ordinal - 1)] ELSE [] END AS needs,
    CASE WHEN ordinal % 2 = 0 THEN MAP {'E0': '${{ needs.j' || (ordinal - 1) || '.outputs.o1 }}', 'E1': 'plain'} END AS env, CASE WHEN ordinal % 4 = 1 THEN MAP {'o1': 'from terraform', 'o2': 'fixed'} END AS outputs
  FROM (SELECT 'pipeline:' || o_custkey AS workflow, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INTEGER AS ordinal FROM orders)),
ci_steps AS (
  SELECT workflow, job, ordinal, n AS position, CASE WHEN n % 3 <> 0 THEN 's' || n END AS step, CASE kind WHEN 0 THEN 'export V' || v || '=$(terraform output -raw o' || v || ')' WHEN 1 THEN 'terraform output -json > ' || CASE v WHEN 3 THEN 'my-values.json' ELSE 'out' || v || '.json' END
      WHEN 2 THEN 'helm upgrade app ./chart --set a.x=$V' || v || ' --set b.y=$(terraform output -raw o' || w || ') --set e.f=$W' || w WHEN 3 THEN 'echo "V' || v || '=$(terraform output o' || w || ')" >> $GITHUB_ENV'
      WHEN 6 THEN 'helm install app ./chart -f values/' || CASE v WHEN 3 THEN 'terraform.yaml' ELSE 'out' || v || '.json' END || ' --set c.z=${{ needs.j' || (ordinal - 1) || '.outputs.o' || w || ' }} --set d.e=${{ steps.s' || v || '.outputs.o' || v || ' }} -f <(jq ''{k' || w || ': .x}'' out' || w || '.json)' END AS text,
    CASE kind WHEN 4 THEN 'actions/upload-artifact@v3' WHEN 5 THEN 'actions/download-artifact@v3' END AS uses, CASE kind WHEN 4 THEN 'tf-art' || v WHEN 5 THEN 'TF-art' || w END AS artifact,
    CASE WHEN kind = 4 THEN 'out' || v || '.json' WHEN kind = 5 AND v % 2 = 1 THEN 'out' || w || '.json' END AS path, CASE kind WHEN 0 THEN 'W' || v END AS env_name
  FROM (SELECT workflow, job, ordinal, n, l_partkey % 4 AS v, l_suppkey % 3 AS w, (n + ordinal) % 7 AS kind FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)::INTEGER AS n FROM lineitem) JOIN ci_jobs ON o_orderkey = l_orderkey))
"""


def chained_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges, and such as make chains over several tools: a part feeds the job of its number, a job its customer, and a chart the deployment of its number."""
    o, s, p = table(spark, sf_dir, "orders"), table(spark, sf_dir, "supplier"), table(spark, sf_dir, "part")
    columns = ["id", "source", "target", "type", "confidence"]

    def made(df: DataFrame, source: F.Column, target: F.Column, kind: str, key: F.Column) -> DataFrame:
        return df.select(F.concat(F.lit(f"{kind}:"), source, F.lit(">"), target).alias("id"), source.alias("source"), target.alias("target"), F.lit(kind).alias("type"), (F.lit(40) + key % 61).cast("double").alias("confidence"))

    more = made(p, _key("part", "p_partkey"), _key("orders", "p_partkey"), "output_value", F.col("p_partkey"))
    more = more.union(made(o, _key("orders", "o_orderkey"), _key("customer", "o_custkey"), "secret_ref", F.col("o_orderkey")))
    more = more.union(made(s, _key("supplier", "s_suppkey"), _key("customer", "s_suppkey"), "configmap_ref", F.col("s_suppkey")))
    return edges(spark, sf_dir).select(*columns).unionByName(more)


#: The same, which may follow GRAPH_SQL.
CHAINED_SQL = """
chained AS (
  SELECT source, target, type, confidence FROM edges
  UNION ALL SELECT 'part:' || p_partkey, 'orders:' || p_partkey, 'output_value', (40 + p_partkey % 61)::DOUBLE FROM part
  UNION ALL SELECT 'orders:' || o_orderkey, 'customer:' || o_custkey, 'secret_ref', (40 + o_orderkey % 61)::DOUBLE FROM orders
  UNION ALL SELECT 'supplier:' || s_suppkey, 'customer:' || s_suppkey, 'configmap_ref', (40 + s_suppkey % 61)::DOUBLE FROM supplier)
"""
