"""Queries over the jobs and steps of workflows, with DuckDB SQL that tries every pair of steps of a workflow."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import workflows
from ..sources import property_graph as pg
from ..sources.tables import checkpointed, wide
from .registry import plain

STEPS_SQL = rf""", {pg.WORKFLOWS_SQL},
tf AS (SELECT *, list_distinct(regexp_extract_all(text, 'terraform\s+output\s+(?:-(?:raw|json)\s+)?([a-zA-Z_]\w*)', 1)) AS outs FROM ci_steps WHERE regexp_matches(text, 'terraform\s+')),
h AS (SELECT workflow, job AS t_job, ordinal AS t_ordinal, position AS t_position, text FROM ci_steps WHERE regexp_matches(text, 'helm\s+')),
dep AS (SELECT workflow, job, unnest(needs) AS src FROM ci_jobs), depends AS (SELECT * FROM dep UNION SELECT a.workflow, a.job, b.src FROM dep a JOIN dep b ON a.workflow = b.workflow AND a.src = b.job)"""

SET = r"--set(?:-string)?\s+([^=\s]+)="
DIRECT_SQL = rf"""du AS (SELECT *, unnest(regexp_extract_all(text, '{SET}\$\(\s*terraform\s+output\s+(?:-raw\s+)?([a-zA-Z_]\w*)\s*\)', 1)) AS path, unnest(regexp_extract_all(text, '{SET}\$\(\s*terraform\s+output\s+(?:-raw\s+)?([a-zA-Z_]\w*)\s*\)', 2)) AS output FROM h),
direct AS (
  SELECT u.workflow, u.t_job, u.t_ordinal, u.t_position, u.path, u.output, arg_min((tf.job, tf.position), (CASE WHEN tf.job = u.t_job THEN 0 WHEN d.src IS NOT NULL THEN 1 ELSE 2 END, tf.ordinal, tf.position)) AS s, 100.0::DOUBLE AS confidence
  FROM du u JOIN tf ON tf.workflow = u.workflow AND regexp_matches(tf.text, '\b' || u.output || '\b') LEFT JOIN depends d ON d.workflow = u.workflow AND d.job = u.t_job AND d.src = tf.job GROUP BY ALL)"""
ENV_SQL = rf"""defs AS (
  SELECT workflow, job, ordinal, position, unnest(regexp_extract_all(text, '([a-zA-Z_]\w*)=\$\(\s*terraform\s+output\s+(?:-raw\s+)?([a-zA-Z_]\w*)\s*\)', 1)) AS variable, unnest(regexp_extract_all(text, '([a-zA-Z_]\w*)=\$\(\s*terraform\s+output\s+(?:-raw\s+)?([a-zA-Z_]\w*)\s*\)', 2)) AS output FROM tf
  UNION ALL SELECT workflow, job, ordinal, position, env_name, outs[1] FROM tf WHERE env_name IS NOT NULL),
vs AS (
  SELECT * EXCLUDE (value), unnest(regexp_extract_all(value, '\$([a-zA-Z_]\w*)', 1)) AS variable FROM (SELECT *, unnest(regexp_extract_all(text, '{SET}([^\s]+)', 1)) AS path, unnest(regexp_extract_all(text, '{SET}([^\s]+)', 2)) AS value FROM h)
  UNION SELECT * FROM (SELECT workflow, t_job, t_ordinal, t_position, text, regexp_extract(text, '{SET}.*\$' || variable, 1) AS path, variable FROM (SELECT *, unnest(regexp_extract_all(text, '\$([a-zA-Z_]\w*)', 1)) AS variable FROM h)) WHERE path <> ''),
last AS (SELECT workflow, variable, arg_max((job, position, output), (ordinal, position)) AS d FROM defs GROUP BY ALL)"""
FLOW_SQL = """SELECT workflow, s[1] AS source_job, s[2] AS source_position, output, t_job AS target_job, t_position AS target_position, path, confidence FROM """


def _frames(spark, sf_dir):
    return workflows.frames(pg.workflow_steps(spark, sf_dir), pg.workflow_jobs(spark, sf_dir))


def _shown(found):
    return found.select("workflow", "source_job", "source_position", "output", "target_job", "target_position", "path", "confidence")


@plain("output_links", f"{STEPS_SQL}, {DIRECT_SQL} {FLOW_SQL} direct")
def output_links(spark, sf_dir):
    _, terraform, helm, depends = _frames(spark, sf_dir)
    return _shown(workflows.direct_flows(terraform, helm, depends))


ENV_FLOWS = "env AS (SELECT v.workflow, t_job, t_ordinal, t_position, path, d[3] AS output, (d[1], d[2]) AS s, CASE WHEN d[1] <> t_job AND src IS NOT NULL THEN 100.0 ELSE 100.0 END::DOUBLE AS confidence FROM vs v JOIN last l ON l.workflow = v.workflow AND l.variable = v.variable LEFT JOIN depends p ON p.workflow = v.workflow AND p.job = t_job AND p.src = d[1])"


@plain("env_links", f"{STEPS_SQL}, {ENV_SQL}, {ENV_FLOWS} {FLOW_SQL} env")
def env_links(spark, sf_dir):
    _, terraform, helm, depends = _frames(spark, sf_dir)
    return _shown(workflows.env_flows(terraform, helm, depends))


REACHING = """reached AS (SELECT v.*, arg_max((job, position, output), (ordinal, position)) AS d FROM vs v JOIN defs f ON f.workflow = v.workflow AND f.variable = v.variable AND (f.ordinal, f.position) < (v.t_ordinal, v.t_position) GROUP BY ALL)
SELECT workflow, d[1] AS source_job, d[2] AS source_position, d[3] AS output, t_job AS target_job, t_position AS target_position, path FROM reached"""


@plain("reaching_definitions", f"{STEPS_SQL}, {ENV_SQL}, {REACHING}")
def reaching_definitions(spark, sf_dir):
    _, terraform, helm, depends = _frames(spark, sf_dir)
    return _shown(workflows.env_flows(terraform, helm, depends, reaching=True)).drop("confidence")


FILES_SQL = r"""wf AS (SELECT workflow, job, ordinal, position, unnest(regexp_extract_all(text, 'terraform\s+output\s+-json\s*>\s*([^\s|;]+)', 1)) AS file FROM tf),
fu AS (
  SELECT *, true AS piped, unnest(regexp_extract_all(text, '-f\s+<\(\s*(jq|yq)\s+''\{([a-z0-9]+):[^'']*''\s+([^\s)]+)\s*\)', 2)) AS path, unnest(regexp_extract_all(text, '-f\s+<\(\s*(jq|yq)\s+''\{([a-z0-9]+):[^'']*''\s+([^\s)]+)\s*\)', 3)) AS file FROM h
  UNION ALL SELECT * EXCLUDE (x), false, x, x FROM (SELECT *, unnest(regexp_extract_all(text, '-f\s+([^\s]+)', 1)) AS x FROM h)),
fb AS (SELECT *, regexp_replace(regexp_replace(file, '^.*/', ''), '[.][^.]+$', '') AS base FROM fu), wb AS (SELECT *, regexp_replace(regexp_replace(file, '^.*/', ''), '[.][^.]+$', '') AS base FROM wf),
files AS (
  SELECT u.workflow, t_job, t_ordinal, t_position, path, piped, 'json_outputs' AS output, arg_min((w.job, w.position), (w.ordinal, w.position)) AS s
  FROM fb u JOIN wb w ON u.workflow = w.workflow AND CASE WHEN piped THEN ends_with(u.file, w.file) OR ends_with(w.file, u.file) ELSE contains(u.file, w.file) OR contains(w.file, u.file) OR contains(u.base, w.base) OR contains(w.base, u.base)
    OR (contains(u.base, 'terraform') AND contains(w.base, 'values')) OR (contains(u.base, 'tf') AND contains(w.base, 'helm')) OR (contains(u.base, 'output') AND contains(w.base, 'values')) END
  GROUP BY ALL),
file AS (SELECT f.* EXCLUDE (piped), CASE WHEN NOT piped THEN 95.0 ELSE 100.0 END::DOUBLE AS confidence FROM files f)"""


@plain("file_links", f"{STEPS_SQL}, {FILES_SQL} {FLOW_SQL} file")
def file_links(spark, sf_dir):
    _, terraform, helm, depends = _frames(spark, sf_dir)
    return _shown(workflows.file_flows(terraform, helm, depends))


ARTIFACT_SQL = r"""up AS (
  SELECT c.workflow, lower(c.artifact) AS name, c.path, c.ordinal, c.position, c.job, min(tf.position) AS first, bool_or(contains(tf.text, c.path) OR regexp_matches(c.path, '(?i)terraform.*output|tf.*output|\.tfoutput|outputs?\.json')) AS holds
  FROM ci_steps c JOIN tf ON tf.workflow = c.workflow AND tf.job = c.job WHERE c.uses LIKE '%upload-artifact%' GROUP BY ALL),
dn AS (SELECT workflow, job, position, lower(artifact) AS name, coalesce(path, '') AS d_path FROM ci_steps WHERE uses LIKE '%download-artifact%'),
am AS (
  SELECT d.workflow, d.job, d.position, d.d_path, arg_min({'path': u.path, 'job': u.job, 'first': u.first, 'holds': u.holds}, (u.ordinal, u.position)) AS u FROM dn d JOIN up u ON u.workflow = d.workflow
    AND (contains(u.name, d.name) OR contains(d.name, u.name) OR (contains(u.name, 'terraform') AND contains(d.name, 'terraform')) OR (contains(u.name, 'tf') AND contains(d.name, 'tf')) OR (contains(u.name, 'output') AND contains(d.name, 'output')))
  GROUP BY ALL),
ax AS (SELECT h.*, am.position AS d_position, am.d_path, am.u, CASE d_path WHEN '' THEN u.path ELSE d_path END AS f FROM h JOIN am ON am.workflow = h.workflow AND am.job = h.t_job),
art AS (
  SELECT a.workflow, t_job, t_ordinal, t_position, CASE d_path WHEN '' THEN 'values' ELSE d_path END AS path, CASE WHEN u.holds THEN regexp_replace(regexp_replace(u.path, '^.*/', ''), '[.][^.]+$', '') ELSE 'artifact_data' END AS output, (u.job, u.first) AS s, d_position,
    least(100, round(65 + (150 + CASE WHEN p.src IS NULL THEN 0 ELSE 85 END + CASE WHEN u.holds THEN 80 ELSE 0 END) / (2.0 + (p.src IS NOT NULL)::INT + u.holds::INT) * 0.3 + least(10, 2 * (2 + (p.src IS NOT NULL)::INT + u.holds::INT))))::DOUBLE AS confidence
  FROM ax a LEFT JOIN depends p ON p.workflow = a.workflow AND p.job = t_job AND p.src = u.job
  WHERE contains(text, f) OR len(list_filter(regexp_extract_all(text, '-f\s+([^\s]+)', 1), lambda v: ends_with(v, f) OR ends_with(f, v))) > 0)"""


@plain("artifact_links", f"{STEPS_SQL}, {ARTIFACT_SQL} {FLOW_SQL} art")
def artifact_links(spark, sf_dir):
    steps, terraform, helm, depends = _frames(spark, sf_dir)
    return _shown(workflows.artifact_flows(steps, terraform, helm, depends))


ALL_SQL = f"""{STEPS_SQL}, {DIRECT_SQL}, {ENV_SQL}, {ENV_FLOWS}, {FILES_SQL}, {ARTIFACT_SQL},
every AS (
  SELECT 0 AS o, 'direct_output' AS pattern, workflow, s, output, t_job, t_ordinal, t_position, path, confidence FROM direct UNION ALL SELECT 1, 'output_to_env', workflow, s, output, t_job, t_ordinal, t_position, path, confidence FROM env
  UNION ALL SELECT 2, 'output_to_file', workflow, s, output, t_job, t_ordinal, t_position, path, confidence FROM file UNION ALL SELECT 3, 'artifact_transfer', workflow, s, output, t_job, t_ordinal, t_position, path, confidence FROM art)"""


@plain("detected_flows", f"{ALL_SQL} SELECT workflow, s[1] AS source_job, output, t_job AS target_job, path, arg_min(pattern, (o, t_ordinal, t_position)) AS pattern, arg_min(t_position, (o, t_ordinal, t_position)) AS target_position FROM every GROUP BY ALL")
def detected_flows(spark, sf_dir):
    steps, jobs = pg.workflow_steps(spark, sf_dir), pg.workflow_jobs(spark, sf_dir)
    return workflows.detected(steps, jobs).select("workflow", "source_job", "output", "target_job", "path", "pattern", "target_position")


TRACE_SQL = rf"""{STEPS_SQL},
va AS (
  SELECT DISTINCT workflow, job, 'needs' AS scope, unnest(regexp_extract_all(text, 'needs\.([\w.]+)', 1)) AS name FROM ci_steps UNION SELECT workflow, job, 'steps', unnest(regexp_extract_all(text, 'steps\.([\w.]+)', 1)) FROM ci_steps
  UNION SELECT workflow, job, 'env', unnest(['E0', 'E1']) FROM ci_jobs UNION SELECT workflow, job, 'other', unnest(['tf_x', 'plain', 'vpc_id']) FROM ci_jobs WHERE ordinal = 1),
oj AS (SELECT workflow, job, bool_or(regexp_matches(text, '(?i)terraform\s+output')) AS asks, list_distinct(flatten(list(outs))) AS outs FROM tf GROUP BY ALL),
vp AS (SELECT *, split_part(name, '.', 1) AS j, string_split(name, '.')[-1] AS o FROM va)
SELECT v.workflow, v.job, scope, name, CASE WHEN asks OR list_contains(outs, o) THEN 'terraform_output' ELSE 'job_output' END AS type, j || '.outputs.' || o AS source, CASE WHEN asks OR list_contains(outs, o) THEN 85.0 ELSE 60.0 END::DOUBLE AS confidence
  FROM vp v JOIN dep ON dep.workflow = v.workflow AND dep.job = v.job AND dep.src = v.j JOIN oj ON oj.workflow = v.workflow AND oj.job = v.j WHERE scope = 'needs'
UNION ALL SELECT v.workflow, v.job, scope, name, 'terraform_output', j || '.outputs.' || o, 75.0 FROM vp v JOIN ci_jobs c ON c.workflow = v.workflow AND c.job = v.j WHERE scope = 'needs' AND contains(c.outputs[o], 'terraform')
UNION ALL SELECT v.workflow, v.job, scope, name, CASE name WHEN 'E0' THEN 'terraform_output' ELSE 'env_variable' END, 'env.' || name, CASE name WHEN 'E0' THEN 80.0 ELSE 40.0 END FROM vp v JOIN ci_jobs c ON c.workflow = v.workflow AND c.job = v.job WHERE scope = 'env' AND c.env IS NOT NULL
UNION ALL SELECT DISTINCT v.workflow, v.job, scope, name, 'terraform_output', 'steps.' || j || '.outputs.' || o, 90.0 FROM vp v JOIN tf ON tf.workflow = v.workflow AND tf.job = v.job AND tf.step = v.j WHERE scope = 'steps' AND contains(tf.text, 'terraform output')
UNION ALL SELECT workflow, job, scope, name, 'terraform_output', name, 45.0 FROM vp WHERE scope = 'other' AND name <> 'plain'"""


@plain("traced_variables", TRACE_SQL)
def traced_variables(spark, sf_dir):
    steps, jobs = pg.workflow_steps(spark, sf_dir).select("workflow", "job", "step", "text").filter("text is not null"), checkpointed(pg.workflow_jobs(spark, sf_dir), "jobs")
    steps = wide(checkpointed(steps, "steps"))  # a shell line is made of many cases, and read for each scope
    named = lambda scope: steps.select("workflow", "job", F.lit(scope).alias("scope"), F.explode(F.regexp_extract_all("text", F.lit(rf"{scope}\.([\w.]+)"), F.lit(1))).alias("name"))
    listed = lambda df, scope, *names: df.select("workflow", "job", F.lit(scope).alias("scope"), F.explode(F.array(*map(F.lit, names))).alias("name"))
    asked = named("needs").union(named("steps")).union(listed(jobs, "env", "E0", "E1")).union(listed(jobs.filter("ordinal = 1"), "other", "tf_x", "plain", "vpc_id"))
    return workflows.traced(asked, steps, jobs)


@plain("expression_links", rf"""{STEPS_SQL}, ex AS (SELECT workflow, t_job, text, position AS p, coalesce(step, 'step-' || position) AS t_step, n, s, o FROM (
    SELECT c.workflow, c.job AS t_job, c.text, c.position, c.step, unnest(regexp_extract_all(text, '(needs|steps)\.(\w+)\.outputs\.(\w+)', 1)) AS n, unnest(regexp_extract_all(text, '(needs|steps)\.(\w+)\.outputs\.(\w+)', 2)) AS s, unnest(regexp_extract_all(text, '(needs|steps)\.(\w+)\.outputs\.(\w+)', 3)) AS o FROM ci_steps c))
  SELECT DISTINCT workflow, CASE n WHEN 'needs' THEN s ELSE t_job END AS source_job, CASE n WHEN 'steps' THEN s END AS source_step, o AS output, t_job AS target_job, t_step AS target_step, CASE n WHEN 'needs' THEN 'job_output' ELSE 'step_output' END AS flow_type, 95.0::DOUBLE AS confidence FROM ex
  UNION ALL SELECT DISTINCT e.workflow, s, NULL, o, t_job, t_step, 'terraform_to_helm', 85.0 FROM ex e JOIN dep ON dep.workflow = e.workflow AND dep.job = e.t_job AND dep.src = e.s WHERE n = 'needs' AND contains(text, 'helm ') AND EXISTS (SELECT 1 FROM tf WHERE tf.workflow = e.workflow AND tf.job = e.s)""")
def expression_links(spark, sf_dir):
    return workflows.output_flows(pg.workflow_steps(spark, sf_dir), pg.workflow_jobs(spark, sf_dir))


@plain("job_chains", f"""{STEPS_SQL}, {DIRECT_SQL}, pr AS (SELECT DISTINCT workflow, s[1] AS source, t_job AS target FROM direct),
  w AS (SELECT DISTINCT workflow, source, [source] AS chain FROM pr UNION ALL SELECT w.workflow, source, list_append(chain, job) FROM w JOIN dep ON dep.workflow = w.workflow AND dep.src = chain[-1])
  SELECT p.workflow, p.source, p.target, coalesce(min_chain, CASE WHEN p.source = p.target THEN p.source ELSE p.source || '>' || p.target END) AS chain
  FROM pr p LEFT JOIN (SELECT workflow, source, chain[-1] AS target, arg_min(array_to_string(chain, '>'), (len(chain), chain)) AS min_chain FROM w GROUP BY ALL) c ON c.workflow = p.workflow AND c.source = p.source AND c.target = p.target""")
def job_chains(spark, sf_dir):
    _, terraform, helm, depends = _frames(spark, sf_dir)
    found = workflows.direct_flows(terraform, helm, depends)
    return workflows.job_chains(found, pg.workflow_jobs(spark, sf_dir)).withColumn("chain", F.array_join("chain", ">"))


@plain("step_operations", f""", {pg.WORKFLOWS_SQL} SELECT workflow, job, position, CASE WHEN text LIKE '%terraform output%' THEN 'terraform' WHEN text LIKE 'helm %' THEN 'helm' WHEN trim(text) <> '' THEN 'script' END AS type,
  CASE WHEN text LIKE '%terraform output%' THEN 'output' WHEN text LIKE 'helm install%' THEN 'install' ELSE 'upgrade' END AS command,
  CASE WHEN text LIKE '%terraform output%' THEN array_to_string(list_concat(regexp_extract_all(text, 'terraform output (?:-raw )?(?:-json )?([a-zA-Z_][a-zA-Z0-9_]*)', 1), regexp_extract_all(text, 'echo "([A-Z0-9]+)=', 1)), ',') ELSE '' END AS outputs FROM ci_steps WHERE text IS NOT NULL""")
def step_operations(spark, sf_dir):
    return workflows.operations(pg.workflow_steps(spark, sf_dir)).withColumn("outputs", F.array_join("outputs", ","))
