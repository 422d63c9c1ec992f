"""Queries on merged configurations, ARN patterns and percentiles by group, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import configs, external, rollup, stats
from ..sources import property_graph as pg
from ..sources.tables import table
from .registry import plain, query


def _text(*parts):
    return F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])


def _files(spark, sf_dir):
    """Files of customers include those of their nation and of a partner, nations theirs of the region, all the common one; regions include it twice over a file of their own."""
    c, n, r = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    k = F.col("c_custkey")
    files = c.select(_text("c", k).alias("path"), F.array(_text("n", F.col("c_nationkey")), _text("r", k % 5), F.lit("common")).alias("includes"))
    files = files.union(n.select(_text("n", F.col("n_nationkey")), F.array(F.lit("common"), _text("r", F.col("n_regionkey")))))
    return files.union(r.select(_text("r", F.col("r_regionkey")), F.array(F.lit("base"), F.lit("common")))).union(r.filter("r_regionkey = 0").select(F.lit("base"), F.array(F.lit("common"))))


def _blocks(spark, sf_dir):
    c, n, r = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    k, m, q = F.col("c_custkey"), F.col("n_nationkey"), F.col("r_regionkey")
    none = F.lit(None).cast("string")
    row = lambda df, path, at, kind, key, value: df.select(path.alias("path"), F.lit(at).alias("position"), F.lit(kind).alias("kind"), key.alias("key"), value.alias("value"))
    one = r.filter("r_regionkey = 0")
    parts = [
        row(c, _text("c", k), 0, "inputs", _text("a", k % 3), F.col("c_mktsegment")), row(c, _text("c", k), 1, "inputs", F.lit("a1"), _text("late", k)),
        row(n, _text("n", m), 0, "inputs", F.lit("a2"), F.col("n_name")), row(n, _text("n", m), 1, "remote_state", none, _text("s", m)), row(n, _text("n", m), 2, "remote_state", none, F.lit("second")),
        row(r, _text("r", q), 0, "locals", F.lit("place"), F.col("r_name")), row(r, _text("r", q), 1, "remote_state", none, _text("r", q)),
        row(one, F.lit("base"), 0, "inputs", F.lit("a0"), F.lit("base")), row(one, F.lit("common"), 0, "inputs", F.lit("a0"), F.lit("common")), row(one, F.lit("common"), 1, "terraform", none, F.lit("t")),
    ]
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    return found


CONFIG_SQL = """, fi AS (SELECT 'c' || c_custkey AS path, ['n' || c_nationkey, 'r' || (c_custkey % 5), 'common'] AS includes FROM customer UNION ALL SELECT 'n' || n_nationkey, ['common', 'r' || n_regionkey] FROM nation UNION ALL SELECT 'r' || r_regionkey, ['base', 'common'] FROM region UNION ALL SELECT 'base', ['common']),
  bl AS (SELECT 'c' || c_custkey AS path, 0 AS position, 'inputs' AS kind, 'a' || (c_custkey % 3) AS key, c_mktsegment AS value FROM customer UNION ALL SELECT 'c' || c_custkey, 1, 'inputs', 'a1', 'late' || c_custkey FROM customer UNION ALL SELECT 'n' || n_nationkey, 0, 'inputs', 'a2', n_name FROM nation
    UNION ALL SELECT 'n' || n_nationkey, 1, 'remote_state', NULL, 's' || n_nationkey FROM nation UNION ALL SELECT 'n' || n_nationkey, 2, 'remote_state', NULL, 'second' FROM nation UNION ALL SELECT 'r' || r_regionkey, 0, 'locals', 'place', r_name FROM region UNION ALL SELECT 'r' || r_regionkey, 1, 'remote_state', NULL, 'r' || r_regionkey FROM region
    UNION ALL SELECT * FROM (VALUES ('base', 0, 'inputs', 'a0', 'base'), ('common', 0, 'inputs', 'a0', 'common'), ('common', 1, 'terraform', NULL, 't'))),
  inc AS (SELECT path, unnest(includes) AS next, generate_subscripts(includes, 1) AS i FROM fi),
  wy AS (SELECT path, next AS file, [i] AS way FROM inc UNION ALL SELECT wy.path, inc.next, list_append(way, inc.i) FROM wy JOIN inc ON inc.path = wy.file),
  fw AS (SELECT path, file, min(way) AS way FROM wy WHERE path <> file GROUP BY ALL), ch AS (SELECT path, file, list_append(way, 999) AS place FROM fw UNION ALL SELECT path, path, [999, 1] FROM fi)"""


@plain("merged_configs", f"{CONFIG_SQL} SELECT ch.path, kind, key, arg_max(value, (place, CASE WHEN key IS NULL THEN -position ELSE position END)) AS value, arg_max(file, (place, CASE WHEN key IS NULL THEN -position ELSE position END)) AS origin FROM ch JOIN bl ON bl.path = ch.file GROUP BY ch.path, kind, key")
def merged_configs(spark, sf_dir):
    return configs.merged(_files(spark, sf_dir), _blocks(spark, sf_dir))


@plain("config_ancestors", f"{CONFIG_SQL} SELECT path, file AS ancestor, row_number() OVER (PARTITION BY path ORDER BY place) AS n FROM ch WHERE path <> file")
def config_ancestors(spark, sf_dir):
    found = configs.ancestors(_files(spark, sf_dir))
    listed = found.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("place", "ancestor"))).alias("a"))
    return listed.select("path", F.posexplode("a").alias("n", "x")).select("path", "x.ancestor", (F.col("n") + 1).cast("long").alias("n"))


@query("arn_patterns", """, p AS (SELECT DISTINCT unnest(['arn:aws:s3:::bucket-' || s_suppkey || '*', 'arn:*:s3:*:*:*-' || s_suppkey, 'arn:aws:s3:::b*et-' || s_suppkey, 'arn:aws:s3:::*t-' || s_suppkey || '*', 'arn:aws:s3:::bucket-' || s_suppkey, 'arn:aws:sqs:*:*:' || s_suppkey]) AS pattern FROM supplier), a AS (SELECT DISTINCT metadata->>'arn' AS arn FROM nodes WHERE metadata->>'arn' IS NOT NULL)
  SELECT pattern, arn FROM p JOIN a ON regexp_full_match(arn, replace(pattern, '*', '.*'))""")
def arn_patterns(nodes, edges):
    k = F.regexp_extract("id", r":(\d+)$", 1)
    forms = F.explode(F.array(_text("arn:aws:s3:::bucket-", k, "*"), _text("arn:*:s3:*:*:*-", k), _text("arn:aws:s3:::b*et-", k), _text("arn:aws:s3:::*t-", k, "*"), _text("arn:aws:s3:::bucket-", k), _text("arn:aws:sqs:*:*:", k)))
    return external.wildcard_matches(nodes.filter("type = 'helm_chart'").select(forms.alias("pattern")), nodes.select(F.get_json_object("metadata", "$.arn").alias("arn")))


@query("arn_matches_of_pattern", "SELECT a.id AS source, b.id AS target FROM nodes a JOIN nodes b ON a.metadata->>'arn' = b.metadata->>'arn' AND a.repo_id < b.repo_id WHERE a.metadata->>'arn' LIKE 'arn:aws:s3:::bucket-%7'")
def arn_matches_of_pattern(nodes, edges):
    return rollup.matches(nodes, rollup.arn_matcher(pattern="arn:*:s3:::bucket-*7")).select("source", "target")


@plain("percentiles_by_status", """, r AS (SELECT status, node_count::DOUBLE AS x, row_number() OVER (PARTITION BY status ORDER BY node_count) AS i, count(*) OVER (PARTITION BY status) AS n FROM scans)
  SELECT status, min(x) AS least, max(x) AS most, round(avg(x), 6) AS average, round(stddev_pop(x), 6) AS deviation, max(x) FILTER (i = ceil(0.5 * n)) AS p50, max(x) FILTER (i = ceil(0.75 * n)) AS p75, max(x) FILTER (i = ceil(0.9 * n)) AS p90, max(x) FILTER (i = ceil(0.95 * n)) AS p95, max(x) FILTER (i = ceil(0.99 * n)) AS p99 FROM r GROUP BY status""")
def percentiles_by_status(spark, sf_dir):
    return stats.percentiles_by(pg.scans(spark, sf_dir).select("status", F.col("node_count").cast("double").alias("x")), "x", ["status"])
