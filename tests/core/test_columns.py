"""Column functions and table operators, with literal expectations."""

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import external as fx
from loomgraph.functions import graph as fg
from loomgraph.operators import diff, external, flows, rollup, scoring, search, stats, tables


def one(spark, column, **values):
    return spark.range(1).select(F.lit(1).alias("one"), *[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


def test_tools_levels_and_risks(spark):
    assert one(spark, fg.tool_of(F.col("t")), t="k8s_pod") == "kubernetes" and one(spark, fg.tool_of(F.col("t")), t="other") == "terraform"
    assert [one(spark, fg.confidence_level(F.col("c")), c=c) for c in (95, 94.9, 60, 40, 39)] == ["certain", "high", "medium", "low", "uncertain"]
    assert one(spark, fg.risk_level(F.lit(2), F.lit(4), F.lit(0))) == "low"
    assert one(spark, fg.risk_level(F.lit(20), F.lit(10), F.lit(5))) == "critical"


def test_texts(spark):
    assert one(spark, fg.fnv1a(F.col("t")), t="hello") == "4f9f2cab"
    assert one(spark, fg.normal_path(F.col("p")), p=".\\A\\b/") == "a/b"
    assert one(spark, fg.path_similarity(F.col("a"), F.col("b")), a="x/y/z", b="x/y/w") == 67
    assert one(spark, fg.name_similarity(F.col("a"), F.col("b")), a="my-app", b="my_app") == 100
    assert one(spark, fg.name_similarity(F.col("a"), F.col("b")), a="my-app", b="myapp2") == 80
    assert [tuple(r) for r in one(spark, fg.version_constraints(F.col("v")), v=">= 1.2, ~> 3.0,4")] == [(">=", "1.2"), ("~>", "3.0"), ("=", "4")]
    kinds = {"./a": "local", "github.com/x/y": "github", "git::https://h/x.git": "git", "s3::https://b": "s3", "hashicorp/vpc/aws": "registry", "what": "unknown"}
    assert {k: one(spark, fg.module_source_kind(F.col("s")), s=k) for k in kinds} == kinds
    assert one(spark, fg.expressions(F.col("t")), t="a ${{ needs.x.outputs.y }} ${{ github.sha }}") == ["needs.x.outputs.y", "github.sha"]
    assert one(spark, fg.infrastructure_command(F.col("t")), t="cd x && terraform -chdir=y plan -out z") == "terraform plan"
    assert one(spark, fg.template_values(F.col("t")), t="{{ .Values.image.tag }} {{ .Values.a }} {{ .Values.a }}") == ["image.tag", "a"]


def test_external_ids(spark):
    arn = "arn:aws:s3:eu-west-1:123456789012:bucket/My-Key"
    assert one(spark, fx.normal_arn(F.col("a")), a=arn) == "arn:aws:s3:::bucket/my-key"
    assert one(spark, fx.arn_parts(F.col("a")), a="no arn") is None
    assert one(spark, fx.arn_confidence(F.lit(arn), F.lit("arn:aws:s3:::bucket/My-Key"))) == 100
    assert one(spark, fx.arn_confidence(F.lit(arn), F.lit("arn:aws-cn:s3:::bucket/My-Key"))) == 67
    assert one(spark, fx.provider_of(F.col("i")), i="vpc-0123abcd") == "aws" and one(spark, fx.provider_of(F.col("i")), i="x") == "unknown"


def test_upsert_and_updates(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, w string")
    new = spark.createDataFrame([(2, "B", "Y"), (3, "C", "Z")], "k int, v string, w string")
    assert {tuple(r) for r in tables.upsert(old, new, ["k"], ["v"]).collect()} == {(1, "a", "x"), (2, "B", "y"), (3, "C", "Z")}
    assert {tuple(r) for r in tables.insert_missing(old, new, ["k"]).collect()} == {(3, "C", "Z")}
    assert tables.tenant_rows(old.withColumn("tenant_id", F.lit("t")), None).count() == 0
    assert tables.page(old, [F.col("k")], 1, 1).first()["total_count"] == 2


def test_evidence_scores(spark):
    rows = [("e", "explicit_reference", "explicit", 90.0), ("e", "interpolation", "syntax", 80.0), ("h", "naming_convention", "heuristic", 40.0)]
    got = {r["edge_id"]: r for r in scoring.edge_scores(spark.createDataFrame(rows, "edge_id string, type string, category string, confidence double")).collect()}
    assert got["e"]["value"] == 100 and got["e"]["base"] == 81 and got["e"]["multiplier"] == 1.085 and got["e"]["level"] == "certain"
    assert got["h"]["value"] == round(24 - 15 + 0.8) and got["h"]["level"] == "uncertain"


def test_flow_score(spark):
    e = "array<struct<type:string,strength:double,snippet:string,description:string>>"
    df = spark.createDataFrame([("direct_output", [("explicit_reference", 90.0, "x", None)]), ("inferred", [("step_proximity", 30.0, "jq .", None)]), ("odd", [])], f"pattern string, evidence {e}")
    got = [r["s"]["total"] for r in df.select(flows.flow_score(F.col("pattern"), F.col("evidence")).alias("s")).collect()]
    assert got == [100, 40 + 9 - (5 + 3 + 5 + 5), 40]


def test_leaf_paths_and_diffs(spark):
    assert one(spark, diff.leaves(F.col("m")), m='{"a":{"b":1,"c":[1,2]},"id":5,"d":"x"}') == {"a.b": "1", "a.c": "[1,2]", "d": "x"}
    rows = [("1", "t", "n", None, "p", '{"a":1}'), ("2", "t", "m", None, "p", "{}")]
    schema = "id string, type string, name string, namespace string, file_path string, metadata string"
    base, other = spark.createDataFrame(rows, schema), spark.createDataFrame([("9", "t", "n", None, "P/", '{"a":2}'), ("3", "t", "k", "s", "p", "{}")], schema)
    assert diff.node_diff(base, base).filter("change <> 'unchanged'").count() == 0
    assert {(r["key"], r["change"]) for r in diff.node_diff(base, other).collect()} == {("t::n::p", "modified"), ("t::m::p", "removed"), ("t::k::p::s", "added")}


def test_matching_and_merging(spark):
    schema = "repo_id string, id string, type string, name string, namespace string, metadata string"
    arn = '{"arn":"arn:aws:s3:%s::shared-bucket","tags":{"Environment":"production"}}'
    df = spark.createDataFrame([("a", "1", "terraform_resource", "Bucket", None, arn % "eu"), ("b", "2", "terraform_resource", "bucket", None, arn % "us"), ("c", "3", "k8s_pod", "bucket", None, "{}"), ("a", "4", "t", "other", None, "{}")], schema)
    found = rollup.all_matches(df, [rollup.arn_matcher(), rollup.name_matcher(), rollup.tag_matcher(["Environment"])])
    assert {(r["source"], r["target"], r["strategy"], r["confidence"]) for r in found.collect()} == {("1", "2", "arn", 100), ("1", "3", "name", 95), ("2", "3", "name", 95)}
    grouped = rollup.groups(found)
    merged = rollup.merged_nodes(df, grouped).collect()
    assert len(merged) == 1 and merged[0]["name"] == "bucket" and merged[0]["source_ids"] == ["a/1", "b/2", "c/3"]
    edges = spark.createDataFrame([("a", "1", "4", "x"), ("b", "2", "2", "x"), ("a", "4", "1", "x")], "repo_id string, source string, target string, type string")
    out = {(r["source"], r["target"], r["cross_repo"]) for r in rollup.remapped_edges(edges, grouped, rollup.merged_nodes(df, grouped)).collect()}
    assert out == {(merged[0]["id"], "a/4", True), ("a/4", merged[0]["id"], True)}


def test_kubernetes_references(spark):
    spec = '{"serviceAccountName":"sa","containers":[{"envFrom":[{"configMapRef":{"name":"cm"}},{"secretRef":{"name":"s"}}]}],"volumes":[{"persistentVolumeClaim":{"claimName":"data"}},{"secret":{"secretName":"s"}}]}'
    df = spark.createDataFrame([("n", spec), ("m", "{}")], "id string, spec string")
    assert {(r["kind"], r["name"]) for r in external.kubernetes_references(df).collect()} == {("configmap", "cm"), ("secret", "s"), ("pvc", "data"), ("serviceaccount", "sa")}


def test_search_and_percentiles(spark):
    assert one(spark, search.trigram_similarity(F.col("a"), F.col("b")), a="word", b="two words") == pytest.approx(0.363636, abs=1e-5)
    df = spark.createDataFrame([(1, "red fox"), (2, "red red dog"), (3, "blue")], "id int, name string")
    assert [r["id"] for r in search.bm25(df, "red fox").orderBy(F.desc("score")).collect()] == [1, 2]
    row = stats.percentiles(spark.range(1, 101).select(F.col("id").cast("double").alias("x")), "x").first()
    assert (row["p50"], row["p99"], row["average"]) == (50, 99, 50.5)
