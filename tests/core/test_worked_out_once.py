"""What is costly to work out for a row is worked out once, not in each place that names it."""

import json

from pyspark.sql import functions as F

from loomgraph.operators import rollup, workflows
from loomgraph.plans import workflows as plans

NODE = "repo_id string, id string, type string, name string, namespace string, metadata string"
STEP = "workflow string, job string, ordinal int, position int, step string, text string, uses string, artifact string, path string, env map<string,string>"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def pairs(found):
    return sorted((r["source"], r["target"], r["confidence"]) for r in found.collect())


def test_ids_of_resources(spark):
    texts = ('{"arn":"b-1","resourceType":"x"}', '{"arn":"b-1","resourceType":"y"}', '{"\\u0061rn":"b-1","resourceType":"x"}', '{"arn":"b-2"}', "{}", None)
    nodes = spark.createDataFrame([(f"r{i}", f"n{i}", "terraform_resource", "n", None, t) for i, t in enumerate(texts)], NODE)
    shown = nodes.withColumn("metadata", F.regexp_replace("metadata", "arn", "unique_id"))
    found = rollup.matches(shown, rollup.resource_id_matcher("bucket", extract=r"b-(\d+)"))
    assert plan(found).count("regexp_replace(") <= 4  # for either side, in the id and in the kind
    assert pairs(found) == [("n0", "n1", 95.0)]
    escaped = nodes.withColumn("metadata", F.regexp_replace("metadata", "(a|u0061)rn", "$1rn_id"))  # a name of a field spelled by an escape is found as well
    assert pairs(rollup.matches(escaped, rollup.resource_id_matcher("arn"))) == [("n0", "n1", 95.0), ("n0", "n2", 100.0), ("n1", "n2", 95.0)]


def test_entries_of_tags(spark):
    tagged = lambda kind, **tags: json.dumps({"resourceType": kind, "labels": tags})
    rows = [("r0", "a", tagged("x", A="1", B="2", C="3")), ("r1", "b", tagged("x", A="1", B="2", C="4")), ("r1", "c", tagged("y", A="1", B="5")), ("r1", "d", None)]
    nodes = spark.createDataFrame([(repo, node, "terraform_resource", "n", None, m) for repo, node, m in rows], NODE)
    shown = nodes.withColumn("metadata", F.regexp_replace("metadata", "labels", "tags"))
    entries = shown.select(rollup.tag_entries(["A", "B", "C"], "any").alias("own")).filter("own is not null")
    assert plan(entries).count("regexp_replace(") <= 2  # in the filter and in the column
    assert pairs(rollup.tag_matches(shown, ["A", "B", "C"], 60, "any")) == [("a", "b", 2 / 3 * 100 + 5)]
    assert pairs(rollup.tag_matches(shown, ["A", "B", "C"], 60)) == [("a", "b", 2 / 3 * 100 + 5)]


def test_steps_of_workflows(spark):
    texts = ["TERRAFORM OUTPUT -raw a", "export X=$(terraform output b)", "terraform init", "terraform  destroy", "terraform apply", "helm upgrade r c --set x=$A --set y=1 --set x=${B} -f v.yaml --values=w.yaml", "helm list", None]
    steps = spark.createDataFrame([("w", "j", 1, i, None, t, None, None, None, None) for i, t in enumerate(texts)], STEP)
    shown = steps.withColumn("text", F.regexp_replace("text", "export", "set"))
    found = workflows.terraform_steps(shown)
    assert plan(found).count("regexp_replace(") <= 13  # in the first filter, and once in each part of the row
    assert sorted((r["position"], r["outputs"], r["command"]) for r in found.collect()) == [(0, ["a"], "output"), (1, ["b"], "output"), (4, [], "apply")]
    helm = workflows.helm_steps(shown)
    assert plan(helm).count("regexp_extract_all(") <= 4  # each list once, not again for each of its items
    assert sorted((r["position"], [tuple(x) for x in r["set_values"]], r["files"]) for r in helm.collect()) == [(5, [("y", "1"), ("x", "${B}")], ["v.yaml", "w.yaml"]), (6, [], [])]
    used = workflows.uses_of_variables(helm)
    assert sorted((r["variable"], r["path"]) for r in used.collect()) == [("A", "x"), ("B", "x")]


def test_shell_lines_of_traced_variables(spark, tmp_path, monkeypatch):
    made = []
    monkeypatch.setattr(plans.pg, "workflow_steps", lambda *_: made.append(1) or spark.createDataFrame([("w", "j", 1, 1, "s1", "terraform output -raw a ${{ steps.s1.outputs.a }} ${{ needs.i.outputs.o }}", None, None, None, None)], STEP).withColumn("text", F.regexp_replace("text", "raw", "raw")))
    monkeypatch.setattr(plans.pg, "workflow_jobs", lambda *_: spark.createDataFrame([("w", "j", 1, ["i"], {"E0": "needs.i.outputs.o"}, None), ("w", "i", 2, None, None, {"o": "from terraform"})], "workflow string, job string, ordinal int, needs array<string>, env map<string,string>, outputs map<string,string>"))
    found = plans.traced_variables(spark, str(tmp_path))
    assert "regexp_replace(" not in plan(found)  # lines are kept, not made again for each scope
    assert sorted((r["scope"], r["name"], r["source"], r["confidence"]) for r in found.collect()) == [("env", "E0", "env.E0", 80.0), ("needs", "i.outputs.o", "i.outputs.o", 75.0), ("other", "tf_x", "tf_x", 45.0), ("other", "vpc_id", "vpc_id", 45.0), ("steps", "s1.outputs.a", "steps.s1.outputs.a", 90.0)]
