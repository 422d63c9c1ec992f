"""Flows behind destinations, conflicting metadata, ignored attributes, shares of tags: expectations worked out by hand."""

import json

import pytest

from loomgraph.operators import diff, flows, rollup

EDGE = "id string, source string, target string, type string, confidence double"


def test_flows_go_on_behind_a_destination(spark):
    nodes = spark.createDataFrame([("o", "terraform_output"), ("r", "helm_release"), ("d", "k8s_deployment"), ("j", "ci_job"), ("k", "ci_job"), ("x", "k8s_secret")], "id string, type string")
    pairs = [("o", "r", 90.0), ("r", "d", 70.0), ("o", "j", 60.0), ("j", "k", 60.0), ("k", "x", 90.0), ("d", "o", 50.0)]
    edges = spark.createDataFrame([(f"{a}{b}", a, b, "FEEDS_INTO", c) for a, b, c in pairs], EDGE)
    got = {(r["source"], r["target"]): (r["path"], r["confidence"], r["pipeline"], r["tools"]) for r in flows.end_to_end_flows(nodes, edges).collect()}
    assert got == {("o", "r"): (["o", "r"], 90.0, None, ["terraform", "helm"]), ("o", "d"): (["o", "r", "d"], 80.0, None, ["terraform", "helm", "kubernetes"]), ("o", "x"): (["o", "j", "k", "x"], 70.0, "k", ["terraform", "ci", "kubernetes"])}
    assert [r["target"] for r in flows.filtered_flows(flows.end_to_end_flows(nodes, edges), destination_tool="helm").collect()] == ["r"]


def test_a_path_of_ten_nodes_is_grown_by_one(spark):
    ids = [f"n{i:02}" for i in range(13)]
    nodes = spark.createDataFrame([(i, "terraform_output" if i == "n00" else "k8s_pod") for i in ids], "id string, type string")
    edges = spark.createDataFrame([(a, a, b, "references", 50.0) for a, b in zip(ids, ids[1:])], EDGE)
    assert sorted(r["target"] for r in flows.end_to_end_flows(nodes, edges).collect()) == ids[1:11]


def merged(spark, resolution, *texts):
    nodes = spark.createDataFrame([(f"r{i}", "n", t) for i, t in enumerate(texts)], "repo_id string, id string, metadata string")
    grouped = nodes.selectExpr("repo_id", "id", "'g' as `group`", "100.0 confidence", "'arn' strategy")
    return {r["key"]: r["value"] for r in rollup.merged_metadata(nodes, grouped, resolution).collect()}


def test_conflicts_of_metadata(spark):
    a, b, c = '{"x":[1,2],"o":{"p":1,"q":{"z":1}},"n":1,"s":"[t","same":{"b":1,"a":[2]},"only":"v"}', '{"x":[2,3,{"k":1}],"o":{"q":2,"r\\"":"t"},"n":2,"s":"u","same":{"a":[2],"b":1}}', '{"x":"no list","o":[1],"n":3,"same":{"b":1,"a":[2]}}'
    got = merged(spark, "merge", a, b, c)
    assert json.loads(got["x"]) == [1, 2, 3, {"k": 1}] and json.loads(got["o"]) == {"p": 1, "q": 2, 'r"': "t"}
    assert (got["n"], got["s"], got["only"], json.loads(got["same"])) == ("1", "[t", "v", {"a": [2], "b": 1})
    assert merged(spark, "merge", '{"x":1}', '{"x":[1]}') == {"x": "1"} and merged(spark, "merge", '{"x":[]}', '{"x":1}') == {"x": "[]"}
    assert merged(spark, "first", a, b)["n"] == "1" and merged(spark, "last", a, b)["n"] == "2" and merged(spark, "merge", None, "{}") == {}
    with pytest.raises(Exception, match="conflict in x"):
        merged(spark, "error", '{"x":1}', '{"x":2}')


def test_ignored_attributes_by_mode(spark):
    schema = "id string, type string, name string, namespace string, file_path string, metadata string"
    before = '{"status":{"ready":1},"resourceVersion":"1","metadata":{"generation":1,"labels":1},"updatedAt":1,"location":{"lineStart":1,"file":"a"}}'
    after = '{"status":{"ready":2},"resourceVersion":"2","metadata":{"generation":2,"labels":1},"updatedAt":2,"location":{"lineStart":2,"file":"a"}}'
    side = lambda m: spark.createDataFrame([("1", "t", "n", None, "p", m)], schema)
    found = lambda ignore: diff.node_diff(side(before), side(after), ignore=ignore).collect()[0]["changes"]["modified"]
    assert found("nodes") == ["updatedAt"] and found("records") == ["metadata.generation", "resourceVersion", "status.ready"]


def resource(repo, node, kind, **tags):
    return repo, node, "terraform_resource", json.dumps({"resourceType": kind, "tags": tags})


def test_shares_of_tags(spark):
    rows = [resource("a", "1", "s3", E="p", P="x"), resource("b", "2", "s3", E="p", P="y"), resource("b", "3", "ec2", E="p", P="y"), resource("c", "4", "s3", E="p", P="x"), resource("c", "5", "s3", E="p"), ("c", "6", "k8s_pod", '{"tags":{"E":"p","P":"x"}}')]
    nodes = spark.createDataFrame(rows, "repo_id string, id string, type string, metadata string")
    got = lambda *args: {(r["source"], r["target"]): r["confidence"] for r in rollup.tag_matches(nodes, *args).collect()}
    assert got(["E", "P"]) == {("1", "4"): 100.0}
    assert got(["E", "P"], 50) == {("1", "2"): 55.0, ("1", "3"): 50.0, ("1", "4"): 100.0, ("2", "4"): 55.0, ("3", "4"): 50.0}
    assert got(["E", "P"], 55) == {("1", "2"): 55.0, ("1", "4"): 100.0, ("2", "4"): 55.0}
    assert got(["E", "P"], 50, "any") == got(["E", "P"], 50) | {("1", "5"): 55.0, ("2", "5"): 55.0, ("3", "5"): 50.0}
    assert got([rollup.Tag("P", "y"), rollup.Tag("E", pattern="^q")], 0, "any") == {} and got([rollup.Tag("P", pattern="[xy]")], 100) == {("1", "4"): 100.0}
    assert rollup.tag_matches(nodes.filter("false"), ["E"]).count() == 0
