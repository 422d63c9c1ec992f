"""Flows inside workflows: two workflows with the same names in their jobs, steps, outputs, variables, files and artifacts."""

import pytest

from loomgraph.operators import likeness, pipelines, workflows

STEP = "workflow string, job string, ordinal int, position int, step string, text string, uses string, artifact string, path string, env map<string,string>"
JOB = "workflow string, job string, ordinal int, needs array<string>, env map<string,string>, outputs map<string,string>"


def run(position, text, step=None, env=None):
    return position, step, text, None, None, None, env


def act(position, uses, artifact, path):
    return position, None, None, uses, artifact, path, None


def steps(spark, jobs):
    """Step rows of two workflows with the same jobs {name: steps}."""
    return spark.createDataFrame([(w, j, o, p, s, t, u, a, x, e) for w in ("w1", "w2") for o, (j, own) in enumerate(jobs.items()) for p, s, t, u, a, x, e in own], STEP)


def jobs(spark, needs, env=None, outputs=None):
    return spark.createDataFrame([(w, j, o, on, (env or {}).get(j), (outputs or {}).get(j)) for w in ("w1", "w2") for o, (j, on) in enumerate(needs.items())], JOB)


def found(df, *columns):
    """Rows of the first workflow; those of the second are the same."""
    rows = {w: sorted(tuple(r[c] for c in columns) for r in df.collect() if r["workflow"] == w) for w in ("w1", "w2")}
    assert rows["w1"] == rows["w2"]
    return rows["w1"]


SHOWN = ("pattern", "source_job", "source_position", "output", "target_job", "path", "confidence")


@pytest.mark.parametrize(
    ("own", "needs", "want"),
    [
        ({"deploy": [act(0, "hashicorp/setup-terraform@v2", None, None), run(1, "terraform init && terraform apply -auto-approve"), run(2, "helm upgrade --install myapp ./chart \\\n  --set cluster.endpoint=$(terraform output -raw cluster_endpoint) \\\n  --set vpc.id=$(terraform output -raw vpc_id)")]}, {"deploy": []},
         [("direct_output", "deploy", 2, "cluster_endpoint", "deploy", "cluster.endpoint", 100.0), ("direct_output", "deploy", 2, "vpc_id", "deploy", "vpc.id", 100.0)]),
        ({"terraform": [run(0, "terraform apply -auto-approve"), run(1, 'export VPC_ID=$(terraform output -raw vpc_id)\necho "VPC_ID=$VPC_ID" >> $GITHUB_ENV')], "helm": [run(0, "helm upgrade --install myapp ./chart --set vpc.id=${{ env.VPC_ID }}")]}, {"terraform": [], "helm": ["terraform"]},
         [("output_to_env", "terraform", 1, "vpc_id", "helm", "vpc.id", 100.0)]),
        ({"terraform": [run(0, "terraform apply"), run(1, "terraform output -json > tf-outputs.json")], "helm": [run(0, "helm upgrade --install myapp ./chart \\\n  -f <(jq '{cluster: {endpoint: .cluster_endpoint.value}}' tf-outputs.json)")]}, {"terraform": [], "helm": ["terraform"]},
         [("output_to_file", "terraform", 1, "json_outputs", "helm", "cluster", 100.0)]),
        ({"terraform": [run(0, "terraform apply"), run(1, "terraform output -json > tf-outputs.json"), act(2, "actions/upload-artifact@v3", "terraform-outputs", "tf-outputs.json")], "helm": [act(0, "actions/download-artifact@v3", "terraform-outputs", "."), run(1, "helm upgrade --install myapp ./chart -f tf-outputs.json")]}, {"terraform": [], "helm": ["terraform"]},
         [("artifact_transfer", "terraform", 0, "tf-outputs", "helm", ".", 97.0), ("output_to_file", "terraform", 1, "json_outputs", "helm", "tf-outputs.json", 95.0)]),
    ],
)
def test_patterns(spark, own, needs, want):
    assert found(workflows.detected(steps(spark, own), jobs(spark, needs)), *SHOWN) == want


def test_the_first_provider_of_the_own_job_then_of_needed_jobs_then_of_any(spark):
    own = {"a": [run(0, "terraform output x")], "b": [run(0, "terraform output x")], "c": [run(0, "helm upgrade r c --set k=$(terraform output y)"), run(1, "terraform plan # y")], "d": [run(0, "helm upgrade r c --set v=$VX --set w=$HOME")], "e": [run(0, "export VX=$(terraform output x)")]}
    needs = {"a": [], "b": [], "c": ["b"], "d": ["c"], "e": []}
    got = workflows.detected(steps(spark, own), jobs(spark, needs))
    assert found(got, *SHOWN[:6]) == [("direct_output", "c", 0, "y", "c", "k"), ("output_to_env", "e", 0, "x", "d", "v")]
    terraform, helm, depends = workflows.frames(steps(spark, own), jobs(spark, needs))[1:]
    assert not found(workflows.env_flows(terraform, helm, depends, reaching=True), "path")  # VX is set after its use
    only = steps(spark, own | {"c": [run(0, "helm upgrade r c --set k=${x}$(echo)", env={})]})
    uses = only.unionByName(steps(spark, {"z": [run(5, "helm upgrade r c --set k=$(terraform output x)")]}).filter("workflow = 'w1'"))
    first = {r["source_job"] for r in workflows.detected(uses, jobs(spark, {"z": ["c"], "c": ["b"]})).collect() if r["target_job"] == "z"}
    assert first == {"z"}  # a Helm step that asks for an output is a Terraform step as well


def test_providers_are_chosen_by_dependence(spark):
    own = {"a": [run(0, "terraform output x")], "b": [run(0, "terraform output x")], "h": [run(0, "helm install r c -f x.yaml")]}
    terraform, _, depends = workflows.frames(steps(spark, own), jobs(spark, {"a": [], "b": [], "m": ["b"], "h": ["m"]}))[1:]
    helm = workflows.helm_steps(steps(spark, {"h": [run(0, "helm install r c --set k=$(terraform output x)")]}))
    assert found(workflows.direct_flows(terraform, helm, depends), "source_job") == [("b",)]  # through one job between
    assert found(workflows.direct_flows(terraform, helm, depends.filter("false")), "source_job") == [("a",)]


def test_definitions_reach_the_uses_behind_them(spark):
    own = {"t": [run(0, "export V=$(terraform output one)"), run(1, "helm upgrade r c --set a=$V"), run(2, "V=$(terraform output two)"), run(3, "helm upgrade r c --set b=$V"), run(4, 'echo "V=got three" >> $GITHUB_ENV # terraform output three')]}
    terraform, helm, depends = workflows.frames(steps(spark, own), jobs(spark, {"t": []}))[1:]
    assert found(workflows.env_flows(terraform, helm, depends, reaching=True), "path", "output") == [("a", "one"), ("b", "two")]
    assert found(workflows.env_flows(terraform, helm, depends), "path", "output") == [("a", "three"), ("b", "three")]


def test_variables_and_chains(spark):
    own = {"a": [run(0, "terraform output x", "s1")], "b": [run(0, "terraform apply")], "c": [run(0, "helm upgrade r c --set v=${{ needs.a.outputs.x }}")]}
    needs = jobs(spark, {"a": [], "b": ["a"], "c": ["a", "b"]}, env={"c": {"E": "from needs.a.outputs.x", "P": "p"}}, outputs={"b": {"y": "a terraform value"}})
    asked = spark.createDataFrame([(w, j, s, n) for w in ("w1", "w2") for j, s, n in (("c", "needs", "a.outputs.x"), ("c", "needs", "b.outputs.y"), ("c", "needs", "q"), ("c", "env", "E"), ("c", "env", "P"), ("a", "steps", "s1.outputs.x"), ("c", "else", "my_arn"), ("c", "else", "other"))], "workflow string, job string, scope string, name string")
    got = found(workflows.traced(asked, steps(spark, own), needs), "scope", "name", "type", "source", "confidence")
    assert got == sorted([("needs", "a.outputs.x", "terraform_output", "a.outputs.x", 85.0), ("needs", "b.outputs.y", "job_output", "b.outputs.y", 60.0), ("needs", "b.outputs.y", "terraform_output", "b.outputs.y", 75.0), ("needs", "q", "terraform_output", "a.outputs.q", 85.0), ("needs", "q", "job_output", "b.outputs.q", 60.0), ("env", "E", "terraform_output", "env.E", 80.0), ("env", "P", "env_variable", "env.P", 40.0), ("steps", "s1.outputs.x", "terraform_output", "steps.s1.outputs.x", 90.0), ("else", "my_arn", "terraform_output", "my_arn", 45.0)])
    flows = workflows.output_flows(steps(spark, own), needs)
    assert found(flows, "source_job", "output", "target_job", "target_step", "flow_type", "confidence") == [("a", "x", "c", "step-0", "job_output", 95.0), ("a", "x", "c", "step-0", "terraform_to_helm", 85.0)]
    ends = spark.createDataFrame([(w, s, t) for w in ("w1", "w2") for s, t in (("a", "c"), ("b", "c"), ("c", "a"), ("a", "a"))], "workflow string, source_job string, target_job string")
    assert found(workflows.job_chains(ends, needs), "source", "target", "chain") == [("a", "a", ["a"]), ("a", "c", ["a", "c"]), ("b", "c", ["b", "c"]), ("c", "a", ["c", "a"])]


def test_empty_and_null_rows_give_nothing(spark):
    none = steps(spark, {"a": [run(0, None), run(1, "")]})
    assert workflows.detected(none, jobs(spark, {"a": None})).count() == 0 and workflows.detected(none.filter("false"), jobs(spark, {}).filter("false")).count() == 0


def test_pipelines_with_jobs_of_one_name(spark):
    rows = spark.createDataFrame([("p", "build", []), ("p", "test", ["build"]), ("q", "build", ["test"])], "pipeline string, job string, needs array<string>")
    nodes, edges = pipelines.pipeline_graph(rows)
    assert {r["id"] for r in nodes.collect()} == {"p", "q", "p/build", "p/test", "q/build"}
    assert {(r["source"], r["target"]) for r in edges.filter("type = 'JOB_DEPENDS_ON'").collect()} == {("p/build", "p/test")}


def test_holding_with_and_without_groups(spark):
    names = ["", "a", "ab", "b", "cab", "abcab", "x" * 40, "y" + "x" * 60]
    frame = spark.createDataFrame([(g, n) for g in ("1", "2") for n in names if g == "1" or len(n) < 3], "g string, name string")
    got = {(r["g"], r["left"], r["right"]) for r in likeness.holding(frame, frame, ["g"]).collect()}
    assert got == {(g, a, b) for g in ("1", "2") for a in names for b in names if (a in b or b in a) and (g == "1" or max(len(a), len(b)) < 3)}
