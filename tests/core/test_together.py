"""Flows of CI workflows are found within buckets by workflow: no pattern shuffles steps, names or files again."""

import pytest

from loomgraph.operators import likeness, workflows
from loomgraph.sources import tables

STEP = "workflow string, job string, ordinal int, position int, step string, text string, uses string, artifact string, path string, env map<string,string>"
JOB = "workflow string, job string, ordinal int, needs array<string>"


@pytest.fixture(scope="module")
def framed(spark):
    def steps(w):
        texts = ["terraform output -json > out1.json", "export V=$(terraform output x)", "helm upgrade r c --set a=$V --set b=$(terraform output x) -f values/out1.json -f terraform.yaml -f <(jq '{k: .x}' dir/out1.json)", "terraform output -json > b/my-values.json"]
        rows = [(w, f"j{i}", i, p, None, t, None, None, None, None) for i in range(3) for p, t in enumerate(texts)]
        return [*rows, (w, "j0", 0, 8, None, None, "actions/upload-artifact@v3", "tf-1", "out1.json", None), (w, "j1", 1, 8, None, None, "actions/download-artifact@v3", "TF-1", None, None), rows[0]]

    names = [f"w{i}" for i in range(20)]
    jobs = [(w, f"j{i}", i, [f"j{i - 1}"] if i else []) for w in names for i in range(3)]
    return workflows.frames(spark.createDataFrame([r for w in names for r in steps(w)], STEP), spark.createDataFrame(jobs, JOB))


def test_patterns_shuffle_nothing(spark, framed, monkeypatch):
    plans = []

    def seen(df, *rest, **more):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return tables.checkpointed(df, *rest)

    monkeypatch.setattr(workflows, "checkpointed", seen)
    steps, terraform, helm, depends = framed
    for found in (workflows.direct_flows(terraform, helm, depends), workflows.env_flows(terraform, helm, depends), workflows.file_flows(terraform, helm, depends)):
        assert found.count()
    assert len(plans) == 3 and not any("Exchange" in p or "Broadcast" in p for p in plans)


def test_steps_are_dealt_out_once_and_none_twice(spark, framed):
    steps, terraform, helm, _ = framed
    assert steps.count() == 20 * 14 and terraform.count() == 20 * 12 and helm.count() == 20 * 3
    setting = "spark.sql.requireAllClusterKeysForCoPartition"
    with tables.together(spark):
        assert "Exchange" not in terraform.join(helm, ["workflow", "job"])._jdf.queryExecution().executedPlan().toString()
    assert spark.conf.get(setting) == "true"


def test_files_of_few_and_of_many_are_the_same(spark, framed, monkeypatch):
    _, terraform, helm, depends = framed
    rows = lambda: sorted(map(tuple, workflows.file_flows(terraform, helm, depends).drop("order").collect()))
    few = rows()
    monkeypatch.setattr(likeness, "PAIRS_OF_A_NAME", 0)
    assert rows() == few and len(few) == 20 * 9
