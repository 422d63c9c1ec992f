"""Writing in chunks: sizes, failures of single chunks, stray files."""

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import workflows
from loomgraph.sources import chunks


def test_chunks_fail_by_themselves(spark, tmp_path):
    rows = spark.range(0, 2500, 1, 2).withColumn("name", F.when(F.col("id") != 700, F.concat(F.lit("n"), F.col("id").cast("string"))))
    path = chunks.write_chunks(rows, f"{tmp_path}/c", 500, ["name"])
    states = chunks.chunk_status(spark, path).orderBy("partition", "chunk").collect()
    assert [(r["partition"], r["chunk"], r["rows"], r["error"]) for r in states] == [(0, 0, 500, None), (0, 1, 500, "null in name"), (0, 2, 250, None), (1, 0, 500, None), (1, 1, 500, None), (1, 2, 250, None)]
    read = chunks.read_chunks(spark, path, "id long, name string")
    assert sorted(r["id"] for r in read.select("id").collect()) == [*range(500), *range(1000, 2500)]
    spark.range(3).selectExpr("id", "'stray' name").write.mode("append").parquet(path)  # of an attempt that was not committed
    assert chunks.read_chunks(spark, path, "id long, name string").count() == 2000
    chunks.write_chunks(rows.filter("id = 700"), path)
    assert chunks.read_chunks(spark, path, "id long, name string").filter("name is null").count() == 1


def test_no_rows(spark):
    path = chunks.write_chunks(spark.range(0))
    assert chunks.chunk_status(spark, path).count() == 0


@pytest.mark.parametrize(
    ("text", "uses", "want"),
    [
        ("cd x && Terraform  PLAN\nhelm upgrade a b", None, ("terraform", "plan", [])),
        ("terraform output -raw vpc\necho 'id=1' >> $GITHUB_OUTPUT", None, ("terraform", "output", ["vpc", "id"])),
        (None, "hashicorp/setup-terraform@v2", ("terraform", "unknown", [])),
        ("helmfile sync", None, ("helm", "sync", [])),
        ("kubectl apply -f x", None, ("kubectl", "apply", [])),
        ("run kaniko here", None, ("docker", "build", [])),
        ("docker-compose up", None, ("docker", "up", [])),
        ("make all", "own/action@v1", ("script", "own/action@v1", [])),
        ("make", None, ("script", "script", [])),
        (" \n", "own/action@v1", None),
        (None, None, None),
    ],
)
def test_operations_of_steps(spark, text, uses, want):
    row = spark.createDataFrame([("w", "j", 0, text, uses)], "workflow string, job string, position int, text string, uses string")
    got = workflows.operations(row).collect()
    assert [(r["type"], r["command"], r["outputs"]) for r in got] == ([want] if want else [])
