"""Equi-joins whose keys have to keep pairs few on larger tables."""

import itertools
import re

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import components, external, references


def test_short_literal_before_a_star_does_not_meet_every_arn(spark, monkeypatch):
    n = 300
    patterns = spark.range(1000, 1000 + n).select(F.explode(F.array(F.format_string("arn:aws:s3:::b*et-%d", "id"), F.format_string("arn:aws:s3:::bucket-*%d*", "id"), F.format_string("arn:aws:s3:::*t-%d*", "id"))).alias("pattern"))
    arns = spark.range(1000, 1000 + n).select(F.format_string("arn:aws:s3:::bucket-%d", "id").alias("arn"))
    assert external.wildcard_matches(patterns, arns).count() == 3 * n
    monkeypatch.setattr(external, "arn_regex", lambda pattern: F.lit(".*"))  # all pairs that meet
    assert external.wildcard_matches(patterns, arns).count() < 10 * n


@pytest.mark.parametrize("resource", ["a*b", "*", "ab*", "*ba", "a*ab*a", "*ab*", "aab", "a*", "a*a", "**"])
def test_overlapping_literals(spark, resource):
    texts = ["".join(t) for k in (1, 2, 3, 4) for t in itertools.product("ab", repeat=k)]
    arns = spark.createDataFrame([(f"arn:aws:s3:::{t}",) for t in texts], "arn string")
    got = {r["arn"] for r in external.wildcard_matches(spark.createDataFrame([(f"arn:aws:s3:::{resource}",)], "pattern string"), arns).collect()}
    assert got == {f"arn:aws:s3:::{t}" for t in texts if re.fullmatch(resource.replace("*", ".*"), t)}


def test_common_beginning_of_expressions_does_not_meet_every_description(spark, monkeypatch):
    n = 300
    rows = spark.range(n)
    edges = rows.select(F.format_string("e%d", "id").alias("id"), F.format_string("s%d", "id").alias("source"), F.lit("t").alias("target"), F.format_string("customer:%04d", "id").alias("expression"))
    evidence = rows.select(F.format_string("v%d", "id").alias("id"), F.lit(None).cast("string").alias("edge_id"), F.lit("x").alias("source"), F.lit("y").alias("target"), F.format_string("calls customer:%04d here", "id").alias("description"))
    found = references.evidence_of_edges(edges, evidence).collect()
    assert sorted((r["edge"], r["evidence"]) for r in found) == sorted((f"e{i}", f"v{i}") for i in range(n))
    monkeypatch.setattr(F, "contains", lambda a, b: F.lit(True))  # all pairs that meet
    assert references.evidence_of_edges(edges, evidence).count() < 10 * n


def test_acyclic_beginnings_are_dropped_before_levels_are_counted(spark, monkeypatch):
    counted = []
    peeled = components.peeled
    monkeypatch.setattr(components, "peeled", lambda moves: counted.append(moves.count()) or peeled(moves))
    many = [(f"a{i}", "b") for i in range(100)] + [("b", "c"), ("x", "y"), ("y", "x"), ("y", "z")]
    found = components.trimmed(spark.createDataFrame(many, "source string, target string"))
    assert sorted(map(tuple, found.collect())) == [("x", "y"), ("y", "x")] and max(counted, default=0) < 10
    assert components.trimmed(spark.createDataFrame([("a", "b"), ("b", "c")], "source string, target string")).count() == 0
