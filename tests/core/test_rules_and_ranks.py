"""Conditions of rules, weighted ranks, filters of flows and kinds, on small literals."""

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import flows, scoring, search, stats, tables


def test_conditions_hold_only_for_values_of_their_kind(spark):
    rows = spark.createDataFrame([(1, "abc", 5.0, ("x",)), (2, None, None, (None,))], "id int, text string, n double, at struct<file:string>")
    cases = {
        ("text", "equals", "abc"): True, ("text", "equals", 5): False, ("n", "equals", 5): True, ("text", "contains", "bc"): True, ("n", "contains", "5"): False,
        ("text", "matches", "^a.c$"): True, ("text", "matches", "^b"): False, ("n", "gt", 4): True, ("n", "gt", 5): False, ("n", "gt", "4"): False, ("n", "lt", 6): True, ("n", "lt", True): False,
        ("at.file", "exists", None): True, ("at.line", "exists", None): False, ("text.file", "exists", None): False, ("text", "unlike", "abc"): False,
    }
    got = rows.orderBy("id").select(*[scoring.meets(rows, *case).alias(f"c{i}") for i, case in enumerate(cases)]).collect()
    assert list(got[0]) == list(cases.values())
    assert not any(got[1])  # nulls meet nothing


def test_rules_count_what_they_match(spark):
    rows = spark.createDataFrame([("e", "a", 90.0), ("e", "a", 10.0), ("e", "b", 90.0), ("f", "b", 1.0), (None, "a", 90.0)], "edge_id string, type string, confidence double")
    rules = [scoring.Rule("high", ("a",), 10, 1.5, (("confidence", "gt", 50),)), scoring.Rule("all", ("a", "b"), 2), scoring.Rule("none", (), 9)]
    got = {tuple(r) for r in scoring.rule_results(rows, rules).collect()}
    assert got == {("e", "high", 1, 15.0), ("e", "all", 3, 6.0), ("f", "all", 1, 2.0), (None, "high", 1, 15.0), (None, "all", 1, 2.0)}
    assert scoring.rule_results(rows.limit(0), rules).isEmpty()


def test_weighted_ranks_need_every_word_and_weigh_fields(spark):
    rows = spark.createDataFrame([("1", "red red", "red/x"), ("2", "blue", "red"), ("3", "red", None), ("4", None, None)], "id string, name string, file_path string")
    whole = lambda *weights: round(sum(w / (i + 1) ** 2 for i, w in enumerate(weights)) / search.RANK_SUM, 6)
    got = [tuple(r) for r in search.weighted_search(rows, "RED").collect()]
    assert got == [("1", whole(1, 1, 0.2)), ("3", whole(1)), ("2", whole(0.2))]
    both = search.weighted_search(rows, "red blue").collect()
    assert [r["id"] for r in both] == ["2"] and both[0]["rank"] == pytest.approx((whole(0.2) + whole(1)) / 2, abs=1e-6)
    assert search.weighted_search(rows, " - ").isEmpty() and search.weighted_search(rows, "red", limit=1).count() == 1


def test_flow_filters(spark):
    rows = spark.createDataFrame([("a", 90.0, None, ["terraform", "helm"]), ("b", 90.0, "p", ["terraform", "ci", "kubernetes"]), ("c", 20.0, "p", ["terraform", "helm"])], "flow_id string, confidence double, pipeline string, tools array<string>")
    ids = lambda **options: [r["flow_id"] for r in flows.filtered_flows(rows, **options).orderBy("flow_id").collect()]
    assert ids() == ["a", "b", "c"] and ids(least=50) == ["a", "b"] and ids(destination_tool="helm") == ["a", "c"] and ids(source_tool="helm") == []
    assert ids(orchestrated=True) == ["b", "c"] and ids(limit=1) == ["a"]
    assert {tuple(r) for r in flows.flow_levels(rows).collect()} == {("high", 2), ("uncertain", 1)}


def test_kinds_and_links(spark):
    rows = spark.createDataFrame([("x",), ("y",), ("z",)], "type string")
    kinds = lambda *lists: sorted(r["type"] for r in tables.of_kinds(rows, *lists).collect())
    assert kinds() == ["x", "y", "z"] and kinds(["x", "y"], ["y"]) == ["x"] and kinds([], ["z"]) == ["x", "y"]
    links = spark.createDataFrame([("j", "t", "apply", 90.0), ("j", "u", None, 40.0)], "source string, target string, operation_type string, confidence double")
    got = {r["operation"]: (r["edges"], r["jobs"], r["targets"], r["average"], r["high"], r["low"]) for r in stats.linking_stats(links).collect()}
    assert got == {"apply": (1, 1, 1, 90.0, 1, 0), "unknown": (1, 1, 1, 40.0, 0, 1), None: (2, 1, 2, 65.0, 1, 1)}


def test_unmatched_nodes_count_beside_merged_ones(spark):
    nodes = spark.createDataFrame([("r", "1", "a"), ("s", "1", "a"), ("s", "2", "b")], "repo_id string, id string, type string")
    grouped, merged = nodes.filter("id = '1'"), nodes.filter("repo_id = 'r'").select(F.col("type"))
    assert {tuple(r) for r in stats.rollup_type_counts(nodes, grouped, merged).collect()} == {("a", 1), ("b", 1)}
