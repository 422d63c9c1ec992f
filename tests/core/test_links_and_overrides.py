"""Links of Helm operations against trying all pairs; overriding values; diffs one behind the other."""

import random
import re

from loomgraph.operators import diff, flows

OP = "job string, position int, path string, name string, working_dir string, command string, namespace string"
NODE = "id string, file_path string, name string, release string, chart string, chart_path string, namespace string"


def bare(x):
    return re.sub(r"[-_\s]", "", (x or "").lower())


def likeness(a, b):
    """Levenshtein in percent of the longer name, or 100 and 80 for equal and held ones."""
    a, b = bare(a), bare(b)
    if a == b:
        return 100
    if a in b or b in a:
        return 80
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return round(100 * (max(len(a), len(b)) - row[-1]) / max(len(a), len(b)))


def shared(a, b):
    a, b = (x.strip("/").split("/") for x in (a, b))
    n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return round(100 * n / max(len(a), len(b)))


def test_helm_links_against_all_pairs(spark):
    draw = random.Random(5)
    dirs, names = ["ci/a/", "ci/b/x/", "charts/web/", "charts/db/"], ["web-app", "webapp", "db", "data-base", "cache", "cachet", "zzzzzz"]
    ops = [(f"j{i:02}", 0, draw.choice(dirs) + "p.yml", draw.choice(names), draw.choice([None, "charts/web", "charts/db", "a/b/c/d/e"]), f"helm {draw.choice(['upgrade', 'install'])} {draw.choice(['web', 'db-1', 'cache'])} {draw.choice(['./web', 'db', 'nginx'])}", draw.choice([None, "ns-1", "ns_2"])) for i in range(40)]
    nodes = [(f"n{i:02}", draw.choice(dirs) + "Chart.yaml", draw.choice(names), draw.choice([None, "WEB", "db1", "x"]), draw.choice([None, "web", "my-db-chart"]), draw.choice([None, "charts/web", "charts/db", "a/b/c/d/f"]), draw.choice([None, "ns1", "ns2"])) for i in range(40)]
    want = set()
    for job, at, path, name, wd, command, ns in ops:
        release, chart = command.split()[2], command.split()[3]
        scored = []
        for node, file, own, rel, ch, cp, nns in nodes:
            score = max([0, 95 * (rel is not None and bare(rel) == bare(release)), 85 * (ch is not None and (bare(ch) in bare(chart) or bare(chart) in bare(ch))), 75 * (ns is not None and nns is not None and bare(ns) == bare(nns))] + ([shared(wd, cp)] if wd and cp and shared(wd, cp) >= 80 else []))
            a, b = (x.rsplit("/", 1)[0] for x in (path, file))
            near = a == b or a.startswith(b + "/") or b.startswith(a + "/") or a.rsplit("/", 1)[0] == b.rsplit("/", 1)[0]
            if score < 50 and near:
                score = 55
            if score < 50 and likeness(name, own) >= 60:
                score = round(0.7 * likeness(name, own))
            if score >= 50:
                scored.append((-score, node))
        want |= {(job, node, -s) for s, node in sorted(scored)[:5]}
    got = {(r["job"], r["node"], r["score"]) for r in flows.helm_links(spark.createDataFrame(ops, OP), spark.createDataFrame(nodes, NODE)).collect()}
    assert got == want


def test_values_that_override(spark):
    base = spark.createDataFrame([("a", '{"x":{"y":1,"z":[1,2]},"id":1,"s":"t"}'), ("b", None)], "key string, metadata string")
    over = spark.createDataFrame([("a", "f1", '{"x":{"y":2,"z":[1,2],"n":{}},"id":2}'), ("a", "f2", '{"s":"t"}'), ("b", "f1", '{"p":1}'), ("c", "f1", None)], "key string, source string, metadata string")
    got = {(r["key"], r["source"], r["path"], r["base_value"], r["value"]) for r in diff.value_overrides(base, over).collect()}
    assert got == {("a", "f1", "x.y", "1", "2"), ("a", "f1", "x.n", None, "{}"), ("a", "f1", "id", "1", "2"), ("b", "f1", "p", None, "1")}


def test_appended_diffs_keep_both_ways(spark):
    one = spark.createDataFrame([("k", "t", "added")], "key string, type string, change string")
    two = one.selectExpr("key", "type", "'removed' change")
    assert [(r["at"], r["change"]) for r in diff.appended([one, two]).orderBy("at").collect()] == [(0, "added"), (1, "removed")]
