"""Fuzzy names and links of jobs against brute force over all pairs."""

import random

import pytest

from loomgraph.operators import flows, likeness, rollup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def percent(a, b):
    n = max(len(a), len(b))
    return int(100 * (n - distance(a, b)) / n + 0.5)


def variants(draw, n):
    words = ["".join(draw.choice("abc") for _ in range(draw.randint(1, 34))) for _ in range(n)]
    out = set(words)
    for w in words:
        for _ in range(6):
            x = list(w)
            for _ in range(draw.randint(1, 5)):
                i = draw.randint(0, len(x))
                x[i : i + draw.randint(0, 1)] = draw.choice(["", "a", "c"])
            out.add("".join(x))
    return sorted(out - {""})


@pytest.mark.parametrize("threshold", [90, 72, 35])
def test_a_key_is_shared_by_every_pair_that_is_alike(threshold):
    names = variants(random.Random(threshold), 12)
    longer, shorter = ({x: f(x, threshold) for x in names} for f in (likeness.longer_keys, likeness.shorter_keys))
    pairs = [(a, b) for a in names for b in names if a != b and len(a) >= len(b) and percent(a, b) >= threshold]
    assert pairs and not [p for p in pairs if not longer[p[0]] & shorter[p[1]]]


def test_fuzzy_names_of_all_beginnings_and_types(spark):
    names = [("xpayments-database", "t"), ("payments-database", "t"), ("Payments-Database", "k8s_pod"), ("qayments-databasf", "t"), ("other", "t")] + [(x, "t") for x in variants(random.Random(1), 6)]
    rows = [(repo, f"{repo}{i}", kind, name, None, "{}") for repo in "ab" for i, (name, kind) in enumerate(names)]
    df = spark.createDataFrame(rows, "repo_id string, id string, type string, name string, namespace string, metadata string")
    got = {(r["source"], r["target"]): r["confidence"] for r in rollup.matches(df, rollup.name_matcher(90, threshold=90)).collect()}
    want = {}
    for i, (x, s) in enumerate(names):
        for j, (y, t) in enumerate(names):
            score = (100 if s == t else 95) if x.lower() == y.lower() else percent(x.lower(), y.lower())
            if score >= 90:
                want[f"a{i}", f"b{j}"] = score
    assert got == want and got["a0", "b1"] == 94


def link_score(path, name, file_path, node_name):
    def normal(x):
        return x.replace("\\", "/").removeprefix("./").removesuffix("/").lower()

    a, b = normal(path), normal(file_path)
    one, two = ([x for x in p.split("/") if x] for p in (a, b))
    same = next((i for i, (x, y) in enumerate(zip(one, two, strict=False)) if x != y), min(len(one), len(two)))
    like = 100 if a == b else int(100 * same / max(len(one), len(two)) + 0.5)
    da, db = (p.rpartition("/")[0] for p in (a, b))
    under = lambda x, y: x.startswith(y + "/")
    if like >= 50:
        return like if like >= 80 else like * 0.9
    if under(a, b) or under(b, a) or da == db or under(da, db) or under(db, da):
        return 60
    x, y = ("".join(c for c in n.lower() if c not in "-_ ") for n in (name, node_name))
    return 0.7 * (100 if x == y else 80 if x in y or y in x else percent(x, y))


def test_job_links_are_the_best_of_all_nodes(spark):
    draw = random.Random(3)
    dirs = ["", "infra", "./Infra", "infra/x", "infra/x/y/z", ".github/workflows", "modules", "modules/net/deep", "/abs", "charts/a"]
    path = lambda file: "/".join(x for x in (draw.choice(dirs), draw.choice(["", "a", "b/c"]), file) if x)
    words = ["deploy", "deploy-app", "deploy_ap", "network", "netwrok-1", "payments", "xpayments", "db", "a"]
    jobs = [(f"j{i}", path("jobs.yml"), draw.choice(words)) for i in range(30)] + [("root", ".gitlab-ci.yml", "ci"), ("far", ".github/workflows/a.yml", "network")]
    nodes = [(f"n{i:03}", path(draw.choice(["main.tf", "jobs.yml"])), draw.choice(words)) for i in range(60)] + [("top", "main.tf", "zzz"), ("net", "modules/q/w/e.tf", "network")]
    got = {(r["job"], r["node"]): r["score"] for r in flows.job_links(spark.createDataFrame(jobs, "job string, path string, name string"), spark.createDataFrame(nodes, "id string, file_path string, name string")).collect()}
    want = {}
    for job, p, n in jobs:
        scored = sorted((-round(link_score(p, n, f, m), 4), i) for i, f, m in nodes)
        want |= {(job, i): -s for s, i in scored[:5] if -s >= 50}
    assert got == want
    assert any(s == 70 for s in want.values()) and any(s == 60 for s in want.values())
