"""Names whose letters are like no name's of the other side get no keys, and no pair is lost by that."""

import random

import pytest

from loomgraph.operators import likeness


def names_of(spark, names):
    return spark.createDataFrame([(n,) for n in names], "name string")


def near(a, b, threshold):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    longest = max(len(a), len(b))
    return a != b and int(100 * (longest - row[-1]) / longest + 0.5) >= threshold


@pytest.fixture(scope="module")
def sides():
    rng = random.Random(5)
    word = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    jobs = [f"job{rng.randrange(10 ** rng.randrange(1, 9))}" for _ in range(30)] + ["réseau", "reseau", "JOB12", "job12 "]
    other = [f"supplier#{i:09d}" for i in range(20)] + [word(rng.randrange(3, 9), "jobse12") for _ in range(30)] + ["resau", "job12", "ob1"]
    return sorted(set(jobs)), sorted(set(other))


@pytest.mark.parametrize("most", [2000, 25, 15, 0])  # single letters, groups, digits and letters, no profiles
def test_pairs_are_those_of_all_names(spark, sides, monkeypatch, most):
    monkeypatch.setattr(likeness, "MOST_PROFILES", most)
    a, b = sides
    left, right = names_of(spark, a), names_of(spark, b)
    got = {(r["left"], r["right"]) for r in likeness.holding(left, right).collect()}
    assert got == {(x, y) for x in a for y in b if x in y or y in x} and got
    got = {(r["left"], r["right"]) for r in likeness.alike(left, right, 60).collect()}
    assert got == {(x, y) for x in a for y in b if near(x, y, 60)} and got


def test_names_of_other_letters_get_no_keys(spark, monkeypatch):
    kept, keys = likeness._keyed, []

    def keyed(names, *rest):
        keys.append(kept(names, *rest).count())
        return kept(names, *rest)

    monkeypatch.setattr(likeness, "_keyed", keyed)
    jobs, charts = names_of(spark, [f"job{i}" for i in range(200)]), names_of(spark, [f"supplier#{i:09d}" for i in range(50)])
    assert likeness.holding(jobs, charts).count() == 0 and likeness.alike(jobs, charts, 60).count() == 0
    assert keys == [0] * 8


def test_names_of_one_repository_are_no_pairs(spark):
    rows = [(f"job-{i}", f"repo-{i % 2}") for i in range(100000, 100060)] + [("job-100000", "repo-1"), ("job-100002", "repo-2"), (None, "repo-0")]
    names = spark.createDataFrame(rows, "name string, repo_id string")
    got = {(r["left"], r["right"]) for r in likeness.alike(names, names, 90, rising="repo_id").collect()}
    assert got == {(a, b) for a, r in rows for b, s in rows if a and b and r < s and near(a, b, 90)} and got
