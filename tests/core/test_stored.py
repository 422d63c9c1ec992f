"""Stored indexes and tables: what they answer, what they read, and that replays change nothing."""

import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import configs, external, search, stats, textindex, timeseries
from loomgraph.sources import tables
from loomgraph.streaming import upkeep

WORDS = ["red", "fox", "network", "Net", "été", "x1", "main", "vpc"]


def nodes(spark):
    draw = random.Random(2)
    rows = [(f"n{i}", " ".join(draw.choice(WORDS) for _ in range(draw.randint(0, 6))), draw.choice([None, "", "infra/main.tf", "net/vpc-main.tf"])) for i in range(200)]
    return spark.createDataFrame([*rows, ("none", None, None), (None, "red", "fox")], "id string, name string, file_path string").repartition(3)


@pytest.mark.parametrize("query", ["red netw", "vpc", "zzz", ""])
def test_searches_from_the_index_are_those_from_the_rows(spark, query):
    rows = nodes(spark).filter("id is not null")
    index = textindex.TextIndex.build(nodes(spark), {"name": "A", "file_path": "C"}, 8)
    plain = search.fuzzy_search(rows, query, 20, 0.2)
    assert [tuple(r) for r in index.alike(spark, query, 20, 0.2).collect()] == [(r["id"], r["similarity"]) for r in plain.collect()]
    words = search.weighted_search(rows, query, limit=300)
    assert [tuple(r) for r in index.weighted(spark, query, 300).collect()] == [(r["id"], r["rank"]) for r in words.collect()]
    joined = rows.withColumn("both", F.concat_ws(" ", "name", "file_path"))
    assert {r["id"]: r["score"] for r in index.bm25(spark, query).collect()} == pytest.approx({r["id"]: r["score"] for r in search.bm25(joined, query, "id", "both").collect()})


def test_a_search_opens_the_folders_of_its_terms(spark):
    index = textindex.TextIndex.build(nodes(spark), {"name": "A"}, 16)
    found = index.postings(spark, "words", ["red"])
    assert found.select("term").distinct().collect() == [("red",)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "part" in plan.split("PartitionFilters:")[1].split("]")[0] and ("EqualTo(term,red)" in plan or "In(term" in plan)
    empty = textindex.TextIndex.build(nodes(spark).filter("false"), {"name": "A"}, 4)
    assert empty.alike(spark, "red").count() == 0 and empty.bm25(spark, "red").count() == 0


SCAN = "id long, status string, started_at timestamp, completed_at timestamp, node_count int, edge_count int"


def test_only_the_days_between_are_made_anew(spark, tmp_path):
    scans = spark.createDataFrame([(i, "completed", f"2024-01-{d:02} 10:00:00", f"2024-01-{d:02} 11:00:00", i, i) for i, d in enumerate([1, 1, 2, 3, 3, 5])], SCAN.replace("timestamp", "string")).withColumns({c: F.col(c).cast("timestamp") for c in ("started_at", "completed_at")})
    path = f"{tmp_path}/days"
    timeseries.refresh(path, scans, "2024-01-01", "2024-02-01")
    days = lambda: {(str(r["bucket"])[:10], r["scans"]) for r in timeseries.stored(spark, path).collect()}
    assert days() == {("2024-01-01", 2), ("2024-01-02", 1), ("2024-01-03", 2), ("2024-01-05", 1)}
    files = lambda: {p.name for p in (tmp_path / "days" / "day=2024-01-01").iterdir() if p.suffix == ".parquet"}
    before = files()
    for _ in range(2):
        timeseries.refresh(path, scans.filter("id not in (0, 2, 3)"), "2024-01-02", "2024-01-04")  # the first is outside
        assert days() == {("2024-01-01", 2), ("2024-01-03", 1), ("2024-01-05", 1)} and files() == before


def test_the_index_follows_the_last_event_whatever_the_order(spark, tmp_path):
    arn = '{"a":"arn:aws:s3:::bucket-%s"}'
    graph = spark.createDataFrame([("s1", "t", "r", "n1", arn % 1), ("s1", "t", "r", "n2", arn % 2), ("s2", "t", "r", "n3", arn % 3), ("s3", "t", "r", "n4", "{}")], "scan_id string, tenant_id string, repo_id string, id string, metadata string")
    of = lambda scans: graph.join(scans, "scan_id", "left_semi")
    rows = [("e1", "s1", "completed", "2024-01-01"), ("e2", "s2", "completed", "2024-01-01"), ("e3", "s2", "deleted", "2024-01-02"), ("e4", "s3", "completed", "2024-01-01")]
    frame = lambda x: spark.createDataFrame(x, "event_id string, scan_id string, kind string, at string").withColumn("at", F.col("at").cast("timestamp"))
    for n, order in enumerate([list(p) for p in permutations(range(3))][:4]):
        path = f"{tmp_path}/i{n}"
        for batch, i in enumerate(order):
            upkeep.apply(path, frame([rows[i], rows[3]]), batch, of)
            upkeep.apply(path, frame([rows[i], rows[3]]), batch, of)  # comes again
        assert {r["node_id"] for r in upkeep.index_of(spark, path).collect()} == {"n1", "n2"}


def test_a_stream_of_events_keeps_the_index(spark, tmp_path):
    graph = spark.createDataFrame([("s1", "t", "r", "n1", '{"a":"arn:aws:s3:::b1"}'), ("s2", "t", "r", "n2", '{"a":"arn:aws:s3:::b2"}')], "scan_id string, tenant_id string, repo_id string, id string, metadata string")
    schema = "event_id string, scan_id string, kind string, at timestamp"
    put = lambda name, rows: spark.createDataFrame(rows, schema.replace("timestamp", "string")).withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
    put("a", [("e1", "s1", "completed", "2024-01-01"), ("e2", "s2", "completed", "2024-01-01"), ("e1", "s1", "completed", "2024-01-01")])
    for _ in range(2):
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        upkeep.keep_up(f"{tmp_path}/index", stream, lambda scans: graph.join(scans, "scan_id", "left_semi"), f"{tmp_path}/state").awaitTermination()
        if _ == 0:
            assert {r["node_id"] for r in upkeep.index_of(spark, f"{tmp_path}/index").collect()} == {"n1", "n2"}
            put("b", [("e3", "s1", "deleted", "2024-01-02")])
    assert {r["node_id"] for r in upkeep.index_of(spark, f"{tmp_path}/index").collect()} == {"n2"}


def test_configurations_merge_oldest_first(spark):
    files = spark.createDataFrame([("app", ["env", "root"]), ("env", ["root", "lost"]), ("root", []), ("loop", ["pool"]), ("pool", ["loop"]), ("self", ["self"]), ("bare", None)], "path string, includes array<string>")
    rows = [("root", 0, "inputs", "a", "1"), ("root", 1, "inputs", "b", "1"), ("env", 0, "inputs", "a", "2"), ("env", 1, "inputs", "a", "3"), ("app", 0, "inputs", "c", "4"), ("app", 1, "locals", "a", "5"), ("root", 2, "remote_state", None, "first"), ("root", 3, "remote_state", None, "second"), ("env", 2, "terraform", None, "t"), ("pool", 0, "inputs", "x", "p"), ("loop", 0, "inputs", "x", "l"), ("app", 2, "inputs", None, "no")]
    got = {(r["path"], r["kind"], r["key"]): (r["value"], r["origin"]) for r in configs.merged(files, spark.createDataFrame(rows, "path string, position int, kind string, key string, value string")).collect()}
    assert {k[1:]: v for k, v in got.items() if k[0] == "app"} == {("inputs", "a"): ("3", "env"), ("inputs", "b"): ("1", "root"), ("inputs", "c"): ("4", "app"), ("locals", "a"): ("5", "app"), ("remote_state", None): ("first", "root"), ("terraform", None): ("t", "env")}
    assert got["loop", "inputs", "x"] == ("l", "loop") and got["pool", "inputs", "x"] == ("p", "pool") and not [k for k in got if k[0] in ("self", "bare")]
    order = configs.ancestors(files).filter("path = 'app'").orderBy("place").collect()
    assert [r["ancestor"] for r in order] == ["root", "lost", "env"]
    needs = spark.createDataFrame([("root", 0, "vpc"), ("app", 0, "db"), ("app", 1, "dns")], "path string, position int, dependency string")
    assert [tuple(r) for r in configs.collected(files, needs).filter("path = 'app'").orderBy("n").collect()] == [("app", "vpc", "root", 0), ("app", "db", "app", 1), ("app", "dns", "app", 2)]


def test_patterns_of_arns(spark):
    import re

    draw = random.Random(3)
    piece = lambda: draw.choice(["", "a", "ab", "b-1", "x/y", "a:b"])
    arns = {f"arn:{draw.choice(['aws', 'aws-cn'])}:{draw.choice(['s3', 'sqs'])}:{draw.choice(['', 'eu'])}:{draw.choice(['', '12'])}:{piece()}{piece()}{piece()}" for _ in range(300)} | {"no arn", "arn:aws:s3"}
    pattern = lambda: f"arn:{draw.choice(['aws', '*', 'a*'])}:{draw.choice(['s3', '*', 's*'])}:{draw.choice(['', '*', 'eu'])}:{draw.choice(['', '*', '12'])}:{draw.choice(['', '*'])}{piece()}{draw.choice(['', '*'])}{piece()}{draw.choice(['', '*'])}"
    patterns = {pattern() for _ in range(300)} | {"arn:*", "x"}
    got = {(r["pattern"], r["arn"]) for r in external.wildcard_matches(spark.createDataFrame([(p,) for p in patterns] + [(None,)], "pattern string"), spark.createDataFrame([(a,) for a in arns] + [(None,)], "arn string")).collect()}
    assert got == {(p, a) for p in patterns for a in arns if p.count(":") >= 5 and a.count(":") >= 5 and re.fullmatch(re.escape(p).replace(r"\*", ".*"), a)}


def test_percentiles_of_groups(spark):
    draw = random.Random(4)
    rows = [(draw.choice(["a", "b", None]), draw.choice([None, draw.randint(0, 50)])) for _ in range(400)] + [("c", 7)]
    got = {r["g"]: r for r in stats.percentiles_by(spark.createDataFrame(rows, "g string, x int"), "x", ["g"]).collect()}
    for g in ("a", "b", None, "c"):
        own = sorted(x for k, x in rows if k == g and x is not None)
        assert [got[g][f"p{p}"] for p in (50, 75, 90, 95, 99)] == [own[-(-p * len(own) // 100) - 1] for p in (50, 75, 90, 95, 99)] and (got[g]["least"], got[g]["most"]) == (own[0], own[-1])
    assert stats.percentiles(spark.createDataFrame([], "x int"), "x").first()["p99"] == 0


def test_folders_of_an_absent_path(spark, tmp_path):
    assert tables.folders(spark, f"{tmp_path}/none") == []
