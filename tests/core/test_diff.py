from loomgraph.operators import diff

SCHEMA = "id string, type string, name string, namespace string, file_path string, metadata string"


def changes(spark, *pairs):
    side = lambda i: spark.createDataFrame([(str(n), "t", f"n{n:02}", None, "p", pair[i]) for n, pair in enumerate(pairs)], SCHEMA)
    found = diff.node_diff(side(0), side(1)).orderBy("key").collect()
    return [(r["change"], *map(list, r["changes"])) for r in found]


def test_changes_at_any_depth_of_any_metadata(spark):
    same = ("unchanged", [], [], [])
    assert changes(
        spark,
        ('{"image":"{{ .Values.image }}","tag":"1"}', '{"image":"{{ .Values.image }}","tag":"2"}'),
        ('{"x":"{a,b}"}', '{"x":"{a,c}"}'),
        (None, '{"a":1}'),
        ('{"a":1}', None),
        (None, None),
        ('{"a":{"b":{"c":{"d":{"e":1,"f":2}}}}}', '{"a":{"b":{"c":{"d":{"e":1,"g":2}}}}}'),
        ('{"a":{"b":{"c":{"x":1,"y":[{"p":1,"q":2}]}}}}', '{"a":{"b":{"c":{"y":[{"q":2,"p":1.0}],"x":1}}}}'),
        ('{"a":1}', '{"a":"1"}'),
        ('{"a":{"id":1},"id":1}', '{"a":{"id":2},"id":2}'),
        ("no json", "none"),
    ) == [
        ("modified", [], [], ["tag"]),
        ("modified", [], [], ["x"]),
        ("modified", ["a"], [], []),
        ("modified", [], ["a"], []),
        same,
        ("modified", ["a.b.c.d.g"], ["a.b.c.d.f"], []),
        same,
        ("modified", [], [], ["a"]),
        ("modified", [], [], ["a.id"]),
        ("modified", [], [], [""]),
    ]
