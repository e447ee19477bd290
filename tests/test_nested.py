import json

from pyspark.sql import functions as F

from chainloom.operators import nested
from chainloom.plans import reports

SCHEMA = "report_id long, body string, loaded_at timestamp, files string"


def items(spark, *bodies):
    rows = [(i, b if b is None or isinstance(b, str) else json.dumps(b), None, "x") for i, b in enumerate(bodies)]
    return sorted(tuple(r) for r in reports.items(spark.createDataFrame(rows, SCHEMA)).collect())


def test_shapes(spark):
    chain = {"path": ["a", None, {"variable": "b"}, {"variable": ""}, 7]}
    listed = {"files": [{"file": "F", "tp_matched": [{"chain": chain, "tp": {"id": 5}}], "fp_chains": {"path": "one", "fp_pattern": {"reason": "r"}}}]}
    named = {"files": {"G.java": {"unclassified_chains": [{"chain": {"path": None}}, {"path": ["z"]}], "fp_chains": None}}}
    assert items(spark, listed, named) == [
        (0, "F", "fp_chains", 0, "fp_reason", 0, "r"), (0, "F", "fp_chains", 0, "path", 0, "one"),
        (0, "F", "tp_matched", 0, "path", 0, "a"), (0, "F", "tp_matched", 0, "path", 2, "b"), (0, "F", "tp_matched", 0, "path", 4, "7"), (0, "F", "tp_matched", 0, "tp_id", 0, "5"),
        (1, "G.java", "unclassified_chains", 1, "path", 0, "z"),
    ]


def test_encodings_and_unreadable(spark):
    body = {"files": [{"file": "F", "tp_matched": [{"path": ["a"]}]}]}
    text = json.dumps(body)
    got = items(spark, "\ufeff" + text, json.dumps(text), json.dumps(json.dumps(text)), None, "", "{broken", "[1]")
    assert [r[0] for r in got] == [0, 1, 2]


def test_repeated_and_empty(spark):
    row = (1, json.dumps({"files": {"F": {"tp_matched": [{"path": ["a"]}]}}}), None, "x")
    assert reports.items(spark.createDataFrame([row, row], SCHEMA)).count() == 1
    assert reports.items(spark.createDataFrame([], SCHEMA)).count() == 0
    nodes = reports.path_nodes(spark.createDataFrame([row], SCHEMA)).collect()
    assert [(n.report_id, n.file, n.section, n.entry_no, n.node_no, n.variable) for n in nodes] == [(1, "F", "tp_matched", 0, 0, "a")]
    schema = {(r.path, r.kind) for r in reports.schema(spark.createDataFrame([row], SCHEMA)).collect()}
    assert ("files[].tp_matched[].path", "array") in schema
    for table in (reports.files, reports.chains, reports.path_nodes, reports.labels, reports.fp_patterns):
        assert table(spark.createDataFrame([], SCHEMA)).count() == 0


def test_related_tables(spark):
    """Children find their parents by surrogate key; columns and their types come from the schema of all records."""
    one = {"files": {"a/F.java": {"cve": None, "m": {"n": 3}, "tp_matched": [{"chain": {"id": "c", "source": {"line": 5}, "path": ["x", {"variable": "y", "line": 2}]}, "tp": {"id": 7}}], "fn_chains": [{"id": "L1", "extra": True}]}}}
    two = {"files": [{"file": "G", "cve": "CVE-1", "m": {"n": 1.5}, "fp_chains": [{"id": "d", "source": {"line": None}, "path": "z", "fp_pattern": [{"reason": "r"}, None, {"reason": ""}]}]}]}
    raw = spark.createDataFrame([(1, json.dumps(one), None, "x"), (2, json.dumps(two), None, "x")], SCHEMA)
    files, chains, nodes, patterns = (t(raw).collect() for t in (reports.files, reports.chains, reports.path_nodes, reports.fp_patterns))
    assert sorted((r.report_id, r.file, r.cve, r.m__n) for r in files) == [(1, "a/F.java", None, 3.0), (2, "G", "CVE-1", 1.5)]
    assert sorted((r.file, r.section, r.entry_no, r.id, r.source__line, r.tp__id) for r in chains) == [("G", "fp_chains", 0, "d", None, None), ("a/F.java", "tp_matched", 0, "c", 5, 7)]
    assert {r.parent_key for r in chains} == {r.row_key for r in files} and {r.parent_key for r in nodes} == {r.row_key for r in chains}
    assert sorted((r.file, r.node_no, r.variable, r.line) for r in nodes) == [("G", 0, "z", None), ("a/F.java", 0, "x", None), ("a/F.java", 1, "y", 2)]
    assert sorted((r.pattern_no, r.reason) for r in patterns if r.reason is not None) == [(0, "r"), (2, "")] and len(patterns) == 3
    assert [(r.report_id, r.file, r.id, r.extra) for r in reports.labels(raw).collect()] == [(1, "a/F.java", "L1", True)]


def test_any_nesting(spark):
    """Levels follow the records, whatever their names: three arrays within each other, one below plain objects."""
    body = {"a": [{"b": {"c": [{"d": [1, 2]}, {"d": []}]}}, {"b": {"c": None}}]}
    df = spark.createDataFrame([(9, json.dumps(body))], "id long, body string")
    shapes = nested.shapes_of(nested.infer(df, F.col("body")))
    tables = nested.levels(shapes)
    assert [t.path for t in tables] == ["a[]", "a[].b.c[]", "a[].b.c[].d[]"]
    rows = nested.shred(df.select("id", nested.parse_record(F.col("body")).alias("v")), ["id"], "v", tables)
    assert sorted((r.level, r.ordinals) for r in rows.collect()) == [("a[]", [0]), ("a[]", [1]), ("a[].b.c[]", [0, 0]), ("a[].b.c[]", [0, 1]), ("a[].b.c[].d[]", [0, 0, 0]), ("a[].b.c[].d[]", [0, 0, 1])]
    assert sorted(r.value for r in nested.flat_table(rows, shapes, (), "a[].b.c[].d[]").collect()) == [1, 2]
