import datetime
import json
import random

import numpy as np

from chainloom.operators import schema_drift
from chainloom.operators.schema_drift import canonical_names, canonical_table, flatten, flood, rename_roots, schema_changes, select

SCHEMA = "suite long, report long, run timestamp, section string, record_no int, body string, field string"


def rows(report, bodies, section="fn_chains", suite=1):
    return [(suite, report, datetime.datetime(2025, 1, 1 + report), section, i, b if isinstance(b, str | None) else json.dumps(b), "clash") for i, b in enumerate(bodies)]


def changes(spark, data):
    flat = flatten(spark.createDataFrame(data, SCHEMA), "suite", "report", "run")
    return flat, sorted((r.file_id, r.field, r.change, r.old_field) for r in schema_changes(flat).collect())


def test_rename_move_and_type(spark):
    old = [{"id": f"T{i}", "_cwe": f"C{i % 3}", "line": i, "old": 1} for i in range(5)]
    new = [{"id": f"T{i}", "weakness": {"id": [f"C{i % 3}"]}, "line": str(i), "new": True, "none": None} for i in range(5)]
    flat, got = changes(spark, rows(1, [*old, "{broken", None, "[1]"]) + rows(2, new + new[:1]))
    assert got == [
        (2, "fn_chains.line", "type_changed", ""), (2, "fn_chains.new", "added", ""), (2, "fn_chains.old", "removed", ""),
        (2, "fn_chains.weakness.id", "renamed", "fn_chains._cwe"), (2, "fn_chains.weakness.id", "type_changed", ""),
    ]
    table = canonical_table(flat, canonical_names(flat, schema_changes(flat))).where("file_id = 2 and record_no = 1").first()
    assert table["fn_chains___cwe"] == "C1" and table["fn_chains__line"] == 1


def test_half_is_no_rename(spark):
    old, new = [{"id": str(i), "a": i} for i in range(4)], [{"id": str(i), "b": i if i < 2 else 9} for i in range(4)]
    assert changes(spark, rows(1, old) + rows(2, new))[1] == [(2, "fn_chains.a", "removed", ""), (2, "fn_chains.b", "added", "")]


def test_numbers_and_sections(spark):
    a, b = [{"id": "1", "v": 1}], [{"id": "1", "v": 1.0}]
    data = rows(1, a) + rows(2, b) + rows(3, [{"tp": {"id": "1"}, "v": 1}], "tp_matched", 2)
    assert changes(spark, data)[1] == [(2, "fn_chains.v", "type_changed", "")]


def test_empty(spark):
    flat, got = changes(spark, [])
    assert got == [] and canonical_table(flat, canonical_names(flat, schema_changes(flat))).count() == 0


def test_flooding_prefers_likely_names():
    a, b, score = flood([("s.source_line", "integer"), ("s.sink_var", "string")], [("s.srcLine", "integer"), ("s.note", "string")])
    assert score[a["s.source_line"], b["s.srcLine"]] > score[a["s.source_line"], b["s.note"]]


def test_roots_agree_with_a_walk(spark):
    rng, events, want = random.Random(5), [], {}
    for series in range(6):
        name, present = {}, ["a", "b", "c"]
        for place in range(2, 40):
            if rng.random() < 0.5:
                old = rng.choice(present)
                new = rng.choice([f for f in "abcdefgh" if f not in present])
                present[present.index(old)] = new
                name[new] = name.get(old, old)
                events.append((series, new, old, place))
                want[series, new, place] = name[new]
    got = rename_roots(spark.createDataFrame(events, "series long, field string, old_field string, place long")).collect()
    assert {(r.series, r.field, r.place): r.canonical for r in got} == want and len(got) == len(events)


def test_names_persist_over_gaps(spark):
    a, b, none = ([{"id": str(i), n: i * 7, "x": 1} for i in range(4)] for n in ("a", "b", "x"))
    flat = flatten(spark.createDataFrame(rows(1, a) + rows(2, b) + rows(3, none) + rows(4, b), SCHEMA), "suite", "report", "run")
    names = {(r.file_id, r.field): r.canonical for r in canonical_names(flat, schema_changes(flat)).collect()}
    assert names[1, "fn_chains.a"] == names[2, "fn_chains.b"] == names[4, "fn_chains.b"] == "fn_chains.a"


def test_a_name_that_comes_back_loses_no_value(spark):
    a, b = ([{"id": str(i), n: f"v{i}"} for i in range(4)] for n in ("a", "b"))
    both = [{"id": str(i), "b": f"v{i}", "a": "other"} for i in range(4)]
    flat = flatten(spark.createDataFrame(rows(1, a) + rows(2, b) + rows(3, both), SCHEMA), "suite", "report", "run")
    table = canonical_table(flat, canonical_names(flat, schema_changes(flat)))
    got = table.where("record_no = 1").orderBy("file_id").collect()
    assert [r["fn_chains__a"] for r in got] == ["v1", "v1", "v1"] and [r["fn_chains__a__again"] for r in got] == [None, None, "other"]


def test_flooding_decides(spark, monkeypatch):
    """Without scores there are no candidates; a pair that flooding doesn't select is no rename, though its values agree."""
    old, new = [{"id": str(i), "source_line": i, "x": 1} for i in range(4)], [{"id": str(i), "src_line": i} for i in range(4)]
    assert (2, "fn_chains.src_line", "renamed", "fn_chains.source_line") in changes(spark, rows(1, old) + rows(2, new))[1]
    flooded = schema_drift.flood
    monkeypatch.setattr(schema_drift, "flood", lambda a, b: (lambda x, y, s: (x, y, s * 0))(*flooded(a, b)))
    assert not [r for r in changes(spark, rows(1, old) + rows(2, new))[1] if r[2] == "renamed"]


def test_selection_and_second_choice(spark, monkeypatch):
    assert select(np.array([[1.0, 0.4], [0.6, 0.55]])).tolist() == [[True, False], [True, True]]
    # Both old fields agree with both new ones; the best pair is taken, and the rest still finds its own.
    old = [{"id": str(i), "source_file": f"F{i}", "sink_file": f"F{i}"} for i in range(4)]
    new = [{"id": str(i), "src_file": f"F{i}", "sinkFile": f"F{i}"} for i in range(4)]
    got = [(r[1], r[3]) for r in changes(spark, rows(1, old) + rows(2, new))[1]]
    assert got == [("fn_chains.sinkFile", "fn_chains.sink_file"), ("fn_chains.src_file", "fn_chains.source_file")]


def test_types_of_columns(spark):
    one, two = [{"id": "1", "n": 1, "f": 1, "b": True, "t": 5, "s": "x"}], [{"id": "1", "n": ["2"], "f": 1.5, "b": False, "t": "five", "s": ["a", "b"]}]
    flat, _ = changes(spark, rows(1, one) + rows(2, two))
    table = canonical_table(flat, canonical_names(flat, schema_changes(flat)))
    assert {k: v for k, v in table.dtypes if k.startswith("fn_")} == {"fn_chains__id": "string", "fn_chains__n": "bigint", "fn_chains__f": "double", "fn_chains__b": "boolean", "fn_chains__t": "string", "fn_chains__s": "string"}
    last = table.where("file_id = 2").first()
    assert (last.fn_chains__n, last.fn_chains__f, last.fn_chains__b, last.fn_chains__t, last.fn_chains__s) == (2, 1.5, False, "five", '["a", "b"]')
