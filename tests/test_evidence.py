"""Queries on functions, names, cases and quality over small tables with nulls and odd texts."""

import pytest

from chainloom.plans import evidence

SIDE = "struct<variable: string, file: string, line: int, function_name: string, class_name: string, code_snippet: string>"
CHAINS = f"row_id long, backend string, section string, file string, cwe string, vulnerability_label string, source {SIDE}, sink {SIDE}, path array<string>, confidence double, loaded_at timestamp"
JAVA = """class A {
    public int two() {
        return 2 + 2;
    }
    public String call(String in) {
        if (in != null) { log(in); }
        return in;
    }
}"""


@pytest.fixture()
def folder(spark, tmp_path):
    def end(variable, file, line, text):
        return (variable, file, line, "f", "C", text)

    rows = [
        (1, "llm", "tp_matched", "p/A.java", "CWE-1", "xss", end("this.req.body", "/x/p/A.java", 3, "String req = a.b();"), end("Scope:this.Out", "/x/p/A.java", 0, "out.print(req);"), ["a", "b"], 0.9, None),
        (1, "llm", "tp_matched", "p/A.java", "CWE-1", "xss", end("this.req.body", "/x/p/A.java", 3, "String req = a.b();"), end("Scope:this.Out", "/x/p/A.java", 0, "out.print(req);"), ["a", "b"], 0.9, None),
        (2, "llm", "fp_chains", None, " ", None, None, None, None, float("nan"), None),
        (3, "static", "unclassified_chains", "q/Z.java", "", "", end("a", "p/A.java", 1, ""), end("b", "q/B.java", 1, "import x.Y;"), [], 70.0, None),
    ]
    spark.createDataFrame(rows, CHAINS).write.parquet(str(tmp_path / "chains.parquet"))
    spark.createDataFrame([(1, JAVA, "java"), (2, None, "java"), (3, "", "java"), (4, 'Answer:\n```json\n{"a": 1}\n```\nbye', "note"), (5, ' {"b": 2}\n', "json")], "doc_id long, text string, kind string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("p/A.java",), ("r/B.java",), (None,)], "file string").write.parquet(str(tmp_path / "tp_labels.parquet"))
    return str(tmp_path)


def test_functions(spark, folder):
    got = {r.function_name: (r.calls, r.statements, r.trivial, r.constant) for r in evidence.function_traits(spark, folder).collect()}
    assert got == {"two": (False, 1, True, True), "call": (True, 1, False, False)}


def test_names_and_snippets(spark, folder):
    names = {r.row_id: tuple(r)[1:] for r in evidence.canonical_names(spark, folder).collect()}
    assert names[1] == ("req", "req.body", None, "out") and names[2] == (None, None, None, None)
    kinds = {r.row_id: tuple(r)[1:] for r in evidence.snippet_kinds(spark, folder).collect()}
    assert kinds[1][0] == "operation" and kinds[2] == ("none", False) and kinds[3] == ("import", False)


def test_cases(spark, folder):
    got = {r.row_id: (r.cases, r.status, r.case_id) for r in evidence.case_attribution(spark, folder).collect()}
    assert got == {1: (1, "attributed", "A"), 2: (0, "orphan", None), 3: (2, "several", None)}


def test_quality_counts_repeated_rows_once(spark, folder):
    got = {(r.backend, r.problem): r.n for r in evidence.data_quality(spark, folder).collect()}
    assert got["llm", "confidence_missing"] == 1 and got["static", "confidence_scale"] == 1 and got["llm", "sink_line_unknown"] == 2 and got["llm", "path_missing"] == 1


def test_answers_in_texts(spark, folder):
    assert {r.doc_id: (r.body, r.fenced) for r in evidence.json_in_text(spark, folder).collect()} == {1: (JAVA, False), 4: ('{"a": 1}', True), 5: ('{"b": 2}', False)}


def test_unique_suffix(spark, folder):
    got = {r.reported: (r.candidates, r.known) for r in evidence.unique_suffix_route(spark, folder).collect()}
    assert got == {"p/A.java": (2, None)}


def test_declarations_and_conditions(spark, folder):
    assert evidence.declared_types(spark, folder).collect() == []
    assert [(r.variable, r.n) for r in evidence.condition_loops(spark, folder).collect()] == [("in", 1)]


def test_empty_tables(spark, folder, tmp_path):
    empty = tmp_path / "empty"
    for name in ("chains", "documents", "tp_labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(str(empty / f"{name}.parquet"))
    for f in (evidence.function_traits, evidence.case_attribution, evidence.data_quality, evidence.chain_signatures, evidence.file_groups, evidence.verification_summary, evidence.json_in_text):
        assert f(spark, str(empty)).collect() == []
