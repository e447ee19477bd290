import random

import pytest
from pyspark.sql import functions as F

from chainloom.functions import registry
from chainloom.operators import chains, evaluation, source_text
from chainloom.plans import corpus as corpus_plans
from chainloom.plans import scopes as scope_plans


def test_chains_cross_files_and_are_rejected(spark):
    one = 'class A {\npublic String first(String pa) {\nString input = request.getParameter("x");\nString both = input + pa;\nhelper.second(both);\ndb.executeQuery(both);\n}\n}'
    two = "class B {\npublic String second(String pb) {\nString other = pb;\nother = UUID.fromString(other).toString();\nlog.executeUpdate(other);\n}\n}"
    df = spark.createDataFrame([("A", one, 1), ("B", two, 2), ("C", None, 3)], "file string, text string, line int")
    made = chains.chains_from_source(df)
    rows = {(r.source_variable, r.sink_variable): r for r in made.collect()}
    assert set(rows) == {("input", "both"), ("input", "other")}
    assert rows["input", "other"].path == ["A:input", "A:both", "B:pb", "B:other"] and rows["input", "other"].vuln_type == "sql_injection"
    sanitizers = source_text.static_sanitizers(df).join(source_text.lines(df), ["file", "line_number"])
    found = chains.sanitizers_on(made, sanitizers)
    assert [(r.sanitizer, r.line_number) for r in found.collect()] == [("uuid_validation", 4)]
    verdict = {r.chain_id: r for r in chains.rejected(made, found).collect()}
    assert verdict[rows["input", "other"].chain_id].verified is False and verdict[rows["input", "both"].chain_id].verified is None
    assert chains.sanitizers_on(made, sanitizers, by_file=False).count() == 0
    assert chains.chains_from_source(df.limit(0)).count() == 0


def one_by_one(pairs):
    free, got = {b for _, b, _ in pairs}, {}
    for a in sorted({a for a, _, _ in pairs}):
        own = [(s, -b) for x, b, s in pairs if x == a and b in free]
        if own:
            s, b = max(own)
            got[a] = -b
            free.discard(-b)
    return got


@pytest.mark.parametrize("seed", range(3))
def test_greedy_match_is_that_of_a_loop(spark, seed):
    rng = random.Random(seed)
    pairs = sorted({(rng.randrange(25), 100 + rng.randrange(12)) for _ in range(90)})
    pairs = [(a, b, rng.choice((105, 108, 110))) for a, b in pairs]
    df = spark.createDataFrame(pairs, "finding long, label long, score int")
    assert {r.finding: r.label for r in evaluation.greedy_match(df).collect()} == one_by_one(pairs)
    assert evaluation.greedy_match(df.limit(0)).count() == 0


def test_candidates_and_patterns(spark):
    shape = "project string, source_var string, source_file string, source_line int, sink_var string, sink_file string, sink_line int, vuln_type string"
    found = spark.createDataFrame([(1, "p", "f:this.Input", "/x/a/B.java", 10, "q", "/x/a/B.java", 20, "XSS"), (2, "p", "input", "a/B.java", 0, "q", "a/B.java", 20, "xss"), (3, "p", "input", "ab/B.java", 10, "q", "ab/B.java", 26, "xss")], "finding long, " + shape)
    truth = spark.createDataFrame([(7, "p", "input", "a/B.java", 12, "q", None, 18, "xss"), (8, "p", "input", None, 0, "q", None, None, None)], "label long, " + shape)
    got = sorted((r.finding, r.label, r.score) for r in evaluation.match_candidates(found, truth).collect())
    assert got == [(1, 7, 106), (1, 8, 110), (2, 8, 110), (3, 8, 110)]
    texts = spark.createDataFrame([(1, "F", "alpha", "x.get(alpha)", "beta", None), (2, "G", "alpha", None, "beta", "send(beta)")], "finding long, file string, source_var string, source_text string, sink_var string, sink_text string")
    patterns = spark.createDataFrame([("2", "F", None, "beta", r"get\(", None), ("1", "F", "other", "beta", None, None), ("0", "F", None, None, None, None), ("3", "G", None, None, None, r"^beta send")], "pattern string, file string, source_var string, sink_var string, source_pattern string, sink_pattern string")
    assert sorted(map(tuple, evaluation.first_pattern(texts, patterns).collect())) == [(1, "2"), (2, "3")]


def test_confusion(spark):
    cases = [("a", True, True)] * 3 + [("a", True, False)] + [("a", False, True)] + [("a", False, False)] * 5 + [("b", True, True)]
    df = spark.createDataFrame(cases, "kind string, detected boolean, vulnerable boolean")
    rows = {r.kind: r for r in evaluation.confusion(df, "kind").collect()}
    a = rows["a"]
    assert (a.tp, a.fp, a.fn, a.tn) == (3, 1, 1, 5) and (a.precision, a.recall, a.specificity, a.accuracy) == (0.75, 0.75, 0.8333, 0.8) and a.youden == 0.5833
    assert rows[None].tp == 4 and rows["b"].specificity == 0.0


def test_sql_functions(spark):
    assert len(registry.register(spark)) == len(set(registry.register(spark)))
    row = spark.sql("SELECT chainloom_unit_confidence(85D) a, chainloom_weakness_number('cwe-079') b, chainloom_canonical_name('F:this.userName') c, chainloom_line_close(0, 5) d, chainloom_line_close(3, 0) e").first()
    assert tuple(row) == (0.85, "CWE-79", "username", False, True)


def test_names_of_kinds(spark):
    df = spark.createDataFrame([(1, "public String f(String a) {")], "file long, text string")
    assert source_text.functions(df).select(F.col("end_line")).first()[0] == 1


def test_corpus_is_put_together_by_line_numbers(spark, tmp_path):
    """Each line once, at its place, also for repeated rows, items without an order and files with gaps."""
    spark.createDataFrame([(1,), (1,), (63,), (200,)], "o_orderkey long").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(1, 2), (1, 2), (63, 7), (70, 5), (70, 8), (1, 0)], "l_orderkey long, l_linenumber int").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    df = corpus_plans.corpus(spark, str(tmp_path))
    got = {r.file: dict(enumerate(r.text.split("\n"), 1)) for r in df.collect()}
    assert all(len(x) == 642 for x in got.values()) and "map_from_entries" not in df._jdf.queryExecution().analyzed().toString()
    said = {f: {n: x for n, x in text.items() if x} for f, text in got.items()}
    assert said[0] == {1: "class F0 {", 12: "public String step1(String p1) {", 14: "String mid1 = in1;", 20: "}", 632: "public String step63(String p63) {", 639: "stmt63 = conn.prepareStatement(cat63);", 640: "}", 642: "}"}
    assert said[1] == {1: "class F1 {", 67: "helper.step170(cat70);", 642: "}"} and said[3][82] == "public String step200(String p200) {"


def small_corpus(spark, folder):
    """Orders 0 and 100, of which the first reads, copies, joins, runs, passes on and checks."""
    spark.createDataFrame([(0,), (100,)], "o_orderkey long").coalesce(1).write.parquet(str(folder / "orders.parquet"))
    spark.createDataFrame([(0, i) for i in range(1, 7)] + [(100, 3), (100, 4)], "l_orderkey long, l_linenumber int").coalesce(1).write.parquet(str(folder / "lineitem.parquet"))
    return str(folder)


def counted(monkeypatch, module, name):
    calls, real = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda *a, **k: calls.append(name) or real(*a, **k))
    return calls


def test_metrics_make_edges_and_chains_once(spark, tmp_path, monkeypatch):
    d, edges, walks = small_corpus(spark, tmp_path), counted(monkeypatch, chains, "flow_edges"), counted(monkeypatch, chains, "sanitizers_on")
    got = {r.metric: r.n for r in scope_plans.corpus_metrics(spark, d).collect()}
    assert (len(edges), len(walks)) == (1, 1)
    assert {k: got[k] for k in ("sources", "sinks", "sanitizers", "chains", "rejected")} == {"sources": 1, "sinks": 2, "sanitizers": 1, "chains": 2, "rejected": 2}


def test_rejects_and_sanitizers_put_the_corpus_together_once(spark, tmp_path, monkeypatch):
    d, made = small_corpus(spark, tmp_path), counted(monkeypatch, corpus_plans, "corpus")
    assert {(r.sanitizers, r.verified) for r in corpus_plans.corpus_rejects(spark, d).collect()} == {(1, False)} and len(made) == 1
    assert {r.sanitizer for r in corpus_plans.corpus_chain_sanitizers(spark, d).collect()} == {"uuid_validation"} and len(made) == 2
