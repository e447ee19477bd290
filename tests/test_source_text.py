from pyspark.sql import functions as F

from chainloom.operators import source_text

CODE = '''import a.b.C;
public class Foo extends Bar {
    public String run(String id, int n) {
        String name = req.getParameter("id"); // id = "x"
        this.copy = name;
        /* a
           b */
        if (n > 1) { db.executeQuery("q" + name); }
    }
    private void stop() { x.exec(cmd); }
}'''


def files(spark, *texts):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "file int, text string, line string")


def test_comments_keep_lines(spark):
    out = files(spark, CODE, 'a = "// no"; // yes', "", None).select("file", source_text.without_comments(F.col("text")).alias("c")).collect()
    assert out[0].c.count("\n") == CODE.count("\n") and "b */" not in out[0].c and 'id = "x"' not in out[0].c
    assert out[1].c == 'a = "// no"; ' and out[2].c == "" and out[3].c is None


def test_long_literals_are_no_deep_stack(spark):
    """Literals of any length, closed or not: they were an error from some thousand letters on."""
    for quote in "\"'":
        for inner in ("x" * 100_000, "\\" + quote + "//" * 50_000, "\\\\" * 50_000):
            out = files(spark, f"a = {quote}{inner}{quote}; // yes").select(source_text.without_comments(F.col("text")).alias("c")).first().c
            assert out == f"a = {quote}{inner}{quote}; "
        out = files(spark, f"a = {quote}{'x' * 100_000}\nb /* c\n*/ d").select(source_text.without_comments(F.col("text")).alias("c")).first().c
        assert out == f"a = {quote}{'x' * 100_000}\nb \n d"


def test_flows_functions_endpoints(spark):
    df = files(spark, CODE, None, "")
    flows = {(r.from_var, r.to_var) for r in source_text.assignments(df).collect()}
    assert ("name", "copy") in flows and ("req", "name") not in {("", "")}
    functions = {(r.function_name, r.start_line, r.end_line) for r in source_text.functions(df).collect()}
    assert functions == {("run", 3, 9), ("stop", 10, 10)} or functions == {("run", 3, 9), ("stop", 10, 11)}
    assert [(r.variable, r.line_number) for r in source_text.static_sources(df).collect()] == [("name", 4)]
    assert {(r.variable, r.vuln_type) for r in source_text.static_sinks(df).collect()} == {("name", "sql_injection"), ("cmd", "command_injection")}
    held = source_text.in_functions(source_text.static_sinks(df), source_text.functions(df)).collect()
    assert {(r.variable, r.function_name) for r in held} == {("name", "run"), ("cmd", "stop")}
    assert [(r.class_name, r.superclass) for r in source_text.class_records(df).collect()] == [("Foo", "Bar")]
    assert source_text.imports(df).first().imported == "a.b.C"


def test_sanitizers_and_secrets(spark):
    df = files(spark, 'PreparedStatement ps = c.prepareStatement(sql);\nlong n = Long.parseLong(x);')
    assert {(r.sanitizer, r.variable) for r in source_text.static_sanitizers(df).collect()} == {("prepared_statement", "ps"), ("numeric_parse", "n")}
    assert files(spark, "password = hunter2, x").select(source_text.redacted(F.col("text"))).first()[0] == "password = ***, x"


def test_unicode_words(spark):
    assert {r.variable for r in source_text.variables(files(spark, "für prüfung ab")).collect()} == {"ab"}
    assert source_text.lines(files(spark)).count() == 0


def test_bridges_need_one_owner(spark):
    a = 'public void go() {\n  helper.push(name + "q", 3, extra);\n  helper.two(name);\n}'
    b = "public void push(String first, int second) {\n}\npublic void two(String x) {\n}"
    c = "public void two(String x) {\n}"
    got = source_text.call_bridges(files(spark, a, b, c)).collect()
    assert [(r.file, r.line_number, r.method, r.argument, r.owner, r.parameter) for r in got] == [(0, 2, "push", "name", 1, "first")]
    first = {r.variable: r.line_number for r in source_text.first_occurrences(files(spark, a)).collect()}
    assert first["name"] == 2 and first["go"] == 1
    edge = spark.createDataFrame([(0, "name", "helper"), (0, "name", "nowhere")], "file int, from_var string, to_var string")
    assert [tuple(r) for r in source_text.statement_of(edge, files(spark, a)).collect()] == [(0, "name", "helper", 2)]


def test_functions_meet_lines_by_bands(spark):
    """Lines are not joined with all functions of their file; the innermost is found over bands' edges too."""
    scopes = [(1, "whole", 1, 400), (1, "inner", 15, 17), (1, "late", 160, 230), (1, "one", 200, 200), (2, "other", 1, 9)]
    rows = [(f, n) for f in (1, 2, 3) for n in range(1, 420, 3)]
    held = source_text.in_functions(spark.createDataFrame(rows, "file int, line_number int"), spark.createDataFrame(scopes, "file int, function_name string, start_line int, end_line int"))
    want = {(f, n): max(((s, name) for g, name, s, e in scopes if g == f and s <= n <= e), default=(0, None))[1] for f, n in rows}
    assert {(r.file, r.line_number): r.function_name for r in held.collect()} == want
    assert "__band" in held._jdf.queryExecution().optimizedPlan().toString()


def test_letters_of_patterns(spark):
    assert source_text.letters(r"\.setParameter\s*\(|\.createNamedQuery\s*\(") == ["setParameter", "createNamedQuery"]
    assert source_text.letters(r"(?i)\.prepareStatement\(") == source_text.letters(r"(Integer|Long)\.x\(") == source_text.letters(r"abcd?|[xyz]{4}") == []
    said = ["x.normalize ( )", "normal", "@Valid x", "Validator . validate (x)", "new  ProcessBuilder(List.of", "x.replace(\"../\", \"\")", "a.PREPAREstatement(", "jdbcTemplate.queryForList(a, b,"]
    df = spark.createDataFrame([(x,) for x in said], "line string")
    for *_, p in source_text.SANITIZERS:
        assert df.where(source_text.has(F.col("line"), p)).count() == df.where(F.col("line").rlike(p)).count()


def test_owners_need_no_ends_and_lines_without_braces_stay(spark):
    """Calls are owned by headers alone, and only lines with braces are shuffled for the ends of functions."""
    code = "class A {\npublic void go(int a) {\n\nhelper.go(a);\n}\n\n}\n\n"
    df = files(spark, code, code.replace("go(", "at("), "public void open(int b) {\n\n", None)
    assert "Window" not in source_text.owned_calls(df)._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.file, r.owner, r.line_number, r.arguments) for r in source_text.owned_calls(df).collect()} == {(0, 0, 4, "a"), (1, 1, 4, "a")}
    assert {tuple(r) for r in source_text.functions(df).collect()} == {(0, "go", "int a", 2, 5), (1, "at", "int a", 2, 5), (2, "open", "int b", 1, 3)}
    assert "Contains(line" in source_text.functions(df)._jdf.queryExecution().optimizedPlan().toString()


def test_names_and_statements_in_one_match(spark):
    """Words that only hold or follow an identifier are none, also beyond the basic plane, and marks are plain text."""
    text = "int x1 = für + y_2é + ab + éab + 9ab + ifx + if;\n𝒳ab = cd𝒳 + ef;\n\x01a\x01b = cd;\nto = \x01cd;\nab = cd\r\nto = a.b(cd(ef));"
    df = files(spark, text)
    assert {r.variable for r in source_text.variables(df).collect()} == {"x1", "ab", "ifx", "ef", "cd", "to"}
    assert {(r.line_number, r.from_var, r.to_var, r.flow_type) for r in source_text.assignments(df).collect()} == {(1, "ab", "x1", "arithmetic"), (1, "ifx", "x1", "arithmetic"), (4, "cd", "to", "other"), (5, "cd", "ab", "direct"), (6, "cd", "to", "method_call"), (6, "ef", "to", "method_call")}
    assert [tuple(r)[2:] for r in source_text.calls(files(spark, "x.go(a, b).then(c) + 1ab.on()")).collect()] == [("x", "go", "a, b"), ("ab", "on", "")]
    plan = source_text.assignments(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(line") == 1
