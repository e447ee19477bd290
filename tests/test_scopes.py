from pyspark.sql import functions as F

from chainloom.operators import graph, matching, scopes, source_text

TEXT = "\n".join([
    "class A extends B {",
    '    private static final String NAME = "a;b";',
    "    protected Map<String, List<Integer>> held;",
    "    public String first(String pa, final int pb) {",
    '        String one = request.getParameter("one"); // one is said here',
    "        String two = one;",
    "        try { helper.get().run(two).exec(two); } catch (IOException problem) { }",
    "        for (String each : list) {",
    "            two = clean(two);",
    "        }",
    "        one = other;",
    "        db.executeQuery(one);",
    "    }",
    "    public void second(String two) {",
    "        db.executeQuery(two);",
    "    }",
    "}",
])
SCHEMA = "file string, text string, line int, function_name string"


def files(spark):
    return spark.createDataFrame([("A", TEXT, 1, "x"), ("A", TEXT, 1, "x"), ("B", "", 2, None), ("C", None, 3, None), (None, "// only said", 4, None)], SCHEMA)


def test_fields_and_locals(spark):
    rows = scopes.fields(files(spark).distinct()).collect()
    assert sorted((r.line_number, r.field, r.type) for r in rows) == [(2, "NAME", "String"), (3, "held", "Map<String, List<Integer>>")]
    names = {r.function_name: r.names for r in scopes.locals_of(files(spark)).collect()}
    assert names == {"first": "each,one,pa,pb,problem,two", "second": "two"}


def test_census_and_relevance(spark):
    df = files(spark).select(F.lit("s").alias("source"), "text")
    assert scopes.census(df, "source").collect()[0][1:] == (5, 2, 1, 0)
    assert {r.function_name: r.relevant for r in scopes.relevant_functions(files(spark)).collect()} == {"first": True, "second": True}
    dull = spark.createDataFrame([("D", "public int one() {\nreturn 1;\n}", 1, "")], SCHEMA)
    assert [r.relevant for r in scopes.relevant_functions(dull).collect()] == [False]


def test_definitions_uses_and_values(spark):
    df = files(spark).distinct()
    rows = {r.variable: r for r in scopes.definitions_and_uses(df).collect()}
    assert (rows["one"].definitions, rows["one"].uses, rows["one"].first_definition) == (2, 2, 5)
    kept = {r.variable: r.preserved for r in scopes.preserved(df).collect()}
    assert kept["one"] is False and kept["two"] is True and kept["request"] is None and kept["db"] is True
    own = spark.createDataFrame([("E", "String x1 = in;\nx1 = x1.trim();\nrun(x1);", 1, "")], SCHEMA)
    assert {r.variable: r.preserved for r in scopes.preserved(own).collect()}["x1"] is True


def test_uses_by_distance(spark):
    rows = {(r.variable, r.vuln_type): (r.line_number, r.use_line) for r in scopes.terminal_uses(files(spark)).collect()}
    assert rows["one", "sql_injection"] == (5, 12) and rows["two", "command_injection"] == (6, 7) and ("two", "sql_injection") not in rows
    near = {r.variable: (r.use_line, r.tier) for r in scopes.nearest_uses(files(spark)).collect()}
    assert near["two"] == (7, 1) and near["one"] == (12, 2) and near["NAME"] == (2, 4)
    roots = {(r.root, r.method) for r in scopes.call_roots(files(spark)).collect()}
    assert ("helper", "exec") in roots and ("db", "executeQuery") in roots


def test_guard_lets_no_source_of_another_method_through(spark):
    bridges = spark.createDataFrame([("A", "x", "m", 1), ("A", "x", "n", 2), ("A", "y", "n", 3), ("A", "x", None, 4), ("B", "x", "n", 5), (None, "x", "n", 6)], "file string, argument string, function_name string, k int")
    sources = spark.createDataFrame([("A", "x", "m"), ("A", "x", "m"), ("A", "y", None), (None, "x", "m")], "file string, variable string, function_name string")
    assert sorted(r.k for r in scopes.guarded(bridges, sources).collect()) == [1, 3, 4, 5, 6]


def test_empty_tables(spark):
    none = files(spark).limit(0)
    for f in (scopes.fields, scopes.locals_of, scopes.definitions_and_uses, scopes.preserved, scopes.terminal_uses, scopes.nearest_uses, scopes.call_roots, scopes.relevant_functions):
        assert f(none).count() == 0
    assert source_text.functions(none).count() == 0


def test_cheapest_paths_are_those_of_relaxing_one_by_one(spark):
    import random

    rng = random.Random(5)
    edges = [(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}", float(rng.randrange(1, 6))) for _ in range(45)] + [("n0", None, 1.0), ("n1", "n1", 1.0), ("n0", "n3", 9.0)]
    starts, ends, bound = ["n0", "n1", "n2"], [f"n{i}" for i in range(6, 14)], 4
    price = {}
    for a, b, c in edges:
        if b is not None:
            price[a, b] = min(c, price.get((a, b), c))
    expected, walks = {}, [(0.0, [s]) for s in starts]
    while walks:
        cost, path = walks.pop()
        if path[-1] in ends and len(path) > 1:
            key = (path[0], path[-1])
            expected[key] = min(expected.get(key, (cost, len(path), path)), (cost, len(path), path))
        if len(path) <= bound:
            walks += [(cost + c, path + [b]) for (a, b), c in price.items() if a == path[-1] and b not in path]
    node = lambda names: spark.createDataFrame([(n,) for n in names], "node string")
    rows = graph.cheapest_paths(spark.createDataFrame(edges, "src string, dst string, cost double"), node(starts), node(ends), bound).collect()
    assert {(r.source, r.sink): (r.cost, len(r.path), r.path) for r in rows} == expected


def test_call_slice_has_both_distances(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "c"), ("x", "b"), ("d", "e"), (None, "a")], "src string, dst string")
    node = lambda *names: spark.createDataFrame([(n,) for n in names], "node string")
    rows = {r.node: (r.forth, r.back) for r in graph.call_slice(edges, node("a"), node("d"), 15).collect()}
    assert rows == {"a": (0, 2), "b": (1, 2), "c": (1, 1), "d": (2, 0)}


def test_replaced_groups_and_two_tiers(spark):
    base = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "file string, n int")
    update = spark.createDataFrame([("a", 9), (None, 8), ("c", 7)], "file string, n int")
    assert sorted((r.file or "", r.n) for r in matching.replace_groups(base, update, "file").collect()) == [("", 4), ("", 8), ("a", 9), ("b", 3), ("c", 7)]
    wanted = spark.createDataFrame([("p/x/A.java",), ("q\\y\\B.java",), ("C.java",), (None,), ("",)], "file string")
    known = spark.createDataFrame([("/r/p/x/A.java",), ("/s/x/A.java",), ("/t/y/b.java",), ("/u/C.java",), ("/v/C.java",)], "name string")
    rows = sorted((r.file, r.name, r.tier) for r in matching.two_tier_suffix(wanted, "file", known, "name").collect())
    assert rows == [("C.java", "/u/C.java", 1), ("C.java", "/v/C.java", 1), ("p/x/A.java", "/r/p/x/A.java", 1), ("q\\y\\B.java", "/t/y/b.java", 2)]


def test_connected_by_paths_of_any_length(spark):
    chain = [(f"m{i}", f"m{i + 1}") for i in range(20)] + [("m20", "m0"), ("z", "m3"), (None, "m1")]
    edges = spark.createDataFrame(chain, "src string, dst string")
    pairs = spark.createDataFrame([("m0", "m20"), ("m0", "m20"), ("m5", "m4"), ("m0", "z"), ("z", "z"), ("q", "m1"), (None, "m1"), ("m1", None)], "source string, sink string")
    rows = {(r.source, r.sink): r.reaches for r in graph.connected(edges, pairs).collect()}
    assert rows == {("m0", "m20"): True, ("m5", "m4"): True, ("m0", "z"): False, ("z", "z"): True, ("q", "m1"): False, (None, "m1"): False, ("m1", None): False}
    assert graph.connected(edges.limit(0), pairs.limit(0)).count() == 0


def test_arrows(spark):
    text = "# a -> b\n\n a -> b \r\na -> b -> c\n -> d\nc->d"
    df = spark.createDataFrame([("A", text, 1, ""), ("B", None, 1, "")], SCHEMA)
    assert [(r.line_number, r.src, r.dst) for r in source_text.arrow_edges(df).collect()] == [(3, "a", "b"), (6, "c", "d")]


def test_census_of_long_literals(spark):
    """A literal of any length is code; it was an error from some thousand letters on."""
    files = spark.createDataFrame([("s", f'a.b("{"x" * 100_000}");'), ("s", f"// {'x' * 100_000}"), ("s", f"c = '{'y' * 100_000}';")], "source string, text string")
    assert tuple(scopes.census(files, "source").first()) == ("s", 3, 0, 1, 1)
