"""Queries on scopes, uses and slices of source text, over the java documents and the derived corpus."""

from pyspark.sql import functions as F

from chainloom.functions.lineage import cut, stored
from chainloom.operators import chains, graph, regions, scopes, source_text
from chainloom.plans.catalog import QUERIES, SQL, _FUNCTIONS, _LINES, _NAMES, _SINKS, _SOURCES, java_files, query, quoted
from chainloom.plans.corpus import _BY_FILE, _EDGES, _MADE, _SAN, _WITH, _on_corpus, corpus
from chainloom.sources.tables import table

_PLAIN = lambda x: f"""regexp_replace(regexp_replace({x}, '"[^"]*"', '""', 'g'), '//.*$', '')"""
_BARE = f"(SELECT file, line_number, line, {_PLAIN('line')} AS bare FROM {_LINES})"
_HAS = lambda x, p: f"coalesce(regexp_matches({x}, {quoted(p)}), false)"


def _in_functions(rows: str, columns: str) -> str:
    """Rows (file, line_number, columns) with the innermost function, as in_functions has them."""
    own = ", ".join(f"r.{c.strip()}" for c in columns.split(","))
    return f"(SELECT r.file, r.line_number, {own}, max_by(s.function_name, s.start_line) AS function_name FROM {rows} r LEFT JOIN {_FUNCTIONS} s ON r.file = s.file AND r.line_number BETWEEN s.start_line AND s.end_line GROUP BY r.file, r.line_number, {own})"


# --- files and functions ---------------------------------------------------------------------------------------------


@query(f"""SELECT source, count(*) AS files, count(*) FILTER (WHERE NOT said) AS without_text, count(*) FILTER (WHERE said AND NOT coded) AS remarks_only, count(*) FILTER (WHERE coded AND NOT called) AS without_calls
FROM (SELECT source, {_HAS('d.text', scopes.VISIBLE)} AS said, {_HAS('code', scopes.VISIBLE)} AS coded, {_HAS('code', scopes.INVOKED)} AS called FROM documents d LEFT JOIN ({SQL['strip_comments']}) c ON c.file = d.doc_id WHERE d.kind = 'java') GROUP BY source""")
def file_census(spark, d):
    """Files of each source before any is left out, and those that are not worth a look."""
    return scopes.census(table(spark, d, "documents").where("kind = 'java'").select("source", "text"), "source")


@query(f"SELECT f.file, f.function_name, f.start_line, coalesce(bool_or(regexp_matches(l.line, {quoted(scopes.FUNCTION_RELEVANT)})), false) AS relevant FROM (SELECT DISTINCT file, function_name, start_line, end_line FROM {_FUNCTIONS}) f LEFT JOIN {_LINES} l ON f.file = l.file AND l.line_number BETWEEN f.start_line AND f.end_line GROUP BY f.file, f.function_name, f.start_line")
def function_relevance(spark, d):
    return scopes.relevant_functions(java_files(spark, d))


_DEPTHS = "(SELECT *, sum(delta) OVER (PARTITION BY file ORDER BY line_number) AS depth FROM (SELECT *, length(regexp_replace(line, '[^{]', '', 'g')) - length(regexp_replace(line, '[^}]', '', 'g')) AS delta FROM " + _LINES + "))"


@query(f"SELECT file, line_number, regexp_extract(line, {quoted(scopes.FIELD)}, 2) AS field, trim(regexp_extract(line, {quoted(scopes.FIELD)}, 1)) AS type FROM {_DEPTHS} WHERE depth = 1 AND delta = 0 AND regexp_matches(line, {quoted(scopes.FIELD)})")
def class_fields(spark, d):
    return scopes.fields(java_files(spark, d))


_ALL = lambda x, p, i=1: f"regexp_extract_all({x}, {quoted(p)}, {i})"
_SAID = f"(SELECT DISTINCT file, line_number, unnest(list_concat({_ALL('line', scopes.LOCAL)}, {_ALL('line', scopes.CAUGHT)}, {_ALL('line', scopes.EACH)})) AS name FROM {_LINES})"
_GIVEN = f"SELECT file, function_name, unnest(list_transform(string_split(parameters, ','), lambda p: regexp_extract(p, {quoted(f'({source_text.NAME})' + chr(92) + 's*$')}, 1))) AS name FROM {_FUNCTIONS}"
_LOCALS = f"SELECT file, function_name, count(DISTINCT name) AS n, array_to_string(list_sort(list_distinct(list(name))), ',') AS names FROM ({_GIVEN} UNION ALL SELECT file, function_name, name FROM {_in_functions(_SAID, 'name')} WHERE function_name IS NOT NULL) WHERE name <> '' GROUP BY file, function_name"


@query(_LOCALS)
def function_locals(spark, d):
    return scopes.locals_of(java_files(spark, d))


@query(f"SELECT file, line_number, unnest({_ALL('line', scopes.CHAINED, 1)}) AS root, unnest({_ALL('line', scopes.CHAINED, 2)}) AS method FROM {_LINES}")
def call_roots(spark, d):
    return scopes.call_roots(java_files(spark, d))


# --- definitions and uses --------------------------------------------------------------------------------------------

_SETS = f"regexp_matches(bare, {quoted(source_text.STATEMENT)})"
_PART = lambda i: f"regexp_extract(bare, {quoted(source_text.STATEMENT)}, {i})"


@query(f"""SELECT file, variable, count(*) FILTER (WHERE defines) AS definitions, count(*) FILTER (WHERE NOT defines) AS uses, min(line_number) FILTER (WHERE defines) AS first_definition
FROM (SELECT file, line_number, {_PART(1)} AS variable, true AS defines FROM {_BARE} WHERE {_SETS} UNION ALL SELECT file, line_number, unnest(CASE WHEN {_SETS} THEN {_NAMES(_PART(2))} ELSE {_NAMES('bare')} END), false FROM {_BARE}) GROUP BY file, variable""")
def definitions_and_uses(spark, d):
    return scopes.definitions_and_uses(java_files(spark, d))


_PRESERVED = f"""WITH st AS (SELECT file, variable, min(line_number) AS first_line, max(line_number) AS last_line FROM (SELECT file, line_number, unnest({_NAMES('bare')}) AS variable FROM {_BARE}) GROUP BY file, variable),
lost AS (SELECT file, line_number, variable FROM (SELECT file, line_number, unnest({_ALL('bare', scopes.SET, 1)}) AS variable, unnest({_ALL('bare', scopes.SET, 2)}) AS value FROM {_BARE}) WHERE NOT list_contains({_NAMES('value')}, variable))
SELECT st.file, st.variable, first_line, last_line, CASE WHEN last_line > first_line THEN NOT EXISTS (SELECT 1 FROM lost l WHERE l.file = st.file AND l.variable = st.variable AND l.line_number > first_line AND l.line_number <= last_line) END AS preserved FROM st"""


@query(_PRESERVED)
def value_preserved(spark, d):
    return scopes.preserved(java_files(spark, d))


@query(f"WITH {_WITH} {_on_corpus(_PRESERVED).replace('WITH st AS', 'SELECT * FROM (WITH st AS', 1)})")
def corpus_value_preserved(spark, d):
    """The same over the corpus, of which some variables are set anew from themselves."""
    return scopes.preserved(corpus(spark, d))


_SET = f"(SELECT file, variable, function_name, min(line_number) AS line_number FROM {_in_functions(f'(SELECT DISTINCT file, line_number, regexp_extract(line, {quoted(source_text.STATEMENT)}, 1) AS variable FROM {_LINES} WHERE regexp_matches(line, {quoted(source_text.STATEMENT)}))', 'variable')} GROUP BY file, variable, function_name)"
_TAKEN = f"(SELECT DISTINCT file, line_number, method, unnest({_NAMES('arguments')}) AS variable FROM (" + " UNION ALL ".join(f"SELECT file, line_number, unnest({_ALL('bare', p, 1)}) AS method, unnest({_ALL('bare', p, 2)}) AS arguments FROM {_BARE}" for p in (scopes.OUTER, scopes.INNER)) + f") WHERE NOT list_contains([{', '.join(map(quoted, source_text.KEYWORDS))}], method))"
_USES = f"(SELECT file, variable, line_number AS at, method, function_name FROM {_in_functions(_TAKEN, 'method, variable')})"
_OPERATIONS = "(SELECT unnest([" + ", ".join(quoted(k) for k, names in scopes.OPERATIONS for _ in names.split()) + "]) AS vuln_type, unnest([" + ", ".join(quoted(n) for _, names in scopes.OPERATIONS for n in names.split()) + "]) AS method)"
_BEST = "ORDER BY abs(u.at - s.line_number), u.at < s.line_number, u.at"
_TERMINAL = f"""SELECT file, function_name, variable, line_number, vuln_type, use_line FROM (SELECT s.file, s.function_name, s.variable, s.line_number, o.vuln_type, u.at AS use_line, row_number() OVER (PARTITION BY s.file, s.function_name, s.variable, o.vuln_type {_BEST}) AS rn
FROM {_SET} s JOIN {_USES} u ON s.file = u.file AND s.function_name = u.function_name AND s.variable = u.variable JOIN {_OPERATIONS} o ON o.method = u.method) WHERE rn = 1"""


@query(_TERMINAL)
def terminal_uses(spark, d):
    return scopes.terminal_uses(java_files(spark, d))


@query(f"WITH {_WITH} {_on_corpus(_TERMINAL)}")
def corpus_terminal_uses(spark, d):
    return scopes.terminal_uses(corpus(spark, d))


_FIRST = f"(SELECT file, variable, line_number, line FROM ({SQL['first_occurrences']}))"


@query(f"SELECT * FROM {_in_functions(_FIRST, 'variable, line')}")
def node_functions(spark, d):
    """Where each variable of a file stands first, with the function that holds the line."""
    files = java_files(spark, d)
    return source_text.in_functions(source_text.first_occurrences(files), source_text.functions(files))


@query(f"SELECT file, function_name, variable, min(line_number) AS line_number FROM {_in_functions(f'(SELECT DISTINCT file, line_number, variable FROM {_SOURCES})', 'variable')} GROUP BY ALL")
def source_dedup_functions(spark, d):
    """Of the sources of one variable in one function the first."""
    files = java_files(spark, d)
    rows = source_text.in_functions(source_text.static_sources(files).select("file", "line_number", "variable").distinct(), source_text.functions(files))
    return rows.groupBy("file", "function_name", "variable").agg(F.min("line_number").alias("line_number"))


_TIER = f"CASE WHEN u.at IS NULL THEN 4 WHEN u.at = s.line_number THEN 0 WHEN abs(u.at - s.line_number) <= {scopes.NEAR} THEN 1 WHEN u.function_name IS NOT DISTINCT FROM s.function_name THEN 2 ELSE 3 END"


_NEAREST = f"""SELECT file, function_name, variable, line_number, use_line, tier FROM (SELECT s.file, s.function_name, s.variable, s.line_number, coalesce(u.at, s.line_number) AS use_line, {_TIER} AS tier, row_number() OVER (PARTITION BY s.file, s.function_name, s.variable ORDER BY {_TIER}, abs(u.at - s.line_number), u.at < s.line_number, u.at) AS rn
FROM {_SET} s LEFT JOIN {_USES} u ON s.file = u.file AND s.variable = u.variable) WHERE rn = 1"""


@query(_NEAREST)
def nearest_uses(spark, d):
    return scopes.nearest_uses(java_files(spark, d))


@query(f"WITH {_WITH} {_on_corpus(_NEAREST)}")
def corpus_nearest_uses(spark, d):
    return scopes.nearest_uses(corpus(spark, d))


# --- calls between files ---------------------------------------------------------------------------------------------

_BRIDGE = f"({_on_corpus(SQL['call_bridges'])})"
_SRC_IN = _on_corpus(_in_functions(f"(SELECT DISTINCT file, line_number, variable FROM {_SOURCES})", "variable"))
_BRIDGE_IN = _on_corpus(_in_functions(_BRIDGE, "method, argument, owner, parameter"))


@query(f"""WITH {_WITH}, b AS MATERIALIZED (SELECT * FROM {_BRIDGE_IN}), s AS MATERIALIZED (SELECT * FROM {_SRC_IN} WHERE function_name IS NOT NULL)
SELECT file, line_number, method, argument, owner, parameter, function_name FROM b WHERE function_name IS NULL OR NOT EXISTS (SELECT 1 FROM s WHERE s.file = b.file AND s.variable = b.argument) OR EXISTS (SELECT 1 FROM s WHERE s.file = b.file AND s.variable = b.argument AND s.function_name = b.function_name)""")
def corpus_guarded_bridges(spark, d):
    """Calls from file to file without those that would borrow a source of another method."""
    files = cut(corpus(spark, d))
    own = source_text.functions(files)
    sources = source_text.in_functions(source_text.static_sources(files).select("file", "line_number", "variable").distinct(), own)
    return scopes.guarded(source_text.in_functions(source_text.call_bridges(files), own), sources)


_LEVEL = lambda name, start, a, b: f"{name}(node, hops) AS (SELECT DISTINCT file, 0 FROM {_on_corpus(start)} UNION SELECT e.{b}, {name}.hops + 1 FROM {name} JOIN e ON {name}.node = e.{a} WHERE {name}.hops < {chains.MAX_NODES})"


@query(f"""WITH RECURSIVE {_WITH}, e AS MATERIALIZED (SELECT DISTINCT file AS src, owner AS dst FROM ({_on_corpus(SQL['owned_calls'])}) WHERE file <> owner), {_LEVEL('f', _SOURCES, 'src', 'dst')}, {_LEVEL('b', _SINKS, 'dst', 'src')}
SELECT file, forth, back, (forth + back)::INT AS distance FROM (SELECT node AS file, min(hops)::INT AS forth FROM f GROUP BY node) JOIN (SELECT node AS file, min(hops)::INT AS back FROM b GROUP BY node) USING (file)""")
def corpus_call_slice(spark, d):
    """Files on a way of calls from a file with a source to a file with a sink, with their distance from both."""
    files = cut(corpus(spark, d))
    calls = source_text.owned_calls(files).where("file <> owner").select(F.col("file").alias("src"), F.col("owner").alias("dst"))
    ends = lambda df: df.select(F.col("file").alias("node")).distinct()
    rows = graph.call_slice(calls, ends(source_text.static_sources(files)), ends(source_text.static_sinks(files)), chains.MAX_NODES)
    return rows.select(F.col("node").alias("file"), "forth", "back", (F.col("forth") + F.col("back")).alias("distance"))


#: Costs of a step by its flow; a call into another file costs most.
COSTS = (("direct", 1.0), ("concatenation", 2.0), ("arithmetic", 2.0), ("method_call", 1.5), ("method_arg", 1.5), ("other", 1.0))
ACROSS = 3.0
_COST = "CASE flow_type " + " ".join(f"WHEN {quoted(k)} THEN {c}" for k, c in COSTS) + " END::DOUBLE"
_PRICED = _EDGES.replace("concat(file, ':', to_var) AS dst FROM", f"concat(file, ':', to_var) AS dst, {_COST} AS cost FROM").replace("concat(owner, ':', parameter) FROM", f"concat(owner, ':', parameter), {ACROSS}::DOUBLE FROM")


@query(f"""WITH RECURSIVE {_WITH}, e AS MATERIALIZED (SELECT src, dst, min(cost) AS cost FROM ({_PRICED}) GROUP BY src, dst),
so AS MATERIALIZED (SELECT DISTINCT concat(file, ':', variable) AS node FROM {_on_corpus(_SOURCES)}), si AS MATERIALIZED (SELECT DISTINCT concat(file, ':', variable) AS node FROM {_on_corpus(_SINKS)}),
p(start, node, cost, path) AS (SELECT node, node, 0.0::DOUBLE, [node] FROM so UNION ALL SELECT p.start, e.dst, p.cost + e.cost, list_append(p.path, e.dst) FROM p JOIN e ON p.node = e.src WHERE len(p.path) < {chains.MAX_NODES} AND NOT list_contains(p.path, e.dst))
SELECT source, sink, cost, path FROM (SELECT start AS source, node AS sink, cost, path, row_number() OVER (PARTITION BY start, node ORDER BY cost, len(path), path) AS rn FROM p WHERE len(path) > 1 AND node IN (SELECT node FROM si)) WHERE rn = 1""")
def corpus_weighted_paths(spark, d):
    """Paths of least cost from sources to sinks, of at most 15 nodes."""
    files = stored(corpus(spark, d))
    flows = source_text.assignments(files).unionByName(source_text.argument_flows(files))
    cost = F.coalesce(*[F.when(F.col("flow_type") == k, c) for k, c in COSTS])
    inside = flows.select(chains.node("file", "from_var").alias("src"), chains.node("file", "to_var").alias("dst"), cost.alias("cost"))
    across = source_text.call_bridges(files).select(chains.node("file", "argument").alias("src"), chains.node("owner", "parameter").alias("dst"), F.lit(ACROSS).alias("cost"))
    ends = lambda df: cut(df.select(chains.node("file", "variable").alias("node")).distinct())
    return graph.cheapest_paths(inside.unionByName(across), ends(source_text.static_sources(files)), ends(source_text.static_sinks(files)), chains.MAX_NODES - 1)


@query(f"""{_MADE}, {_SAN}, found AS ({_BY_FILE}), strongest AS (SELECT chain_id, max(effectiveness) AS effectiveness FROM found GROUP BY chain_id)
SELECT * FROM (SELECT unnest(['sources', 'sinks', 'sanitizers', 'edges', 'chains', 'rejected']) AS metric, unnest([(SELECT count(*) FROM {_on_corpus(_SOURCES)}), (SELECT count(*) FROM {_on_corpus(_SINKS)}), (SELECT count(*) FROM s), (SELECT count(*) FROM e), (SELECT count(*) FROM made), (SELECT count(*) FROM strongest WHERE effectiveness >= {chains.REJECTS})]) AS n)""")
def corpus_metrics(spark, d):
    """How much each step of the way from text to verified chains makes."""
    files = stored(corpus(spark, d))
    rows = regions.held(files, chains.MAX_NODES)
    if rows is not None:
        return chains.counts_in(rows)
    sanitizers = stored(source_text.static_sanitizers(files).join(source_text.lines(files), ["file", "line_number"]))
    edges, ends = stored(chains.flow_edges(files)), chains.both_ends(files)
    made = stored(chains.chains_of(edges, *ends))
    # One row has both counts of the chains, so that they are made once.
    verdict = chains.rejected(made, chains.sanitizers_on(made, sanitizers)).agg(F.count(F.lit(1)).alias("chains"), F.count_if(F.coalesce(~F.col("verified"), F.lit(False))).alias("rejected"))
    both = verdict.select(F.explode(F.create_map(F.lit("chains"), "chains", F.lit("rejected"), "rejected")).alias("metric", "n"))
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("metric"), "n")
    parts = [n(source_text.static_sources(files), "sources"), n(source_text.static_sinks(files), "sinks"), n(sanitizers, "sanitizers"), n(edges, "edges"), both]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows
