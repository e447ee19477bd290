"""Queries of the taint-chain operators over the given tables, each with the SQL that says the same."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainloom.functions import rules
from chainloom.operators import blocks, graph, matching, ordering, source_text
from chainloom.sources import files
from chainloom.sources.tables import table
from chainloom.streaming import incremental

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- source text -----------------------------------------------------------------------------------------------------

_NAME, _KEYWORDS = source_text.NAME, "[" + ", ".join(map(quoted, source_text.KEYWORDS)) + "]"
_LINES = "(SELECT doc_id AS file, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::INT AS line_number FROM documents WHERE kind = 'java' AND text IS NOT NULL)"
_NAMES = lambda x: f"list_filter(list_distinct(regexp_extract_all({x}, {quoted(source_text.WORD)})), lambda v: length(v) > 1 AND regexp_matches(v, {quoted(f'^{_NAME}$')}) AND NOT list_contains({_KEYWORDS}, v))"
_NO_TEXT = lambda x: f"""regexp_replace({x}, '"[^"]*"', '""', 'g')"""
_CALLS = "(SELECT file, line_number, " + ", ".join(f"unnest(regexp_extract_all(line, {quoted(source_text.CALL)}, {i})) AS {n}" for i, n in ((1, "receiver"), (2, "method"), (3, "arguments"))) + f" FROM {_LINES})"


def java_files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("kind = 'java'").select(F.col("doc_id").alias("file"), "text")


@query(f"SELECT file, line_number, line FROM {_LINES}")
def scan_lines(spark, d):
    return source_text.lines(java_files(spark, d))


@query(f"""SELECT doc_id AS file, array_to_string(list_transform(regexp_extract_all(text, {quoted(source_text.TOKEN)}), lambda t: CASE WHEN t LIKE '//%' OR t LIKE '/*%' THEN repeat(chr(10), (length(t) - length(replace(t, chr(10), '')))::INT) ELSE t END), '') AS code FROM documents WHERE kind = 'java' AND text IS NOT NULL""")
def strip_comments(spark, d):
    return java_files(spark, d).where("text is not null").select("file", source_text.without_comments(F.col("text")).alias("code"))


@query(f"SELECT doc_id AS file, unnest({_NAMES('text')}) AS variable FROM documents WHERE kind = 'java' AND text IS NOT NULL")
def extract_variables(spark, d):
    return source_text.variables(java_files(spark, d))


_FLOW = rf"""CASE WHEN regexp_matches(value, {quoted(f'^{_NAME}$')}) THEN 'direct' WHEN contains(value, '"') AND contains(value, '+') THEN 'concatenation' WHEN regexp_matches(value, '[-+*/%]') THEN 'arithmetic' WHEN contains(value, '(') THEN 'method_call' ELSE 'other' END"""
_ASSIGNED = f"(SELECT file, line_number, unnest({_NAMES(_NO_TEXT('value'))}) AS from_var, to_var, {_FLOW} AS flow_type FROM (SELECT file, line_number, regexp_extract(line, {quoted(source_text.STATEMENT)}, 1) AS to_var, regexp_extract(line, {quoted(source_text.STATEMENT)}, 2) AS value FROM {_LINES} WHERE regexp_matches(line, {quoted(source_text.STATEMENT)})))"
_ARGUMENTS = f"(SELECT file, line_number, unnest({_NAMES(_NO_TEXT('arguments'))}) AS from_var, receiver AS to_var, 'method_arg' AS flow_type FROM {_CALLS})"
_FLOWS = f"(SELECT * FROM {_ASSIGNED} UNION ALL SELECT * FROM {_ARGUMENTS})"


def all_flows(spark, d) -> DataFrame:
    files = java_files(spark, d)
    return source_text.assignments(files).unionByName(source_text.argument_flows(files))


@query(f"SELECT * FROM {_FLOWS} WHERE from_var <> to_var")
def data_flows(spark, d):
    return all_flows(spark, d)


@query(f"SELECT file, line_number, receiver, method, arguments FROM {_CALLS}")
def call_records(spark, d):
    return source_text.calls(java_files(spark, d))


_DEPTH = f"(SELECT *, sum(delta) OVER (PARTITION BY file ORDER BY line_number) AS depth FROM (SELECT *, length(regexp_replace(line, '[^{{]', '', 'g')) - length(regexp_replace(line, '[^}}]', '', 'g')) AS delta FROM {_LINES}))"
_FUNCTIONS = f"""(WITH depth AS MATERIALIZED (SELECT * FROM {_DEPTH}), heads AS (SELECT file, regexp_extract(line, {quoted(source_text.FUNCTION)}, 1) AS function_name, trim(regexp_extract(line, {quoted(source_text.FUNCTION)}, 2)) AS parameters, line_number AS start_line, depth - delta AS base FROM depth WHERE regexp_matches(line, {quoted(source_text.FUNCTION)}))
SELECT h.file, h.function_name, h.parameters, h.start_line, coalesce(min(e.line_number), any_value(l.last_line)) AS end_line FROM heads h JOIN (SELECT file, max(line_number) AS last_line FROM depth GROUP BY file) l ON h.file = l.file LEFT JOIN depth e ON h.file = e.file AND e.delta < 0 AND e.line_number > h.start_line AND e.depth <= h.base GROUP BY ALL)""".replace("GROUP BY ALL", "GROUP BY h.file, h.function_name, h.parameters, h.start_line")


@query(f"SELECT * FROM {_FUNCTIONS}")
def function_records(spark, d):
    return source_text.functions(java_files(spark, d))


@query(f"SELECT f.file, f.line_number, f.from_var, f.to_var, f.flow_type, max_by(s.function_name, s.start_line) AS function_name FROM {_FLOWS} f LEFT JOIN {_FUNCTIONS} s ON f.file = s.file AND f.line_number BETWEEN s.start_line AND s.end_line WHERE from_var <> to_var GROUP BY ALL")
def flows_in_functions(spark, d):
    return source_text.in_functions(all_flows(spark, d), source_text.functions(java_files(spark, d)))


@query(f"SELECT file, line_number, regexp_extract(line, {quoted(source_text.IMPORT)}, 1) AS imported FROM {_LINES} WHERE regexp_matches(line, {quoted(source_text.IMPORT)})")
def import_records(spark, d):
    return source_text.imports(java_files(spark, d))


@query(f"SELECT file, line_number, regexp_extract(line, {quoted(source_text.CLASS)}, 1) AS class_name, nullif(regexp_extract(line, {quoted(source_text.CLASS)}, 2), '') AS superclass FROM {_LINES} WHERE regexp_matches(line, {quoted(source_text.CLASS)})")
def class_records(spark, d):
    return source_text.class_records(java_files(spark, d))


_SOURCE = rf"({_NAME})\s*=\s*[^=;]*\.(?:{source_text.INPUT_CALLS})\("
_SOURCES = f"(SELECT file, line_number, regexp_extract(line, {quoted(_SOURCE)}, 1) AS variable, 'external_data' AS source_type, 0.86::DOUBLE AS confidence FROM {_LINES} WHERE regexp_matches(line, {quoted(_SOURCE)}))"
_KIND = "CASE " + " ".join(f"WHEN regexp_matches(method, {quoted(f'^(?:{p})$')}) THEN {quoted(t)}" for t, p in source_text.SINKS) + " END"
_SINKS = f"(SELECT * FROM (SELECT file, line_number, {_NAMES(_NO_TEXT('arguments'))}[1] AS variable, {_KIND} AS vuln_type, 0.9::DOUBLE AS confidence FROM {_CALLS}) WHERE variable IS NOT NULL AND vuln_type IS NOT NULL)"


@query(f"SELECT * FROM {_SOURCES}")
def static_sources(spark, d):
    return source_text.static_sources(java_files(spark, d))


@query()
def static_sinks(spark, d):
    """SQL has the variables of a list in no certain order, so the first of them has none."""
    return source_text.static_sinks(java_files(spark, d))


@query(f"SELECT vuln_type, count(*) AS n, count(DISTINCT file) AS files FROM {_SINKS} GROUP BY vuln_type")
def sink_inventory(spark, d):
    return source_text.static_sinks(java_files(spark, d)).groupBy("vuln_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file").alias("files"))


@query(" UNION ALL ".join(f"SELECT file, line_number, {quoted(t)} AS sanitizer, {quoted(v)} AS protects, {e}::DOUBLE AS effectiveness, coalesce(nullif(regexp_extract(line, {quoted(source_text.STATEMENT)}, 1), ''), nullif(regexp_extract(line, {quoted(source_text.CALL)}, 1), '')) AS variable FROM {_LINES} WHERE regexp_matches(line, {quoted(p)})" for t, v, e, p in source_text.SANITIZERS))
def static_sanitizers(spark, d):
    return source_text.static_sanitizers(java_files(spark, d))


@query(f"SELECT file, variable, min(line_number) AS line_number FROM {_SOURCES} GROUP BY file, variable")
def source_dedup(spark, d):
    """Of the sources of one variable in one file the first."""
    return source_text.static_sources(java_files(spark, d)).groupBy("file", "variable").agg(F.min("line_number").alias("line_number"))


@query(f"SELECT doc_id, coalesce(regexp_matches(text, {quoted(source_text.RELEVANT)}), false) AS relevant, row_number() OVER (PARTITION BY source ORDER BY coalesce(regexp_matches(text, {quoted(source_text.RELEVANT)}), false) DESC, doc_id)::INT AS place FROM documents")
def file_relevance(spark, d):
    relevant = F.coalesce(F.col("text").rlike(source_text.RELEVANT), F.lit(False))
    rows = table(spark, d, "documents").select("doc_id", "source", relevant.alias("relevant"), (~relevant).alias("later"))
    return ordering.running_sum(rows, "source", ["later", "doc_id"], None, "place").select("doc_id", "relevant", F.col("place").cast("int").alias("place"))


@query(f"SELECT doc_id, regexp_replace(text, {quoted(source_text.SECRET)}, '\\1\\2***', 'g') AS text FROM documents")
def secret_redaction(spark, d):
    """All texts; those without a secret as they are."""
    return table(spark, d, "documents").select("doc_id", source_text.redacted(F.col("text")).alias("text"))


@query("SELECT doc_id, sha256(concat_ws(chr(0), text, 'schema-1', coalesce(lang, ''))) AS cache_key, substr(sha256(concat_ws(chr(0), text, 'schema-1', coalesce(lang, ''))), 1, 2) AS shard FROM documents WHERE text IS NOT NULL")
def cache_keys(spark, d):
    key = F.sha2(F.concat_ws("\0", "text", F.lit("schema-1"), F.coalesce("lang", F.lit(""))), 256)
    return table(spark, d, "documents").where("text is not null").select("doc_id", key.alias("cache_key"), F.substring(key, 1, 2).alias("shard"))


_CHUNK, _OVERLAP = 2000, 8


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::INT AS line_number FROM documents WHERE text IS NOT NULL),
c AS (SELECT *, ((sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_number) - length(line) - 1) // {_CHUNK})::BIGINT AS chunk FROM l),
b AS (SELECT doc_id, chunk, min(line_number) AS first_line, max(line_number) AS last_line, sum(length(line) + 1)::BIGINT AS chars FROM c GROUP BY doc_id, chunk)
SELECT doc_id, chunk, greatest(1, first_line - CASE WHEN chunk > 0 THEN {_OVERLAP} ELSE 0 END)::INT AS from_line, last_line AS to_line, chars FROM b""")
def text_chunks(spark, d):
    """Chunks of whole lines by running length; each starts some lines before its own first, to overlap the last."""
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    size = (F.char_length("line") + 1).cast("long")
    before = F.sum(size).over(Window.partitionBy("doc_id").orderBy("at")) - size
    cut = rows.withColumn("chunk", F.floor(before / _CHUNK)).groupBy("doc_id", "chunk").agg(F.min("at").alias("a"), F.max("at").alias("b"), F.sum(size).alias("chars"))
    return cut.select("doc_id", "chunk", F.greatest(F.lit(1), F.col("a") + 1 - F.when(F.col("chunk") > 0, _OVERLAP).otherwise(0)).alias("from_line"), (F.col("b") + 1).alias("to_line"), "chars")


@query("SELECT doc_id, source, n_chars, running::BIGINT AS running FROM (SELECT doc_id, source, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS running FROM documents WHERE n_chars IS NOT NULL) WHERE running <= 50000")
def budget_cut(spark, d):
    return matching.running_cut(table(spark, d, "documents").where("n_chars is not null").select("doc_id", "source", "n_chars"), "source", ["doc_id"], "n_chars", 50_000)


@query("SELECT doc_id, (n - 1)::INT AS hop, part[n] AS src, part[n + 1] AS dst FROM (SELECT doc_id, part, unnest(range(1, len(part))) AS n FROM (SELECT doc_id, list_transform(string_split(unnest(string_split(text, chr(10))), ' -> '), lambda x: trim(x)) AS part FROM documents WHERE kind = 'label' AND text IS NOT NULL)) WHERE part[n] <> '' AND part[n + 1] <> ''")
def label_edges(spark, d):
    """Edges of dependence graphs written as lines a -> b -> c."""
    rows = table(spark, d, "documents").where("kind = 'label' and text is not null").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    part = rows.select("doc_id", F.transform(F.split("line", " -> "), lambda x: F.trim(x)).alias("part")).where(F.size("part") > 1)
    pairs = F.transform(F.sequence(F.lit(1), F.size("part") - 1), lambda i: F.struct((i - 1).alias("hop"), F.element_at("part", i).alias("src"), F.element_at("part", i + 1).alias("dst")))
    return part.select("doc_id", F.explode(pairs).alias("x")).select("doc_id", "x.*").where("src <> '' and dst <> ''")


@query("SELECT event_id, (props::JSON->>'$.k')::BIGINT AS k FROM events WHERE (props::JSON->>'$.k')::BIGINT >= 1")
def json_entries(spark, d):
    parsed = F.from_json("props", "k BIGINT")
    return table(spark, d, "events").select("event_id", parsed["k"].alias("k")).where("k >= 1")


@query(f"SELECT file, from_var, to_var, coalesce(array_to_string(list_sort(list_distinct(list(function_name) FILTER (WHERE function_name IS NOT NULL))), ','), '') AS functions, min(line_number) AS line_number, count(*) AS n FROM ({SQL['flows_in_functions']}) GROUP BY file, from_var, to_var")
def flow_graph(spark, d):
    """One edge for each pair of variables of a file; the functions in which it stands add up."""
    flows = source_text.in_functions(all_flows(spark, d), source_text.functions(java_files(spark, d)))
    return flows.groupBy("file", "from_var", "to_var").agg(F.array_join(F.sort_array(F.collect_set("function_name")), ",").alias("functions"), F.min("line_number").alias("line_number"), F.count(F.lit(1)).alias("n"))


_INDEX = f"(SELECT file, line_number, line, unnest({_NAMES('line')}) AS variable FROM {_LINES})"


@query(f"SELECT file, variable, min(line_number) AS line_number, min_by(line, line_number) AS line FROM {_INDEX} GROUP BY file, variable")
def first_occurrences(spark, d):
    return source_text.first_occurrences(java_files(spark, d))


_OWNED = f"(SELECT c.file, c.line_number, c.method, c.arguments, o.owner, o.parameters FROM {_CALLS} c JOIN (SELECT function_name, min(file) AS owner, min_by(parameters, start_line) AS parameters FROM {_FUNCTIONS} GROUP BY function_name HAVING count(DISTINCT file) = 1) o ON c.method = o.function_name)"


@query(f"SELECT file, line_number, method, arguments, owner FROM {_OWNED}")
def owned_calls(spark, d):
    return source_text.owned_calls(java_files(spark, d)).drop("parameters")


_ZIP = f"list_zip(list_transform(string_split({_NO_TEXT('arguments')}, ','), lambda p: regexp_extract(p, {quoted(f'({_NAME})')}, 1)), list_transform(string_split(parameters, ','), lambda p: regexp_extract(p, {quoted(f'({_NAME})' + chr(92) + 's*$')}, 1)))"


@query(f"SELECT file, line_number, method, x[1] AS argument, owner, x[2] AS parameter FROM (SELECT file, line_number, method, owner, unnest({_ZIP}) AS x FROM {_OWNED} WHERE file <> owner) WHERE x[1] <> '' AND x[2] <> ''")
def call_bridges(spark, d):
    return source_text.call_bridges(java_files(spark, d))


@query(f"SELECT e.file, e.from_var, e.to_var, min(a.line_number) AS line_number FROM (SELECT DISTINCT file, from_var, to_var FROM {_FLOWS} WHERE from_var <> to_var) e JOIN {_INDEX} a ON a.file = e.file AND a.variable = e.from_var JOIN {_INDEX} b ON b.file = e.file AND b.variable = e.to_var AND a.line_number = b.line_number GROUP BY e.file, e.from_var, e.to_var")
def statement_of_edge(spark, d):
    return source_text.statement_of(all_flows(spark, d), java_files(spark, d))


# The flows of the reference's five patterns: every match of a line, words as often as they stand there.
_FLOW_WORDS = lambda x: f"list_filter(regexp_extract_all({x}, {quoted(source_text.WORD)}), lambda v: length(v) > 1 AND regexp_matches(v, '^[a-zA-Z_]') AND NOT list_contains([{', '.join(map(quoted, source_text.FLOW_KEYWORDS))}], v))"
_PART = lambda t, i: f"unnest(regexp_extract_all(line, {quoted(source_text.FLOWS[t])}, {i}))"
_MATCHES = " UNION ALL ".join(f"SELECT file, line_number, {quoted(t)} AS flow_type, {_PART(t, i)} AS names, {_PART(t, j) if j else quoted('return_value')} AS to_var FROM {_LINES}" for t, i, j in (("assignment", 2, 1), ("method_chain", 1, 2), ("throw_arg", 2, 1), ("return", 1, 0), ("method_arg", 2, 1)))
_NAMED = f"(length(to_var) > 1 AND NOT list_contains([{', '.join(map(quoted, source_text.FLOW_KEYWORDS))}], to_var))"
_PATTERN_FLOWS = f"(SELECT file, line_number, from_var, to_var, flow_type FROM (SELECT file, line_number, unnest({_FLOW_WORDS('names')}) AS from_var, to_var, flow_type FROM ({_MATCHES})) WHERE CASE flow_type WHEN 'assignment' THEN from_var <> to_var WHEN 'method_arg' THEN from_var <> to_var AND {_NAMED} WHEN 'method_chain' THEN {_NAMED} ELSE true END)"
_TIMES = f"(SELECT file, line_number, from_var, to_var, flow_type, count(*) AS n FROM {_PATTERN_FLOWS} GROUP BY file, line_number, from_var, to_var, flow_type)"


@query(f"SELECT * FROM {_PATTERN_FLOWS}")
def pattern_flows(spark, d):
    return source_text.pattern_flows(java_files(spark, d))


@query(f"SELECT f.file, f.line_number, f.from_var, f.to_var, f.flow_type, f.n, max_by(s.function_name, s.start_line) AS function_name FROM {_TIMES} f LEFT JOIN {_FUNCTIONS} s ON f.file = s.file AND f.line_number BETWEEN s.start_line AND s.end_line GROUP BY ALL")
def pattern_flows_in_functions(spark, d):
    """n tells how often the flow stands on the line."""
    times = source_text.pattern_flows(java_files(spark, d)).groupBy("file", "line_number", "from_var", "to_var", "flow_type").agg(F.count(F.lit(1)).alias("n"))
    return source_text.in_functions(times, source_text.functions(java_files(spark, d)))


@query(f"SELECT file, from_var, to_var, coalesce(array_to_string(list_sort(list_distinct(list(function_name) FILTER (WHERE function_name IS NOT NULL))), ','), '') AS functions, min(line_number) AS line_number, sum(n)::BIGINT AS n FROM ({SQL['pattern_flows_in_functions']}) GROUP BY file, from_var, to_var")
def pattern_flow_graph(spark, d):
    flows = pattern_flows_in_functions(spark, d)
    return flows.groupBy("file", "from_var", "to_var").agg(F.array_join(F.sort_array(F.collect_set("function_name")), ",").alias("functions"), F.min("line_number").alias("line_number"), F.sum("n").alias("n"))


@query(f"SELECT file, from_var, to_var, min(line_number) AS line_number, count(*) AS n FROM {_PATTERN_FLOWS} GROUP BY file, from_var, to_var")
def pattern_flow_statements(spark, d):
    return source_text.flow_statements(source_text.pattern_flows(java_files(spark, d)))


# --- chains ----------------------------------------------------------------------------------------------------------

_CHAINS = "(SELECT DISTINCT ON (row_id) * FROM chains ORDER BY row_id, loaded_at)"
_UNIT = "CASE WHEN confidence IS NULL OR isnan(confidence) THEN NULL WHEN confidence > 1 THEN least(confidence / 100, 1.0) ELSE greatest(confidence, 0.0) END"


def chain_rows(spark, d, *columns: str) -> DataFrame:
    """The given columns of chains, each row_id once: the earliest loaded of its redelivered rows. Only these columns
    and loaded_at are read and shuffled; members of source and sink are given with their dots and keep them."""
    ends: dict[str, list[str]] = {}
    for c in columns:
        ends.setdefault(c.split(".")[0], []).append(c)
    parts = [F.col(c) if own == [c] and "." not in own[0] else F.struct(*[F.col(x).alias(x.split(".")[1]) for x in own]).alias(c) for c, own in ends.items()]
    return table(spark, d, "chains").groupBy("row_id").agg(F.min_by(F.struct(*parts), F.struct("loaded_at")).alias("x")).select("row_id", "x.*")


@query("SELECT row_id, concat(source.variable, '_to_', sink.variable, '_', substr(sha256(concat_ws(chr(0), source.file, source.line::VARCHAR, sink.file, sink.line::VARCHAR, array_to_string(path, chr(0)))), 1, 20)) AS stable_id FROM " + _CHAINS + " WHERE path IS NOT NULL AND source.variable IS NOT NULL AND sink.variable IS NOT NULL")
def chain_ids(spark, d):
    key = F.sha2(F.concat_ws("\0", "source.file", F.col("source.line").cast("string"), "sink.file", F.col("sink.line").cast("string"), F.array_join("path", "\0")), 256)
    rows = chain_rows(spark, d, "path", "source.variable", "source.file", "source.line", "sink.variable", "sink.file", "sink.line").where("path is not null and source.variable is not null and sink.variable is not null")
    return rows.select("row_id", F.concat("source.variable", F.lit("_to_"), "sink.variable", F.lit("_"), F.substring(key, 1, 20)).alias("stable_id"))


_PASS = "SELECT row_id, sv, sf, kv, kf, vuln_type FROM (SELECT row_id, source.variable AS sv, source.file AS sf, sink.variable AS kv, sink.file AS kf, vuln_type, row_number() OVER (PARTITION BY source.variable, source.file, {0}, sink.variable, sink.file, {1}, vuln_type ORDER BY coalesce(len(path), 0), coalesce(" + _UNIT + ", 0) DESC, row_id) AS rn FROM " + _CHAINS + ") WHERE rn = 1"


def _deduped(spark, d, part: str) -> DataFrame:
    own = chain_rows(spark, d, "path", "vuln_type", "confidence", *[f"{e}.{m}" for e in ("source", "sink") for m in ("variable", "file", part)]).select("row_id", F.col("source.variable").alias("sv"), F.col("source.file").alias("sf"), F.col(f"source.{part}").alias("sp"), F.col("sink.variable").alias("kv"), F.col("sink.file").alias("kf"), F.col(f"sink.{part}").alias("kp"), "vuln_type", F.coalesce(F.size("path"), F.lit(0)).alias("n"), F.coalesce(rules.unit_confidence(F.col("confidence")), F.lit(0.0)).alias("c"))
    own = own.withColumn("n", F.greatest("n", F.lit(0)))
    return matching.first_by(own, ["sv", "sf", "sp", "kv", "kf", "kp", "vuln_type"], F.col("n"), -F.col("c"), F.col("row_id")).select("row_id", "sv", "sf", "kv", "kf", "vuln_type")


@query(_PASS.format("source.line", "sink.line"))
def chain_dedup_lines(spark, d):
    return _deduped(spark, d, "line")


@query(_PASS.format("source.function_name", "sink.function_name"))
def chain_dedup_functions(spark, d):
    return _deduped(spark, d, "function_name")


@query("SELECT row_id, (source.file = sink.file AND source.function_name <> sink.function_name) AS crosses_functions, (coalesce(source.code_snippet, '') <> '' AND coalesce(sink.code_snippet, '') <> '' AND length(source.variable) > 1 AND length(sink.variable) > 1 AND NOT contains(source.code_snippet, source.variable) AND NOT contains(sink.code_snippet, sink.variable)) AS low_quality FROM " + _CHAINS)
def chain_filters(spark, d):
    """Chains between two functions of one file by a name that they share, and chains whose snippets lack the names."""
    side = lambda s: (F.coalesce(f"{s}.code_snippet", F.lit("")) != "") & (F.length(f"{s}.variable") > 1) & ~F.contains(F.col(f"{s}.code_snippet"), F.col(f"{s}.variable"))
    return chain_rows(spark, d, *[f"{e}.{m}" for e in ("source", "sink") for m in ("variable", "file", "function_name", "code_snippet")]).select("row_id", ((F.col("source.file") == F.col("sink.file")) & (F.col("source.function_name") != F.col("sink.function_name"))).alias("crosses_functions"), (side("source") & side("sink")).alias("low_quality"))


def _first(text: str, pairs, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, {quoted(p)}) THEN {quoted(n)}" for n, p in pairs) + f" ELSE {otherwise} END"


_KINDS = [(k, p) for k, _, _, p in rules.KINDS]
_NUMBER = lambda x: f"'CWE-' || nullif(regexp_extract(trim({x}), '^(?:[Cc][Ww][Ee][-_ ]?)?0*([0-9]+)$', 1), '')"
_KIND_OF = lambda x: f"CASE WHEN lower(trim({x})) IN ({', '.join(quoted(k) for k, _ in _KINDS)}) THEN lower(trim({x})) ELSE {_first(f'lower(trim({x}))', _KINDS, quoted('other'))} END"
_CWE_OF = lambda kind, other: "CASE " + kind + " " + " ".join(f"WHEN {quoted(k)} THEN 'CWE-{n}'" for k, n, *_ in rules.KINDS) + f" ELSE {other} END"


@query(f"SELECT row_id, {_NUMBER('cwe')} AS cwe, {_KIND_OF('vulnerability_label')} AS kind FROM {_CHAINS}")
def weakness_kinds(spark, d):
    return chain_rows(spark, d, "cwe", "vulnerability_label").select("row_id", rules.weakness_number(F.col("cwe")).alias("cwe"), rules.weakness_kind(F.col("vulnerability_label")).alias("kind"))


_BY_KIND = "CASE " + " ".join(f"WHEN vuln_type IN ({', '.join(map(quoted, kinds))}) THEN {quoted(n)}" for n, kinds in rules.SINK_OF_KIND) + " ELSE 'unknown' END"
_SRC_KIND, _SINK_KIND = _first("source.code_snippet", rules.SOURCE_KINDS, quoted("internal_api")), _first("sink.code_snippet", rules.SINK_KINDS, _BY_KIND)


@query(f"SELECT row_id, {_SRC_KIND} AS source_kind, {_SINK_KIND} AS sink_kind FROM {_CHAINS}")
def endpoint_kinds(spark, d):
    return chain_rows(spark, d, "vuln_type", "source.code_snippet", "sink.code_snippet").select("row_id", _source_kind().alias("source_kind"), _sink_kind().alias("sink_kind"))


def _source_kind():
    return rules.first_match(F.col("source.code_snippet"), rules.SOURCE_KINDS, F.lit("internal_api"))


def _sink_kind():
    by_kind = F.coalesce(*[F.when(F.col("vuln_type").isin(*kinds), n) for n, kinds in rules.SINK_OF_KIND], F.lit("unknown"))
    return rules.first_match(F.col("sink.code_snippet"), rules.SINK_KINDS, by_kind)


@query(f"SELECT row_id, source_kind, sink_kind, confidence, round(adjusted, 6) AS adjusted FROM (SELECT row_id, {_SRC_KIND} AS source_kind, {_SINK_KIND} AS sink_kind, {_UNIT} AS confidence, ({_UNIT}) * CASE WHEN {_SINK_KIND} IN ('benign', 'event_logging') THEN 0.1::DOUBLE WHEN {_SINK_KIND} IN ('data_storage', 'framework_api') AND {_SRC_KIND} IN ('session_data', 'internal_api', 'database') THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END AS adjusted FROM {_CHAINS}) WHERE adjusted >= 0.5")
def confidence_adjust(spark, d):
    own = chain_rows(spark, d, "vuln_type", "confidence", "source.code_snippet", "sink.code_snippet").select("row_id", _source_kind().alias("source_kind"), _sink_kind().alias("sink_kind"), rules.unit_confidence(F.col("confidence")).alias("confidence"))
    adjusted = rules.adjusted_confidence(F.col("confidence"), F.col("source_kind"), F.col("sink_kind"))
    return own.withColumn("adjusted", adjusted).where("adjusted >= 0.5").withColumn("adjusted", F.round("adjusted", 6))


_BASE = "CASE vuln_type " + " ".join(f"WHEN {quoted(k)} THEN {rules.LEVELS.index(s)}" for k, _, s, _ in rules.KINDS) + " ELSE 1 END"


@query(f"SELECT vuln_type, severity, count(*) AS n, min(cwe_id) AS cwe_id FROM (SELECT vuln_type, {_CWE_OF('vuln_type', quoted('CWE-UNKNOWN'))} AS cwe_id, (['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'])[1 + greatest(0, {_BASE} - CASE WHEN coalesce({_UNIT}, 0) < 0.6 THEN 1 ELSE 0 END)] AS severity FROM {_CHAINS}) GROUP BY vuln_type, severity")
def severity_rollup(spark, d):
    own = chain_rows(spark, d, "vuln_type", "confidence").select("vuln_type", rules.severity(F.col("vuln_type"), F.coalesce(rules.unit_confidence(F.col("confidence")), F.lit(0.0)), F.lit(0)).alias("severity"), rules.weakness_of(F.col("vuln_type"), F.lit("CWE-UNKNOWN")).alias("cwe_id"))
    return own.groupBy("vuln_type", "severity").agg(F.count(F.lit(1)).alias("n"), F.min("cwe_id").alias("cwe_id"))


@query(f"SELECT source, sink, source_confidence, sink_confidence, (source_confidence + sink_confidence) / 2 AS confidence FROM (SELECT concat(project, ':', source.variable) AS source, concat(project, ':', sink.variable) AS sink, max({_UNIT}) AS source_confidence, min({_UNIT}) AS sink_confidence FROM {_CHAINS} WHERE source.variable IS NOT NULL AND sink.variable IS NOT NULL AND project IS NOT NULL GROUP BY 1, 2) WHERE source_confidence IS NOT NULL ORDER BY confidence DESC, source_confidence DESC, sink_confidence DESC, source DESC, sink DESC LIMIT 100")
def candidate_topk(spark, d):
    own = chain_rows(spark, d, "project", "confidence", "source.variable", "sink.variable").where("source.variable is not null and sink.variable is not null and project is not null")
    c = rules.unit_confidence(F.col("confidence"))
    pairs = own.groupBy(F.concat_ws(":", "project", "source.variable").alias("source"), F.concat_ws(":", "project", "sink.variable").alias("sink")).agg(F.max(c).alias("source_confidence"), F.min(c).alias("sink_confidence"))
    return graph.ranked_pairs(pairs.where("source_confidence is not null"), 100)


@query(f"SELECT project, backend, section, count(*) AS n, count(DISTINCT file) AS files, round(avg({_UNIT}), 6) AS mean_confidence FROM {_CHAINS} GROUP BY ROLLUP (project, backend, section)")
def chain_rollup(spark, d):
    c = rules.unit_confidence(F.col("confidence"))
    return chain_rows(spark, d, "project", "backend", "section", "file", "confidence").rollup("project", "backend", "section").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file").alias("files"), F.round(F.avg(c), 6).alias("mean_confidence"))


_TEST = "(?i:(?:^|/)(?:" + "|".join(files.TEST_FOLDERS).replace("-", "[-_]") + ")/)|" + files.TEST_NAME
_SKIP = "(?:^|/)(?:" + "|".join(files.SKIPPED_FOLDERS).replace(".", r"\.") + ")/"


@query(f"SELECT file, count(*) AS chains FROM {_CHAINS} WHERE file IS NOT NULL AND NOT regexp_matches(file, {quoted(_TEST)}) AND NOT regexp_matches(file, {quoted(_SKIP)}) GROUP BY file")
def source_discovery(spark, d):
    return chain_rows(spark, d, "file").where(F.col("file").isNotNull() & ~F.col("file").rlike(_TEST) & ~F.col("file").rlike(_SKIP)).groupBy("file").agg(F.count(F.lit(1)).alias("chains"))


@query(f"SELECT row_id, (len(list_filter(a, lambda x: NOT list_contains(b, x))) + len(list_filter(b, lambda x: NOT list_contains(a, x))))::DOUBLE / greatest(length(sv), length(kv), 1) AS distance FROM (SELECT row_id, source.variable AS sv, sink.variable AS kv, list_distinct(string_split(source.variable, '')) AS a, list_distinct(string_split(sink.variable, '')) AS b FROM {_CHAINS} WHERE source.variable <> '' AND sink.variable <> '')")
def name_distance(spark, d):
    """Letters that only one of two names has, by the longer name: the fall-back heuristic of path search."""
    rows = chain_rows(spark, d, "source.variable", "sink.variable").select("row_id", F.col("source.variable").alias("sv"), F.col("sink.variable").alias("kv")).where("sv <> '' and kv <> ''")
    letters = lambda c: F.array_distinct(F.split(c, ""))
    apart = F.size(F.array_except(letters("sv"), letters("kv"))) + F.size(F.array_except(letters("kv"), letters("sv")))
    return rows.select("row_id", (apart / F.greatest(F.length("sv"), F.length("kv"), F.lit(1))).alias("distance"))


@query(f"SELECT row_id, round(0.4 * c + 0.5 * v + 0.1 * greatest(0.5, 1 - 0.05 * (n - 2)) * CASE WHEN same THEN 0.5 ELSE 1 END * CASE WHEN n <= 2 THEN 0.8 ELSE 1 END, 6)::DOUBLE AS overall FROM (SELECT row_id, ({_UNIT})::DOUBLE AS c, (CASE section WHEN 'tp_matched' THEN 0.95 WHEN 'fp_chains' THEN 0.1 ELSE 0.6 END)::DOUBLE AS v, len(path) AS n, source.variable = sink.variable AS same FROM {_CHAINS} WHERE len(path) > 0) WHERE c IS NOT NULL AND same IS NOT NULL")
def overall_confidence(spark, d):
    """Confidence of the finding, of its verification and of its path, which falls with length, weighted."""
    rows = chain_rows(spark, d, "section", "path", "confidence", "source.variable", "sink.variable").where(F.size("path") > 0).select("row_id", rules.unit_confidence(F.col("confidence")).alias("c"), F.when(F.col("section") == "tp_matched", 0.95).when(F.col("section") == "fp_chains", 0.1).otherwise(0.6).alias("v"), F.size("path").alias("n"), (F.col("source.variable") == F.col("sink.variable")).alias("same"))
    path = F.greatest(F.lit(0.5), 1 - 0.05 * (F.col("n") - 2)) * F.when(F.col("same"), 0.5).otherwise(1.0) * F.when(F.col("n") <= 2, 0.8).otherwise(1.0)
    return rows.where("c is not null and same is not null").select("row_id", F.round(0.4 * F.col("c") + 0.5 * F.col("v") + 0.1 * path, 6).alias("overall"))


@query(f"SELECT vuln_type, tp, fp, fn, {'round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 4)'} AS precision, {'round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 4)'} AS recall FROM (SELECT vuln_type, count(*) FILTER (WHERE detected AND vulnerable) AS tp, count(*) FILTER (WHERE detected AND NOT vulnerable) AS fp, count(*) FILTER (WHERE NOT detected AND vulnerable) AS fn FROM (SELECT project, file, vuln_type, bool_or(detected) AS detected, bool_or(vulnerable) AS vulnerable FROM (SELECT project, file, vuln_type, true AS detected, false AS vulnerable FROM chains WHERE backend = 'static' UNION ALL SELECT project, file, vuln_type, false, true FROM tp_labels) GROUP BY project, file, vuln_type) GROUP BY vuln_type)")
def confusion_by_kind(spark, d):
    """One prediction for each case (project, file, kind): whether any finding of the kind is there, against labels."""
    side = lambda df, a, b: df.select("project", "file", "vuln_type", F.lit(a).alias("detected"), F.lit(b).alias("vulnerable"))
    rows = side(table(spark, d, "chains").where("backend = 'static'"), True, False).unionByName(side(table(spark, d, "tp_labels"), False, True))
    cases = rows.groupBy("project", "file", "vuln_type").agg(F.bool_or("detected").alias("detected"), F.bool_or("vulnerable").alias("vulnerable"))
    n = lambda c: F.count(F.when(c, 1))
    counts = cases.groupBy("vuln_type").agg(n(F.col("detected") & F.col("vulnerable")).alias("tp"), n(F.col("detected") & ~F.col("vulnerable")).alias("fp"), n(~F.col("detected") & F.col("vulnerable")).alias("fn"))
    return counts.select("*", rules.ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), rules.ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))


# --- graphs ----------------------------------------------------------------------------------------------------------

# A node is a variable of a project. Sources are the sources of true positives, sinks those of the same; 3 hops.
_PATHS = "(SELECT project, path FROM chains WHERE path IS NOT NULL AND project IS NOT NULL AND backend = 'static')"
_EDGES = f"(SELECT DISTINCT src, dst FROM (SELECT concat(project, ':', path[n]) AS src, concat(project, ':', path[n + 1]) AS dst FROM (SELECT project, path, unnest(range(1, len(path))) AS n FROM {_PATHS}) WHERE path[n] IS NOT NULL AND path[n + 1] IS NOT NULL))"
_STARTS = "(SELECT DISTINCT concat(project, ':', path[1]) AS node FROM chains WHERE backend = 'static' AND section = 'tp_matched' AND project IS NOT NULL AND path[1] IS NOT NULL)"
_ENDS = "(SELECT DISTINCT concat(project, ':', path[len(path)]) AS node FROM chains WHERE backend = 'static' AND section = 'tp_matched' AND project IS NOT NULL AND path[len(path)] IS NOT NULL)"
_HOPS = f"(WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM {_EDGES}), h(start, node, hops) AS (SELECT node, node, 0 FROM {_STARTS} UNION SELECT h.start, e.dst, h.hops + 1 FROM h JOIN e ON h.node = e.src WHERE h.hops < 4) SELECT start, node, min(hops)::INT AS hops FROM h GROUP BY start, node)"


def graph_chains(spark, d, static: bool = True) -> DataFrame:
    """The chains that a graph is built from: those of the static backend or all."""
    own = table(spark, d, "chains").where("project is not null")
    return own.where("backend = 'static'") if static else own


def path_edges(spark, d, static: bool = True) -> DataFrame:
    own = graph_chains(spark, d, static).where("path is not null").where(F.size("path") > 1)
    node = lambda i: F.when(F.element_at("path", i).isNotNull(), F.concat_ws(":", "project", F.element_at("path", i)))
    return own.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(node(i).alias("src"), node(i + 1).alias("dst")))).alias("x")).select("x.*")


def endpoints(spark, d, last: bool, static: bool = True) -> DataFrame:
    own = graph_chains(spark, d, static).where("section = 'tp_matched'").where(F.size("path") > 0)
    end = F.try_element_at("path", F.lit(-1 if last else 1))
    return own.where(end.isNotNull()).select(F.concat_ws(":", "project", end).alias("node")).distinct()


def typed_nodes(edges: DataFrame, starts: DataFrame, ends: DataFrame) -> DataFrame:
    typed = lambda df, c, n: df.select(F.col(c).alias("node"), F.lit(n).alias("rank"))
    rows = typed(edges, "src", 0).unionByName(typed(edges, "dst", 0)).unionByName(typed(starts, "node", 1)).unionByName(typed(ends, "node", 2))
    return rows.where("node is not null").groupBy("node").agg(F.element_at(F.array(*map(F.lit, ("variable", "source", "sink"))), F.max("rank") + 1).alias("node_type"))


@query(f"SELECT src, dst FROM {_EDGES}")
def graph_edges(spark, d):
    return graph.simple_edges(path_edges(spark, d))


@query(f"SELECT node, CASE WHEN node IN (SELECT node FROM {_ENDS}) THEN 'sink' WHEN node IN (SELECT node FROM {_STARTS}) THEN 'source' ELSE 'variable' END AS node_type FROM (SELECT src AS node FROM {_EDGES} UNION SELECT dst FROM {_EDGES} UNION SELECT node FROM {_STARTS} UNION SELECT node FROM {_ENDS})")
def graph_nodes(spark, d):
    """Every node with its type: a name that is both source and sink is a sink."""
    return typed_nodes(path_edges(spark, d), endpoints(spark, d, False), endpoints(spark, d, True))


@query(f"SELECT start, node, hops FROM {_HOPS}")
def graph_bounded_reach(spark, d):
    return graph.hops(path_edges(spark, d), endpoints(spark, d, False), 4)


@query(f"SELECT start AS source, node AS sink, hops FROM {_HOPS} WHERE node IN (SELECT node FROM {_ENDS})")
def graph_source_sink_pairs(spark, d):
    return graph.reachable_pairs(path_edges(spark, d), endpoints(spark, d, False), endpoints(spark, d, True), 4)


_BACK = f"(WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM {_EDGES}), h(node, hops) AS (SELECT node, 0 FROM {_ENDS} UNION SELECT e.src, h.hops + 1 FROM h JOIN e ON h.node = e.dst WHERE h.hops < 4) SELECT DISTINCT node FROM h)"


@query(f"SELECT DISTINCT node FROM {_HOPS} WHERE node IN (SELECT node FROM {_BACK})")
def graph_taint_slice(spark, d):
    return graph.taint_slice(path_edges(spark, d), endpoints(spark, d, False), endpoints(spark, d, True), 4)


@query(f"SELECT src, dst FROM {_EDGES} WHERE src IN (SELECT node FROM {_HOPS}) AND dst IN (SELECT node FROM {_HOPS})")
def graph_induced(spark, d):
    edges = graph.simple_edges(path_edges(spark, d))
    return graph.known_edges(edges, graph.reachable(edges, endpoints(spark, d, False), 4))


@query(f"""WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM {_EDGES}), p(start, node, path) AS (SELECT node, node, [node] FROM {_STARTS} UNION ALL SELECT p.start, e.dst, list_append(p.path, e.dst) FROM p JOIN e ON p.node = e.src WHERE len(p.path) < 5 AND NOT list_contains(p.path, e.dst))
SELECT start AS source, node AS sink, path FROM (SELECT *, row_number() OVER (PARTITION BY start, node ORDER BY len(path), path) AS rn FROM p WHERE node IN (SELECT node FROM {_ENDS})) WHERE rn = 1""")
def graph_shortest_paths(spark, d):
    return graph.shortest_paths(path_edges(spark, d), endpoints(spark, d, False), endpoints(spark, d, True), 4)


@query()
def graph_components(spark, d):
    """Checked against a union-find in the tests; SQL would list all pairs of nodes of a component."""
    return graph.components(path_edges(spark, d))


# The queries above read the chains of one backend and walk 4 hops, as far as recursive SQL can follow. Those below read
# the chains of all backends and walk to the reference's bound, without SQL: max_path_length hops of a reach or slice,
# max_path_length nodes of a path.
MAX_PATH_LENGTH = 15
_ANY = lambda sql: sql.replace(" AND backend = 'static'", "").replace("backend = 'static' AND ", "")
_FULL_EDGES, _FULL_STARTS, _FULL_ENDS = _ANY(_EDGES), _ANY(_STARTS), _ANY(_ENDS)


def full_graph(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges, sources and sinks of the chains of all backends."""
    return path_edges(spark, d, False), endpoints(spark, d, False, False), endpoints(spark, d, True, False)


def _project(node: str) -> Column:
    """What both ends of an edge have in common: the project, which names begin with, up to the first colon."""
    return F.substring_index(node, ":", 1)


@query(f"SELECT src, dst FROM {_FULL_EDGES}")
def graph_full_edges(spark, d):
    return graph.simple_edges(path_edges(spark, d, False))


@query(f"SELECT node, CASE WHEN node IN (SELECT node FROM {_FULL_ENDS}) THEN 'sink' WHEN node IN (SELECT node FROM {_FULL_STARTS}) THEN 'source' ELSE 'variable' END AS node_type FROM (SELECT src AS node FROM {_FULL_EDGES} UNION SELECT dst FROM {_FULL_EDGES} UNION SELECT node FROM {_FULL_STARTS} UNION SELECT node FROM {_FULL_ENDS})")
def graph_full_nodes(spark, d):
    return typed_nodes(*full_graph(spark, d))


@query()
def graph_full_reach(spark, d):
    edges, starts, _ = full_graph(spark, d)
    return blocks.hops(edges, starts, MAX_PATH_LENGTH, _project)


@query()
def graph_full_pairs(spark, d):
    return graph.reachable_pairs(*full_graph(spark, d), MAX_PATH_LENGTH)


@query()
def graph_full_slice(spark, d):
    return graph.taint_slice(*full_graph(spark, d), MAX_PATH_LENGTH)


@query()
def graph_full_induced(spark, d):
    edges, starts, _ = full_graph(spark, d)
    edges = graph.simple_edges(edges)
    return graph.known_edges(edges, graph.reachable(edges, starts, MAX_PATH_LENGTH))


@query()
def graph_full_paths(spark, d):
    return blocks.shortest_paths(*full_graph(spark, d), MAX_PATH_LENGTH - 1, _project)


@query()
def graph_full_components(spark, d):
    return graph.components(path_edges(spark, d, False))


# --- matching and metrics --------------------------------------------------------------------------------------------

_LABELS = "(SELECT DISTINCT ON (label_key) * FROM tp_labels ORDER BY label_key)"


def label_rows(spark, d, *columns: str) -> DataFrame:
    """The given columns of tp_labels, each label_key once."""
    return table(spark, d, "tp_labels").groupBy("label_key").agg(F.min(F.struct(*columns)).alias("x")).select("label_key", "x.*")


@query(f"SELECT l.label_key, f.finding_key FROM {_LABELS} l JOIN (SELECT DISTINCT finding_key, project_name, sink_name, sink_at FROM scan_findings) f ON l.project = f.project_name AND l.sink_var = f.sink_name AND abs(l.sink_line - f.sink_at) <= 5")
def label_band_match(spark, d):
    """Findings at most 5 lines from a label's sink, by the names as they are written."""
    a = label_rows(spark, d, "project", "sink_var", "sink_line")
    b = table(spark, d, "scan_findings").select("finding_key", F.col("project_name").alias("project"), F.col("sink_name").alias("sink_var"), "sink_at").distinct()
    return matching.band_join(a, b, ["project", "sink_var"], "sink_line", "sink_at", 5).select("label_key", "finding_key")


@query("SELECT p.file_path, max_by(l.file, (length(l.file), l.file)) AS file FROM (SELECT DISTINCT file_path FROM scan_findings WHERE file_path IS NOT NULL) p JOIN (SELECT DISTINCT file FROM tp_labels WHERE file IS NOT NULL) l ON lower(replace(p.file_path, chr(92), '/')) = lower(l.file) OR ends_with(lower(replace(p.file_path, chr(92), '/')), '/' || lower(l.file)) GROUP BY p.file_path")
def longest_suffix_route(spark, d):
    return matching.longest_suffix(table(spark, d, "scan_findings"), "file_path", table(spark, d, "tp_labels"), "file")


_CASES = "count(*) FILTER (WHERE section = 'tp_matched') AS tp, count(*) FILTER (WHERE section = 'fp_chains') AS fp, count(*) FILTER (WHERE section = 'unclassified_chains') AS unclassified"
_DIV = lambda a, b: f"round(coalesce(({a})::DOUBLE / nullif({b}, 0), 0), 4)"


@query(f"SELECT vuln_type, tp, fp, unclassified, {_DIV('tp', 'tp + fp + unclassified')} AS precision, {_DIV('tp', 'tp + fp')} AS precision_known FROM (SELECT vuln_type, {_CASES} FROM {_CHAINS} GROUP BY vuln_type)")
def precision_by_kind(spark, d):
    n = lambda s: F.count(F.when(F.col("section") == s, 1))
    rows = chain_rows(spark, d, "vuln_type", "section").groupBy("vuln_type").agg(n("tp_matched").alias("tp"), n("fp_chains").alias("fp"), n("unclassified_chains").alias("unclassified"))
    return rows.select("*", rules.ratio(F.col("tp"), F.col("tp") + F.col("fp") + F.col("unclassified")).alias("precision"), rules.ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision_known"))


_EVALS = "(SELECT DISTINCT ON (eval_id) * FROM file_evals_a ORDER BY eval_id, updated_at DESC) WHERE NOT coalesce(is_deleted, false)"


def eval_rows(spark, d) -> DataFrame:
    """The counts of file_evals_a, each eval_id by its last version; withdrawn rows are left out."""
    rest = ["report", "project", "found_tp", "fp", "fn", "is_deleted"]
    return table(spark, d, "file_evals_a").groupBy("eval_id").agg(F.max_by(F.struct(*rest), F.struct("updated_at")).alias("x")).select("eval_id", "x.*").where(~F.coalesce("is_deleted", F.lit(False)))


_SUMS = "coalesce(sum(found_tp), 0)::BIGINT AS tp, coalesce(sum(fp), 0)::BIGINT AS fp, coalesce(sum(fn), 0)::BIGINT AS fn"


def _sums(grouped) -> DataFrame:
    s = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return grouped.agg(s("found_tp").alias("tp"), s("fp").alias("fp"), s("fn").alias("fn"))


@query(f"SELECT report, project, tp, fp, fn, {_DIV('tp', 'tp + fp')} AS precision, {_DIV('tp', 'tp + fn')} AS recall, {_DIV('2 * tp', '2 * tp + fp + fn')} AS f1 FROM (SELECT report, project, {_SUMS} FROM {_EVALS} GROUP BY ROLLUP (report, project))")
def metrics_rollup(spark, d):
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return _sums(eval_rows(spark, d).rollup("report", "project")).select("report", "project", "tp", "fp", "fn", rules.ratio(tp, tp + fp).alias("precision"), rules.ratio(tp, tp + fn).alias("recall"), rules.f1(tp, fp, fn).alias("f1"))


@query(f"WITH p AS (SELECT report, project, {_SUMS} FROM {_EVALS} GROUP BY report, project) SELECT report, round(avg(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0)), 4) AS macro_recall, round(avg(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0)), 4) AS macro_precision, round(coalesce(sum(tp)::DOUBLE / nullif(sum(tp + fn), 0), 0), 4) AS micro_recall FROM p GROUP BY report")
def macro_micro(spark, d):
    """Macro scores are means of unrounded scores of projects, micro scores come from the sums."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    rows = _sums(eval_rows(spark, d).groupBy("report", "project")).groupBy("report")
    return rows.agg(F.round(F.avg(share(tp, tp + fn)), 4).alias("macro_recall"), F.round(F.avg(share(tp, tp + fp)), 4).alias("macro_precision"), F.round(share(F.sum(tp), F.sum(tp + fn)), 4).alias("micro_recall"))


@query(f"WITH p AS (SELECT project, report, {_SUMS} FROM {_EVALS} GROUP BY project, report) SELECT coalesce(a.project, b.project) AS project, coalesce(b.tp, 0) - coalesce(a.tp, 0) AS tp_change, coalesce(b.fp, 0) - coalesce(a.fp, 0) AS fp_change, coalesce(b.fn, 0) - coalesce(a.fn, 0) AS fn_change FROM (SELECT * FROM p WHERE report = 'static-honest') a FULL JOIN (SELECT * FROM p WHERE report = 'hybrid-honest') b ON a.project = b.project")
def report_diff(spark, d):
    rows = _sums(eval_rows(spark, d).groupBy("project", "report"))
    side = lambda r, x: rows.where(F.col("report") == r).select("project", *[F.col(c).alias(f"{c}_{x}") for c in ("tp", "fp", "fn")])
    change = lambda c: (F.coalesce(f"{c}_b", F.lit(0)) - F.coalesce(f"{c}_a", F.lit(0))).alias(f"{c}_change")
    return side("static-honest", "a").join(side("hybrid-honest", "b"), "project", "full_outer").select("project", *map(change, ("tp", "fp", "fn")))


@query("SELECT DISTINCT project, file, 'label_only' AS side FROM tp_labels l WHERE NOT EXISTS (SELECT 1 FROM chains c WHERE c.project = l.project AND c.file = l.file) UNION ALL SELECT DISTINCT project, file, 'chain_only' FROM chains c WHERE NOT EXISTS (SELECT 1 FROM tp_labels l WHERE c.project = l.project AND c.file = l.file)")
def oracle_difference(spark, d):
    a, b = table(spark, d, "tp_labels").select("project", "file").distinct(), table(spark, d, "chains").select("project", "file").distinct()
    only = lambda x, y, n: x.join(y, ["project", "file"], "left_anti").withColumn("side", F.lit(n))
    return only(a, b, "label_only").unionByName(only(b, a, "chain_only"))


@query("SELECT project, label_id, count(DISTINCT label_key) AS n FROM tp_labels GROUP BY project, label_id HAVING count(DISTINCT label_key) > 1")
def duplicate_labels(spark, d):
    return table(spark, d, "tp_labels").groupBy("project", "label_id").agg(F.count_distinct("label_key").alias("n")).where("n > 1")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'final' ELSE 'open' END AS state, CASE WHEN o_orderstatus = 'F' THEN round(o_totalprice * 2, 2) ELSE o_totalprice END AS total FROM orders")
def checkpoint_overlay(spark, d):
    """A restored table overlaid with the rows that were done again."""
    orders = table(spark, d, "orders")
    base = orders.select("o_orderkey", F.lit("open").alias("state"), F.col("o_totalprice").alias("total"))
    again = orders.where("o_orderstatus = 'F'").select("o_orderkey", F.lit("final").alias("state"), F.round(F.col("o_totalprice") * 2, 2).alias("total"))
    return matching.overlay(base, again, "o_orderkey")


@query("SELECT l.l_orderkey, l.l_linenumber, (l.l_shipdate BETWEEN o.o_orderdate AND o.o_orderdate + INTERVAL 30 DAY) AS in_scope FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey")
def interval_scope(spark, d):
    joined = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select("l_orderkey", "l_linenumber", F.col("l_shipdate").between(F.col("o_orderdate"), F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("in_scope"))


@query("SELECT a.event_id AS error_id, b.event_id AS click_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type = 'click' AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 1800000000")
def event_band_match(spark, d):
    events = table(spark, d, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    a = events.where("event_type = 'error'").select(F.col("event_id").alias("error_id"), "user_id", F.col("at").alias("at_a"))
    b = events.where("event_type = 'click'").select(F.col("event_id").alias("click_id"), "user_id", F.col("at").alias("at_b"))
    return matching.band_join(a, b, ["user_id"], "at_a", "at_b", 1_800_000_000).select("error_id", "click_id")


@query("SELECT a.vec_id, round(greatest(0, least(1, 1 - list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))))), 6) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def embedding_distance(spark, d):
    """Semantic distance of each vector to the next: one less the cosine, between 0 and 1; 1 for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    own = table(spark, d, "embeddings").select("vec_id", "embedding")
    pairs = own.join(own.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    cosine = F.try_divide(dot("embedding", "other"), F.sqrt(dot("embedding", "embedding")) * F.sqrt(dot("other", "other")))
    return pairs.select("vec_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.coalesce(cosine, F.lit(0.0)))), 6).alias("distance"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def event_windows(spark, d):
    return incremental.windowed_counts(table(spark, d, "events"), "ts", "event_type", "value")


@query(SQL["event_windows"])
def event_windows_streamed(spark, d):
    """The same as event_windows, run as a stream to its end: the last update of each window."""
    stream = incremental.windowed_counts(incremental.read_stream(spark, f"{d}/events.parquet"), "ts", "event_type", "value")
    return incremental.newest(incremental.run_to_end(stream, "event_windows"), ["window_start", "event_type"])


@query()
def seeded_sample(spark, d):
    """A sample of 100 documents of each source by the hash of a seed and the id; the limit is the feature."""
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.xxhash64(F.lit(42), "doc_id"), "doc_id"))
    return table(spark, d, "documents").select("doc_id", "source", place.alias("place")).where("place <= 100")
